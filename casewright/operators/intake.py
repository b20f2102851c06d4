"""Intake: files to evidence rows, texts to chunks with vectors and entities, and the changes to what was taken in. Tables come
in and tables go out. Null contents have no hash and are never duplicates; ties of equal contents go to the first path."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.functions import exprs as X
from casewright.functions.models import Models, kept_entities
from casewright.operators import entities as E
from casewright.operators.evidence import IMAGE_TYPES, MEDIA_TYPES, TEXT_TYPES, packed
from casewright.sources import materialise
from casewright.sources.files import text_of

DIMS = 384


@dataclass
class Registered:
    """evidence: the new rows, status processing; duplicates: (original_path, sha256, existing_id)."""

    evidence: DataFrame
    duplicates: DataFrame


def register(files: DataFrame, known: DataFrame, case_id: int | None = None) -> Registered:
    """Files (original_path, filename, suffix, size_bytes, sha256) that are new by content, with ids that go on from `known`. The
    first path of a content wins; a content that is known already, in whatever case, is a duplicate of the row that
    has it. New ids are dense: rows are ranked by path over range partitions."""
    first = files.groupBy("sha256").agg(F.min(F.struct("original_path", "filename", "suffix", "size_bytes")).alias("f"))
    have = known.where("sha256 is not null").groupBy("sha256").agg(F.min("id").alias("existing_id"))
    new = first.where("sha256 is not null").join(have, "sha256", "left_anti").select("f.*", "sha256")
    top = known.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]
    new = materialise(dense(new, "original_path").withColumn("id", (F.col("rank") + top + 1).cast("long")).drop("rank"))
    rows = new.select(
        "id", F.lit(case_id).cast("long").alias("case_id"), "original_path", F.concat_ws(".", "sha256", F.when(F.col("suffix") != "", F.col("suffix"))).alias("stored_path"), "filename", "sha256", "size_bytes",
        X.mime_type(F.col("filename")).alias("mime_type"), F.current_timestamp().alias("imported_at"), F.lit("processing").alias("status"),
    )
    owner = have.unionByName(new.select("sha256", F.col("id").alias("existing_id")))
    again = files.select("original_path", "sha256").join(owner, "sha256").join(new.select("original_path"), "original_path", "left_anti")
    return Registered(rows, again)


def dense(df: DataFrame, *order: str) -> DataFrame:
    """df with `rank` from 0 in the given order: partitions sorted by range, each shifted by the rows before it. One number for
    each partition reaches the driver."""
    rows = materialise(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    rows = rows.withColumn("_p", F.shiftright("_at", 33)).withColumn("_i", F.col("_at").bitwiseAND((1 << 33) - 1))
    before, shift = 0, []
    for r in rows.groupBy("_p").agg(F.count("*").alias("n")).orderBy("_p").collect():
        shift.append((r["_p"], before))
        before += r["n"]
    s = df.sparkSession.createDataFrame(shift or [(0, 0)], "_p long, _b long")
    return rows.join(F.broadcast(s), "_p").withColumn("rank", F.col("_i") + F.col("_b")).drop("_p", "_i", "_at", "_b")


def summary(files: DataFrame, made: Registered) -> DataFrame:
    """One row (scanned, registered, duplicates)."""
    count = lambda d, n: d.agg(F.count("*").alias(n))
    return count(files, "scanned").crossJoin(count(made.evidence, "registered")).crossJoin(count(made.duplicates, "duplicates"))


SEGMENTS = "array<struct<start:double,end:double,text:string>>"


def extracted(files: DataFrame, models: Models = Models()) -> DataFrame:
    """files (id, suffix, content) with text, segments and method: text, ocr, transcription, unsupported, and failed or
    unavailable where a reader failed or is not there. A PDF whose text layer is empty counts as scanned."""
    f = text_of(files)
    hook = lambda h, kind: F.pandas_udf(h, kind)("content")
    none = F.lit(None).cast("string")
    image = hook(models.ocr, "string") if models.ocr else none
    pdf = hook(models.pdf, "string") if models.pdf else none
    media = hook(models.transcribe, SEGMENTS) if models.transcribe else F.lit(None).cast(SEGMENTS)
    s = F.col("suffix")
    f = f.withColumn("layer", F.when(s == "pdf", X.ustrip(X.logical_order(pdf)))).withColumn("seen", F.when(s.isin(*IMAGE_TYPES) | ((s == "pdf") & (F.col("layer") == "")), X.ustrip(image)))
    f = f.withColumn("segments", F.when(s.isin(*MEDIA_TYPES), media))
    text = F.coalesce(F.nullif(F.col("layer"), F.lit("")), F.col("seen"), F.col("text"))
    method = (
        F.when(s == "txt", "text").when((s == "pdf") & (F.col("layer") != ""), "text").when(s.isin(*IMAGE_TYPES, "pdf"), F.when(F.col("seen").isNull(), "failed").otherwise("ocr"))
        .when(s.isin(*MEDIA_TYPES), F.when(F.col("segments").isNull(), "unavailable").otherwise("transcription")).otherwise("unsupported")
    )
    return f.withColumns({"method": method, "text": text}).select("id", "method", "text", "segments")


def status_of(method: Column, chunks: Column) -> Column:
    """The status a file gets when it was read."""
    return (
        F.when(method == "failed", "text_extraction_failed").when(method == "unavailable", "transcription_unavailable")
        .when(chunks > 0, F.when(method == "ocr", "ocr_indexed").when(method == "transcription", "transcribed").otherwise("indexed"))
        .when(method == "unsupported", "extraction_not_supported").otherwise("no_text_found")
    )


@dataclass
class Indexed:
    """chunks (evidence_id, chunk_index, text, source_location, embedding, embedding_model, embedding_dimension), entities
    (evidence_id, chunk_index, text, label), status (id, chunks, status)."""

    chunks: DataFrame
    entities: DataFrame
    status: DataFrame


def index(texts: DataFrame, models: Models = Models(), size: int = 1200, overlap: int = 150, target: int = 1000) -> Indexed:
    """texts: (id, method, text, segments). Texts are cut into overlapping windows, transcripts into packs of segments; every chunk
    gets its vector and its entities."""
    plain = texts.where("segments is null and text is not null").select(F.col("id").alias("evidence_id"), F.posexplode(X.chunks_of(F.col("text"), size, overlap)).alias("chunk_index", "c"))
    cut = plain.select("evidence_id", "chunk_index", "c.text", F.concat(F.lit("chars:"), "c.start_char", F.lit("-"), "c.end_char").alias("source_location"))
    seg = texts.where("segments is not null").select(F.col("id").alias("evidence_id"), F.posexplode("segments").alias("chunk_index", "s")).select("evidence_id", "chunk_index", F.col("chunk_index").cast("long").alias("id"), X.ustrip(F.coalesce("s.text", F.lit(""))).alias("text"), X.minutes_seconds(F.col("s.start")).alias("start"), X.minutes_seconds(F.col("s.end")).alias("end"))
    said = packed(seg, target).select("evidence_id", F.col("pack").alias("chunk_index"), "text", "source_location")
    chunks = materialise(cut.unionByName(said))
    if models.embed:
        vector, name = F.pandas_udf(models.embed, "array<double>")("text"), models.embed_name
    else:
        vector, name = X.hash_vector(F.col("buckets"), DIMS), f"fallback-hash-{DIMS}d"
    full = chunks.withColumn("buckets", X.hash_buckets(F.col("text"), DIMS)) if not models.embed else chunks
    full = full.withColumn("embedding", vector).drop("buckets").withColumns({"embedding_model": F.lit(name), "embedding_dimension": X.dimension(F.col("embedding"))})
    n = chunks.groupBy(F.col("evidence_id").alias("id")).agg(F.count("*").alias("chunks"))
    state = texts.select("id", "method").join(n, "id", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)))
    return Indexed(full, entities_of(chunks, models), state.select("id", "chunks", status_of(F.col("method"), F.col("chunks")).alias("status")))


def entities_of(chunks: DataFrame, models: Models = Models()) -> DataFrame:
    """(evidence_id, chunk_index, text, label) of chunks: the families of rules; with a model, its entities take the place of the
    Latin and Hebrew families."""
    keyed = chunks.select(F.struct("evidence_id", "chunk_index").alias("id"), "text")
    found = E.extract(keyed, with_model=models.ner is not None)
    if models.ner:
        ner = models.ner

        def read(text: pd.Series) -> pd.Series:
            return ner(text).map(lambda found: [{"text": t, "label": x} for t, x in kept_entities(found)])

        more = keyed.where("text is not null").select("id", F.explode(F.pandas_udf(read, "array<struct<text:string,label:string>>")("text")).alias("e")).select("id", "e.label", "e.text")
        found = found.unionByName(more)
    return found.select("id.evidence_id", "id.chunk_index", "text", "label")


def replaced(table: DataFrame, fresh: DataFrame, ids: DataFrame, key: str = "evidence_id") -> DataFrame:
    """table with the rows of ids (id) taken out and the fresh ones put in: a file indexed again replaces itself. Fresh rows
    get ids that go on from the table's where they have none."""
    kept = table.join(ids.select(F.col("id").alias(key)).distinct(), key, "left_anti")
    if "id" in table.columns and "id" not in fresh.columns:
        top = table.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]
        order = [c for c in ("evidence_id", "chunk_index", "label", "text") if c in fresh.columns]
        fresh = dense(fresh, *order).withColumn("id", (F.col("rank") + top + 1).cast("long")).drop("rank")
    return kept.unionByName(fresh, allowMissingColumns=True).select(*table.columns)


def with_status(evidence: DataFrame, status: DataFrame) -> DataFrame:
    new = status.select("id", F.col("status").alias("_s"))
    return evidence.join(new, "id", "left").withColumn("status", F.coalesce("_s", "status")).drop("_s").select(*evidence.columns)


def pending(evidence: DataFrame) -> DataFrame:
    """The rows whose indexing never ended: what resume takes up again."""
    return evidence.where("status = 'processing'")


def reset(evidence: DataFrame, evidence_id: int) -> DataFrame:
    """evidence with one row set to be indexed again."""
    return evidence.withColumn("status", F.when(F.col("id") == evidence_id, "processing").otherwise(F.col("status")))


def delete(evidence: DataFrame, chunks: DataFrame, entities: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(evidence, chunks, entities) without the files of ids (id) and what was made of them. Links that name them stay."""
    gone = ids.select("id").distinct()
    of = gone.select(F.col("id").alias("evidence_id"))
    return evidence.join(gone, "id", "left_anti"), chunks.join(of, "evidence_id", "left_anti"), entities.join(of, "evidence_id", "left_anti")


# Columns that later versions added, with what old rows hold there.
ADDED = {
    "evidence": {"case_id": ("long", None)}, "evidencechunk": {"embedding_model": ("string", ""), "embedding_dimension": ("int", 0), "embedding_version": ("string", "1")},
    "auditevent": {"prev_hash": ("string", ""), "event_hash": ("string", "")},
}


def migrated(table: DataFrame, name: str) -> DataFrame:
    """table with the columns that later versions added and it lacks."""
    lacking = {c: F.lit(v).cast(t) for c, (t, v) in ADDED.get(name, {}).items() if c not in table.columns}
    return table.withColumns(lacking) if lacking else table


def create_case(cases: DataFrame, name: str) -> DataFrame:
    """cases with one more; ValueError where the name is blank or longer than 200 characters."""
    if not 1 <= len(name.strip()) <= 200:
        raise ValueError("a case needs a name of 1 to 200 characters")
    top = cases.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]
    row = cases.sparkSession.range(1).select(F.lit(top + 1).cast("long").alias("id"), F.lit(name.strip()).alias("name"), F.current_timestamp().alias("created_at"))
    return cases.unionByName(row.select(*cases.columns))


def newest_chunks(chunks: DataFrame) -> DataFrame:
    """Of chunks kept twice (one file and number, new id) the one of the greatest id."""
    w = Window.partitionBy("evidence_id", "chunk_index").orderBy(F.desc("id"))
    return chunks.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


__all__ = ["TEXT_TYPES", "Indexed", "Registered", "create_case", "delete", "dense", "entities_of", "extracted", "index", "migrated", "newest_chunks", "pending", "register", "replaced", "reset", "status_of", "summary", "with_status"]
