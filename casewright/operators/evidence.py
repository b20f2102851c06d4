"""Evidence files: intake, dedupe, status, chunks, integrity, and deletes. Null keys join nothing; ties go to the lowest id."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.functions import exprs as X

# Extensions that are accepted, and those a text can be taken from.
TEXT_TYPES, IMAGE_TYPES = ("txt", "pdf"), ("png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp")
MEDIA_TYPES = ("mp3", "wav", "m4a", "ogg", "flac", "mp4", "mkv", "avi", "mov", "webm")
OTHER_TYPES = ("gif", "docx", "xlsx", "pptx", "eml", "msg")
ACCEPTED = TEXT_TYPES + IMAGE_TYPES + MEDIA_TYPES + OTHER_TYPES


def extension(c):
    return F.lower(F.regexp_extract(c, r"\.([^./]+)$", 1))


def in_case(df: DataFrame, evidence: DataFrame, case_id: int | None) -> DataFrame:
    """Rows of evidence of a case; all rows where no case is asked."""
    if case_id is None:
        return df
    return df.join(evidence.where(F.col("case_id") == case_id).select(F.col("id").alias("evidence_id")).distinct(), "evidence_id", "left_semi")


def dedupe(evidence: DataFrame) -> DataFrame:
    """(id, sha256, first_id, duplicate): the first registered row of a content hash wins, over all cases; a row without a hash
    is its own first. Hashes that very many rows share are handled by aggregation, not by a window over the group."""
    first = evidence.where("sha256 is not null").groupBy("sha256").agg(F.min("id").alias("f"))
    d = evidence.select("id", "sha256").join(first, "sha256", "left").withColumn("first_id", F.coalesce("f", "id"))
    return d.select("id", "sha256", "first_id", (F.col("id") > F.col("first_id")).alias("duplicate"))


def folder_summary(evidence: DataFrame) -> DataFrame:
    """Counters of a folder import: scanned, accepted by extension, registered and duplicates."""
    d = evidence.join(dedupe(evidence).select("id", "duplicate"), "id").withColumn("ok", extension(F.col("filename")).isin(*ACCEPTED))
    return d.agg(F.count("*").alias("scanned"), F.count_if("ok").alias("accepted"), F.count_if(F.col("ok") & ~F.col("duplicate")).alias("registered"), F.count_if(F.col("ok") & F.col("duplicate")).alias("duplicates"))


def status_of(ext, has_chunks):
    """The status an indexed file gets, by its type and by whether text was found."""
    return (
        F.when(ext.isin(*OTHER_TYPES) | ~ext.isin(*ACCEPTED), "extraction_not_supported")
        .when(~has_chunks, "no_text_found").when(ext.isin(*MEDIA_TYPES), "transcribed").when(ext.isin(*IMAGE_TYPES), "ocr_indexed").otherwise("indexed")
    )


def index_status(evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    have = chunks.where(~X.is_blank(F.col("text"))).groupBy("evidence_id").agg(F.count("*").alias("chunks")).withColumnRenamed("evidence_id", "id")
    d = evidence.select("id", "filename").join(have, "id", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)))
    return d.select("id", "chunks", status_of(extension(F.col("filename")), F.col("chunks") > 0).alias("new_status"))


def chunk_documents(documents: DataFrame, size: int = 1200, overlap: int = 150) -> DataFrame:
    """Overlapping windows of every text with exact offsets. Null and blank texts have none; texts of any length are cut whole."""
    c = documents.select("doc_id", F.posexplode(X.chunks_of(F.col("text"), size, overlap)).alias("chunk_index", "c"))
    return c.select("doc_id", "chunk_index", "c.start_char", "c.end_char", F.concat(F.lit("chars:"), "c.start_char", F.lit("-"), "c.end_char").alias("source_location"), "c.text")


def pack_segments(chunks: DataFrame, evidence: DataFrame, target: int = 1000) -> DataFrame:
    """The segments of transcribed files, in order of chunk_index and id, as packs (see packed); blank ones are left out."""
    media = evidence.where("status = 'transcribed'").select(F.col("id").alias("evidence_id")).distinct()
    time = lambda i: F.regexp_extract("source_location", r"^time:([0-9]+:[0-9]+)-([0-9]+:[0-9]+)$", i)
    seg = chunks.join(media, "evidence_id", "left_semi").where(~X.is_blank(F.col("text")))
    return packed(seg.select("evidence_id", "chunk_index", "id", X.ustrip(F.col("text")).alias("text"), time(1).alias("start"), time(2).alias("end")), target)


def packed(segments: DataFrame, target: int = 1000) -> DataFrame:
    """(evidence_id, pack, segments, chars, text, source_location): segments (evidence_id, chunk_index, id, text, start, end) packed
    greedily in order; a pack closes when its segments hold `target` characters, and one without text is left out. Where a pack
    begins depends on all packs before it, so the segments of a file, sorted by the shuffle, stream through one task in batches; only
    the open pack is held."""

    def fold(batches):
        key, pack, held = None, 0, []

        def closed():
            text = " ".join(t for t, _, _ in held).strip()
            return (key, pack, len(held), sum(len(t) for t, _, _ in held), text, f"time:{held[0][1]}-{held[-1][2]}") if text else None

        for d in batches:
            out = []
            for e, t, a, b in zip(d["evidence_id"], d["text"], d["start"], d["end"]):
                if e != key:
                    if held and (row := closed()):
                        out.append(row)
                    key, pack, held = e, 0, []
                held.append((t, a, b))
                if sum(len(x) for x, _, _ in held) >= target:
                    if row := closed():
                        out.append(row)
                        pack += 1
                    held = []
            yield pd.DataFrame(out, columns=["evidence_id", "pack", "segments", "chars", "text", "source_location"])
        if held and (row := closed()):
            yield pd.DataFrame([row], columns=["evidence_id", "pack", "segments", "chars", "text", "source_location"])

    rows = segments.where("evidence_id is not null").repartition("evidence_id").sortWithinPartitions("evidence_id", "chunk_index", "id")
    return rows.select("evidence_id", "text", "start", "end").mapInPandas(fold, "evidence_id long, pack int, segments int, chars int, text string, source_location string")


def integrity(evidence: DataFrame) -> DataFrame:
    """(id, filename, expected, actual, state): the stored file's hash (bound here to the hash in its stored path) against
    the registered one: missing where there is none, tampered where they differ."""
    actual = F.nullif(F.regexp_extract("stored_path", r"([0-9a-f]{64})", 1), F.lit(""))
    state = F.when(actual.isNull(), "missing").when(actual != F.col("sha256"), "tampered").otherwise("verified")
    return evidence.select("id", "filename", F.col("sha256").alias("expected"), actual.alias("actual"), state.alias("state"))


def integrity_counts(state: DataFrame) -> DataFrame:
    """One row (verified, missing, tampered, ok) of rows with a state."""
    n = {x: F.count_if(F.col("state") == x).alias(x) for x in ("verified", "missing", "tampered")}
    return state.agg(*n.values()).select(*n, ((F.col("missing") == 0) & (F.col("tampered") == 0)).alias("ok"))


def as_listed(evidence: DataFrame) -> DataFrame:
    """Evidence rows as they are handed out, with the time of intake in ISO form."""
    from casewright.operators.audit import iso

    return evidence.select("id", "case_id", "original_path", "stored_path", "filename", "sha256", "size_bytes", "mime_type", iso(F.col("imported_at")).alias("imported_at"), "status")


def photos(evidence: DataFrame) -> DataFrame:
    return evidence.where(F.col("mime_type").startswith("image/"))


def status_counts(evidence: DataFrame) -> DataFrame:
    return evidence.agg(F.count("*").alias("evidence_total"), F.count_if(F.col("status") == "processing").alias("processing"), (F.count_if(F.col("status") == "processing") > 0).alias("busy"))


def page(df: DataFrame, key: str = "id", limit: int = 100, offset: int = 0, descending: bool = False) -> DataFrame:
    return df.orderBy(F.desc(key) if descending else key).offset(offset).limit(limit)


def delete_case(case_id: int, evidence: DataFrame, chunks: DataFrame, entities: DataFrame, persons: DataFrame, links: DataFrame) -> DataFrame:
    """(tbl, remaining): rows left in each table after a case is deleted with what belongs to it (outbound links go,
    inbound links of other cases stay)."""
    gone = evidence.where(F.col("case_id") == case_id).select(F.col("id").alias("evidence_id"))
    who = persons.where(F.col("case_id") == case_id).select(F.col("id").alias("person_id"))
    left = {
        "evidence": evidence.where(F.col("case_id").isNull() | (F.col("case_id") != case_id)), "evidencechunk": chunks.join(gone, "evidence_id", "left_anti"),
        "extractedentity": entities.join(gone, "evidence_id", "left_anti"), "person": persons.where(F.col("case_id").isNull() | (F.col("case_id") != case_id)), "personlink": links.join(who, "person_id", "left_anti"),
    }
    out = None
    for name, df in left.items():
        row = df.agg(F.count("*").alias("remaining")).select(F.lit(name).alias("tbl"), "remaining")
        out = row if out is None else out.unionByName(row)
    return out


def delete_person(person_id: int, links: DataFrame) -> DataFrame:
    """Links left after a person is deleted: outbound and inbound ones go."""
    return links.where((F.col("person_id") != person_id) & (F.col("related_person_id").isNull() | (F.col("related_person_id") != person_id)))
