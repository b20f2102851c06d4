"""Keyword search over a kept index. The index is a folder of three tables, each in one folder for every batch:

postings (token, id, evidence_id, n, positions), range-sorted by token, so that a query reads only the row groups of its tokens;
docs (id, n), n null for a deleted text; stats (docs, tokens), what the batch added to the totals, so that a query adds up
one row for each batch instead of scanning.

An upsert writes a new batch; of a text in several batches the newest counts. Null texts are not indexed; texts without a
token are texts of length 0. Scores: the phrase's BM25 over the whole index, as the reference's full-text table ranks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casewright.functions import exprs as X
from casewright.operators.evidence import in_case
from casewright.sources import materialise, small_side

K1, B = 1.2, 0.75
HIT = ("id", "evidence_id", "filename", "chunk_index", "source_location", "score", "text")


def _read(spark: SparkSession, index: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{index}/{name}")


def _batches(spark: SparkSession, index: str) -> list[int]:
    """The numbers of the batches of an index, none where it does not exist yet."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(f"{index}/stats")
    fs = p.getFileSystem(conf)
    return sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(p) if "=" in s.getPath().getName()) if fs.exists(p) else []


def upsert(chunks: DataFrame, index: str, deleted: DataFrame | None = None, batch: int | None = None) -> int:
    """Indexes chunks (id, evidence_id, text), replacing texts of the same id, and takes out the ids of `deleted` (id). A batch
    that runs again replaces itself. Of an id that comes twice in a batch the longer, then greater text counts."""
    spark = chunks.sparkSession
    known = _batches(spark, index)
    number = batch if batch is not None else (known[-1] + 1 if known else 0)
    known = [b for b in known if b < number]
    one = chunks.where("id is not null and text is not null").groupBy("id").agg(F.max(F.struct(F.length("text").alias("l"), "text", "evidence_id")).alias("m")).select("id", "m.text", "m.evidence_id")
    tokens = materialise(one.select("id", "evidence_id", X.tokens(F.col("text")).alias("t")).withColumn("n", F.size("t")))
    rows = tokens.select("id", "evidence_id", "n", F.posexplode("t").alias("pos", "token")).groupBy("token", "id", "evidence_id", "n").agg(F.sort_array(F.collect_list("pos")).alias("positions"))
    rows.repartitionByRange("token", "id").sortWithinPartitions("token", "id").write.mode("overwrite").option("parquet.block.size", 4 << 20).parquet(f"{index}/postings/batch={number}")
    docs = tokens.select("id", "n")
    if deleted is not None:
        docs = docs.unionByName(deleted.select("id").distinct().join(docs.select("id"), "id", "left_anti").select("id", F.lit(None).cast("int").alias("n")))
    docs = materialise(docs)
    total = docs.agg(F.count("n").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"))
    if known:
        before = latest(spark, index, known).join(docs.select("id"), "id", "left_semi").agg(F.count("n").alias("d"), F.coalesce(F.sum("n"), F.lit(0)).alias("t"))
        total = total.crossJoin(before).select((F.col("docs") - F.col("d")).alias("docs"), (F.col("tokens") - F.col("t")).alias("tokens"))
    docs.write.mode("overwrite").parquet(f"{index}/docs/batch={number}")
    total.write.mode("overwrite").parquet(f"{index}/stats/batch={number}")
    return number


def latest(spark: SparkSession, index: str, batches: list[int] | None = None) -> DataFrame:
    """(id, n, batch) of the newest version of every text; n is null where it was deleted."""
    d = _read(spark, index, "docs")
    d = d if batches is None else d.where(F.col("batch").isin(batches))
    return d.groupBy("id").agg(F.max(F.struct("batch", "n")).alias("m")).select("id", "m.n", "m.batch")


def query_tokens(spark: SparkSession, query: str | None) -> list[str]:
    return list(spark.range(1).select(X.tokens(F.lit(query or "")).alias("q")).first()["q"])


def matches(spark: SparkSession, index: str, query: str | None) -> DataFrame:
    """(id, evidence_id, n, tf) of the texts that hold the tokens of the query next to one another, in order."""
    q = query_tokens(spark, query)
    p = _read(spark, index, "postings").where(F.col("token").isin(q) if q else F.lit(False))
    several = len(_batches(spark, index)) > 1
    version = F.col("batch") if several else F.lit(0).alias("batch")
    at = [F.max(F.when(F.col("token") == t, F.col("positions"))).alias(f"p{i}") for i, t in enumerate(dict.fromkeys(q))]
    which = {t: f"p{i}" for i, t in enumerate(dict.fromkeys(q))}
    hits = p.select("token", "id", "evidence_id", "n", "positions", version).groupBy("id", "evidence_id", "n", "batch").agg(*(at or [F.max("positions").alias("p0")]))
    starts = None
    for k, t in enumerate(q):
        here = _moved(which[t], k)
        starts = here if starts is None else F.array_intersect(starts, here)
    hits = hits.select("id", "evidence_id", "n", "batch", (F.size(starts) if q else F.lit(0)).alias("tf")).where("tf > 0")
    if several:
        hits = materialise(hits)
        newest = latest(spark, index).join(small_side(hits.select("id").distinct()), "id", "left_semi").select("id", "batch")
        hits = hits.join(newest, ["id", "batch"], "left_semi")
    return hits.drop("batch")


def _moved(positions: str, by: int):
    return F.transform(positions, lambda x: x - by)


def ranked(spark: SparkSession, index: str, query: str | None, limit: int = 10, evidence: DataFrame | None = None, case_id: int | None = None) -> DataFrame:
    """(id, bm25), best first, ties by id; df, the number and the mean length of texts are those of the whole index."""
    hits = materialise(matches(spark, index, query))
    total = _read(spark, index, "stats").agg(F.sum("docs").alias("docs"), F.try_divide(F.sum("tokens"), F.sum("docs")).alias("mean")).first()
    df, docs = hits.count(), total["docs"] or 0
    raw = F.log(F.lit((docs - df + 0.5) / (df + 0.5)))
    idf = F.when(raw <= 0, 1e-6).otherwise(raw)
    s = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n") / F.lit(float(total["mean"] or 1.0))))
    scoped = in_case(hits, evidence, case_id) if evidence is not None else hits
    return scoped.select("id", F.round(s, 6).alias("bm25")).orderBy(F.desc("bm25"), "id").limit(limit)


def with_files(hits: DataFrame, evidence: DataFrame) -> DataFrame:
    """hits with filename, null where the file is gone; hits are few, so they go to the table."""
    files = evidence.select(F.col("id").alias("evidence_id"), "filename").join(F.broadcast(hits.select("evidence_id").distinct()), "evidence_id", "left_semi")
    return hits.join(files.groupBy("evidence_id").agg(F.min("filename").alias("filename")), "evidence_id", "left")


def search(index: str, chunks: DataFrame, evidence: DataFrame, query: str | None, limit: int = 10, case_id: int | None = None) -> DataFrame:
    """The hits of a phrase with file, place and text: HIT, and bm25. Blank queries find nothing."""
    r = materialise(ranked(chunks.sparkSession, index, query, limit, evidence, case_id))
    hits = chunks.select("id", "evidence_id", "chunk_index", "source_location", "text").join(F.broadcast(r), "id")
    return with_files(hits.withColumn("score", F.lit(1.0)), evidence).select(*HIT, "bm25")


def contains(chunks: DataFrame, evidence: DataFrame, query: str | None, limit: int = 10, case_id: int | None = None) -> DataFrame:
    """The hits of a pattern inside a text: % is any run, _ any character, ASCII letters match in either case. Texts whose
    file is gone are left out; the least ids come first."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    q = (query or "").strip().translate(str.maketrans(upper, lower)).replace("\\", "\\\\")
    e = evidence.where(F.lit(True) if case_id is None else F.col("case_id") == case_id).groupBy(F.col("id").alias("evidence_id")).agg(F.min("filename").alias("filename"))
    hit = chunks.where(F.translate("text", upper, lower).like(f"%{q}%") if q else F.lit(False))
    return hit.join(e, "evidence_id").withColumn("score", F.lit(1.0)).select(*HIT).orderBy("id").limit(limit)


def statistics(spark: SparkSession, index: str) -> DataFrame:
    """(token, df, occurrences) of the newest versions."""
    p = _read(spark, index, "postings").join(latest(spark, index).select("id", "batch"), ["id", "batch"], "left_semi")
    return p.groupBy("token").agg(F.count("*").alias("df"), F.sum(F.size("positions")).alias("occurrences"))


def best_of(hits: DataFrame, order, limit: int) -> DataFrame:
    """hits with `rank` from 1 in the given order, at most `limit`."""
    return hits.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
