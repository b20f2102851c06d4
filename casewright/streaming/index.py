"""Incremental intake: file streams that are indexed batch by batch. What a batch wrote it writes again if it runs again, and an id
or content that an earlier batch took is left out, so every chunk id and every content counts exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.functions.models import Models
from casewright.operators import entities, intake, keyword
from casewright.sources import scratch, table
from casewright.sources.files import read as read_files
from casewright.sources.files import supported


def _earlier(spark: SparkSession, path: str, number: int) -> DataFrame | None:
    """What batches before `number` wrote under path."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    if not any(n.startswith("batch=") and int(n[6:]) < number for n in names):
        return None
    return spark.read.parquet(path).where(F.col("batch") < number).drop("batch")


def index_stream(spark: SparkSession, source: str, schema, out: str, state: str, per_batch: int | None = None) -> None:
    """Reads what is new under `source` and keeps, under `out`: ids, entities, and the keyword index in `out`/keywords, one folder
    for each batch."""
    stream = spark.readStream.schema(schema)
    stream = (stream.option("maxFilesPerTrigger", per_batch) if per_batch else stream).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        before = _earlier(spark, f"{out}/ids", number)
        one = batch.where("id is not null").dropDuplicates(["id"])
        new = (one if before is None else one.join(before, "id", "left_anti")).persist()
        new.select("id").write.mode("overwrite").parquet(f"{out}/ids/batch={number}")
        entities.extract(new).write.mode("overwrite").parquet(f"{out}/entities/batch={number}")
        keyword.upsert(new, f"{out}/keywords", batch=number)
        new.unpersist()

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()


def intake_stream(spark: SparkSession, folder: str, out: str, state: str, case_id: int | None = None, models: Models = Models()) -> None:
    """Takes in the evidence files that are new under `folder`: each batch registers its new contents, indexes them and keeps
    evidence, chunks and entities under `out`."""
    listed = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(folder)

    def write(batch: DataFrame, number: int) -> None:
        known = _earlier(spark, f"{out}/evidence", number)
        paths = [r.path for r in batch.select("path").collect()]  # the names of one batch's files
        if not paths:
            return
        files = supported(read_files(spark, paths))
        empty = spark.createDataFrame([], "id long, sha256 string")
        made = intake.register(files, empty if known is None else known.select("id", "sha256"), case_id)
        rows = made.evidence.persist()
        texts = intake.extracted(files.join(rows.select("id", "original_path"), "original_path").select("id", "suffix", "content"), models)
        done = intake.index(texts, models)
        intake.with_status(rows, done.status).write.mode("overwrite").parquet(f"{out}/evidence/batch={number}")
        done.chunks.write.mode("overwrite").parquet(f"{out}/chunks/batch={number}")
        done.entities.write.mode("overwrite").parquet(f"{out}/entities/batch={number}")
        rows.unpersist()

    q = listed.select("path").writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()


def indexed_counts(spark: SparkSession, d: str) -> DataFrame:
    """Entities per label after the whole chunk table came in as a stream."""
    root = scratch(spark, "stream")
    index_stream(spark, f"{d}/evidencechunk.parquet*", table(spark, d, "evidencechunk").schema, f"{root}/out", f"{root}/state")
    return spark.read.parquet(f"{root}/out/entities").groupBy("label").agg(F.count("*").alias("n"))


__all__ = ["index_stream", "indexed_counts", "intake_stream"]
