"""Parquet table access, lineage cutting, size-checked broadcasts and even spreading, shared by all operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only after its rows were counted and are at most this many.
BROADCAST_ROWS = 1_000_000

_written: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of the directory; columns are pruned by Catalyst at the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir, or the checkpoint folder of the context. Where both are unset a folder of
    this machine is used in local mode; on a cluster, whose executors would not see it, that is an error."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if path is None:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="casewright-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def scratch(spark: SparkSession, name: str = "table", keep: bool = False) -> str:
    """A new path in the shared folder; what is written there goes with release or, to be kept for later queries, at the end of
    the program."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/casewright-{name}-{uuid.uuid4().hex}"
    if keep:
        atexit.register(_drop, path, spark)
    else:
        if not _written:
            atexit.register(release)
        _written[path] = spark
    return path


def _drop(path: str, spark: SparkSession) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may have ended before
        pass


def release() -> None:
    """Removes every scratch table written so far. Call it between queries of a long session, once their results were read."""
    while _written:
        _drop(*_written.popitem())


def materialise(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a compressed table in the shared checkpoint folder: a lost executor costs no
    recomputation of what lies before, an expensive subplan used several times runs once, and later
    scans still prune columns."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `most` rows, else unchanged (a shuffle join follows)."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def spread_out(df: DataFrame) -> DataFrame:
    """df on at least as many partitions as there are cores, for costly work on each row: a small file comes as one partition. An
    input of that many partitions passes untouched, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
