"""Files as rows: a folder of evidence files, their content, hash and type; the store of files by content; table backup.

Every file is a row of Spark's binaryFile source, so folders are listed and read by the cluster. The source holds a file in memory
once; files beyond spark.sql.sources.binaryFile.maxLength are an error there, not a silent cut."""

from __future__ import annotations

import posixpath
from urllib.parse import unquote, urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewright.functions import exprs as X
from casewright.operators.evidence import ACCEPTED, extension


class PathNotAllowed(ValueError):
    """The path lies outside the allowed roots."""


def local_path(c: Column) -> Column:
    """A path without the scheme of the file system, decoded."""
    return F.url_decode(F.replace(F.regexp_replace(c, r"^[a-z0-9]+:(//[^/]*)?(?=/)", ""), F.lit("+"), F.lit("%2B")))


def check_root(path: str, roots: list[str] | None) -> None:
    """PathNotAllowed where roots are given and path lies in none of them, compared component by component."""
    real = posixpath.normpath(unquote(urlparse(path).path) if "://" in path or path.startswith("file:") else path)
    if roots and not any(real == r or real.startswith(r.rstrip("/") + "/") for r in (posixpath.normpath(x.strip()) for x in roots if x.strip())):
        raise PathNotAllowed(path)


def in_roots(path: Column, roots: list[str] | None) -> Column:
    """The same as a predicate on rows."""
    if not roots:
        return F.lit(True)
    out = F.lit(False)
    for r in (posixpath.normpath(x.strip()) for x in roots if x.strip()):
        out = out | (path == r) | path.startswith(r.rstrip("/") + "/")
    return out


def read(spark: SparkSession, path: str | list[str], roots: list[str] | None = None) -> DataFrame:
    """(original_path, filename, suffix, size_bytes, sha256, content) of files or of all files under folders. The content is read
    only where it or its hash is used."""
    for p in [path] if isinstance(path, str) else path:
        check_root(p, roots)
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    real = local_path(F.col("path"))
    name = F.substring_index(real, "/", -1)
    return f.select(real.alias("original_path"), name.alias("filename"), extension(name).alias("suffix"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), "content")


def supported(files: DataFrame) -> DataFrame:
    return files.where(F.col("suffix").isin(*ACCEPTED))


@F.pandas_udf(T.StringType())
def decoded(content: pd.Series) -> pd.Series:
    """UTF-8 text; bytes that are none are left out."""
    return content.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore"))


@F.pandas_udf(T.StringType())
def decoded_with_marks(content: pd.Series) -> pd.Series:
    """UTF-8 text; bytes that are none become U+FFFD."""
    return content.map(lambda b: None if b is None else bytes(b).decode("utf-8", "replace"))


def text_of(files: DataFrame) -> DataFrame:
    """files with `text`: the stripped text of TXT files, null for other types."""
    return files.withColumn("text", F.when(F.col("suffix") == "txt", X.ustrip(decoded("content"))))


def store(files: DataFrame, folder: str) -> DataFrame:
    """Keeps each content once as <sha256>.<suffix> under folder and gives (sha256, stored_path). A file that is there stays
    untouched, so the step may run again."""

    def keep(batches):
        import os

        os.makedirs(folder, exist_ok=True)
        for d in batches:
            paths = []
            for h, s, b in zip(d["sha256"], d["suffix"], d["content"]):
                p = f"{folder}/{h}.{s}" if s else f"{folder}/{h}"
                if not os.path.exists(p):
                    part = f"{p}.{os.getpid()}.part"
                    with open(part, "wb") as out:
                        out.write(bytes(b))
                    os.replace(part, p)
                paths.append(p)
            yield pd.DataFrame({"sha256": d["sha256"], "stored_path": paths})

    return files.dropDuplicates(["sha256"]).select("sha256", "suffix", "content").mapInPandas(keep, "sha256 string, stored_path string")


def stored_state(evidence: DataFrame, files: DataFrame) -> DataFrame:
    """(id, filename, expected, actual, state) of every row of evidence against the files (original_path, sha256) that are there:
    missing, tampered or verified."""
    have = files.groupBy(F.col("original_path").alias("stored_path")).agg(F.min("sha256").alias("actual"))
    state = F.when(F.col("actual").isNull(), "missing").when(F.col("actual").eqNullSafe(F.col("sha256")), "verified").otherwise("tampered")
    return evidence.join(have, "stored_path", "left").select("id", "filename", F.col("sha256").alias("expected"), "actual", state.alias("state"))


def content(evidence: DataFrame, files: DataFrame, evidence_id: int) -> DataFrame:
    """(id, filename, mime_type, text) of a stored text: no row where the evidence or its file is gone or it is no text."""
    e = evidence.where((F.col("id") == evidence_id) & F.col("mime_type").startswith("text/")).select("id", "filename", "mime_type", F.col("stored_path").alias("original_path"))
    return files.select("original_path", "content").join(F.broadcast(e), "original_path").select("id", "filename", "mime_type", decoded_with_marks("content").alias("text"))


def backup(tables: dict[str, DataFrame], folder: str) -> DataFrame:
    """Writes a snapshot of every table under folder and gives (tbl, rows) of what was written."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in sorted(tables.items()):
        df.write.mode("errorifexists").option("compression", "zstd").parquet(f"{folder}/{name}.parquet")
    out = None
    for name in sorted(tables):
        n = spark.read.parquet(f"{folder}/{name}.parquet").agg(F.count("*").alias("rows")).select(F.lit(name).alias("tbl"), "rows")
        out = n if out is None else out.unionByName(n)
    return out
