"""Sizes of texts in tokens of a public tokenizer, read from a vocabulary file whose path is a parameter."""

from __future__ import annotations

import base64

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.sources import spread_out

# Fixed value: the public pre-tokenisation pattern of byte-level BPE.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_loaded: dict = {}


def encoding(path: str):
    import tiktoken

    if path not in _loaded:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def token_sizes(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, source, tokens); null texts have 0 tokens."""

    def run(batches):
        enc = encoding(path)
        for d in batches:
            yield pd.DataFrame({"doc_id": d["doc_id"], "source": d["source"], "tokens": [len(enc.encode_ordinary(t)) if t else 0 for t in d["text"]]})

    return spread_out(documents.where("doc_id is not null").select("doc_id", "source", "text")).mapInPandas(run, "doc_id long, source string, tokens long")


def ranked(df: DataFrame, *order) -> DataFrame:
    """df with `rank` from 0 in the given order: range-sorted partitions, each shifted by the rows before it. Only one
    number per partition reaches the driver."""
    from casewright.sources import materialise

    at = F.monotonically_increasing_id()
    rows = materialise(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at))
    rows = rows.withColumn("_p", F.shiftright("_at", 33)).withColumn("_i", F.col("_at").bitwiseAND((1 << 33) - 1))
    counts = rows.groupBy("_p").agg(F.count("*").alias("n")).orderBy("_p").collect()
    before, offsets = 0, []
    for r in counts:
        offsets.append((r["_p"], before))
        before += r["n"]
    shift = df.sparkSession.createDataFrame(offsets or [(0, 0)], "_p long, _before long")
    return rows.join(F.broadcast(shift), "_p").withColumn("rank", F.col("_i") + F.col("_before")).drop("_p", "_i", "_at", "_before")
