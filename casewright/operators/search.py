"""Semantic search, contradictions, and answers by citation. Blank queries find nothing; ties go to the lower id. Vectors are
compared by their inner product; null, empty and vectors of another length or model than asked are left out."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.functions import exprs as X
from casewright.operators.evidence import in_case
from casewright.operators.keyword import HIT, best_of, with_files
from casewright.sources import materialise

# The sentences of an answer.
NO_QUESTION, NOT_FOUND, INTRO = "No question provided.", "No relevant evidence was found.", "Relevant evidence was found. Review the cited chunks below."
BLOCK = 4096


def of_model(chunks: DataFrame, model: str | None) -> DataFrame:
    """Chunks whose model is empty, or the one asked; all where none is asked."""
    return chunks if model is None else chunks.where((F.coalesce("embedding_model", F.lit("")) == "") | (F.col("embedding_model") == model))


def semantic(vectors: DataFrame, query: DataFrame, limit: int = 10) -> DataFrame:
    """(vec_id, score): the most similar vectors to the one row of `query` (v), score above 0."""
    s = vectors.crossJoin(F.broadcast(query.limit(1))).select("vec_id", "label", F.round(X.dot(F.col("embedding"), F.col("v")), 6).alias("score"))
    return s.where("score > 0").orderBy(F.desc("score"), "vec_id").limit(limit)


def semantic_hits(chunks: DataFrame, evidence: DataFrame, vector: list[float], model: str | None = None, limit: int = 10, case_id: int | None = None) -> DataFrame:
    """HIT and rank: the chunks most similar to a vector. Scores are computed on ids alone and texts fetched for the hits."""
    v = F.array(*(F.lit(float(x)) for x in vector)) if vector else F.array().cast("array<double>")
    near = in_case(of_model(chunks, model), evidence, case_id).where(F.size("embedding") == len(vector)).select("id", X.dot(F.col("embedding"), v).alias("s")).where("s > 0")
    top = materialise(best_of(near.select("id", F.round("s", 6).alias("score")), (F.desc("score"), "id"), limit))
    return _hits(top, chunks, evidence)


def _hits(top: DataFrame, chunks: DataFrame, evidence: DataFrame) -> DataFrame:
    """HIT and rank of the few ids of top."""
    rows = chunks.select("id", "evidence_id", "chunk_index", "source_location", "text").join(F.broadcast(top), "id")
    return with_files(rows, evidence).select(*HIT, "rank")


def hash_embedding(chunks: DataFrame, dims: int = 384) -> DataFrame:
    """(id, bucket, weight): token counts by hash bucket, of unit length, in sparse form."""
    t = chunks.where("text is not null").select("id", F.explode(F.split(F.lower(X.ustrip(F.col("text"))), r"\s+")).alias("t")).where("t <> ''")
    n = t.select("id", X.hash_bucket(F.col("t"), dims).alias("bucket")).groupBy("id", "bucket").agg(F.count("*").alias("n"))
    norm = n.groupBy("id").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return n.join(norm, "id").select("id", "bucket", F.round(F.col("n") / F.col("norm"), 6).alias("weight"))


def semantic_text(chunks: DataFrame, evidence: DataFrame, query: str | None, limit: int = 10, case_id: int | None = None, dims: int = 384) -> DataFrame:
    """HIT and rank: the chunks whose hashed tokens are most like those of the query. The query's weights are a literal of
    `dims` numbers, and a chunk is scored in its own row, so nothing is shuffled but the best ids."""
    spark = chunks.sparkSession
    asked = spark.range(1).select(X.hash_buckets(F.lit(query or ""), dims).alias("b")).first()["b"]
    v = np.bincount(np.array(asked, int), minlength=dims).astype(float)
    v /= np.linalg.norm(v) or 1.0
    weights = F.array(*(F.lit(float(x)) for x in v))
    near = in_case(chunks, evidence, case_id).where(~X.is_blank(F.col("text")) if asked else F.lit(False)).select("id", X.hash_buckets(F.col("text"), dims).alias("b"))
    score = F.aggregate("b", F.lit(0.0), lambda s, x: s + F.get(weights, x)) / X.bucket_norm(F.col("b"))
    scored = near.where("size(b) > 0").select("id", F.round(score, 6).alias("score")).where("score > 0")
    return _hits(materialise(best_of(scored, (F.desc("score"), "id"), limit)), chunks, evidence)


def contradictions(vectors: DataFrame, threshold: float = 0.72, first: int | None = 500, most: int = 8) -> DataFrame:
    """(a, b, similarity, verdict): the most similar pairs of different groups. `first` is the guard of the reference's
    quadratic scan: only the vectors of least id; None compares all vectors."""
    f = vectors.select(F.col("vec_id").alias("id"), F.col("label").alias("grp"), F.col("embedding").alias("v"))
    f = f if first is None else f.orderBy("id").limit(first)
    return similar_pairs(f, threshold, most).select("a", "b", F.round("s", 4).alias("similarity"), F.lit("unverified").alias("verdict"))


def similar_pairs(vectors: DataFrame, threshold: float, most: int) -> DataFrame:
    """(a, b, s): of all pairs of vectors (id, grp, v) of one length and different grp with an inner product of at least threshold,
    the `most` greatest, ties by a, b. Exact: blocks of about BLOCK rows meet block by block as matrix products, and each
    meeting gives up its best `most` pairs only, so no task holds more than two blocks and no list of pairs grows."""
    v = materialise(vectors.where("id is not null and size(v) > 0").select("id", "grp", F.size("v").alias("dim"), F.col("v").cast("array<double>").alias("v")))
    sizes = v.groupBy("dim").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    b = v.join(F.broadcast(sizes), "dim").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    left = b.select("dim", "block", F.explode(F.expr("sequence(block, blocks - 1)")).alias("other"), "id", "grp", "v")
    right = b.select(F.col("dim").alias("d"), F.explode(F.expr("sequence(0, block)")).alias("o"), F.col("block").alias("k"), F.col("id").alias("rid"), F.col("grp").alias("rgrp"), F.col("v").alias("rv"))

    def meet(key, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"a": [], "b": [], "s": []}).astype({"a": "int64", "b": "int64", "s": "float64"})
        if x.empty or y.empty:
            return out
        p, q = np.stack(x.v.to_numpy()), np.stack(y.rv.to_numpy())
        xi, yi, xg, yg = x.id.to_numpy(), y.rid.to_numpy(), x.grp.to_numpy(), y.rgrp.to_numpy()
        parts = [out]
        for at in range(0, len(p), 512):
            s = p[at : at + 512] @ q.T
            i, j = np.nonzero(s >= threshold - 1e-9)
            ok = xg[at + i] != yg[j]
            if key[1] == key[2]:
                ok &= xi[at + i] < yi[j]
            i, j = i[ok], j[ok]
            d = pd.DataFrame({"a": np.minimum(xi[at + i], yi[j]), "b": np.maximum(xi[at + i], yi[j]), "s": s[i, j]})
            parts.append(d.sort_values(["s", "a", "b"], ascending=[False, True, True]).head(4 * most))
        return pd.concat(parts).sort_values(["s", "a", "b"], ascending=[False, True, True]).head(4 * most)

    met = left.groupBy("dim", "block", "other").cogroup(right.groupBy("d", "o", "k")).applyInPandas(meet, "a long, b long, s double")
    # The product of a pair is computed anew in the order of its components, so that ties are the same in every blocking.
    side = lambda n, c: v.select(F.col("id").alias(n), F.col("v").alias(c))
    best = materialise(met.orderBy(F.desc("s"), "a", "b").limit(4 * most))
    exact = side("b", "vb").join(F.broadcast(side("a", "va").join(F.broadcast(best.select("a", "b")), "a")), "b").select("a", "b", X.dot(F.col("va"), F.col("vb")).alias("s"))
    return exact.where(F.col("s") >= threshold).orderBy(F.desc("s"), "a", "b").limit(most)


Judge = Callable[[pd.Series, pd.Series], pd.Series]


def find_contradictions(chunks: DataFrame, evidence: DataFrame, threshold: float = 0.72, most: int = 8, case_id: int | None = None, model: str | None = None, first: int | None = 500, judge: Judge | None = None) -> DataFrame:
    """Pairs of similar chunks of different files: verdict, similarity, explanation, the two files and the first 300 characters
    of their texts, and evidence_id and text again for navigation. `judge` takes two series of texts and gives raw replies
    (see verdict); pairs it finds consistent are left out, and without it, or where a reply is not understood, a
    pair is unverified. As in the reference the guard `first` comes before the scope; None compares all chunks."""
    c = chunks.select("id", "evidence_id", "embedding", "embedding_model")
    c = c if first is None else c.orderBy("id").limit(first)
    c = in_case(of_model(c, model), evidence, case_id)
    pairs = materialise(similar_pairs(c.select("id", F.col("evidence_id").alias("grp"), F.col("embedding").alias("v")), threshold, most))
    text = lambda n: chunks.select(F.col("id").alias(n), F.col("evidence_id").alias(f"evidence_{n}"), F.col("text").alias(f"whole_{n}")).join(F.broadcast(pairs.select(n).distinct()), n, "left_semi")
    d = pairs.join(text("a"), "a").join(text("b"), "b")
    for n in "ab":
        d = with_files(d.withColumnRenamed(f"evidence_{n}", "evidence_id"), evidence).withColumnsRenamed({"filename": f"filename_{n}", "evidence_id": f"evidence_{n}"})
    if judge is None:
        d = d.withColumns({"verdict": F.lit("unverified"), "explanation": F.lit("")})
    else:
        reply = F.pandas_udf(judge, "string")
        d = d.withColumn("reply", reply("whole_a", "whole_b")).withColumns({"v": verdict(F.col("reply")), "explanation": explanation(F.col("reply"))})
        d = d.where("v is null or v <> 'consistent'").withColumn("verdict", F.coalesce("v", F.lit("unverified"))).withColumn("explanation", F.when(F.col("v") == "contradiction", F.col("explanation")).otherwise(""))
    cut = lambda n: F.substring(F.coalesce(f"whole_{n}", F.lit("")), 1, 300)
    return d.select(
        "a", "b", "verdict", F.round("s", 4).alias("similarity"), "explanation", "filename_a", "filename_b", "evidence_a", "evidence_b", cut("a").alias("text_a"), cut("b").alias("text_b"),
        F.col("evidence_a").alias("evidence_id"), cut("a").alias("text"),
    )


def answer(question: str | None, hits: DataFrame, synthesise: Callable[[str, list[dict]], str | None] | None = None) -> DataFrame:
    """One row (mode, answer): the hits (HIT, rank; at most the limit of their search) as numbered citations. `synthesise` may
    write the answer from the question and the citations; a reply without words counts as none."""
    spark = hits.sparkSession
    if not (question or "").strip():
        return spark.createDataFrame([("none", NO_QUESTION)], "mode string, answer string")
    line = lambda x: F.concat(F.lit("["), x["rank"].cast("string"), F.lit("] "), F.coalesce(x["filename"], F.lit("None")), F.lit(" (Evidence ID: "), F.coalesce(x["evidence_id"].cast("string"), F.lit("None")), F.lit(", Chunk: "), F.coalesce(x["chunk_index"].cast("string"), F.lit("None")), F.lit(", Location: "), F.coalesce(x["source_location"], F.lit("None")), F.lit(")\n"), F.coalesce(x["text"], F.lit("")), F.lit("\n"))
    all_ = F.array_sort(F.collect_list(F.struct("rank", "filename", "evidence_id", "chunk_index", "source_location", "text")))
    body = hits.agg(F.count("*").alias("k"), F.array_join(F.transform(all_, line), "\n").alias("body"))
    plain = body.select("k", F.when(F.col("k") == 0, "none").otherwise("citations_only").alias("mode"), F.when(F.col("k") == 0, NOT_FOUND).otherwise(X.ustrip(F.concat(F.lit(INTRO + "\n\n"), "body"))).alias("answer"))
    if synthesise is not None:
        cited = [r.asDict() for r in hits.orderBy("rank").collect()]  # at most the limit of the search
        raw = synthesise(question.strip(), cited) if cited else None
        if raw is not None:
            if raw.strip() == "NOT_FOUND":
                return spark.createDataFrame([("llm", NOT_FOUND)], "mode string, answer string")
            made = spark.createDataFrame([(raw,)], "raw string").select(clean_answer(F.col("raw"), len(cited)).alias("answer")).where(has_prose(F.col("answer")))
            if made.count():
                return made.select(F.lit("llm").alias("mode"), "answer")
    return plain.select("mode", "answer")


def clean_answer(c: Column, k: int = 5) -> Column:
    """Citation markers in one form: [_1] as [1], groups divided, those beyond k left out; Latin letters glued to a Hebrew
    first word go."""
    c = F.regexp_replace(c, r"\[_+(\d+)\]", "[$1]")
    c = F.regexp_replace(c, r"^[_a-zA-Z]{1,8}(?=[\u0590-\u05ff])", "")
    pieces = F.split(c, r"(?=\[\d+(?:\s*,\s*\d+)*\])|(?<=\])")
    numbers = lambda p: F.filter(F.transform(F.split(F.regexp_replace(p, r"[\[\]\s]", ""), ","), lambda n: F.regexp_replace(n, r"^$", "0")), lambda n: n.cast("decimal(38,0)").between(1, k))
    fixed = F.transform(pieces, lambda p: F.when(p.rlike(r"^\[\d+(?:\s*,\s*\d+)*\]$"), F.array_join(F.transform(numbers(p), lambda n: F.concat(F.lit("["), n, F.lit("]"))), "")).otherwise(p))
    return X.ustrip(F.array_join(fixed, ""))


def has_prose(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"\[\d+\]", "").rlike(r"\p{L}")


def _first_line(c: Column) -> Column:
    return X.ustrip(F.regexp_extract(X.ustrip(c), r"^[^\r\n\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]*", 0))


def verdict(c: Column) -> Column:
    line = F.upper(_first_line(c))
    return F.when(line.startswith("CONTRADICTION"), "contradiction").when(line.startswith("CONSISTENT"), "consistent")


def explanation(c: Column) -> Column:
    """What follows the first bar of the first line of a contradiction; empty otherwise."""
    line = _first_line(c)
    return F.when((verdict(c) == "contradiction") & line.contains("|"), X.ustrip(F.regexp_replace(line, r"^[^|]*\|", ""))).otherwise("")


def excerpts(hits: DataFrame) -> DataFrame:
    """(rank, excerpt): what a model is shown of each citation."""
    return hits.select("rank", F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] (file: "), F.coalesce("filename", F.lit("None")), F.lit(", location: "), F.coalesce("source_location", F.lit("None")), F.lit(")\n"), F.coalesce("text", F.lit(""))).alias("excerpt"))
