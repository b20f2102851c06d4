"""Dates in chunks, in order. A date that no format fits has a null normal form and comes last; chunks without text have none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.functions import exprs as X
from casewright.operators.evidence import in_case


def timeline(chunks: DataFrame, evidence: DataFrame, case_id: int | None = None, radius: int = 150) -> DataFrame:
    c = in_case(chunks, evidence, case_id).where("text is not null")
    m = c.select("id", "evidence_id", "chunk_index", "source_location", "text", F.regexp_extract_all("text", F.lit(X.DATE), F.lit(0)).alias("found"), F.split("text", X.DATE, -1).alias("between"))
    place = F.transform(F.when(F.size("found") > 0, F.sequence(F.lit(0), F.size("found") - 1)), lambda i: F.aggregate(F.slice("between", 1, i + 1), F.lit(0), lambda s, x: s + F.length(x)) + F.aggregate(F.slice("found", 1, i), F.lit(0), lambda s, x: s + F.length(x)))
    e = m.where("size(found) > 0").select("id", "evidence_id", "chunk_index", "source_location", "text", F.explode(F.arrays_zip(F.col("found").alias("date"), place.alias("at"))).alias("z"))
    e = e.select("id", "evidence_id", "chunk_index", "source_location", "text", F.col("z").getField("date").alias("date"), F.col("z").getField("at").alias("position"))
    lo = F.greatest(F.col("position") - radius, F.lit(0))
    hi = F.least(F.col("position") + F.length("date") + radius, F.length("text"))
    snippet = F.concat(F.when(lo > 0, "...").otherwise(""), F.substring("text", lo + 1, hi - lo), F.when(hi < F.length("text"), "...").otherwise(""))
    return e.select(F.col("id").alias("chunk_id"), "evidence_id", "chunk_index", "source_location", "position", "date", X.normalised_date(F.col("date")).alias("normalized_date"), snippet.alias("snippet"))


def ordered(events: DataFrame) -> DataFrame:
    return events.orderBy(F.col("normalized_date").isNull(), F.coalesce("normalized_date", "date"), "evidence_id", "chunk_index", "chunk_id", "position")
