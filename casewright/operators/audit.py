"""The hash-chained audit log, one chain per case in order of id. Rows delivered twice count once; rows without a hash are
legacy and skipped; a case without hashed rows has an intact chain."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_case(events: DataFrame) -> DataFrame:
    return events.dropDuplicates(["id"]).withColumn("case_id", F.get_json_object("details_json", "$.case_id").cast("long"))


def verify(events: DataFrame) -> DataFrame:
    """(case_id, ok, broken_at_id, checked, legacy_unhashed): the first row whose prev_hash is not the hash before it, or whose
    event_hash is not the hash of its own content; the counts are of the rows before it, all where the chain is whole.
    Hashes are of UTC times: the session time zone is UTC, as for build."""
    e = with_case(events).withColumn("hashed", F.coalesce(F.col("event_hash"), F.lit("")) != "")
    w = Window.partitionBy("case_id", "hashed").orderBy("id")
    e = e.withColumn("before", F.coalesce(F.lag("event_hash").over(w), F.lit("")))
    prev = F.coalesce("prev_hash", F.lit(""))
    broken = F.col("hashed") & ((prev != F.col("before")) | (hash_of(prev) != F.col("event_hash")))
    e = e.select("case_id", "id", "hashed", broken.alias("broken"))
    # One row for each run of rows up to a break would need a second pass; the first break is a minimum over the window of the case.
    at = e.groupBy("case_id").agg(F.min(F.when(F.col("broken"), F.col("id"))).alias("broken_at_id"))
    seen = e.join(at.withColumnRenamed("case_id", "c"), F.col("case_id").eqNullSafe(F.col("c"))).where("broken_at_id is null or id < broken_at_id")
    n = seen.groupBy("case_id").agg(F.count_if("hashed").alias("checked"), F.count_if(~F.col("hashed")).alias("legacy_unhashed"))
    n = n.withColumnRenamed("case_id", "c")
    return at.join(n, F.col("case_id").eqNullSafe(F.col("c")), "left").select(
        "case_id", F.col("broken_at_id").isNull().alias("ok"), "broken_at_id", F.coalesce("checked", F.lit(0)).alias("checked"), F.coalesce("legacy_unhashed", F.lit(0)).alias("legacy_unhashed")
    )


def iso(ts: Column) -> Column:
    """ISO form without the microseconds where they are 0."""
    full = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.regexp_replace(full, r"\.000000$", "")


def payload() -> Column:
    """What is hashed of a row, after the hash before it."""
    return F.concat_ws("|", "event_type", F.coalesce(F.col("evidence_id").cast("string"), F.lit("None")), iso(F.col("created_at")), "details_json")


def hash_of(prev: Column) -> Column:
    return F.sha2(F.concat_ws("|", prev, payload()), 256)


def payloads(events: DataFrame) -> DataFrame:
    e = with_case(events)
    return e.select("case_id", "id", payload().alias("payload"))


def chained(rows: DataFrame, last: dict | None = None) -> DataFrame:
    """(case_id, id, prev_hash, event_hash) of rows (case_id, id, payload) chained on from the last hash of their case. A chain is
    sequential: its rows, sorted by the shuffle, stream through one task in batches; nothing of it is held but the last hash."""
    start = dict(last or {})

    def fold(batches):
        case, now = object(), ""
        for d in batches:
            prev, out = [], []
            for c, p in zip(d["case_id"], d["payload"]):
                c = None if pd.isna(c) else int(c)
                if c != case:
                    case, now = c, start.get(c, "")
                prev.append(now)
                now = hashlib.sha256(f"{now}|{p}".encode()).hexdigest()
                out.append(now)
            yield pd.DataFrame({"case_id": d["case_id"], "id": d["id"], "prev_hash": prev, "event_hash": out})

    return rows.repartition("case_id").sortWithinPartitions("case_id", "id").mapInPandas(fold, "case_id long, id long, prev_hash string, event_hash string")


def build(events: DataFrame) -> DataFrame:
    """(case_id, id, event_hash) of a chain built anew."""
    return chained(payloads(events)).select("case_id", "id", "event_hash")


def append(events: DataFrame, new: DataFrame) -> DataFrame:
    """events with the rows of new (id, event_type, evidence_id, created_at, details_json) hashed onto the end of the chain of
    their case. Only the last hash of each case that new rows belong to reaches the driver."""
    n = with_case(new)
    hashed = with_case(events).where("event_hash <> ''").join(n.select("case_id").distinct(), "case_id", "left_semi")
    last = {r["case_id"]: r["h"] for r in hashed.groupBy("case_id").agg(F.max_by("event_hash", "id").alias("h")).collect()}
    made = chained(n.select("case_id", "id", payload().alias("payload")), last).select("id", "prev_hash", "event_hash")
    return events.unionByName(new.drop("prev_hash", "event_hash").dropDuplicates(["id"]).join(made, "id").select(*events.columns))
