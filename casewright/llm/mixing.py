"""Problem 9: mixing sources to target weights.

Capped water-filling: every source wants its share of the total; a source that would be taken more than max_repeats times is
clamped there and its excess goes to the others in proportion to their weights, until all fit. A source is then taken a
whole number of times, and a seeded fraction once more: documents in the order of a hash of seed and id until the tokens
of the fraction are reached.

Scale: only the totals of the listed sources reach the driver (one row for each row of the target table). The cut of the
fraction is found in two steps, by hash buckets that are summed before the shuffle, then inside the one bucket where it
falls, so a source with a third of all rows is never sorted in one task.

Edge cases: documents of sources that are not listed, or without a source, are not taken; empty documents have size 0 and go
with the whole repetitions; a listed source without documents gets nothing and its weight goes to the others; where the
caps of all sources are below the total, the total is what the caps allow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casewright.sources import materialise

BUCKETS = 4096


def water_fill(tokens: dict[str, int], shares: dict[str, float], repeats: dict[str, int], total: float) -> dict[str, float]:
    """Tokens to take of each source."""
    caps = {s: tokens.get(s, 0) * max(repeats[s], 0) for s in shares}
    total = min(total, sum(caps.values()))
    fixed: dict[str, float] = {}
    while True:
        open_ = [s for s in shares if s not in fixed]
        weight = sum(shares[s] for s in open_)
        room = total - sum(fixed.values())
        want = {s: room * shares[s] / weight if weight > 0 else 0.0 for s in open_}
        over = [s for s in open_ if want[s] > caps[s]]
        if not over:
            return {**fixed, **want}
        fixed.update({s: float(caps[s]) for s in over})


def plan(sizes: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """(source, target_share, max_repeats, available, amount, epochs): total is by default one epoch of the listed sources."""
    have = {r["source"]: int(r["tokens"]) for r in sizes.join(targets.select("source"), "source", "left_semi").groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()}
    rows = targets.where("source is not null").select("source", "target_share", "max_repeats").collect()
    amount = water_fill(have, {r["source"]: float(r["target_share"] or 0) for r in rows}, {r["source"]: int(r["max_repeats"] or 0) for r in rows}, float(sum(have.values()) if total is None else total))
    out = [(r["source"], float(r["target_share"] or 0), int(r["max_repeats"] or 0), have.get(r["source"], 0), amount[r["source"]], amount[r["source"]] / have[r["source"]] if have.get(r["source"]) else 0.0) for r in rows]
    return sizes.sparkSession.createDataFrame(out, "source string, target_share double, max_repeats int, available long, amount double, epochs double")


def mix(sizes: DataFrame, planned: DataFrame, seed: int = 11) -> DataFrame:
    """(doc_id, source, tokens, copies), copies >= 1."""
    d = sizes.join(F.broadcast(planned.select("source", "epochs", "available")), "source")
    d = d.withColumn("h", F.xxhash64(F.lit(seed), "doc_id")).withColumn("bucket", F.pmod("h", F.lit(BUCKETS)))
    d = materialise(d.withColumn("whole", F.floor("epochs").cast("int")).withColumn("part", (F.col("epochs") - F.floor("epochs")) * F.col("available")))
    per = d.groupBy("source", "bucket", "part").agg(F.sum("tokens").alias("n"))
    w = Window.partitionBy("source").orderBy("bucket")
    cut = per.withColumn("sum", F.sum("n").over(w)).withColumn("before", F.col("sum") - F.col("n")).select("source", "bucket", "before", "sum")
    j = d.join(cut, ["source", "bucket"])
    all_in = j.where(F.col("sum") <= F.col("part")).withColumn("more", F.lit(1))
    none = j.where(F.col("before") >= F.col("part")).where(F.col("sum") > F.col("part")).withColumn("more", F.lit(0))
    edge = j.where((F.col("before") < F.col("part")) & (F.col("sum") > F.col("part")))
    run = F.col("before") + F.sum("tokens").over(Window.partitionBy("source").orderBy("h", "doc_id"))
    edge = edge.withColumn("more", (run <= F.col("part")).cast("int"))
    out = all_in.unionByName(none).unionByName(edge).withColumn("copies", F.col("whole") + F.col("more"))
    return out.where("copies >= 1").select("doc_id", "source", "tokens", "copies")


def report(mixed: DataFrame, planned: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, documents, most_copies, tokens, actual_share)."""
    got = mixed.groupBy("source").agg(F.count("*").alias("documents"), F.max("copies").alias("most_copies"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"))
    j = planned.select("source", "target_share", "max_repeats").join(got, "source", "left").na.fill(0, ["documents", "most_copies", "tokens"])
    return j.withColumn("actual_share", F.round(F.col("tokens") / F.greatest(F.sum("tokens").over(Window.partitionBy(F.lit(1))), F.lit(1)), 6))
