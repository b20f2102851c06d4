"""Problem 8: filling fixed-capacity containers with items.

Bulk-synchronous best fit. Items are range-sorted by size once, the gaps of the open containers in every round. A round
takes the largest items left, one for every two gaps, and sends each to its successor, the smallest gap it fits.
Conflicts are resolved by rank: of items with the same successor the smaller goes first and pushes the others to the next
gaps, so item i (from the smallest) gets gap i + max over k <= i of (successor(k) - k). Sizes are whole numbers up to the
capacity, so successors and their running maximum are a sweep over a histogram of at most `capacity` rows. Items pushed
beyond the last gap open new containers, as many to one as surely fit. Gaps are updated, and the next round follows.

Only items larger than the capacity are divided: into full containers and a remainder that is an item.

Scale: every round is a range sort of the open gaps and a join by rank; histograms (at most capacity rows) and one number
per partition reach the driver. The rounds are written to one table. The number of rounds is about the number of items in the fullest container, not the number
of documents. A size that a third of all items share is split by rank.

Edge cases: items of size 0 go to the first container; null texts count as size 0; repeated texts are items of their own; an
empty table gives no rows; the capacity must be positive.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.llm.sizes import ranked
from casewright.sources import materialise, scratch


def pack(items: DataFrame, capacity: int, slower: int = 2) -> DataFrame:
    """items: (doc_id, tokens). Result: (container, doc_id, part, tokens). A round takes one item for every `slower` gaps, so
    that items find a gap near their size; a larger value fills better in more rounds."""
    if capacity <= 0:
        raise ValueError("capacity must be positive")
    spark = items.sparkSession
    whole = materialise(items.select("doc_id", F.greatest(F.coalesce("tokens", F.lit(0)), F.lit(0)).cast("long").alias("tokens")))
    full = ranked(whole.where(F.col("tokens") > capacity).select("doc_id", F.explode(F.expr(f"sequence(0, cast(tokens div {capacity} as int) - 1)")).alias("part")), "doc_id", "part")
    n_full = full.count()
    schema = "container long, doc_id long, part int, tokens long"
    place = scratch(spark, "packed")

    def keep(d: DataFrame, number: int) -> DataFrame:
        """Writes the rows of a round and reads them from there."""
        path = f"{place}/round={number}"
        d.selectExpr("cast(container as long) container", "doc_id", "cast(part as int) part", "cast(tokens as long) tokens").write.option("compression", "zstd").parquet(path)
        return spark.read.schema(schema).parquet(path)

    keep(full.select(F.col("rank").alias("container"), "doc_id", "part", F.lit(capacity).alias("tokens")), 0)
    rest = whole.select("doc_id", F.expr(f"if(tokens > {capacity}, cast(tokens div {capacity} as int), 0)").alias("part"), F.expr(f"if(tokens > {capacity}, tokens % {capacity}, tokens)").alias("tokens"), (F.col("tokens") > capacity).alias("cut")).where("not (cut and tokens = 0)").drop("cut")
    keep(rest.where("tokens = 0").select(F.lit(0).alias("container"), "doc_id", "part", "tokens"), 1)
    turn = 1
    work = materialise(ranked(rest.where("tokens > 0"), F.desc("tokens"), "doc_id", "part"))
    hist = {int(r["tokens"]): int(r["n"]) for r in work.groupBy("tokens").agg(F.count("*").alias("n")).collect()}
    left = np.repeat(np.array(sorted(hist, reverse=True), np.int64), 1)
    counts = np.array([hist[int(s)] for s in left], np.int64)
    ends = np.cumsum(counts)  # items ranked before the end of each size, largest first
    total, n_items = int((left * counts).sum()), int(counts.sum())
    taken, next_bin = 0, n_full
    gaps, n_gaps, gap_hist = None, 0, {}

    def in_slice(lo: int, hi: int) -> list[tuple[int, int]]:
        """(size, number) of the items of ranks lo..hi-1, smallest first."""
        before = np.concatenate([[0], ends[:-1]])
        n = np.minimum(ends, hi) - np.maximum(before, lo)
        return [(int(s), int(k)) for s, k in zip(left[::-1], n[::-1]) if k > 0]

    while taken < n_items:
        want = -(-n_gaps // slower) or max(1, -(-total // capacity))
        n = min(want, n_items - taken)
        part = in_slice(taken, taken + n)
        # Sweep over the histograms: successor of each size and the running maximum of successor - rank.
        smaller, at, run, shift, start = 0, 0, None, [], 0
        values = sorted(gap_hist)
        for size, k in part:
            while at < len(values) and values[at] < size:
                smaller += gap_hist[values[at]]
                at += 1
            run = smaller - start if run is None else max(run, smaller - start)
            shift.append((size, run))
            start += k  # the items of smaller sizes
        shifts = spark.createDataFrame(shift, "tokens long, push long")
        items_now = work.where((F.col("rank") >= taken) & (F.col("rank") < taken + n)).join(F.broadcast(shifts), "tokens").withColumn("i", F.lit(taken + n - 1) - F.col("rank")).withColumn("to", F.col("i") + F.col("push"))
        # Those beyond the last gap are the largest: they open containers, `per` in each.
        first_out = n
        seen = 0
        for (size, k), (_, push) in zip(part, shift):
            if seen + k - 1 + push >= n_gaps:
                first_out = max(seen, n_gaps - push)
                break
            seen += k
        out = n - first_out
        per = max(1, capacity // part[-1][0]) if out else 1
        opened = -(-out // per)
        placed = []
        if gaps is not None and first_out > 0:
            placed.append(items_now.where(F.col("i") < first_out).join(gaps.select(F.col("rank").alias("to"), "container"), "to").select("container", "doc_id", "part", "tokens"))
        if out:
            placed.append(items_now.where(F.col("i") >= first_out).select((F.lit(next_bin) + F.floor((F.col("i") - first_out) / per)).cast("long").alias("container"), "doc_id", "part", "tokens"))
        now = placed[0] if len(placed) == 1 else placed[0].unionByName(placed[1])
        turn += 1
        now = keep(now, turn)
        used = now.groupBy("container").agg(F.sum("tokens").alias("used"))
        old = gaps.select("container", "gap") if gaps is not None else spark.createDataFrame([], "container long, gap long")
        fresh = spark.range(next_bin, next_bin + opened).select(F.col("id").alias("container"), F.lit(capacity).cast("long").alias("gap"))
        next_bin += opened
        taken += n
        total -= sum(s * k for s, k in part)
        if taken >= n_items:
            break
        least = int(left[-1])
        new = old.unionByName(fresh).join(used, "container", "left").select("container", (F.col("gap") - F.coalesce("used", F.lit(0))).alias("gap")).where(F.col("gap") >= least)
        gaps = materialise(ranked(new, "gap", "container"))
        gap_hist = {int(r["gap"]): int(r["n"]) for r in gaps.groupBy("gap").agg(F.count("*").alias("n")).collect()}
        n_gaps = sum(gap_hist.values())
    return spark.read.schema(schema).parquet(place).select("container", "doc_id", "part", "tokens")


def report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, tokens, and the share of all containers that is filled."""
    per = packed.groupBy("container").agg(F.sum("tokens").alias("used"), F.count("*").alias("items"))
    return per.agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("most"), F.round(F.sum("used") / (F.count("*") * F.lit(capacity)), 6).alias("fill"))
