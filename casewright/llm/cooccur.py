"""Problem 7: items that appear together.

Exact pair counts per case, held against a bipartite configuration null (an item with weight x and
a basket with weight y meet with probability x*y/(1+x*y), weights fitted so that item frequencies
and basket sizes are kept in expectation). The tail of the Poisson-binomial law of a pair's count
is its surprise; pairs above `level`, if one is asked for, are left out. With ranks, Benjamini-Hochberg over all pairs of a case's items gives the
false discovery rate: every pair that is together at least once has its p-value and its rank, whatever is asked for;
pairs never together have p = 1 and rank last, and pairs above `discovery`, if asked for, are left out. The null keeps the
sizes of the baskets: where a few large baskets hold all pairs of a case, pairs far above lift 4 are expected by it.

Scale: the self join runs inside baskets, on long item ids, after two prunings that lose no pair
of the asked kind; counts are combined before the shuffle. A basket or an item that holds a third
of all rows is split by AQE's skew join, and an item in more than n/min_lift baskets is out before
the join because no pair with it can reach the lift. With ranks nothing is pruned before the join, since they
need all pairs; only ids and counts of the pairs are kept. The null is fitted on degree classes: a case
has at most O(sqrt(incidences)) different degrees, so the fit never sees the rows. Pairs of equal degrees and count share
their law; the classes of a large case are split over tasks, each with the weights of the case.

Edge cases: null text or label, evidence without a row or case: no item. Items of equal text and
different label differ. Rows delivered twice count once. Blank text counts as stored. Empty
tables give no rows. Columns beside the named ones are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casewright.sources import materialise, small_side

PAIR_COLUMNS = ["case_id", "text_a", "label_a", "text_b", "label_b"]


def incidences(entities: DataFrame, evidence: DataFrame) -> DataFrame:
    """Distinct (case_id, evidence_id, text, label)."""
    ev = evidence.where("id is not null and case_id is not null").select(F.col("id").alias("evidence_id"), "case_id").distinct()
    items = entities.where("text is not null and label is not null and evidence_id is not null").select("evidence_id", "text", "label").distinct()
    return items.join(ev, "evidence_id")


def fit_null(item_degrees: np.ndarray, item_counts: np.ndarray, basket_degrees: np.ndarray, basket_counts: np.ndarray, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights x (per item degree) and y (per basket size) of the bipartite configuration model, by
    fixed-point iteration on degree classes."""
    total = max(float((item_degrees * item_counts).sum()), 1.0)
    x, y = item_degrees / np.sqrt(total), basket_degrees / np.sqrt(total)
    for _ in range(steps):
        x_new = item_degrees / (basket_counts * y / (1 + np.outer(x, y))).sum(1)
        y_new = basket_degrees / (item_counts[:, None] * x_new[:, None] / (1 + np.outer(x_new, y))).sum(0)
        moved = max(np.abs(x_new / x - 1).max(), np.abs(y_new / y - 1).max())
        x, y = x_new, y_new
        if moved < 1e-9:
            break
    return x, y


def tail(probabilities: np.ndarray, counts: np.ndarray, k: int) -> float:
    """P(N >= k) of a sum of independent trials, counts[i] of them with probabilities[i]. Small tails are summed from above,
    so they are exact far under the resolution of 1 - P(N < k)."""
    if k <= 0:
        return 1.0
    width = int(k + 64 + 8 * np.sqrt(k))
    law = np.zeros(1)
    law[0] = 1.0
    for p, n in zip(probabilities, counts):
        j = np.arange(min(int(n), width - 1) + 1)
        logs = np.concatenate([[0.0], np.cumsum(np.log((n - j[1:] + 1) / j[1:]))]) if len(j) > 1 else np.zeros(1)
        p = min(max(float(p), 1e-300), 1 - 1e-15)
        pmf = np.exp(logs + j * np.log(p) + (n - j) * np.log1p(-p))
        law = np.convolve(law, pmf)[:width]
    below = float(law[:k].sum())
    return 1.0 - below if below < 0.5 else float(law[k:].sum())


CLASSES_A_TASK = 20_000


def weights_of(degrees: DataFrame) -> DataFrame:
    """(case_id, items, x, sizes, counts, y, n_items): the fitted weights of each case, one row for a case."""

    def run(d: pd.DataFrame) -> pd.DataFrame:
        items, baskets = d[d.side == "item"].sort_values("degree"), d[d.side == "basket"].sort_values("degree")
        x, y = fit_null(items.degree.to_numpy(float), items.n.to_numpy(float), baskets.degree.to_numpy(float), baskets.n.to_numpy(float))
        return pd.DataFrame({"case_id": [d.case_id.iloc[0]], "items": [items.degree.to_numpy()], "x": [x], "counts": [baskets.n.to_numpy()], "y": [y], "n_items": [int(items.n.sum())]})

    # The rows are few and the fits long: a stated number of partitions keeps them from being put together into one task.
    apart = degrees.repartition(int(degrees.sparkSession.conf.get("spark.sql.shuffle.partitions")), "case_id")
    return apart.groupBy("case_id").applyInPandas(run, "case_id long, items array<long>, x array<double>, counts array<long>, y array<double>, n_items long")


def law_of(classes: DataFrame, weights: DataFrame) -> DataFrame:
    """classes (case_id, low, high, n_ab, n) with expected and p_value."""
    parts = classes.groupBy("case_id").agg(F.ceil(F.count("*") / CLASSES_A_TASK).cast("int").alias("parts"))
    parts = materialise(parts)  # one row for a case
    left = classes.join(F.broadcast(parts), "case_id").withColumn("part", F.pmod(F.xxhash64("low", "high", "n_ab"), "parts").cast("int"))
    shares = parts.select(F.col("case_id").alias("of_case"), F.explode(F.expr("sequence(0, parts - 1)")).alias("share"))
    right = weights.withColumnRenamed("case_id", "of_case").join(F.broadcast(shares), "of_case")

    def run(c: pd.DataFrame, w: pd.DataFrame) -> pd.DataFrame:
        if c.empty or w.empty:
            return pd.DataFrame(columns=["case_id", "low", "high", "n_ab", "n", "expected", "p_value"])
        w = w.iloc[0]
        at, m, y = dict(zip(w["items"], w["x"])), np.asarray(w["counts"], float), np.asarray(w["y"])
        expected, p_value = [], []
        for low, high, k in zip(c.low, c.high, c.n_ab):
            px, py = at[low] * y, at[high] * y
            p = px / (1 + px) * py / (1 + py)
            expected.append(float((m * p).sum()))
            p_value.append(tail(p, m, int(k)))
        return c[["case_id", "low", "high", "n_ab", "n"]].assign(expected=expected, p_value=p_value)

    return left.groupBy("case_id", "part").cogroup(right.groupBy("of_case", "share")).applyInPandas(run, "case_id long, low long, high long, n_ab long, n long, expected double, p_value double")


def with_rates(law: DataFrame, weights: DataFrame) -> DataFrame:
    """law with q_value: windows over the classes of a case, of which there are few beside its pairs."""
    up = Window.partitionBy("case_id").orderBy("p_value", "low", "high", "n_ab").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("case_id").orderBy(F.desc("p_value"), F.desc("low"), F.desc("high"), F.desc("n_ab")).rowsBetween(Window.unboundedPreceding, 0)
    d = law.join(F.broadcast(weights.select("case_id", "n_items")), "case_id")
    raw = F.col("p_value") * (F.col("n_items") * (F.col("n_items") - 1) / 2) / F.sum("n").over(up)
    return d.withColumn("raw", raw).withColumn("q_value", F.least(F.min("raw").over(down), F.lit(1.0))).drop("raw", "n_items")


def cooccurrence(entities: DataFrame, evidence: DataFrame, min_together: int = 4, min_lift: float = 4.0, level: float | None = None, ranks: bool = False, discovery: float | None = None) -> DataFrame:
    """One row per pair of a case with n_ab >= min_together, n_ab * n >= min_lift * n_a * n_b and, where a level is given, a p-value of at most level.

    Both prunings are exact: n_ab <= min(n_a, n_b), so an item in fewer than min_together baskets
    has no pair, and n_ab * n >= lift * n_a * n_b with n_ab <= n_b needs n >= lift * n_a.
    expected and p_value follow, with ranks q_value too (all pairs of the case's items being tested and ranked, also those
    left out of the result), and then, where discovery is given, the pairs with a q-value of at most that."""
    inc = materialise(incidences(entities, evidence))
    baskets = inc.groupBy("case_id", "evidence_id").agg(F.count("*").alias("degree"))
    sizes = baskets.groupBy("case_id").agg(F.count("*").alias("n"))
    every = inc.groupBy("case_id", "text", "label").agg(F.count("*").alias("n_item"))
    least, lift = (1, 0.0) if ranks else (min_together, min_lift)
    kept = every.where(F.col("n_item") >= least).join(sizes, "case_id").where(F.col("n_item") * F.lit(lift) <= F.col("n"))
    items = materialise(kept.withColumn("item", F.monotonically_increasing_id()))
    small = inc.join(items.select("case_id", "text", "label", "item"), ["case_id", "text", "label"]).select("case_id", "evidence_id", "item")
    a = small.select("evidence_id", F.col("item").alias("a"))
    b = small.select("evidence_id", F.col("item").alias("b"))
    pairs = a.join(b, "evidence_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n_ab")).where(F.col("n_ab") >= least)
    pairs = materialise(pairs)
    ia = items.select(F.col("item").alias("a"), "case_id", F.col("text").alias("t1"), F.col("label").alias("l1"), F.col("n_item").alias("n1"), "n")
    ib = items.select(F.col("item").alias("b"), F.col("text").alias("t2"), F.col("label").alias("l2"), F.col("n_item").alias("n2"))
    full = pairs.where(F.col("n_ab") >= min_together).join(ia, "a").join(ib, "b").where(F.col("n_ab") * F.col("n") >= F.lit(min_lift) * F.col("n1") * F.col("n2"))
    first = F.expr("t1 < t2 or (t1 = t2 and l1 < l2)")
    pick = lambda x, y, name: F.when(first, F.col(x)).otherwise(F.col(y)).alias(name)
    found = full.select(
        "case_id", pick("t1", "t2", "text_a"), pick("l1", "l2", "label_a"), pick("t2", "t1", "text_b"), pick("l2", "l1", "label_b"),
        pick("n1", "n2", "n_a"), pick("n2", "n1", "n_b"), "n_ab", "n", (F.col("n_ab") * F.col("n") / (F.col("n1") * F.col("n2"))).alias("lift"),
    )
    found = materialise(found)
    degrees = every.groupBy("case_id", F.col("n_item").alias("degree")).agg(F.count("*").alias("n")).withColumn("side", F.lit("item")).unionByName(
        baskets.groupBy("case_id", "degree").agg(F.count("*").alias("n")).withColumn("side", F.lit("basket"))
    )
    weights = materialise(weights_of(degrees))
    if ranks:
        of = pairs.join(ia.select("a", "case_id", "n1"), "a").join(ib.select("b", "n2"), "b")
        classes = of.groupBy("case_id", F.least("n1", "n2").alias("low"), F.greatest("n1", "n2").alias("high"), "n_ab").agg(F.count("*").alias("n"))
    else:
        classes = found.groupBy("case_id", F.least("n_a", "n_b").alias("low"), F.greatest("n_a", "n_b").alias("high"), "n_ab").agg(F.count("*").alias("n"))
    law = materialise(law_of(materialise(classes), weights))
    law = materialise(with_rates(law, weights)) if ranks else law
    law = law if level is None else law.where(F.col("p_value") <= level)
    law = (law if discovery is None or not ranks else law.where(F.col("q_value") <= discovery)).drop("n")
    return found.withColumns({"low": F.least("n_a", "n_b"), "high": F.greatest("n_a", "n_b")}).join(small_side(law), ["case_id", "low", "high", "n_ab"]).drop("low", "high")


def strongest(pairs: DataFrame, per_case: int = 20) -> DataFrame:
    """The per_case most surprising pairs of each case (a top-k report); ties by the pair."""
    w = Window.partitionBy("case_id").orderBy("p_value", F.desc("n_ab"), *PAIR_COLUMNS[1:])
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_case)
