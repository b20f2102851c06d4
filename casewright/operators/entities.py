"""Entities: extraction by rules, counts, and the graph of entities that share evidence. Null text or label is a value of
its own in counts; ties are ordered by text, then label."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casewright.functions import exprs as X
from casewright.operators.evidence import in_case

# Hebrew words that are no terms.
HEBREW_STOPWORDS = (
    "אני אתה את הוא היא אנחנו אתם אתן הם הן של על עם לא כן זה זו אלה היה היו יש "
    "אין גם או אם כי אבל אשר מתוך בין עוד כל"
).split()


def extract(chunks: DataFrame, with_model: bool = False) -> DataFrame:
    """(id, label, text) of every match of the rules, repeated as often as it stands in the chunk. Beside a model of named
    entities the families of Latin names and Hebrew terms are left to it."""
    w = X.words(F.col("text"))
    fam = lambda label, arr: F.transform(arr, lambda x: F.struct(F.lit(label).alias("label"), x.alias("text")))
    rules = [
        fam("name", F.filter(w, lambda x: x.rlike("^[А-ЯЁ][а-яё]{2,}$"))), fam("phone", F.transform(X.all_matches(F.col("text"), X.PHONE), lambda x: F.trim(x))),
        fam("israeli_id", X.all_matches(F.col("text"), X.ISRAELI_ID)), fam("vehicle_plate", X.all_matches(F.col("text"), X.PLATE)),
    ]
    if not with_model:
        rules += [fam("name", F.filter(w, lambda x: x.rlike("^[A-Z][a-zA-Z]{2,}$"))), fam("hebrew_term", F.filter(X.all_matches(F.col("text"), X.HEBREW), lambda x: ~x.isin(HEBREW_STOPWORDS)))]
    found = F.concat(*rules)
    return chunks.where("text is not null").select("id", F.explode(found).alias("e")).select("id", "e.label", "e.text")


def counts(entities: DataFrame, evidence: DataFrame | None = None, case_id: int | None = None) -> DataFrame:
    e = in_case(entities, evidence, case_id) if evidence is not None else entities
    return e.groupBy(F.col("text").alias("entity"), F.col("label").alias("type")).agg(F.count("*").alias("count"))


def listing(entities: DataFrame, chunks: DataFrame, evidence: DataFrame | None = None, case_id: int | None = None) -> DataFrame:
    """counts, the most frequent first, ties by text and label; where nothing was extracted yet, the rules are run over all chunks,
    or nothing is given for a case."""
    if entities.limit(1).count() or case_id is not None:
        found = counts(entities, evidence, case_id)
    else:
        found = extract(chunks).groupBy(F.col("text").alias("entity"), F.col("label").alias("type")).agg(F.count("*").alias("count"))
    return found.orderBy(F.desc("count"), "entity", "type")


def graph_nodes(entities: DataFrame, most: int = 30) -> DataFrame:
    """The entities of most mentions."""
    named = entities.where("text is not null and label is not null")
    return counts(named).orderBy(F.desc("count"), "entity", "type").limit(most)


def graph_edges(entities: DataFrame, most: int = 30, edges: int = 200) -> DataFrame:
    """Pairs of top entities by the number of evidence files that hold both. The node list is bounded by `most`, so the
    broadcast is; each file has at most most*(most-1)/2 pairs."""
    top = graph_nodes(entities, most).select(F.col("entity").alias("text"), F.col("type").alias("label"))
    have = entities.join(F.broadcast(top), ["text", "label"], "left_semi").select("evidence_id", "text", "label").distinct()
    a = have.select("evidence_id", F.col("text").alias("a"), F.col("label").alias("a_label"))
    b = have.select("evidence_id", F.col("text").alias("b"), F.col("label").alias("b_label"))
    pairs = a.join(b, "evidence_id").where("a < b or (a = b and a_label < b_label)").groupBy("a", "a_label", "b", "b_label").agg(F.count("*").alias("weight"))
    return pairs.orderBy(F.desc("weight"), "a", "a_label", "b", "b_label").limit(edges)


def edge_width(edges: DataFrame) -> DataFrame:
    """edges with the width they are drawn in."""
    return edges.withColumn("width", F.least(F.col("weight") + 1, F.lit(6)))


def graph_layout(nodes: DataFrame) -> DataFrame:
    """Size and place on a circle of radius 300 of every node, in order of count."""
    n = nodes.select("entity", "type", "count", F.row_number().over(Window.orderBy(F.desc("count"), "entity", "type")).alias("rank"), F.count("*").over(Window.partitionBy(F.lit(1))).alias("n"))
    angle = (F.col("rank") - 1) * (2 * 3.141592653589793) / F.col("n")
    return n.select("entity", "type", (F.lit(14) + F.least(F.floor(F.log(F.col("count") + 1.0) * 10), F.lit(30))).cast("long").alias("size"), F.round(F.cos(angle) * 300, 4).alias("x"), F.round(F.sin(angle) * 300, 4).alias("y"))
