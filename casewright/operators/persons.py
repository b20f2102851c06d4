"""Persons: links, graph, suggestions and changes. Names are compared after blanks are collapsed; ties go to the lower id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.functions import exprs as X
from casewright.sources import materialise, small_side

# Confidence by distance, rounded half to even on binary values; kinds of links; reasons of an alias.
CONFIDENCE = [round(0.5 + 0.5 * (1 - d / 120), 2) for d in range(121)]
LINK_KINDS = ("alias", "phone", "photo", "relation")
PART_OF_NAME, NICKNAME = "חלק מהשם המלא", "כינוי אפשרי"


def norm_name(c: Column) -> Column:
    return X.ustrip(F.regexp_replace(c, r"(?U)\s+", " "))


def norm_phone(c: Column) -> Column:
    return F.regexp_replace(c, r"\P{Nd}", "")


def listing(persons: DataFrame, links: DataFrame) -> DataFrame:
    n = links.groupBy("person_id").agg(F.count("*").alias("links"), F.count_if(F.col("kind") == "alias").alias("aliases"), F.min("id").alias("first_link")).withColumnRenamed("person_id", "id")
    return persons.select("id", "case_id", "name").join(n, "id", "left").na.fill(0, ["links", "aliases"])


def nested(persons: DataFrame, links: DataFrame, case_id: int | None = None) -> DataFrame:
    """Persons by name and id, each with its links (array of struct) by id; a person without links has an empty array."""
    p = persons if case_id is None else persons.where(F.col("case_id") == case_id)
    of = links.select("person_id", F.struct("id", "kind", "value", "evidence_id", "related_person_id", "confidence").alias("link"))
    per = of.groupBy("person_id").agg(F.sort_array(F.collect_list("link")).alias("links")).withColumnRenamed("person_id", "id")
    return p.select("id", "case_id", "name", "description", "in_evidence").join(per, "id", "left").withColumn("links", F.coalesce("links", F.array())).orderBy("name", "id")


def graph_edges(persons: DataFrame, links: DataFrame) -> DataFrame:
    """Relations with both ends in one case."""
    a = persons.select(F.col("id").alias("person_id"), "case_id")
    b = persons.select(F.col("id").alias("related_person_id"), F.col("case_id").alias("case_b"))
    return links.where("kind = 'relation'").join(a, "person_id").join(b, "related_person_id").where("case_id = case_b").select("case_id", F.col("person_id").alias("a"), F.col("related_person_id").alias("b"), F.col("value").alias("label"))


def valid_link(links: DataFrame, persons: DataFrame, evidence: DataFrame) -> DataFrame:
    """(id, valid): a known kind; a photo names evidence that exists, a relation a person that exists."""
    e = evidence.select(F.col("id").alias("evidence_id"), F.lit(True).alias("ev")).distinct()
    p = persons.select(F.col("id").alias("related_person_id"), F.lit(True).alias("pe")).distinct()
    d = links.join(e, "evidence_id", "left").join(p, "related_person_id", "left")
    ok = F.when(F.col("kind") == "photo", F.coalesce("ev", F.lit(False))).when(F.col("kind") == "relation", F.coalesce("pe", F.lit(False))).otherwise(F.col("kind").isin(*LINK_KINDS))
    return d.select("id", F.coalesce(ok, F.lit(False)).alias("valid"))


GRAM = 3


def phone_suggestions(persons: DataFrame, links: DataFrame, chunks: DataFrame, evidence: DataFrame, window: int = 120) -> DataFrame:
    """(person_id, person_name, matched_name, phone, distance, confidence, evidence_id, filename, source_location, snippet): the
    nearest place of a person's name or alias to a phone number in a chunk of the person's case, at most `window` characters
    away; numbers the person already has are left out. One row for a person and number: the highest confidence, and of
    equal ones the least chunk, the earliest number, the longest name, the least name.

    A name stands wherever its letters stand, also inside a word. Only the `window` characters (and the name) on either side of
    a number can matter, so names and numbers meet by case and by the first letters of a name among the grams of that
    stretch: texts stay where they are, and no chunk is held against every person."""
    alias = links.where("kind = 'alias'").select("person_id", F.col("value").alias("name"))
    own = persons.select(F.col("id").alias("person_id"), "name")
    who = persons.select(F.col("id").alias("person_id"), "case_id", F.col("name").alias("person_name"))
    names = own.unionByName(alias).where("length(name) >= 2").distinct().join(who, "person_id").where("case_id is not null")
    names = materialise(names.withColumn("gram", F.substring("name", 1, GRAM)))
    longest = names.agg(F.coalesce(F.max(F.length("name")), F.lit(0))).first()[0]
    ev = evidence.where("case_id is not null").groupBy(F.col("id").alias("evidence_id")).agg(F.min("case_id").alias("case_id"), F.min("filename").alias("filename"))
    m = chunks.where(F.col("text").rlike(X.PHONE)).select("id", "evidence_id", "source_location", "text", X.places(F.col("text"), X.PHONE).alias("ps")).join(ev, "evidence_id")
    one = m.select("id", "evidence_id", "case_id", "filename", "source_location", "text", F.explode("ps").alias("p")).select("*", F.col("p.match").alias("phone"), F.col("p.at").alias("at")).drop("p")
    # The stretch that can hold a near name, kept with its place; the rest of the text is fetched for the few hits.
    reach = window + longest
    lo = F.greatest(F.col("at") - reach, F.lit(0))
    near = materialise(one.select("id", "case_id", "phone", "at", lo.alias("lo"), F.substring("text", lo + 1, F.col("at") - lo + F.length("phone") + reach).alias("part")))
    grams = F.array_distinct(F.expr(f"flatten(transform(sequence(2, {GRAM}), k -> transform(sequence(1, greatest(length(part) - k + 1, 1)), i -> substring(part, i, k))))"))
    keys = near.select("id", "case_id", "at", F.explode(grams).alias("gram")).join(names.select("case_id", "gram").distinct(), ["case_id", "gram"], "left_semi")
    met = keys.join(names, ["case_id", "gram"]).join(near, ["id", "case_id", "at"]).where(F.expr("contains(part, name)"))
    spots = F.expr("filter(sequence(1, length(part) - length(name) + 1), i -> substring(part, i, length(name)) = name)")
    gap = F.expr("array_min(transform(w, i -> least(abs(lo + i - 1 - (at + length(phone))), abs(at - (lo + i - 1 + length(name))))))")
    hit = met.withColumn("w", spots).withColumn("d", gap).where(F.col("d") <= window).withColumn("norm", norm_phone(F.col("phone")))
    have = links.where("kind = 'phone'").select("person_id", norm_phone(F.col("value")).alias("norm")).distinct()
    confidence = F.get(F.array(*map(F.lit, CONFIDENCE)), F.col("d"))
    hit = hit.join(have, ["person_id", "norm"], "left_anti").withColumn("confidence", confidence)
    best = hit.groupBy("person_id", "norm").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "id", "at", (-F.length("name")).alias("l"), "name", "phone", F.col("d").alias("distance"), "person_name")).alias("b")).select("person_id", "b.*")
    best = materialise(best)
    text = chunks.join(small_side(best.select("id").distinct()), "id", "left_semi").groupBy("id").agg(F.max(F.struct("text", "evidence_id", "source_location")).alias("t")).select("id", "t.*").join(ev.select("evidence_id", "filename"), "evidence_id")
    first = F.instr("text", F.col("name")) - 1
    start, end = F.greatest(F.least("at", first) - 20, F.lit(0)), F.least(F.length("text"), F.greatest(F.col("at") + F.length("phone"), first + F.length("name")) + 20)
    d = best.join(text, "id").withColumns({"start": start, "end": end})
    return d.select("person_id", "person_name", F.col("name").alias("matched_name"), "phone", "distance", (-F.col("c")).alias("confidence"), "evidence_id", "filename", "source_location", F.expr("substring(text, start + 1, end - start)").alias("snippet"))


def alias_suggestions(persons: DataFrame, links: DataFrame, entities: DataFrame, evidence: DataFrame) -> DataFrame:
    """(person_id, person_name, alias, confidence, reason): person-like entities of the case that are a word of a person's name (0.9),
    or begin with a word of three letters or more and have at most two more (0.6); claimed names are left out."""
    p = persons.select(F.col("id").alias("person_id"), "case_id", F.col("name").alias("person_name"), norm_name(F.col("name")).alias("name"))
    claimed = p.select("case_id", "name").unionByName(links.where("kind = 'alias'").join(p.select("person_id", "case_id"), "person_id").select("case_id", norm_name(F.col("value")).alias("name"))).distinct()
    ev = evidence.where("case_id is not null").select(F.col("id").alias("evidence_id"), "case_id").distinct()
    cand = entities.where("label in ('person', 'name', 'hebrew_term')").select("evidence_id", norm_name(F.col("text")).alias("name")).where("length(name) >= 2").distinct().join(ev, "evidence_id").select("case_id", "name").distinct().join(claimed, ["case_id", "name"], "left_anti")
    tok = p.select("person_id", "case_id", F.explode(F.array_distinct(F.split("name", " "))).alias("tok")).where("tok <> ''")
    exact = cand.join(tok, (cand.case_id == tok.case_id) & (cand.name == tok.tok)).select("person_id", F.col("name").alias("alias"), F.lit(0.9).alias("confidence"))
    heads = cand.select("case_id", "name", F.explode(F.expr("transform(array(1, 2), i -> substring(name, 1, length(name) - i))")).alias("tok")).where("length(tok) >= 3")
    prefix = heads.join(tok, ["case_id", "tok"]).select("person_id", F.col("name").alias("alias"), F.lit(0.6).alias("confidence"))
    best = exact.unionByName(prefix).groupBy("person_id", "alias").agg(F.max("confidence").alias("confidence"))
    named = best.join(p.select("person_id", "person_name"), "person_id")
    return named.select("person_id", "person_name", "alias", "confidence", F.when(F.col("confidence") > 0.8, PART_OF_NAME).otherwise(NICKNAME).alias("reason"))


def by_confidence(suggestions: DataFrame, *ties: str) -> DataFrame:
    """Suggestions as they are shown: the surest first."""
    return suggestions.orderBy(F.desc("confidence"), *ties)


# -- changes: tables in, tables out ------------------------------------------------------------------------------------------


def next_id(df: DataFrame) -> Column:
    """A one-row scalar subquery would do the same in SQL: the greatest id of a table and one."""
    return F.lit((df.agg(F.max("id")).first()[0] or 0) + 1).cast("long")


def _row_like(df: DataFrame, **values) -> DataFrame:
    """One row in the columns of df; what is not given is null."""
    return df.sparkSession.range(1).select(*((values[f.name] if f.name in values else F.lit(None)).cast(f.dataType).alias(f.name) for f in df.schema))


def create(persons: DataFrame, cases: DataFrame, case_id: int, name: str, description: str = "", in_evidence: bool = True) -> DataFrame:
    """persons with one more; KeyError where the case does not exist, ValueError where the name is blank."""
    if not cases.where(F.col("id") == case_id).limit(1).count():
        raise KeyError(f"case {case_id}")
    if not name.strip():
        raise ValueError("a person needs a name")
    return persons.unionByName(_row_like(persons, id=next_id(persons), case_id=F.lit(case_id), name=F.lit(name.strip()), description=F.lit(description.strip()), in_evidence=F.lit(in_evidence), created_at=F.current_timestamp()))


def update(persons: DataFrame, person_id: int, name: str | None = None, description: str | None = None) -> DataFrame:
    """persons with a new name (a blank one is ignored) or description of one; unknown ids change nothing."""
    one, out = F.col("id") == person_id, persons
    if name is not None and name.strip():
        out = out.withColumn("name", F.when(one, F.lit(name.strip())).otherwise(F.col("name")))
    if description is not None:
        out = out.withColumn("description", F.when(one, F.lit(description.strip())).otherwise(F.col("description")))
    return out


def delete(persons: DataFrame, links: DataFrame, person_id: int) -> tuple[DataFrame, DataFrame]:
    """(persons, links) without a person and the links from and to it."""
    kept = links.where((F.col("person_id") != person_id) & (F.col("related_person_id").isNull() | (F.col("related_person_id") != person_id)))
    return persons.where(F.col("id") != person_id), kept


def add_link(links: DataFrame, persons: DataFrame, evidence: DataFrame, person_id: int, kind: str, value: str = "", evidence_id: int | None = None, related_person_id: int | None = None) -> DataFrame:
    """links with one more of confidence 1; KeyError for an unknown person, ValueError for a link that valid_link refuses."""
    if not persons.where(F.col("id") == person_id).limit(1).count():
        raise KeyError(f"person {person_id}")
    row = _row_like(links, id=next_id(links), person_id=F.lit(person_id), kind=F.lit(kind), value=F.lit(value.strip()), evidence_id=F.lit(evidence_id), related_person_id=F.lit(related_person_id), confidence=F.lit(1.0), created_at=F.current_timestamp())
    if not valid_link(row, persons, evidence).first()["valid"]:
        raise ValueError(f"not a valid link of kind {kind}")
    return links.unionByName(row)


def remove_link(links: DataFrame, person_id: int, link_id: int) -> DataFrame:
    """links without one; a link of another person stays."""
    return links.where(~((F.col("id") == link_id) & (F.col("person_id") == person_id)) | F.col("person_id").isNull())


def newest(versions: DataFrame, *, key: str = "id", order: str = "version") -> DataFrame:
    """The newest version of every row of a table kept as appended versions."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return versions.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
