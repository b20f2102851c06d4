"""Every query with SQL is held against a second engine on the smallest tables; the rest against plain Python."""

import hashlib
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from casewright.functions import exprs as X
from casewright.operators import audit, evidence, keyword, persons, search
from casewright.plans import catalogue
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in os.listdir(DATA):
        c.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{DATA}/{f}')")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    cell = lambda v: None if pd.isna(v) else f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(str, map(cell, r))) for r in df.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_as_sql(spark, con, name):
    ours, theirs = catalogue.QUERIES[name](spark, DATA).toPandas(), con.execute(catalogue.SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_chunk_offsets(spark):
    text = "a" * 2000
    d = spark.createDataFrame([(1, text, "extra"), (2, None, ""), (3, "   ", ""), (4, "", "")], "doc_id long, text string, chunk_index string").drop("chunk_index")
    got = evidence.chunk_documents(d, 500, 50).orderBy("doc_id", "chunk_index").collect()
    want, at = [], 0
    while True:
        end = min(at + 500, 2000)
        want.append((at, end))
        if end == 2000:
            break
        at = end - 50
    assert [(r.start_char, r.end_char) for r in got] == want and {r.doc_id for r in got} == {1}


def test_audit_chain(spark):
    e = spark.createDataFrame([(i, "x", None if i % 2 else i, f'{{"case_id": {i % 2}}}', "", "") for i in range(1, 9)], "id long, event_type string, evidence_id long, details_json string, prev_hash string, event_hash string")
    e = e.withColumn("created_at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    last, want = {}, {}
    for i in range(1, 9):
        c = i % 2
        last[c] = hashlib.sha256("|".join([last.get(c, ""), "x", "None" if c else str(i), "2024-01-01T00:00:00", f'{{"case_id": {c}}}']).encode()).hexdigest()
        want[i] = last[c]
    assert {r.id: r.event_hash for r in audit.build(e.unionByName(e)).collect()} == want
    built = audit.build(e).withColumnRenamed("event_hash", "h").drop("case_id")
    from pyspark.sql import Window

    chained = e.join(built, "id").withColumn("case", F.get_json_object("details_json", "$.case_id")).withColumn("event_hash", F.col("h")).withColumn("prev_hash", F.coalesce(F.lag("h").over(Window.partitionBy("case").orderBy("id")), F.lit(""))).drop("h", "case")
    assert all(r.broken_at_id is None and r.checked == 4 for r in audit.verify(chained).collect())
    assert {r.case_id: (r.ok, r.broken_at_id, r.checked) for r in audit.verify(chained.where("id <> 3")).collect()} == {0: (True, None, 4), 1: (False, 5, 1)}
    more = e.where("id < 4").withColumn("id", F.col("id") + 20)
    assert all(r.ok and r.checked == (5 if r.case_id == 0 else 6) for r in audit.verify(audit.append(chained, more)).collect())
    assert audit.verify(e.limit(0)).count() == 0


def test_phone_suggestions(spark):
    p = spark.createDataFrame([(1, 7, "Dana Levi"), (2, 7, None), (3, 7, ".."), (4, 7, "ana"), (5, 8, "Dana Levi")], "id long, case_id long, name string")
    li = spark.createDataFrame([], "person_id long, kind string, value string")
    text = "Dana Levi can be reached at 052-1234567. Nothing else."
    c = spark.createDataFrame([(1, 5, text, "chars:0-54"), (2, 5, None, ""), (3, 5, "", None)], "id long, evidence_id long, text string, source_location string")
    ev = spark.createDataFrame([(5, 7, "a.txt")], "id long, case_id long, filename string")
    got = {r.person_id: r for r in persons.phone_suggestions(p, li, c, ev).collect()}
    assert set(got) == {1, 4} and (got[1].phone, got[1].distance, got[1].filename, got[1].snippet) == ("052-1234567", 19, "a.txt", text)
    assert (got[4].matched_name, got[4].distance, got[4].confidence) == ("ana", 24, 0.9)  # inside a word
    have = spark.createDataFrame([(1, "phone", "0521234567"), (4, "phone", "052 1234567")], li.schema)
    assert persons.phone_suggestions(p, have, c, ev).count() == 0
    assert persons.phone_suggestions(p.limit(0), li, c, ev).count() == 0


def test_keyword_index(spark, tmp_path):
    """Phrases, repeated words, blanks, and texts that are added, replaced and deleted."""
    cols = "id long, evidence_id long, text string, chunk_index int, source_location string"
    row = lambda i, t: (i, 10 + i, t, 0, "")
    c = spark.createDataFrame([row(1, "alpha beta gamma"), row(2, "beta alpha"), row(3, None), row(4, ""), row(5, "Beta beta, beta")], cols)
    ev = spark.createDataFrame([(11, 1, "a.txt"), (15, 2, "e.txt")], "id long, case_id long, filename string")
    ix = str(tmp_path / "ix")
    keyword.upsert(c, ix)
    ids = lambda q, **k: [r.id for r in keyword.search(ix, c, ev, q, **k).orderBy("id").collect()]
    assert ids("Alpha Beta") == [1] and ids("alph") == ids("  ") == ids(None) == [] and ids("beta beta") == [5] and ids("beta", case_id=2) == [5] and ids("beta") == [1, 2, 5]
    assert {r.id: r.filename for r in keyword.search(ix, c, ev, "beta").collect()} == {1: "a.txt", 2: None, 5: "e.txt"}
    assert {r.id: r.tf for r in keyword.matches(spark, ix, "beta beta").collect()} == {5: 2}
    new = spark.createDataFrame([row(2, "delta beta"), row(6, "alpha beta")], cols)
    keyword.upsert(new, ix, spark.createDataFrame([(5,)], "id long"))
    both = c.where("id not in (2, 5)").unionByName(new)
    fresh = str(tmp_path / "fresh")
    keyword.upsert(both, fresh)
    for q in ("beta", "alpha", "alpha beta", "delta", "gamma"):
        assert keyword.ranked(spark, ix, q).collect() == keyword.ranked(spark, fresh, q).collect(), q
    assert keyword.statistics(spark, ix).orderBy("token").collect() == keyword.statistics(spark, fresh).orderBy("token").collect()
    empty = str(tmp_path / "empty")
    keyword.upsert(c.limit(0), empty)
    assert keyword.ranked(spark, empty, "beta").count() == 0


def test_like_patterns(spark):
    c = spark.createDataFrame([(1, 1, "A 50% cut", 0, ""), (2, 1, "a\\b", 0, ""), (3, 9, "50% off", 0, ""), (4, 1, None, 0, "")], "id long, evidence_id long, text string, chunk_index int, source_location string")
    ev = spark.createDataFrame([(1, 1, "f")], "id long, case_id long, filename string")
    ids = lambda q: [r.id for r in keyword.contains(c, ev, q).collect()]
    assert ids("a 5_%CUT") == [1] and ids("a\\B") == [2] and ids("50% off") == [] and ids(" ") == []


def test_scalars(spark):
    d = spark.createDataFrame([("A [_1] b [1, 2] [9]",)], "a string")
    assert d.select(search.clean_answer(F.col("a"))).first()[0] == "A [1] b [1][2]"
    assert spark.createDataFrame([("<a & 'b'>",)], "a string").select(X.html_escape(F.col("a"))).first()[0] == "&lt;a &amp; &#x27;b&#x27;&gt;"


def test_dedupe_ties_nulls(spark):
    e = spark.createDataFrame([(1, "h"), (2, "h"), (3, None), (4, "g"), (5, None)], "id long, sha256 string")
    assert {(r.id, r.duplicate) for r in evidence.dedupe(e).collect()} == {(1, False), (2, True), (3, False), (4, False), (5, False)}


def test_all_entity_families(spark):
    """Plates and Hebrew terms by the reference's patterns; the other families are what the SQL gives."""
    import re

    from casewright.operators import entities

    plate, hebrew = re.compile(r"\b\d{2,3}[-\s]?\d{2,3}[-\s]?\d{2,3}\b"), re.compile("[֐-׿]{2,}")
    texts = ["car 12-345-67 or 12 345 67, id 123456789", "אני ראיתי את הרכב של דוד", "של על", "٣٤٥-٦٧-٨٩ x12-34-56", None, ""]
    c = spark.createDataFrame(list(enumerate(texts)), "id long, text string").unionByName(spark.read.parquet(f"{DATA}/evidencechunk.parquet").select((F.col("id") + 100).alias("id"), "text"))
    want = []
    for r in c.where("text is not null").collect():
        want += [(r.id, "vehicle_plate", x) for x in plate.findall(r.text)] + [(r.id, "hebrew_term", x) for x in hebrew.findall(r.text) if x not in entities.HEBREW_STOPWORDS]
    got = [tuple(r) for r in entities.extract(c).where("label in ('vehicle_plate', 'hebrew_term')").collect()]
    assert len(entities.HEBREW_STOPWORDS) == 32 and sorted(got) == sorted(want) and {r[1] for r in got} == {"vehicle_plate", "hebrew_term"}


def test_audit_edited_row(spark):
    """A row edited in place breaks its case, though the links of the chain still fit."""
    a = spark.read.parquet(f"{DATA}/auditevent.parquet").where("event_hash <> ''")
    assert audit.verify(a).where("broken_at_id is not null").count() == 0
    one = a.where("evidence_id is not null").agg(F.max("id")).first()[0]
    edits = {"event_type": F.lit("other"), "evidence_id": F.col("evidence_id") + 1, "created_at": F.expr("created_at + interval 1 microsecond"), "details_json": F.concat("details_json", F.lit(" "))}
    for column, new in edits.items():
        edited = a.withColumn(column, F.when(F.col("id") == one, new).otherwise(F.col(column)))
        assert [r.broken_at_id for r in audit.verify(edited).where("broken_at_id is not null").collect()] == [one], column


def test_search_helpers(spark):
    d = spark.createDataFrame([("_theשלום [__2] x",), ("[1,9, 3]",), ("CONTRADICTION | a | b\nc",), (None,)], "a string")
    got = d.select(search.clean_answer(F.col("a")).alias("c"), search.has_prose(F.col("a")).alias("p"), search.verdict(F.col("a")).alias("v"), search.explanation(F.col("a")).alias("e")).collect()
    assert [r.c for r in got] == ["שלום [2] x", "[1][3]", "CONTRADICTION | a | b\nc", None] and [r.p for r in got] == [True, False, True, False]
    assert got[2].v == "contradiction" and got[2].e == "a | b" and got[0].e == ""


def test_similar_pairs_against_brute_force(spark):
    import numpy as np

    x = np.random.default_rng(4).standard_normal((60, 5))
    rows = [(i, i % 7, [float(v) for v in r]) for i, r in enumerate(x)] + [(90, 1, None), (91, 1, []), (92, 1, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    want = sorted(((-float(x[a] @ x[b]), a, b) for a in range(60) for b in range(a + 1, 60) if a % 7 != b % 7 and x[a] @ x[b] >= 1.0))[:15]
    old, search.BLOCK = search.BLOCK, 16
    try:
        got = search.contradictions(df, 1.0, None, 15).collect()
    finally:
        search.BLOCK = old
    assert [(r.a, r.b) for r in got] == [(a, b) for _, a, b in want]
    assert search.contradictions(df.limit(0), 0.1).count() == 0


def test_judge(spark):
    import pandas as pd_

    cols = "id long, evidence_id long, text string, embedding array<double>, embedding_model string"
    c = spark.createDataFrame([(1, 1, "red car", [1.0, 0.0], "m"), (2, 2, "blue car", [1.0, 0.0], "m"), (3, 3, "same", [0.9, 0.1], ""), (4, 4, "other", [1.0, 0.0], "x")], cols)
    ev = spark.createDataFrame([(1, 7, "a"), (2, 7, "b"), (3, 7, "c")], "id long, case_id long, filename string")

    def judge(a: pd_.Series, b: pd_.Series) -> pd_.Series:
        return pd_.Series(["CONTRADICTION | colours" if {x, y} == {"red car", "blue car"} else "CONSISTENT" if x == "red car" else "??" for x, y in zip(a, b)])

    got = {(r.evidence_a, r.evidence_b): (r.verdict, r.explanation) for r in search.find_contradictions(c, ev, 0.5, 8, None, "m", judge=judge).collect()}
    assert got == {(1, 2): ("contradiction", "colours"), (2, 3): ("unverified", "")}
    assert {r.verdict for r in search.find_contradictions(c, ev, 0.5, 8, 7, "m").collect()} == {"unverified"}


def test_answers(spark):
    hits = spark.createDataFrame([(1, "f", 3, 0, "chars:0-4", "text")], "rank int, filename string, evidence_id long, chunk_index int, source_location string, text string")
    one = lambda *a, **k: tuple(search.answer(*a, **k).first())
    assert one("q", hits) == ("citations_only", f"{search.INTRO}\n\n[1] f (Evidence ID: 3, Chunk: 0, Location: chars:0-4)\ntext")
    assert one("q", hits.limit(0)) == ("none", search.NOT_FOUND) and one(" ", hits) == ("none", search.NO_QUESTION)
    assert one("q", hits, synthesise=lambda q, c: "It was [_1, 4].") == ("llm", "It was [_1, 4].") or one("q", hits, synthesise=lambda q, c: "It was [1, 4].") == ("llm", "It was [1].")
    assert one("q", hits, synthesise=lambda q, c: "NOT_FOUND") == ("llm", search.NOT_FOUND) and one("q", hits, synthesise=lambda q, c: "[1]")[0] == "citations_only"


def test_vectors_and_orders(spark):
    d = spark.createDataFrame([("a b a", "שלום עולם 12-34 Tel Aviv"), ("", "abc"), (None, None)], "t string, h string").withColumn("b", X.hash_buckets(F.col("t")))
    got = d.select(X.hash_vector(F.col("b")).alias("v"), X.deserialised(X.serialised(X.hash_vector(F.col("b")))).alias("r")).collect()
    want = [0.0] * 384
    for t, n in (("a", 2), ("b", 1)):
        want[hashlib.sha256(t.encode()).digest()[0]] += n / 5**0.5
    assert all(abs(x - y) < 1e-9 for x, y in zip(got[0].v, want)) and len(got[0].v) == 384 and got[1].v == [] and all(abs(x - y) < 1e-6 for x, y in zip(got[0].r, want))
    logical = "שלום לכולם בית ספר"
    d = spark.createDataFrame([(logical[::-1],), (logical,), ("plain",), (None,)], "t string")
    assert [r[0] for r in d.select(X.logical_order(F.col("t"))).collect()] == [logical, logical, "plain", None]
    assert [r[0] for r in spark.createDataFrame([(0.0,), (75.9,), (3671.0,)], "s double").select(X.minutes_seconds(F.col("s"))).collect()] == ["00:00", "01:15", "61:11"]


def test_person_changes(spark):
    cases = spark.createDataFrame([(1, "c")], "id long, name string")
    p = spark.createDataFrame([(1, 1, "A", "d", True)], "id long, case_id long, name string, description string, in_evidence boolean")
    p = p.withColumn("created_at", F.current_timestamp())
    li = spark.createDataFrame([(1, 1, "alias", "x", None, None, 1.0)], "id long, person_id long, kind string, value string, evidence_id long, related_person_id long, confidence double").withColumn("created_at", F.current_timestamp())
    ev = spark.createDataFrame([(5,)], "id long")
    p = persons.create(p, cases, 1, " B ")
    assert [(r.id, r.name) for r in p.orderBy("id").collect()] == [(1, "A"), (2, "B")]
    with pytest.raises(KeyError):
        persons.create(p, cases, 9, "x")
    with pytest.raises(ValueError):
        persons.create(p, cases, 1, "  ")
    assert [r.name for r in persons.update(p, 1, "  ", " e ").orderBy("id").collect()] == ["A", "B"]
    li = persons.add_link(li, p, ev, 1, "relation", "brother", related_person_id=2)
    li = persons.add_link(li, p, ev, 2, "photo", evidence_id=5)
    for bad in (dict(kind="bogus"), dict(kind="photo"), dict(kind="relation", related_person_id=77)):
        with pytest.raises(ValueError):
            persons.add_link(li, p, ev, 1, **bad)
    assert [len(r.links) for r in persons.nested(p, li, 1).collect()] == [2, 1]
    p2, l2 = persons.delete(p, li, 2)
    assert p2.count() == 1 and [r.id for r in l2.collect()] == [1]
    assert persons.remove_link(li, 1, 3).count() == 3 and persons.remove_link(li, 2, 3).count() == 2
