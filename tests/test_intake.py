"""Files on disk through the whole intake: source, store, extraction with and without hooks, index, stream, integrity, report."""

import hashlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from casewright.functions.models import Models
from casewright.operators import evidence, intake, report
from casewright.sources import files
from casewright.streaming import index as stream

NONE = "id long, sha256 string"
STATEMENT = "  The witness Dana called 052-1234567 on 2024-05-03.\n"


@pytest.fixture()
def folder(tmp_path):
    root = tmp_path / "in"
    (root / "deep er+x").mkdir(parents=True)
    (root / "a.TXT").write_bytes(STATEMENT.encode() + b"\xff\xfe")
    (root / "deep er+x" / "b.txt").write_bytes(STATEMENT.encode() + b"\xff\xfe")
    (root / "deep er+x" / "c d.txt").write_bytes(b"   ")
    (root / "e.docx").write_bytes(b"zip")
    (root / "f.png").write_bytes(b"png")
    (root / "g.mp3").write_bytes(b"mp3")
    (root / "h.pdf").write_bytes(b"pdf")
    (root / "skipped.exe").write_bytes(b"no")
    return root


def registered(spark, folder):
    f = files.supported(files.read(spark, str(folder)))
    return f, intake.register(f, spark.createDataFrame([(40, None), (41, "x")], NONE), 3)


def test_source_and_register(spark, folder):
    f, made = registered(spark, folder)
    rows = {r.filename: r for r in made.evidence.collect()}
    assert set(rows) == {"a.TXT", "c d.txt", "e.docx", "f.png", "g.mp3", "h.pdf"} and sorted(r.id for r in rows.values()) == [42, 43, 44, 45, 46, 47]
    a = rows["a.TXT"]
    assert (a.sha256, a.mime_type, a.status, a.case_id, a.size_bytes) == (hashlib.sha256((folder / "a.TXT").read_bytes()).hexdigest(), "text/plain", "processing", 3, len((folder / "a.TXT").read_bytes()))
    assert [(r.original_path, r.existing_id) for r in made.duplicates.collect()] == [(str(folder / "deep er+x" / "b.txt"), a.id)]
    assert tuple(intake.summary(f, made).first()) == (7, 6, 1)
    again = intake.register(f, made.evidence.select("id", "sha256"))
    assert again.evidence.count() == 0 and again.duplicates.count() == 7


def test_roots(spark, folder, tmp_path):
    with pytest.raises(files.PathNotAllowed):
        files.read(spark, str(folder), [str(tmp_path / "i")])
    with pytest.raises(files.PathNotAllowed):
        files.read(spark, str(tmp_path / "in" / ".." / "other"), [str(tmp_path / "in")])
    assert files.read(spark, str(folder), [str(tmp_path)]).count() == 8


def test_index_without_and_with_models(spark, folder):
    f, made = registered(spark, folder)
    rows = f.join(made.evidence.select("id", "original_path"), "original_path")
    name = {r.id: r.filename for r in made.evidence.collect()}
    done = intake.index(intake.extracted(rows))
    assert {name[r.id]: r.status for r in done.status.collect()} == {
        "a.TXT": "indexed", "c d.txt": "no_text_found", "e.docx": "extraction_not_supported", "f.png": "text_extraction_failed", "g.mp3": "transcription_unavailable", "h.pdf": "text_extraction_failed",
    }
    assert {(r.text, r.label) for r in done.entities.collect()} == {("The", "name"), ("Dana", "name"), ("052-1234567", "phone"), ("1234567", "vehicle_plate"), ("2024-05", "vehicle_plate")}
    chunk = done.chunks.collect()
    assert len(chunk) == 1 and chunk[0].text == STATEMENT.strip() and chunk[0].embedding_dimension == 384 and abs(sum(x * x for x in chunk[0].embedding) - 1) < 1e-9
    models = Models(
        embed=lambda t: pd.Series([[1.0, 2.0]] * len(t)), embed_name="two", ner=lambda t: pd.Series([[{"word": "Dana", "score": 0.9, "entity_group": "PER"}, {"word": "low", "score": 0.2, "entity_group": "PER"}, {"word": "Q", "score": 0.9, "entity_group": "X"}]] * len(t)),
        ocr=lambda c: pd.Series(["" if bytes(b) == b"pdf" else "seen" for b in c]), pdf=lambda c: pd.Series([""] * len(c)), transcribe=lambda c: pd.Series([[{"start": 1.0, "end": 61.5, "text": " said "}, {"start": 62.0, "end": 90.0, "text": "more"}]] * len(c)),
    )
    done = intake.index(intake.extracted(rows, models), models)
    assert {name[r.id]: r.status for r in done.status.collect()} == {
        "a.TXT": "indexed", "c d.txt": "no_text_found", "e.docx": "extraction_not_supported", "f.png": "ocr_indexed", "g.mp3": "transcribed", "h.pdf": "no_text_found",
    }
    got = {name[r.evidence_id]: (r.text, r.source_location, r.embedding_model, r.embedding_dimension) for r in done.chunks.collect()}
    assert got["g.mp3"] == ("said more", "time:00:01-01:30", "two", 2) and got["f.png"][0] == "seen"
    assert ("Dana", "person") in {(r.text, r.label) for r in done.entities.collect()} and "low" not in {r.text for r in done.entities.collect()}


def test_replace_is_no_append(spark):
    table = spark.createDataFrame([(1, 5, "old", 7), (2, 6, "kept", 7)], "id long, evidence_id long, text string, extra int")
    fresh = spark.createDataFrame([(5, "new")], "evidence_id long, text string")
    ids = spark.createDataFrame([(5,)], "id long")
    once = intake.replaced(table, fresh, ids)
    assert sorted(map(tuple, once.collect())) == [(2, 6, "kept", 7), (3, 5, "new", None)]
    assert [r.text for r in intake.replaced(once, fresh, ids).orderBy("text").collect()] == ["kept", "new"]


def test_store_integrity_content_backup(spark, folder, tmp_path):
    f, made = registered(spark, folder)
    store = str(tmp_path / "store")
    kept = files.store(f, store)
    assert kept.count() == 6 and kept.count() == 6  # runs again without harm
    ev = made.evidence.withColumn("stored_path", F.concat(F.lit(store + "/"), "stored_path"))
    state = files.stored_state(ev, files.read(spark, store))
    assert tuple(evidence.integrity_counts(state).first()) == (6, 0, 0, True)
    rows = {r.filename: r for r in ev.collect()}
    with open(rows["a.TXT"].stored_path, "wb") as out:
        out.write(b"changed \xff")
    (tmp_path / "store" / rows["e.docx"].stored_path.rsplit("/", 1)[1]).unlink()
    state = files.stored_state(ev, files.read(spark, store))
    assert tuple(evidence.integrity_counts(state).first()) == (4, 1, 1, False)
    assert {r.filename: r.state for r in state.where("state <> 'verified'").collect()} == {"a.TXT": "tampered", "e.docx": "missing"}
    assert [r.text for r in files.content(ev, files.read(spark, store), rows["a.TXT"].id).collect()] == ["changed \ufffd"]
    assert files.content(ev, files.read(spark, store), rows["f.png"].id).count() == 0
    n = files.backup({"evidence": ev}, str(tmp_path / "backup")).collect()
    assert [tuple(r) for r in n] == [("evidence", 6)]


def test_intake_stream(spark, folder, tmp_path):
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    stream.intake_stream(spark, str(folder), out, state, 3)
    assert spark.read.parquet(f"{out}/evidence").count() == 6 and spark.read.parquet(f"{out}/chunks").count() == 1
    (folder / "late.txt").write_text("Late words of Miriam.")
    (folder / "copy.txt").write_bytes((folder / "a.TXT").read_bytes())
    stream.intake_stream(spark, str(folder), out, state, 3)
    rows = spark.read.parquet(f"{out}/evidence").collect()
    assert len(rows) == 7 and len({r.id for r in rows}) == 7 and {r.status for r in rows if r.filename == "late.txt"} == {"indexed"}


def test_chunk_stream_takes_an_id_once(spark, tmp_path):
    src, out, state = str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "state")
    c = spark.createDataFrame([(1, 1, "Alpha Beta"), (2, 1, "Gamma")], "id long, evidence_id long, text string")
    c.coalesce(1).write.parquet(src)
    stream.index_stream(spark, src, c.schema, out, state)
    c.where("id = 2").unionByName(spark.createDataFrame([(3, 2, "Alpha")], c.schema)).coalesce(1).write.mode("append").parquet(src)
    stream.index_stream(spark, src, c.schema, out, state)
    assert sorted(r.text for r in spark.read.parquet(f"{out}/entities").collect()) == ["Alpha", "Alpha", "Beta", "Gamma"]
    from casewright.operators import keyword

    assert {r.id for r in keyword.matches(spark, f"{out}/keywords", "alpha").collect()} == {1, 3}


def test_report_page(spark, tmp_path):
    ev = spark.createDataFrame([(1, 7, "<b>.txt", "h", 3, "indexed")], "id long, case_id long, filename string, sha256 string, size_bytes long, status string").withColumn("imported_at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    c = spark.createDataFrame([(1, 1, 0, "on 2024-05-03 & later", "chars:0-9")], "id long, evidence_id long, chunk_index int, text string, source_location string")
    en = spark.createDataFrame([(1, 1, "Dana", "name")], "id long, evidence_id long, text string, label string")
    au = spark.createDataFrame([(1, "seen", 1), (2, "other", None)], "id long, event_type string, evidence_id long").withColumn("created_at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    path = report.write(report.sections(7, ev, c, en, au), "A & B", "2024-01-02T00:00:00+00:00", str(tmp_path / "r.html"))
    page = open(path, encoding="utf-8").read()
    assert "&lt;b&gt;.txt" in page and "on 2024-05-03 &amp; later" in page and "A &amp; B" in page and page.count("<tr>") == 8 and "other" not in page
