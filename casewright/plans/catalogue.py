"""The evidence queries on the test tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewright.functions import exprs as X
from casewright.operators import audit, entities, evidence, intake, keyword, persons, report, search, timeline
from casewright.plans.oracles import SQL
from casewright.sources import scratch, table
from casewright.sources.files import in_roots
from casewright.streaming import index as stream

CASE = 2
MODEL, DIMS = "text-enc-s", 64


def _t(name):
    return lambda s, d: table(s, d, name)


ev, ch, en, pe, li, au, do, em, ca = map(_t, ("evidence", "evidencechunk", "extractedentity", "person", "personlink", "auditevent", "documents", "embeddings", "casefile"))

_indexes: dict[tuple, str] = {}


def keyword_index(s, d) -> str:
    """The keyword index of a directory, made once for each session and kept to its end, as an index is kept beside its table."""
    key = (s.sparkContext.applicationId, d)
    if key not in _indexes:
        path = scratch(s, "keywords", keep=True)
        keyword.upsert(ch(s, d), path)
        _indexes[key] = path
    return _indexes[key]


def _search(s, d, q, limit, case=None):
    return keyword.search(keyword_index(s, d), ch(s, d), ev(s, d), q, limit, case)


def _timeline(s, d, case=None):
    return timeline.timeline(ch(s, d), ev(s, d), case)


def _events(s, d, case=None):
    return _timeline(s, d, case).select("chunk_id", "evidence_id", "chunk_index", "source_location", "position", "date", "normalized_date", F.col("snippet").alias("text"))


def _query_vector(s, d):
    return em(s, d).where("vec_id = 0").select(F.col("embedding").alias("v"))


def _asked(s, d):
    """The vector of the chunk of least id that has one of the model."""
    c = ch(s, d).where((F.col("embedding_model") == MODEL) & (F.size("embedding") == DIMS))
    return [float(x) for x in c.select("id", "embedding").orderBy("id").first()["embedding"]]


def _hits(s, d, case=None):
    return search.semantic_text(ch(s, d), ev(s, d), "where was the van seen before midnight", 5, case)


def _dates(s, d):
    raw = "05/03/99 05/03/68 1/2/202 31/02/2024 13/02/99 12/25/2024 0000-01-01 2024-02-30 2024-02-29 7/8/2021 25/12/20".split()
    return s.createDataFrame([(x,) for x in raw], "raw string").select("raw", X.normalised_date(F.col("raw")).alias("normalized"))


def _answers(s, d):
    raw = ["A [_1] b [1, 2]", "[7] none", "only [1][2]", "CONTRADICTION | both", "  consistent  ", "_theשלום [__2] x", "[1,9, 3,4 , 5] end [12]", "contradiction: a | b | c\nmore", "[3]", "12 [1] .", "Consistent\nCONTRADICTION | x", ""]
    return s.createDataFrame([(x,) for x in raw], "raw string")


def _segments(s, d):
    return evidence.pack_segments(ch(s, d), ev(s, d))


def _as_files(s, d):
    """The texts of documents as files: what the file source gives for a folder that holds them."""
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 5 == 0, ".TXT").when(F.col("doc_id") % 7 == 0, ".docx").otherwise(".txt"))
    f = do(s, d).select(F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("content"), name.alias("filename"), F.concat(F.lit("/intake/"), name).alias("original_path"))
    return f.select("original_path", "filename", evidence.extension(F.col("filename")).alias("suffix"), F.length("content").cast("long").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), "content")


def _intake(s, d):
    f = _as_files(s, d)
    return f, intake.register(f, ev(s, d), CASE)


def _indexed(s, d):
    f, made = _intake(s, d)
    return intake.index(intake.extracted(f.join(made.evidence.select("id", "original_path"), "original_path")))


def _pending(s, d):
    """Files whose indexing never ended are indexed again from the texts of their chunks, joined in order."""
    wait = intake.pending(ev(s, d)).select("id", "filename")
    whole = ch(s, d).where("text is not null").groupBy("evidence_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "id", "text"))), lambda x: x["text"]), " ").alias("text"))
    t = wait.join(whole.withColumnRenamed("evidence_id", "id"), "id", "left").select("id", F.lit("text").alias("method"), "text", F.lit(None).cast(intake.SEGMENTS).alias("segments"))
    return intake.with_status(ev(s, d), intake.index(t).status)


def _sections(s, d):
    return report.sections(CASE, ev(s, d), ch(s, d), en(s, d), au(s, d))


def _report_page(s, d):
    parts = _sections(s, d)
    out = None
    for k, name in enumerate(("evidence", "timeline", "entities", "audit")):
        r = report.rows(parts[name]).select(F.lit(k).alias("section"), "row")
        out = r if out is None else out.unionByName(r)
    return out


def _deleted(s, d):
    gone = ev(s, d).where("status = 'text_extraction_failed' or id = 7").select("id")
    out = None
    for name, t in zip(("evidence", "evidencechunk", "extractedentity"), intake.delete(ev(s, d), ch(s, d), en(s, d), gone)):
        r = t.agg(F.count("*").alias("remaining")).select(F.lit(name).alias("tbl"), "remaining")
        out = r if out is None else out.unionByName(r)
    return out


def _migrated(s, d):
    old = ch(s, d).select("id", "evidence_id", "text")
    return intake.migrated(old, "evidencechunk").select("id", "embedding_model", "embedding_dimension", "embedding_version")


def _edited(s, d):
    """The log with one row in a hundred edited in place."""
    return au(s, d).withColumn("details_json", F.when(F.col("id") % 100 == 50, F.concat("details_json", F.lit(" "))).otherwise(F.col("details_json")))


def _person_changes(s, d):
    p = persons.update(persons.create(pe(s, d), ca(s, d), CASE, "  New Person ", "added"), 5, "Renamed", None)
    p, _ = persons.delete(p, li(s, d), 9)
    return p.select("id", "case_id", "name", "description", "in_evidence")


def _link_changes(s, d):
    new = persons.add_link(li(s, d), pe(s, d), ev(s, d), 6, "alias", " Shorty ")
    return persons.remove_link(persons.remove_link(new, 5, 4), 5, 3).select("id", "person_id", "kind", "value", "confidence")


def _vectors(s, d):
    return ch(s, d).select("id", X.serialised(F.col("embedding")).alias("csv"), X.dimension(F.col("embedding")).alias("dimension"))


def _stream_search(s, d):
    """The phrase over an index that a stream made in batches of one file."""
    root = scratch(s, "stream")
    stream.index_stream(s, f"{d}/evidencechunk.parquet*", ch(s, d).schema, f"{root}/out", f"{root}/state", 1)
    return keyword.search(f"{root}/out/keywords", ch(s, d), ev(s, d), "before the warehouse", 50).select("id", "bm25")


def _reversed_texts(s, d):
    w = F.regexp_extract_all("text", F.lit("([\u0590-\u05ff]{2,})"), F.lit(1))
    n = lambda p: F.size(F.filter(w, lambda x: x.rlike(p)))
    return ch(s, d).where("text is not null").select("id", n("^[םןףץך]").alias("starts"), n("[םןףץך]$").alias("ends"), X.looks_reversed(F.col("text")).alias("reversed"))


QUERIES = {
    "entity_counts": lambda s, d: entities.counts(en(s, d)),
    "entity_counts_by_case": lambda s, d: entities.counts(en(s, d), ev(s, d), CASE),
    "entity_graph_nodes": lambda s, d: entities.graph_nodes(en(s, d)),
    "entity_graph_edges": lambda s, d: entities.graph_edges(en(s, d)),
    "entity_graph_edges_by_case": lambda s, d: entities.edge_width(entities.graph_edges(evidence.in_case(en(s, d), ev(s, d), CASE))),
    "entity_list": lambda s, d: entities.listing(en(s, d), ch(s, d)),
    "entity_list_without_entities": lambda s, d: entities.listing(en(s, d).where("id is null"), ch(s, d)),
    "graph_layout": lambda s, d: entities.graph_layout(entities.graph_nodes(en(s, d))),
    "extract_entities": lambda s, d: entities.extract(ch(s, d)),
    "regex_entity_scan": lambda s, d: entities.extract(ch(s, d)).groupBy("label", "text").agg(F.count("*").alias("count")),
    "import_register": lambda s, d: _intake(s, d)[1].evidence.select("id", "case_id", "original_path", "stored_path", "filename", "sha256", "size_bytes", "mime_type", "status"),
    "import_duplicates": lambda s, d: _intake(s, d)[1].duplicates,
    "import_summary": lambda s, d: intake.summary(*_intake(s, d)),
    "import_status": lambda s, d: _indexed(s, d).status,
    "import_chunks": lambda s, d: _indexed(s, d).chunks.select("evidence_id", "chunk_index", "text", "source_location", "embedding_model", "embedding_dimension", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm")),
    "import_entities": lambda s, d: _indexed(s, d).entities,
    "import_roots": lambda s, d: ev(s, d).select("id", in_roots(F.col("original_path"), ["/intake/box3", "/intake/box12/"]).alias("allowed")),
    "resume_pending": lambda s, d: _pending(s, d).select("id", "status"),
    "reindex_reset": lambda s, d: intake.reset(ev(s, d), 7).select("id", "status"),
    "evidence_delete": _deleted,
    "column_migration": _migrated,
    "case_create": lambda s, d: intake.create_case(ca(s, d), "  New case ").select("id", "name"),
    "case_page": lambda s, d: evidence.page(ca(s, d).select("id", "name"), limit=10, offset=2),
    "evidence_listed": lambda s, d: evidence.as_listed(ev(s, d)),
    "evidence_photos": lambda s, d: evidence.photos(ev(s, d)).select("id", "filename", "mime_type"),
    "evidence_dedupe": lambda s, d: evidence.dedupe(ev(s, d)),
    "folder_import_summary": lambda s, d: evidence.folder_summary(ev(s, d)),
    "evidence_by_id": lambda s, d: ev(s, d).where("id = 7").select("id", "case_id", "filename", "sha256", "status"),
    "evidence_page": lambda s, d: evidence.page(ev(s, d).select("id", "filename", "status"), limit=100, offset=50),
    "index_status": lambda s, d: evidence.index_status(ev(s, d), ch(s, d)),
    "chunk_documents": lambda s, d: evidence.chunk_documents(do(s, d)),
    "segment_packing": _segments,
    "integrity_check": lambda s, d: evidence.integrity(ev(s, d)),
    "integrity_summary": lambda s, d: evidence.integrity_counts(evidence.integrity(ev(s, d))),
    "status_counts": lambda s, d: evidence.status_counts(ev(s, d)),
    "case_delete_cascade": lambda s, d: evidence.delete_case(CASE, ev(s, d), ch(s, d), en(s, d), pe(s, d), li(s, d)),
    "person_delete_cascade": lambda s, d: evidence.delete_person(5, li(s, d)).select("id", "person_id", "kind"),
    "timeline": lambda s, d: _events(s, d),
    "timeline_by_case": lambda s, d: _events(s, d, CASE),
    "timeline_page": lambda s, d: timeline.ordered(_events(s, d)).offset(20).limit(100),
    "date_normalization": _dates,
    "keyword_index": lambda s, d: keyword.statistics(s, keyword_index(s, d)),
    "keyword_search_bm25": lambda s, d: _search(s, d, "before the warehouse", 50),
    "keyword_search_by_case": lambda s, d: _search(s, d, "the witness", 20, CASE),
    "keyword_search_like": lambda s, d: keyword.contains(ch(s, d), ev(s, d), " Motor_ycle ", 100),
    "keyword_search_like_by_case": lambda s, d: keyword.contains(ch(s, d), ev(s, d), "the%gate", 100, CASE),
    "semantic_search": lambda s, d: search.semantic(em(s, d), _query_vector(s, d), 10),
    "semantic_search_chunks": lambda s, d: search.semantic_hits(ch(s, d), ev(s, d), _asked(s, d), MODEL, 20),
    "semantic_search_by_case": lambda s, d: search.semantic_hits(ch(s, d), ev(s, d), _asked(s, d), MODEL, 20, CASE),
    "semantic_search_text": lambda s, d: search.semantic_text(ch(s, d), ev(s, d), "the witness saw a white van near the warehouse", 20),
    "contradiction_pairs": lambda s, d: search.contradictions(em(s, d), 0.3),
    "contradiction_pairs_all": lambda s, d: search.contradictions(em(s, d), 0.3, None, 50),
    "contradiction_texts": lambda s, d: search.find_contradictions(ch(s, d), ev(s, d), 0.5, 20, None, MODEL).drop("a", "b"),
    "contradiction_texts_by_case": lambda s, d: search.find_contradictions(ch(s, d), ev(s, d), 0.3, 20, CASE, MODEL, None).drop("a", "b"),
    "ask_citations_only": lambda s, d: search.answer("where was the van seen before midnight", _hits(s, d)),
    "ask_by_case": lambda s, d: search.answer("where was the van seen before midnight", _hits(s, d, CASE)),
    "ask_without_question": lambda s, d: search.answer("  ", _hits(s, d)),
    "answer_excerpts": lambda s, d: search.excerpts(_hits(s, d)),
    "hash_embedding": lambda s, d: search.hash_embedding(ch(s, d)),
    "clean_answer": lambda s, d: _answers(s, d).select("raw", search.clean_answer(F.col("raw")).alias("clean")),
    "has_prose": lambda s, d: _answers(s, d).select("raw", search.has_prose(F.col("raw")).alias("prose")),
    "verdict_parse": lambda s, d: _answers(s, d).select("raw", search.verdict(F.col("raw")).alias("verdict"), search.explanation(F.col("raw")).alias("explanation")),
    "answer_language": lambda s, d: _answers(s, d).select("raw", X.answers_in_hebrew(F.col("raw")).alias("hebrew")),
    "person_nested": lambda s, d: persons.nested(pe(s, d), li(s, d), CASE).select("id", "case_id", "name", "description", "in_evidence", F.to_json("links", {"ignoreNullFields": "false"}).alias("links")),
    "person_changes": _person_changes,
    "link_changes": _link_changes,
    "person_list": lambda s, d: persons.listing(pe(s, d), li(s, d)),
    "person_graph_nodes": lambda s, d: pe(s, d).where(F.col("case_id") == CASE).select("id", "name", "in_evidence"),
    "person_graph_edges": lambda s, d: persons.graph_edges(pe(s, d), li(s, d)),
    "phone_suggestions": lambda s, d: persons.phone_suggestions(pe(s, d), li(s, d), ch(s, d), ev(s, d)),
    "alias_suggestions": lambda s, d: persons.alias_suggestions(pe(s, d), li(s, d), en(s, d), ev(s, d)),
    "link_validation": lambda s, d: persons.valid_link(li(s, d), pe(s, d), ev(s, d)),
    "audit_chain_verify": lambda s, d: audit.verify(au(s, d)),
    "audit_chain_tampered": lambda s, d: audit.verify(au(s, d).where("id % 97 <> 0")),
    "audit_chain_edited": lambda s, d: audit.verify(_edited(s, d)),
    "audit_chain_build": lambda s, d: audit.build(au(s, d)),
    "audit_page": lambda s, d: evidence.page(au(s, d).dropDuplicates(["id"]).select("id", "event_type", "evidence_id"), limit=100, offset=10, descending=True),
    "report_evidence": lambda s, d: _sections(s, d)["evidence"],
    "report_timeline": lambda s, d: _sections(s, d)["timeline"],
    "report_entities": lambda s, d: _sections(s, d)["entities"],
    "report_audit": lambda s, d: _sections(s, d)["audit"],
    "report_page": _report_page,
    "html_escape": lambda s, d: li(s, d).select("id", X.html_escape(F.concat(F.lit("<b>'"), "value", F.lit("' & \"</b>"))).alias("html")),
    "human_size": lambda s, d: ev(s, d).select("id", X.human_size(F.col("size_bytes")).alias("size")),
    "rtl_detection": _reversed_texts,
    "vector_csv": _vectors,
    "vector_round_trip": lambda s, d: _vectors(s, d).select("id", F.round(F.aggregate(X.deserialised(F.col("csv")), F.lit(0.0), lambda a, x: a + x), 3).alias("sum"), F.size(X.deserialised(F.col("csv"))).alias("n")),
    "time_format": lambda s, d: ev(s, d).select("id", X.minutes_seconds(F.col("size_bytes") / 7).alias("mmss")),
    "role_text": lambda s, d: pe(s, d).select("id", X.role_text(F.col("name"), "query", "multilingual-e5-small").alias("query"), X.role_text(F.col("name"), "passage", "multilingual-e5-small").alias("passage"), X.role_text(F.col("name"), "query", "other").alias("raw")),
    "mime_guess": lambda s, d: ev(s, d).select("id", X.mime_type(F.col("filename")).alias("mime")),
    "table_display": lambda s, d: evidence.as_listed(ev(s, d)).select("id", X.shown_type(F.col("mime_type")).alias("type"), X.shown_time(F.col("imported_at")).alias("shown")),
    "preview_needle": lambda s, d: _events(s, d, CASE).select("chunk_id", "position", X.needle(F.col("text")).alias("needle")),
    "json_rows": lambda s, d: en(s, d).select("id", F.to_json(F.struct("text", "label"), {"ignoreNullFields": "false"}).alias("json")),
    "stream_index": stream.indexed_counts,
    "stream_keywords": _stream_search,
}
