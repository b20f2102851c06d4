"""The pN_ queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from casewright.llm import cooccur, language, mixing, names, neighbours, packing, plainform, privacy, scans, sizes, stuffed
from casewright.sources import materialise, table


#: The false discovery rate that p7_surprise marks.
DISCOVERY = 0.05


#: The vocabulary file the sizes of the queries are counted with.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


def p7_found(spark, d):
    pairs = cooccur.cooccurrence(table(spark, d, "extractedentity"), table(spark, d, "evidence"))
    return pairs.select(*cooccur.PAIR_COLUMNS)


def p7_surprise(spark, d):
    pairs = cooccur.cooccurrence(table(spark, d, "extractedentity"), table(spark, d, "evidence"), min_lift=0.0, ranks=True)
    return pairs.select(*cooccur.PAIR_COLUMNS, "n_a", "n_b", "n_ab", "n", *(F.round(c, 6).alias(c) for c in ("lift", "expected", "p_value", "q_value")), (F.col("q_value") <= DISCOVERY).alias("discovery"))


def p2_found(spark, d):
    return plainform.found(table(spark, d, "extractedentity"), table(spark, d, "person"))


def p6_found(spark, d):
    return scans.found(table(spark, d, "evidencechunk"), table(spark, d, "evidence"))


def p6_paragraphs(spark, d):
    return scans.paragraphs(table(spark, d, "evidencechunk"), table(spark, d, "evidence"))


def p5_found(spark, d):
    return language.found(table(spark, d, "evidencechunk"), table(spark, d, "chunklang"))


def p5_segments(spark, d):
    chunks = table(spark, d, "evidencechunk")
    found = language.segments(chunks, language.fit(chunks, table(spark, d, "chunklang")))
    return found.select("chunk_id", "segment", "lang", F.round("confidence", 6).alias("confidence"), "letters")


def p10_found(spark, d):
    return stuffed.found(table(spark, d, "documents"))


def p10_curves(spark, d):
    p = stuffed.pages(table(spark, d, "documents"))
    return p.select("doc_id", "grp", "tokens", *(F.round(c, 6).alias(c) for c in ("slope", "residual", "divergence", "share")), "flag")


def p3_found(spark, d):
    return neighbours.mutual_pairs(table(spark, d, "evidencechunk")).select("chunk_a", "chunk_b")


def p3_nearest(spark, d):
    return neighbours.nearest(table(spark, d, "evidencechunk")).withColumn("cosine", F.round("cosine", 5))


def _classes(spark, d):
    return names.classes(*(table(spark, d, t) for t in ("person", "personlink", "extractedentity", "evidence", "nickname")))


def p4_found(spark, d):
    return names.linked_pairs(_classes(spark, d))


def p4_classes(spark, d):
    of = _classes(spark, d)
    size = F.count("*").over(Window.partitionBy("case_id", "label"))
    first = F.min("name").over(Window.partitionBy("case_id", "label"))
    return of.select("case_id", "name", "kind", first.alias("class_of"), (size - 1).alias("links")).where("links > 0")


def p1_found(spark, d):
    return privacy.found(table(spark, d, "evidencechunk"), table(spark, d, "extractedentity"))


def p1_redacted(spark, d):
    return privacy.redacted(table(spark, d, "evidencechunk"), table(spark, d, "extractedentity"))


STANDARD = 2  # container_id


def _capacity(spark, d):
    return int(table(spark, d, "container").where(F.col("container_id") == STANDARD).first()["capacity"])


def p8_pack(spark, d):
    return packing.pack(sizes.token_sizes(table(spark, d, "documents"), TOKENIZER).select("doc_id", "tokens"), _capacity(spark, d))


def p8_report(spark, d):
    return packing.report(p8_pack(spark, d), _capacity(spark, d))


def _mixed(spark, d):
    n = materialise(sizes.token_sizes(table(spark, d, "documents"), TOKENIZER))
    planned = mixing.plan(n, table(spark, d, "sourcemix"))
    return mixing.mix(n, planned), planned


def p9_mix(spark, d):
    return _mixed(spark, d)[0]


def p9_report(spark, d):
    return mixing.report(*_mixed(spark, d))


QUERIES = {"p7_found": p7_found, "p7_surprise": p7_surprise, "p2_found": p2_found, "p1_found": p1_found, "p1_redacted": p1_redacted, "p8_pack": p8_pack, "p8_report": p8_report, "p9_mix": p9_mix, "p9_report": p9_report, "p4_found": p4_found, "p4_classes": p4_classes, "p3_found": p3_found, "p3_nearest": p3_nearest, "p10_found": p10_found, "p10_curves": p10_curves, "p5_found": p5_found, "p5_segments": p5_segments, "p6_found": p6_found, "p6_paragraphs": p6_paragraphs}

P7_PAIRS = """
with i as (select distinct v.case_id, e.evidence_id, e.text, e.label from extractedentity e
           join (select distinct id, case_id from evidence where case_id is not null) v on v.id = e.evidence_id
           where e.text is not null and e.label is not null),
n as (select case_id, count(distinct evidence_id) n from i group by 1),
c as (select case_id, text, label, count(*) k from i group by all),
p as (select x.case_id, x.text text_a, x.label label_a, y.text text_b, y.label label_b, count(*) n_ab
      from i x join i y on x.evidence_id = y.evidence_id and x.case_id = y.case_id and (x.text, x.label) < (y.text, y.label) group by all having count(*) >= 4)
select p.case_id, text_a, label_a, text_b, label_b from p join n using (case_id)
join c a on a.case_id = p.case_id and a.text = text_a and a.label = label_a
join c b on b.case_id = p.case_id and b.text = text_b and b.label = label_b
where n_ab * n >= 4 * a.k * b.k
"""

SQL = {"p7_found": P7_PAIRS}
