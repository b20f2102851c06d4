"""The report of a case: its sections as tables, and the page that holds them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.functions import exprs as X
from casewright.operators import entities as E
from casewright.operators import timeline as T
from casewright.operators.audit import iso
from casewright.operators.evidence import in_case

# Headings of the page.
TITLE, ALL_CASES = "דוח חקירה", "כל התיקים"
HEADINGS = {
    "evidence": ("1. מצאי ראיות (שרשרת משמורת)", ("מזהה", "שם קובץ", "SHA256", "גודל (בייטים)", "סטטוס", "נקלט")),
    "timeline": ("2. ציר זמן", ("תאריך", "ראיה", "מיקום במקור", "הקשר")),
    "entities": ("3. ישויות מרכזיות", ("ישות", "סוג", "מופעים")),
    "audit": ("4. יומן פעולות (Audit Trail)", ("מועד", "פעולה", "ראיה")),
}
MADE, KEPT, PRINT = "הופק: ", "כל פריט ראיה מזוהה ב-SHA256 לשמירת שרשרת משמורת.", "מסמך זה הופק אוטומטית מתוך ראיות מאוחסנות בלבד. להדפסה כ-PDF: Ctrl+P."


def sections(case_id: int | None, evidence: DataFrame, chunks: DataFrame, entities: DataFrame, events: DataFrame, most: int = 50) -> dict[str, DataFrame]:
    """evidence by id, timeline in order, the most frequent entities, and the audit events of the case's evidence by id."""
    ev = evidence if case_id is None else evidence.where(F.col("case_id") == case_id)
    of = ev.select(F.col("id").alias("evidence_id")).distinct()
    scoped = lambda d: d.join(of, "evidence_id", "left_semi")
    named = (entities if case_id is None else scoped(entities)).where("text is not null and label is not null")
    return {
        "evidence": ev.orderBy("id").select("id", "filename", "sha256", "size_bytes", "status", iso(F.col("imported_at")).alias("imported_at")),
        "timeline": T.ordered(scoped(T.timeline(chunks, evidence))).select(F.coalesce("normalized_date", "date").alias("date"), "evidence_id", "source_location", F.col("snippet").alias("text")),
        "entities": E.counts(named).orderBy(F.desc("count"), "entity", "type").limit(most),
        "audit": scoped(events.dropDuplicates(["id"])).orderBy("id").select(iso(F.col("created_at")).alias("created_at"), "event_type", "evidence_id"),
    }


def rows(section: DataFrame) -> DataFrame:
    """(row): the rows of a section as escaped rows of a table, in their order."""
    cells = [F.concat(F.lit("<td>"), X.html_escape(F.col(c).cast("string")), F.lit("</td>")) for c in section.columns]
    return section.select(F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("row"))


def page(parts: dict[str, DataFrame], case_name: str | None, made_at: str, tool: str = "casewright") -> Iterable[str]:
    """The page in pieces: rows are made by the cluster and pass through the driver one partition at a time, so that a page of
    any length can be written out as it comes."""
    name = (case_name or ALL_CASES).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;").replace("'", "&#x27;")
    yield f'<!DOCTYPE html>\n<html dir="rtl" lang="he"><head><meta charset="utf-8"><title>{TITLE} — {name}</title></head><body>\n<h1>{TITLE} — {name}</h1>\n<p>{MADE}{made_at} · {tool} · {KEPT}</p>\n'
    for key, (heading, columns) in HEADINGS.items():
        yield f"<h2>{heading}</h2>\n<table>\n<tr>{''.join(f'<th>{c}</th>' for c in columns)}</tr>\n"
        for r in rows(parts[key]).toLocalIterator():
            yield r["row"] + "\n"
        yield "</table>\n"
    yield f"<p>{PRINT}</p>\n</body></html>\n"


def write(parts: dict[str, DataFrame], case_name: str | None, made_at: str, path: str) -> str:
    with open(path, "w", encoding="utf-8") as out:
        for piece in page(parts, case_name, made_at):
            out.write(piece)
    return path


__all__ = ["in_case", "page", "rows", "sections", "write"]
