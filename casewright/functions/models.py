"""Hooks for models. Every hook takes pandas series (batches of rows), so that a model is loaded once for each worker and
called on many rows; where none is given, the deterministic fallback runs inside the JVM."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd

#: Labels of a named-entity model and what they are kept as.
LABELS = {"PER": "person", "ORG": "organization", "LOC": "location", "GPE": "location", "FAC": "location", "TIMEX": "time", "TTL": "title"}


@dataclass(frozen=True)
class Models:
    """embed: texts to lists of floats; embed_name its model name. ner: texts to lists of dicts (word, score, entity_group).
    ocr: contents of images, pdf: contents of PDF files, each to text or None where reading failed. transcribe: contents of media
    files to lists of dicts (start, end, text), None where no engine is there. judge: two texts to the raw reply.
    synthesise: (question, citations) to the raw reply."""

    embed: Callable[[pd.Series], pd.Series] | None = None
    embed_name: str = ""
    ner: Callable[[pd.Series], pd.Series] | None = None
    ocr: Callable[[pd.Series], pd.Series] | None = None
    pdf: Callable[[pd.Series], pd.Series] | None = None
    transcribe: Callable[[pd.Series], pd.Series] | None = None
    judge: Callable[[pd.Series, pd.Series], pd.Series] | None = None
    synthesise: Callable[[str, list[dict]], str | None] | None = None


def kept_entities(found: list[dict], least: float = 0.5) -> list[tuple[str, str]]:
    """(text, label) of a model's entities: words of two letters or more with a score of at least `least`."""
    out = []
    for e in found or []:
        word, group = (e.get("word") or "").strip(), e.get("entity_group") or ""
        if len(word) >= 2 and float(e.get("score", 0.0)) >= least:
            out.append((word, LABELS.get(group, group.lower() or "other")))
    return out
