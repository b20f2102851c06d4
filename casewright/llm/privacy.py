"""Problem 1: personal information inside free text.

A character-level bidirectional LSTM with CRF transitions (tagger.py) tags e-mail addresses, phone and identity numbers,
street addresses and names; spans are snapped to whole words, freed of titles and lead-ins, checked exactly (the check
digit of identity numbers, the digits of a phone number) and replaced by placeholders of their kind.

Training data are labelled spans: mentions of extractedentity, by their labels, located in the chunk they come from, and
the entity values themselves. The sample is bounded (TRAIN_CHUNKS chunks, TRAIN_VALUES values); `python -m
casewright.llm.privacy DIR` trains and writes the weights beside this module.

Scale: one narrow pass in Arrow batches; equal values of the two entity columns are grouped before, so that a value
with a tenth of all rows is tagged once. The weights (under 300 KB) are read by each worker.

Edge cases: null and empty text has no spans; text of any length is tagged whole, in overlapping windows; equal texts get
equal spans.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.llm import plainform
from casewright.llm.tagger import GROUP_CHARS, KINDS, Tagger, code_points, joined, one_thread
from casewright.sources import spread_out

WEIGHTS = str(Path(__file__).with_name("privacy_weights.npz"))
TRAIN_CHUNKS = 2500
TRAIN_VALUES = 9000

# Words before a name or number that are not part of it.
TITLES = (
    "mr mrs ms miss dr prof witness suspect officer herr frau mme mlle sr sra srta don doña г-н г-жа гражданин гражданка господин госпожа свидетель "
    "пан пані свідок громадянин громадянка д-р מר גב גב' גברת דר ד\"ר עד עדה tel phone тел טל טל' name"
).split()

class _Characters(dict):
    """Whether a character is of a class, by the expression of the class where it was not seen before."""

    def __init__(self, expression: str):
        self.match = regex.compile(expression).match

    def __missing__(self, c: str) -> bool:
        self[c] = known = self.match(c) is not None
        return known


_WORDCHAR, _NUMBER, _LOCAL = _Characters(r"[\p{L}\p{M}\p{N}\p{Cf}]"), _Characters(r"\p{N}"), _Characters(r"[\w.+\-]")
_TITLE = regex.compile(rf"^(?:{'|'.join(sorted(map(regex.escape, TITLES), key=len, reverse=True))})(?:[.:'’׳]+\s*|\s+)", regex.I)
_MAIL = regex.compile(r"[\w.+\-]+\s*(?:@|[(\[]\s*at\s*[)\]])\s*[\w\-]+(?:\s*(?:\.|\bdot\b)\s*[\w\-]+)+", regex.I)
_PHONE = regex.compile(r"(?<![\w+(])(?:\+?972[\s.\-]?5\d|\(\d{3}\)|\+\d{1,3}|0\d{2,4})(?:[\s.\-]?\d){6,11}(?!\d)")
_ID = regex.compile(r"(?<![\d\-])\d(?:[\s\-]?\d){8}(?![\d])")


_FRENCH = regex.compile(r"\b(?:le|la|les|des|une|est|et|du|au|avec|dans|nie|avoir|que)\b")
_PAYMENT = regex.compile(r"(?:payment|paiement|pago|zahlung|плат[её]ж|платіж|תשלום)\S*\s+(?:\S+\s+)?$", regex.I)
_INVISIBLE = regex.compile(f"[{plainform.INVISIBLE}]")
_UNUSUAL = regex.compile(f"[{plainform.INVISIBLE}{plainform.SPACES}{plainform.HYPHENS}\\uff01-\\uff5e\\p{{Script=Greek}}]|\\p{{Latin}}\\p{{Cyrillic}}|\\p{{Cyrillic}}\\p{{Latin}}")
_ODD, _LATIN, _CYRILLIC = (regex.compile(x) for x in (f"[{plainform.INVISIBLE}{plainform.SPACES}{plainform.HYPHENS}\\uff01-\\uff5e\\p{{Script=Greek}}]", r"\p{Latin}", r"\p{Cyrillic}"))
_DECIMAL = re.compile(r"\d")  # what str.isdecimal holds for; regex knows digits of newer scripts that int does not
_TOKEN = regex.compile(r"[\p{L}\p{M}]+")
_FIRST_DIGIT = regex.compile(r"[+(]?\p{N}")
_INITIAL_BEFORE = regex.compile(r"(?<![\p{L}\p{N}.])[\p{Lu}א-ת]\.\s?$")
_MIDDLE_INITIAL, _GIVEN_BEFORE = regex.compile(r"\p{Lu}\.\s?\p{Lu}"), regex.compile(r"(?<![\p{L}.])\p{Lu}\p{Ll}{2,}\s$")
_AT, _M_DOT = regex.compile(r"@|\bat\b|＠", regex.I), regex.compile(r"M\.\s+")


@lru_cache(maxsize=4096)
def _looks(c: str) -> str:
    p = plainform.ordinary(c)
    return p if len(p) == 1 else c


@lru_cache(maxsize=65536)
def _one_script(token: str) -> str:
    return next((r for r in plainform.readings(token) if len(r) == len(token)), token)


@lru_cache(maxsize=1)
def _signs() -> np.ndarray:
    """1 for the single characters of _UNUSUAL, 2 Latin, 4 Cyrillic, for every character of the first plane."""
    signs, plane = np.zeros(0x10000, np.uint8), "".join(map(chr, range(0x10000)))
    for bit, kind in ((1, _ODD), (2, _LATIN), (4, _CYRILLIC)):
        signs[[m.start() for m in kind.finditer(plane)]] |= bit
    return signs


def unusual(text: str) -> bool:
    """Whether _UNUSUAL is found, read from a table where all characters are of the first plane."""
    c = code_points(text)
    if len(c) and c.max() > 0xFFFF:
        return _UNUSUAL.search(text) is not None
    s = _signs()[c]
    return bool((s & 1).any() or ((s[1:] | s[:-1]) == 6).any())


def any_unusual(texts: list[str]) -> list[int]:
    """The places of the texts that plain_view may change: all texts are read at once, only few of them on their own."""
    out, group, chars, done = [], [], 0, 0
    for t in [*texts, None]:
        if group and (t is None or chars + len(t) > GROUP_CHARS):
            c, starts, ends = joined(group)
            s = _signs()[np.minimum(c, 0xFFFF)]
            signs = (s & 1).astype(bool) | (c > 0xFFFF)
            signs[1:] |= (s[1:] | s[:-1]) == 6
            out += (done + np.unique(np.searchsorted(ends, np.flatnonzero(signs)))).tolist()
            done += len(group)
            group, chars = [], 0
        if t is not None:
            group.append(t)
            chars += len(t)
    return out


def plain_view(text: str) -> tuple[str, list[int] | None]:
    """The text as it looks (problem 2), character for character, and where each character stood; None if unchanged."""
    if text.isascii() or not unusual(text):
        return text, None
    hidden = {m.start() for m in _INVISIBLE.finditer(text)}
    at = [i for i in range(len(text)) if i not in hidden]
    s = "".join([_looks(text[i]) for i in at])
    return _TOKEN.sub(lambda m: _one_script(m[0]), s), at


def check_digit(digits: str) -> bool:
    """The check of the Israeli identity number over nine digits."""
    total = 0
    for i, c in enumerate(digits):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return len(digits) == 9 and total % 10 == 0


def digits_of(text: str) -> str:
    return "".join([str(int(c)) for c in _DECIMAL.findall(text)])


def snapped(text: str, a: int, b: int, kind: str) -> tuple[int, int] | None:
    """The exact piece of a tagged stretch, or None where the check of its kind fails."""
    inside = _WORDCHAR if kind in ("name", "address") else _NUMBER if kind in ("phone", "identity") else _LOCAL
    while a > 0 and inside[text[a - 1]] and inside[text[a]]:
        a -= 1
    while b < len(text) and inside[text[b]] and inside[text[b - 1]]:
        b += 1
    while a < b and (text[a].isspace() or text[a] in ".,;:-–—'\"«»“”*" or (text[a] in ")]" or text[a] == "(" and kind != "phone")):
        a += 1
    while b > a and (text[b - 1].isspace() or text[b - 1] in ",;:-–—\"«»“”*("):
        b -= 1
    if kind in ("phone", "identity"):
        m = _FIRST_DIGIT.search(text[a:b])
        if not m:
            return None
        a += m.start()
        if kind == "phone" and text[a].isdecimal() and a > 0 and text[a - 1] in "+(＋（":
            a -= 1
    elif kind == "name":
        while m := _TITLE.match(text[a:b]) or _monsieur(text, a, b):
            a += m.end()
        if (m := _INITIAL_BEFORE.search(text[max(0, a - 4) : a])) and not _monsieur(text, a - len(m[0]), b):
            a -= len(m[0])
        # A given name before a middle initial.
        if _MIDDLE_INITIAL.match(text[a:b]) and (m := _GIVEN_BEFORE.search(text[max(0, a - 20) : a])) and not _TITLE.match(m[0]):
            a -= len(m[0])
    if a >= b:
        return None
    piece = text[a:b]
    if kind == "email":
        good = _AT.search(piece) and len(piece) >= 6
    elif kind == "phone":
        good = 9 <= len(_DECIMAL.findall(piece)) <= 13
    elif kind == "identity":
        good = check_digit(digits_of(piece))
    else:
        letters, n = sum(map(str.isalpha, piece)), _DECIMAL.search(piece)
        good = n and letters >= 3 if kind == "address" else letters >= 2 and not n
    return (a, b) if good else None


def _monsieur(text: str, a: int, b: int):
    """M. before a name in French text is a title, elsewhere an initial."""
    m = _M_DOT.match(text[a:b])
    return m if m and len(_FRENCH.findall(text[max(0, a - 90) : b + 90])) >= 2 else None


def find(model: Tagger, texts: list[str]) -> list[list[tuple[int, int, str]]]:
    """The pieces of personal data of each text, with places in the text as it is stored."""
    views, places = list(texts), {}
    for i in any_unusual(texts):
        views[i], places[i] = plain_view(texts[i])
    out: list[list[tuple[int, int, str]]] = []
    for starts, ends, tags in model.groups(views):
        runs = stretches(tags)
        till = np.searchsorted(runs[0], ends).tolist()
        a, b, kinds = (r.tolist() for r in runs)
        lo = 0
        for start, hi in zip(starts.tolist(), till):
            spans = pieces_of(views[len(out)], [(a[k] - start, b[k] - start, KINDS[kinds[k]]) for k in range(lo, hi)]) if hi > lo else []
            at = places.get(len(out))
            out.append(spans if at is None else [(at[x], at[y - 1] + 1, k) for x, y, k in spans])
            lo = hi
    return out


def stretches(tags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and number of the kind of every tagged stretch."""
    at = np.flatnonzero(tags)
    inside = tags[at]
    kinds = (inside + 1) // 2  # 1 + the number of the kind; odd tags begin a piece
    first = np.ones(len(at), bool)
    first[1:] = (inside[1:] % 2 == 1) | (kinds[1:] != kinds[:-1]) | (at[1:] != at[:-1] + 1)
    last = np.ones(len(at), bool)
    last[:-1] = first[1:]
    return at[first], at[last] + 1, kinds[first] - 1


def spans_of(text: str, tags: np.ndarray) -> list[tuple[int, int, str]]:
    return pieces_of(text, [(a, b, KINDS[k]) for a, b, k in zip(*(r.tolist() for r in stretches(np.asarray(tags))))])


def pieces_of(text: str, tagged: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The exact pieces of the tagged stretches of a text."""
    out = []
    for i, j, kind in tagged:
        s = snapped(text, i, j, kind)
        if s and kind == "name" and out and out[-1][2] == "name" and 0 <= s[0] - out[-1][1] <= 2 and text[out[-1][1] : s[0]].isspace():
            out[-1] = (out[-1][0], s[1], kind)
        elif s and not (out and s[0] < out[-1][1]):
            out.append((*s, kind))
    return out


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, kind in spans:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def tagged(texts: DataFrame, weights: str = WEIGHTS) -> DataFrame:
    """texts: (key long, text). Result: (key, spans array of start, end, kind, and the text with placeholders)."""

    def run(batches):
        one_thread()
        model = Tagger.load(weights)
        for d in batches:
            known = list(d["text"])
            found = find(model, known)
            yield pd.DataFrame({"key": d["key"], "spans": [[{"start_char": a, "end_char": b, "kind": k} for a, b, k in s] for s in found], "redacted": [redact(t, s) for t, s in zip(known, found)]})

    schema = "key long, spans array<struct<start_char:long, end_char:long, kind:string>>, redacted string"
    return spread_out(texts.where("text is not null and text <> ''").select("key", "text")).mapInPandas(run, schema)


def pieces(texts: DataFrame, key: str, weights: str = WEIGHTS) -> DataFrame:
    """texts: (key, text), or (text) where that is the key. Result: (key, kind, start_char), a row for each piece and no texts."""

    def run(batches):
        one_thread()
        model = Tagger.load(weights)
        for d in batches:
            found = find(model, list(d["text"]))
            many = np.array([len(s) for s in found], np.int64)
            flat = [x for s in found for x in s]
            if flat:  # a frame without rows is not converted to Arrow
                yield pd.DataFrame({key: d[key].to_numpy().repeat(many), "kind": [k for _, _, k in flat], "start_char": np.array([a for a, _, _ in flat], np.int64)})

    return texts.where("text is not null and text <> ''").mapInPandas(run, f"{key} {texts.schema[key].dataType.simpleString()}, kind string, start_char long")


def found(chunks: DataFrame, entities: DataFrame) -> DataFrame:
    """(field, row_id, kind, start_char) of every piece of personal data."""
    c = pieces(spread_out(chunks.where("text is not null and text <> ''").select(F.col("id").alias("row_id"), "text")), "row_id")
    out = c.select(F.lit("evidencechunk.text").alias("field"), "row_id", "kind", "start_char")
    for column in ("text", "label"):
        h = entities.where(F.col(column).isNotNull()).select(F.col(column).alias("text")).distinct()
        rows = entities.select(F.col("id").alias("row_id"), F.col(column).alias("text")).distinct().join(pieces(h, "text"), "text")
        out = out.unionByName(rows.select(F.lit(f"extractedentity.{column}").alias("field"), "row_id", "kind", "start_char"))
    return out.distinct()


def tagged_values(texts: DataFrame, weights: str = WEIGHTS) -> DataFrame:
    """texts: (text). Result: (text, spans, and the text with placeholders)."""

    def run(batches):
        one_thread()
        model = Tagger.load(weights)
        for d in batches:
            known = list(d["text"])
            found = find(model, known)
            yield pd.DataFrame({"text": known, "spans": [[{"start_char": a, "end_char": b, "kind": k} for a, b, k in s] for s in found], "redacted": [redact(t, s) for t, s in zip(known, found)]})

    return texts.where("text <> ''").select("text").mapInPandas(run, "text string, spans array<struct<start_char:long, end_char:long, kind:string>>, redacted string")


def redacted(chunks: DataFrame, entities: DataFrame) -> DataFrame:
    """(field, row_id, redacted, pieces) of every text that is neither null nor empty: placeholders in all three fields."""
    c = tagged(chunks.select(F.col("id").alias("key"), "text"))
    out = c.select(F.lit("evidencechunk.text").alias("field"), F.col("key").alias("row_id"), "redacted", F.size("spans").alias("pieces"))
    for column in ("text", "label"):
        h = entities.where(F.col(column).isNotNull()).select(F.col(column).alias("text")).distinct()
        values = tagged_values(h).select("text", "redacted", F.size("spans").alias("pieces"))
        rows = entities.select(F.col("id").alias("row_id"), F.col(column).alias("text")).distinct().join(values, "text")
        out = out.unionByName(rows.select(F.lit(f"extractedentity.{column}").alias("field"), "row_id", "redacted", "pieces"))
    return out


# -- training -------------------------------------------------------------------------------------------------------


def kind_of_value(text: str, label: str | None) -> str | None:
    """The kind an entity value is labelled with, by its label and content."""
    n = digits_of(text)
    label = (label or "").lower()
    if _MAIL.search(text):
        return "email"
    if _PHONE.search(text) and not regex.search(r"\p{L}{4,}", text):
        return "phone"
    if len(n) == 9 and not regex.search(r"\p{L}", text):
        return "identity" if check_digit(n) else None
    if label in ("location", "loc") and n and regex.search(r"\p{L}{3,}", text):
        return "address"
    if label in ("person", "per", "name") and not n and "@" not in text:
        return "name"
    return None


def labelled_sample(directory: str) -> tuple[list[str], list[np.ndarray]]:
    """Labelled spans of a bounded sample of a table directory."""
    import ahocorasick
    import pyarrow.dataset as ds

    read = lambda t, c: ds.dataset(f"{directory}/{t}.parquet").to_table(columns=c).to_pandas()
    ent, ev = read("extractedentity", ["evidence_id", "text", "label"]).drop_duplicates(), read("evidence", ["id", "case_id"])
    per, chunks = read("person", ["case_id", "name"]), read("evidencechunk", ["id", "evidence_id", "text"])
    ent = ent[ent.text.notna()].merge(ev, left_on="evidence_id", right_on="id", how="left")
    word = regex.compile(r"[\p{L}\p{M}'’\-]{2,}")
    bare = _strip
    ent["kind"] = [kind_of_value(t, x) for t, x in zip(ent.text, ent.label)]
    # A word that stands in organisations or places belongs to a name only where it stands more often in persons.
    in_other, in_person = Counter(), Counter()
    for t, x in zip(ent.text, ent.label):
        if (x or "").lower() in ("organization", "organisation", "org", "location", "loc") and len(t) < 60:
            in_other.update(word.findall(t))
        elif (x or "").lower() in ("person", "per"):
            in_person.update(word.findall(bare(t)))
    in_person.update(w for t in per.name.dropna() for w in word.findall(bare(t)))
    other = {w for w, n in in_other.items() if n > in_person[w]}
    names: dict[float, set[str]] = {}
    for c, t in [*zip(ent[ent.kind == "name"].case_id, ent[ent.kind == "name"].text), *zip(per.case_id, per.name)]:
        if isinstance(t, str):
            names.setdefault(c, set()).update(w for w in word.findall(bare(t)) if w not in other)
    given = pd.Series([w for s in names.values() for w in s]).value_counts()
    common = set(given[given >= 4].index)
    streets = ahocorasick.Automaton()
    for t in ent[ent.kind == "address"].text:
        key = regex.sub(r"\d", "0", t)
        streets.add_word(key, len(key))
    streets.make_automaton()
    case = dict(zip(ev.id, ev.case_id))
    chunks = chunks[chunks.text.notna() & (chunks.text.str.len() > 40)].sample(frac=1, random_state=1).head(TRAIN_CHUNKS)
    texts, tags = [], []
    token = regex.compile(r"[\p{L}\p{M}\p{Cf}'’\-]+")
    for r in chunks.itertuples():
        y = np.zeros(len(r.text), np.int64)
        own = {w.lower() for w in names.get(case.get(r.evidence_id), set()) | common}

        def mark(a, b, kind, y=y):
            if not y[a:b].any():
                k = 1 + 2 * KINDS.index(kind)
                y[a] = k
                y[a + 1 : b] = k + 1

        for m in _MAIL.finditer(r.text):
            mark(m.start(), m.end(), "email")
        for m in _PHONE.finditer(r.text):
            mark(m.start(), m.end(), "phone")
        for m in _ID.finditer(r.text):
            if check_digit(digits_of(m[0])) and not _PAYMENT.search(r.text[max(0, m.start() - 40) : m.start()]):
                mark(m.start(), m.end(), "identity")
        flat = regex.sub(r"\d", "0", regex.sub(r"\s", " ", r.text))
        hits = sorted(((e + 1 - n, e + 1) for e, n in streets.iter(flat)), key=lambda z: z[0] - z[1])
        for a, b in hits:
            if not (flat[a - 1 : a].isalnum() or flat[b : b + 1].isalnum()):
                mark(a, b, "address")
        toks = [(m.start(), m.end(), m[0]) for m in token.finditer(r.text)]
        is_name = [t.lower() in own and len(t) > 1 and (t[0].isupper() or "א" <= t[0] <= "ת" or t.islower() and t.lower() in own and False) for _, _, t in toks]
        initial = [len(t) == 1 and (t.isupper() or "א" <= t <= "ת") and r.text[e : e + 1] == "." for _, e, t in toks]
        i = 0
        while i < len(toks):
            if is_name[i] or initial[i]:
                j = i
                while j + 1 < len(toks) and (is_name[j + 1] or initial[j + 1]) and regex.fullmatch(r"\.?,?\s{1,3}", r.text[toks[j][1] : toks[j + 1][0]]):
                    j += 1
                if any(is_name[i : j + 1]) and j - i < 4:
                    mark(toks[i][0], toks[j][1] + (1 if initial[j] else 0), "name")
                i = j + 1
            else:
                i += 1
        texts.append(r.text)
        tags.append(y)
    some = ent.drop_duplicates(["text", "label"]).sample(frac=1, random_state=2).head(TRAIN_VALUES)
    for t, kind, label in zip(some.text, some.kind, some.label):
        if kind is None and (label is None or (label or "").lower() in ("other", "person", "name", "per")):
            continue
        y = np.zeros(len(t), np.int64)
        if kind:
            m = {"email": _MAIL, "phone": _PHONE, "identity": _ID}.get(kind)
            m = m.search(t) if m else None
            a, b = (m.start(), m.end()) if m else (len(t) - len(_strip(t)), len(t)) if kind == "name" else (0, len(t))
            y[a] = 1 + 2 * KINDS.index(kind)
            y[a + 1 : b] = 2 + 2 * KINDS.index(kind)
        copies = 1
        if kind is None and (label or "").lower() in ("location", "loc", "organization", "organisation", "org"):
            copies = 6 if " " not in t else 2
        for _ in range(copies):
            texts.append(t)
            tags.append(y)
        if kind == "name" and len(texts) % 7 == 0:
            texts += [t.lower(), t.upper()] if len(t.upper()) == len(t) else [t.lower()]
            tags += [y] * (len(texts) - len(tags))
    for t in ("person", "name", "location", "organization", "date", "phone", "other", "vehicle_plate", "israeli_id", "email", "timex", "per", "loc", "org", "tel", "id", "plate", "organisation") * 6:
        for v in (t, t.upper(), t.title()):
            texts.append(v)
            tags.append(np.zeros(len(v), np.int64))
    return texts, tags


def _strip(text: str) -> str:
    while m := _TITLE.match(text):
        text = text[m.end() :]
    return text


def train(directory: str, seconds: float = 420.0, weights: str = WEIGHTS) -> Tagger:
    texts, tags = labelled_sample(directory)
    model = Tagger.fresh()
    model.train(texts, tags, epochs=9, seconds=seconds, say=lambda *a: print(*a, flush=True))
    model.save(weights)
    return model


if __name__ == "__main__":
    train(sys.argv[1])
