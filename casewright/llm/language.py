"""Problem 5: missing or wrong document language labels.

Rank-order profiles: the most frequent character n-grams (1 to 4) of each language in order of rank; a
text is compared by the out-of-place distance of its own ranking. Profiles are fitted on a bounded
sample of chunks by their declared language, in two passes: after the first, every sentence counts for the
language it was found to be in, so that wrong labels and foreign stretches leave the profiles.

A chunk is cut into sentences; each gets the language of the least distance and a confidence (the gap to the next
language, as a share of that distance). Words that tell nothing about a language (names and other
capitalised words inside a sentence, numbers, addresses, codes) are left out of the comparison, so sentences
that differ only in them are compared once per worker (a memo of bounded size; its size changes no result).

Scale: one pass over the chunks in Arrow batches without a shuffle of text; the label table (id, code) is joined
after the text is gone. The sample is chosen on the label table alone by a hash of the id.

Edge cases: null, blank and letterless text has no segments; a sentence of fewer than MIN_LETTERS comparable letters tells too
little to be a chunk's language (it has its segment and confidence all the same). `und`, empty and null labels declare nothing.
Codes are compared by their language (iw = he, fre = fra = fr, en_GB = en). Chunks kept twice count each.
"""

from __future__ import annotations

import itertools
from collections import Counter
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.sources import spread_out

LANGUAGES = ("en", "he", "ru", "uk", "fr", "de", "es")
# ISO 639 codes of the seven languages, old and three-letter forms.
CODES = {
    "en": "en", "eng": "en", "he": "he", "heb": "he", "iw": "he", "ru": "ru", "rus": "ru", "uk": "uk", "ukr": "uk",
    "fr": "fr", "fra": "fr", "fre": "fr", "de": "de", "deu": "de", "ger": "de", "es": "es", "spa": "es",
}
# Languages by script.
BY_SCRIPT = {"latin": ("en", "fr", "de", "es"), "cyrillic": ("ru", "uk"), "hebrew": ("he",)}

SAMPLE_PER_LANGUAGE = 300
PROFILE_SIZE = 1500
MIN_LETTERS = 12
UNSURE = 0.12
MIN_CONFIDENCE = 0.04

_TERMINAL = tuple(a + b for a in ".!?…" for b in ("", '"', "”", "»", "'", ")", "’"))
_SCRIPTS = {"latin": regex.compile(r"\p{Script=Latin}"), "cyrillic": regex.compile(r"\p{Script=Cyrillic}"), "hebrew": regex.compile(r"\p{Script=Hebrew}")}
_LINE_HYPHEN = regex.compile(r"(?<=\p{L})[-­]\s*\n\s*(?=\p{Ll})")
_END = regex.compile(r"(?<=[.!?…:;])[\"»”')\]]*\s+|\n\s*\n")
# Abbreviations that a name or number follows, and such as may also end a sentence.
LEADS = "dr|mr|mrs|ms|prof|no|nr|st|hr|fr|sr|sra|m|mme|mlle|av|avda|c|p|s|pl|pza|pág|vs|v|ул|вул|просп|пер|пров|бул|пл|д|кв|буд|г|гр|стр|ст|п|рис|г-н|г-жа|רח|שד|עמ|גב|מר|טל|тел|tel"
ENDS = "rd|ave|ltd|inc|co|corp|eng|ins|str|sq|ln"
_LEAD = regex.compile(rf"(?:^|[\s(])(?:\p{{Lu}}|{LEADS})['’׳]?\.$|^\d+\.$", regex.I)
_MAY_END = regex.compile(rf"[\s(](?:{ENDS})\.$", regex.I)
_STREET = regex.compile(r"\d[^.]*\sSt\.$")
_WORD = regex.compile(r"[\p{L}\p{M}][\p{L}\p{M}'’׳״-]*")
_MAIL = regex.compile(r"[\w.+-]+\s*(?:@|[(\[]\s*at\s*[)\]])\s*[\w-]+(?:\s*(?:\.|\bdot\b)\s*[\w-]+)*", regex.I)
_OTHER = regex.compile(r"[\d@_/]")


def declared(code: Column) -> Column:
    """The language a code declares, null where it declares none of the seven."""
    main = F.lower(F.regexp_extract(F.trim(code), r"^([A-Za-z]+)", 1))
    return F.create_map(*(F.lit(x) for x in itertools.chain(*CODES.items())))[main]


def sentences(text: str) -> list[str]:
    """The sentences of a text: line breaks inside a paragraph are blanks, a word divided at a line end is joined,
    and a piece that ends in an abbreviation or is too short to be a sentence goes to the next."""
    text = _LINE_HYPHEN.sub("", text)
    out, held, at = [], "", 0
    for m in itertools.chain(_END.finditer(text), [None]):
        piece, gap = (text[at:], "\n\n") if m is None else (text[at : m.start()], m[0])
        at = len(text) if m is None else m.end()
        held = f"{held} {piece.strip()}".strip() if held else piece.strip()
        goes_on = text[at : at + 1].islower() or text[at : at + 1].isdigit()
        whole = held.endswith((".", "!", "?", "…"))
        if whole and held[-1] == "." and len(held[-8:].split()[-1]) <= 6:
            tail = held[-60:]
            lead = _LEAD.search(tail) and not (_STREET.search(tail) and not goes_on)
            whole = not lead and not (goes_on and _MAY_END.search(tail))
        if whole or gap.count("\n") > 1:
            if held:
                out.append(" ".join(held.split()))
            held = ""
    if held:
        out.append(" ".join(held.split()))
    return out


def core(sentence: str, first: bool = False) -> str:
    """The words that tell of a language: without numbers, codes, addresses of mail, and capitalised words (but
    the first, if asked); lower-cased. Where most words are capitals, all are kept."""
    if "@" in sentence or "at)" in sentence or "at]" in sentence or "AT)" in sentence:
        sentence = _MAIL.sub(" ", sentence)
    words = _WORD.findall(" ".join([t for t in sentence.split() if t.isalpha() or not _OTHER.search(t)]))
    small = [w for i, w in enumerate(words) if not w[0].isupper() or first and i == 0]
    if len(small) < 3:
        small = words if sum(w.isupper() for w in words if len(w) > 1) > len(words) / 2 else small
    return " ".join(w.lower() for w in small)


def grams(text: str) -> Counter:
    padded = f" {text} "
    return Counter(padded[i : i + n] for n in (1, 2, 3, 4) for i in range(len(padded) - n + 1) if padded[i : i + n] != " ")


def ranking(counts: Counter, size: int | None = None) -> list[str]:
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:size]]


def script_of(text: str) -> str | None:
    n = {s: len(p.findall(text)) for s, p in _SCRIPTS.items()}
    best = max(n, key=n.get)
    return best if n[best] else None


def distances(text: str, profiles: dict[str, dict[str, int]], size: int = PROFILE_SIZE) -> dict[str, float]:
    """Mean out-of-place distance to each language of the text's script, between 0 and 1."""
    script = script_of(text)
    languages = [x for x in BY_SCRIPT.get(script, ()) if x in profiles]
    own = ranking(grams(text))
    if not own:
        return {}
    out = {}
    for x in languages:
        p = profiles[x]
        out[x] = sum(min(abs(p[g] - i), size) if g in p else size for i, g in enumerate(own)) / (size * len(own))
    return out


class Detector:
    """Finds the language of sentences by given profiles."""

    def __init__(self, profiles: dict[str, list[str]], memo: int = 200_000):
        self.profiles = {x: {g: i for i, g in enumerate(p)} for x, p in profiles.items()}
        self.of_core = lru_cache(maxsize=memo)(self._of_core)
        self.of_sentence = lru_cache(maxsize=memo // 2)(self._of_sentence)

    def _of_core(self, text: str) -> tuple[str | None, float]:
        d = sorted((v, k) for k, v in distances(text, self.profiles).items())
        if not d:
            return None, 0.0
        if len(d) == 1:
            return d[0][1], 1.0
        return d[0][1], float((d[1][0] - d[0][0]) / max(d[1][0], 1e-9))

    def _of_sentence(self, sentence: str) -> tuple[str | None, float, int]:
        """(language, confidence, letters compared)."""
        c = core(sentence)
        if not c:
            return None, 0.0, 0
        lang, sure = self.of_core(c)
        if sure < UNSURE:
            lang, sure = self._of_core(core(sentence, first=True))
        return lang, sure, len(c) - c.count(" ")

    def segments(self, text: str) -> list[tuple[int, str, float, int, str]]:
        """(number, language, confidence, letters, sentence) of each sentence that can be told."""
        out = []
        for i, s in enumerate(sentences(text)):
            if s.endswith(_TERMINAL):
                lang, sure, letters = self.of_sentence(s)
                if lang:
                    out.append((i, lang, sure, letters, s))
        return out


def profiles_of(sample: pd.DataFrame, passes: int = 2, size: int = PROFILE_SIZE) -> dict[str, list[str]]:
    """Profiles from a bounded sample (lang, text)."""
    seen = Counter((r.lang, c) for r in sample.itertuples() for s in sentences(r.text or "") if len(c := core(s)) >= MIN_LETTERS)
    rows = sorted((x, c, n) for (x, c), n in seen.items() if x in BY_SCRIPT.get(script_of(c), ()))
    owner = [x for x, *_ in rows]
    profiles: dict[str, list[str]] = {}
    for turn in range(passes + 1):
        counts = {x: Counter() for x in sorted(set(owner))}
        for x, (_, c, n) in zip(owner, rows):
            for g, k in grams(c).items():
                counts[x][g] += k * n
        profiles = {x: ranking(n, size) for x, n in counts.items()}
        if turn < passes:
            find = Detector(profiles)
            owner = [find.of_core(c)[0] for _, c, _ in rows]
    return profiles


def fit(chunks: DataFrame, labels: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> dict[str, list[str]]:
    """Profiles from at most per_language declared chunks of each language, chosen by a hash of the id. What
    reaches the driver is bounded: seven languages times per_language chunks."""
    w = Window.partitionBy("lang").orderBy(F.xxhash64("chunk_id"), "chunk_id")
    near = labels.select("chunk_id", declared(F.col("lang")).alias("lang")).where("lang is not null")
    chosen = near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_language).select(F.col("chunk_id").alias("id"), "lang")
    sample = chunks.where("text is not null").select("id", "text").join(F.broadcast(chosen), "id").select("lang", "text").toPandas()
    return profiles_of(sample)


def segments(chunks: DataFrame, profiles: dict[str, list[str]]) -> DataFrame:
    """(chunk_id, segment, lang, confidence, letters, text) for every sentence of every chunk."""

    def run(batches):
        find = Detector(profiles)
        for d in batches:
            rows = [(i, *s) for i, t in zip(d["chunk_id"], d["text"]) for s in find.segments(t)]
            yield pd.DataFrame(rows, columns=["chunk_id", "segment", "lang", "confidence", "letters", "text"])

    src = spread_out(chunks.where("text is not null and id is not null").select(F.col("id").alias("chunk_id"), "text"))
    return src.mapInPandas(run, "chunk_id long, segment int, lang string, confidence double, letters int, text string")


def chunk_languages(chunks: DataFrame, profiles: dict[str, list[str]], min_letters: int = MIN_LETTERS, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(chunk_id, lang, confidence, share): the languages a chunk has at least one whole sentence in, with the
    surest sentence's confidence and the language's share of the letters."""

    def run(batches):
        find = Detector(profiles)
        for d in batches:
            rows = []
            for i, t in zip(d["chunk_id"], d["text"]):
                seen: dict[str, list] = {}
                total = 0
                for _, lang, sure, letters, _ in find.segments(t):
                    total += letters
                    if letters >= min_letters and sure >= min_confidence:
                        x = seen.setdefault(lang, [0.0, 0])
                        x[0] = max(x[0], sure)
                        x[1] += letters
                rows += [(i, lang, sure, n / total) for lang, (sure, n) in seen.items()]
            yield pd.DataFrame(rows, columns=["chunk_id", "lang", "confidence", "share"])

    src = spread_out(chunks.where("text is not null and id is not null").select(F.col("id").alias("chunk_id"), "text"))
    return src.mapInPandas(run, "chunk_id long, lang string, confidence double, share double")


def found(chunks: DataFrame, labels: DataFrame) -> DataFrame:
    """(chunk_id, lang) of every language found that the label does not declare."""
    have = chunk_languages(chunks, fit(chunks, labels))
    said = labels.select("chunk_id", declared(F.col("lang")).alias("lang")).where("lang is not null")
    return have.select("chunk_id", "lang").distinct().join(said, ["chunk_id", "lang"], "left_anti")
