"""Problem 2: visually identical text with different characters.

Script-aware repair. A string is taken to compatibility width and precomposed letters, invisible
characters go, special spaces and hyphens become the plain ones; then every token that mixes
scripts is repaired: the dominant script of the token is found, and the letters of the other
scripts are replaced by their look-alikes of that script, if the result stands in the vocabulary of the
corpus. Where both directions do, the more frequent form is taken, at a tie that of the dominant script. A
token none of whose readings is known stays as it is.

Scale: rows are screened by one regular expression inside the scan stage; only distinct suspicious
strings reach Python (Arrow batches). The vocabulary is not broadcast: the readings of the mixed
tokens are few, and only they are joined with the token counts.

Edge cases: null stays null and is no case; empty and blank strings are no cases; text of any
length is handled whole. Equal strings get equal results. Extra columns pass through untouched.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.sources import materialise

# Letters that look like a Latin letter, by script (public confusables data).
CYRILLIC_LOOKS = "АаВЕеЅѕІіЈјКМНОоРрСсТУуХхԁһԛԝҮү"
CYRILLIC_AS_LATIN = "AaBEeSsIiJjKMHOoPpCcTYyXxdhqwYy"
GREEK_LOOKS = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονιαυρκϲϳ"
GREEK_AS_LATIN = "ABEZHIKMNOPTYXovιaupκcj".replace("ι", "i").replace("κ", "k")
# Latin letters and the Cyrillic letters they look like.
LATIN_LOOKS = "AaBEeSsIiJjKMHOoPpCcTYyXxkmtbn"
LATIN_AS_CYRILLIC = "АаВЕеЅѕІіЈјКМНОоРрСсТУуХхкмтьп"
LATIN_MARKED = "ËëÏï"
MARKED_AS_CYRILLIC = "ЁёЇї"
# Characters without width, and the special hyphens.
INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\ufe00-\ufe0f\ufeff"
HYPHENS = "\u2010\u2011\u2012\u2212\ufe63\uff0d"
SPACES = "\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000"

_TO_LATIN = str.maketrans(CYRILLIC_LOOKS + GREEK_LOOKS, CYRILLIC_AS_LATIN + GREEK_AS_LATIN)
_GREEK_CYRILLIC = {g: LATIN_AS_CYRILLIC[LATIN_LOOKS.index(x)] for g, x in zip(GREEK_LOOKS, GREEK_AS_LATIN) if x in LATIN_LOOKS}
_TO_CYRILLIC = str.maketrans(LATIN_LOOKS + LATIN_MARKED + "".join(_GREEK_CYRILLIC), LATIN_AS_CYRILLIC + MARKED_AS_CYRILLIC + "".join(_GREEK_CYRILLIC.values()))
_HIDDEN = regex.compile(f"[{INVISIBLE}]")
_SPACE = regex.compile(f"[{SPACES}]")
_HYPHEN = regex.compile(f"[{HYPHENS}]")
_TOKEN = regex.compile(r"[\p{L}\p{M}]+")
_WIDE = regex.compile("[\uff01-\uff5e\uffe0-\uffe6\ufb00-\ufb06]")
_LATIN, _CYRILLIC, _GREEK, _HEBREW = (regex.compile(rf"\p{{Script={s}}}") for s in ("Latin", "Cyrillic", "Greek", "Hebrew"))

#: Rows that can be out of plain form: anything beside plain Latin, Cyrillic and Hebrew text, or a
#: word in which two scripts touch.
SUSPICIOUS = (
    f"[{INVISIBLE}{SPACES}{HYPHENS}\\p{{M}}\\uff00-\\uffef\\ufb00-\\ufb06\\p{{IsGreek}}]"
    "|\\p{IsLatin}[\\p{IsCyrillic}\\p{IsHebrew}]|\\p{IsCyrillic}[\\p{IsLatin}\\p{IsHebrew}]|\\p{IsHebrew}[\\p{IsLatin}\\p{IsCyrillic}]"
)


def ordinary(text: str) -> str:
    """Width, composition, spaces, hyphens and invisible characters; letters keep their script.

    Only full-width and ligature forms are folded, so º, ² and other signs with a look of their own
    stay. A combining mark that has no precomposed letter stays."""
    text = _HIDDEN.sub("", text)
    text = _HYPHEN.sub("-", _SPACE.sub(" ", text))
    text = _WIDE.sub(lambda m: unicodedata.normalize("NFKC", m[0]), text)
    return unicodedata.normalize("NFC", text)


def readings(token: str) -> list[str]:
    """One-script forms of a token of several scripts, that of the dominant script first; empty where
    the token has one script already or no substitution brings it into one."""
    counts = {"latin": len(_LATIN.findall(token)), "cyrillic": len(_CYRILLIC.findall(token)), "greek": len(_GREEK.findall(token)), "hebrew": len(_HEBREW.findall(token))}
    used = [s for s, n in counts.items() if n]
    if len(used) < 2 or "hebrew" in used:
        return []
    latin, cyrillic = token.translate(_TO_LATIN), token.translate(_TO_CYRILLIC)
    out = []
    if not _CYRILLIC.search(latin) and not _GREEK.search(latin):
        out.append((counts["latin"], latin))
    if not _LATIN.search(cyrillic) and not _GREEK.search(cyrillic):
        out.append((counts["cyrillic"], cyrillic))
    return [t for _, t in sorted(out, key=lambda x: -x[0])]


def _ordinary_and_tokens(batches):
    for d in batches:
        base = d["text"].map(ordinary)
        yield pd.DataFrame({"text": d["text"], "base": base, "mixed": [[t for t in dict.fromkeys(_TOKEN.findall(x)) if readings(t)] for x in base]})


def _readings_of(batches):
    for d in batches:
        rows = [(t, i, r) for t in d["token"] for i, r in enumerate(readings(t))]
        yield pd.DataFrame(rows, columns=["token", "rank", "reading"])


def plain_tokens(strings: DataFrame, suspicious: DataFrame) -> DataFrame:
    """(token, plain) for every mixed token with a reading in the corpus vocabulary: that with the most rows, the
    dominant script at a tie."""
    mixed = suspicious.select(F.explode("mixed").alias("token")).distinct()
    options = mixed.mapInPandas(_readings_of, "token string, rank int, reading string")
    words = strings.select(F.explode(F.expr(r"regexp_extract_all(text, '[\\p{L}\\p{M}]+', 0)")).alias("reading"), "n")
    known = words.join(options.select("reading").distinct(), "reading", "left_semi").groupBy("reading").agg(F.sum("n").alias("n"))
    best = options.join(known, "reading").groupBy("token").agg(F.max_by("reading", F.struct("n", -F.col("rank"))).alias("plain"))
    return best


def repair(strings: DataFrame) -> DataFrame:
    """strings: (text, n) distinct. Result: (text, clean) for each string that is not in plain form."""
    seen = strings.where("text is not null")
    suspicious = materialise(seen.where(F.col("text").rlike(SUSPICIOUS)).select("text").mapInPandas(_ordinary_and_tokens, "text string, base string, mixed array<string>"))
    plain = plain_tokens(seen, suspicious)
    per = suspicious.select("text", F.explode("mixed").alias("token")).join(plain, "token").groupBy("text").agg(F.map_from_entries(F.collect_list(F.struct("token", "plain"))).alias("swap"))

    @F.pandas_udf("string")
    def swap(base: pd.Series, pairs: pd.Series) -> pd.Series:
        out = []
        for b, m in zip(base, pairs):
            m = {} if m is None else dict(m)
            out.append(_TOKEN.sub(lambda x: m.get(x[0], x[0]), b) if m else b)
        return pd.Series(out)

    fixed = suspicious.join(per, "text", "left").select("text", swap("base", "swap").alias("clean"))
    return fixed.where("clean <> text")


def clean_columns(df: DataFrame, column: str, strings: DataFrame | None = None) -> DataFrame:
    """df with column `clean`: the plain form of `column` (the value itself where it is plain)."""
    strings = df.groupBy(F.col(column).alias("text")).agg(F.count("*").alias("n")) if strings is None else strings
    fixed = repair(strings).select(F.col("text").alias("_key"), F.col("clean").alias("_clean"))
    return df.join(fixed, df[column] == fixed["_key"], "left").withColumn("clean", F.coalesce("_clean", df[column])).drop("_key", "_clean")


def found(entities: DataFrame, persons: DataFrame) -> DataFrame:
    """(field, row_id, clean) of every row of the two columns that is not in plain form."""
    rows = entities.select(F.lit("extractedentity.text").alias("field"), F.col("id").alias("row_id"), "text").unionByName(
        persons.select(F.lit("person.name").alias("field"), F.col("id").alias("row_id"), F.col("name").alias("text"))
    )
    strings = rows.where("text is not null").groupBy("text").agg(F.count("*").alias("n"))
    return rows.join(repair(strings), "text").select("field", "row_id", "clean").distinct()
