"""Problem 10: keyword-stuffed and link-list pages.

Every page is a bag of tokens (words, hash tags, parts of links), ranked by count; the line of log count on log rank gives
slope and residual, and the share of the page that exceeds what prose of the same language uses gives the divergence.
Pages are held against the pages of their language at comparable length (power-of-two bins): a page whose slope or
residual lies beyond `spread` robust deviations of its group's median, or whose divergence does, is suspect, and a case has a
divergence of at least DIVERGENCE: what a page repeats no more than prose does is not stuffed, however it is laid out. Of the
suspect pages the stuffed share is then measured exactly: characters in links with their captions, in tags and in keywords
that the page repeats; at least three quarters make a case.

Scale: the tokens of a page are counted, sorted and ranked inside its own row (the position in the sorted array is the
row number a window over the page would give), so neither texts nor tokens are shuffled; fits are sums that are
combined before the exchange of one row for each page. The prose reference is one row per language and word that stands in
one page of 200 or more (document frequency, so a stuffed page counts once per word); it is broadcast after a count.
Group medians are percentiles over pages, not texts.

Edge cases: null, empty and blank texts and texts without a letter or digit have no tokens and are no cases. A page of any
other length is judged. Repeated texts get the same verdict. Unknown languages form a group by script. Extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewright.llm.language import declared
from casewright.sources import materialise, small_side, spread_out

SHARE = 0.75
DIVERGENCE = 0.3

_URL = r"(?:https?://|www\.)[^\s<>\"')\]]+"
_LINK = regex.compile(rf"<a\s[^>]*>.*?</a>|\[[^\]\n]*\]\(\s*{_URL}\s*\)", regex.I | regex.S)
_URL_RE = regex.compile(_URL, regex.I)
_TAG = regex.compile(r"[#＃][\p{L}\p{N}_\-]+")
_HTML = regex.compile(r"<[^<>]{1,200}>")
_ENTRY = regex.compile(r"^\s*(?:\d+[.)]\s|\[?\d{1,2}[:.]\d\d|EX-)|\.{4,}|\s\d+\s*$")
_PRODUCT = regex.compile(r"(?:[$€£₪¥]\s?\d|\d+[.,]\d\d\s*[$€£₪¥]?|\b\d(?:[.,]\d)?\s?/\s?(?:5|10)|\bSKU[\s:#]*\w+|\bEAN[\s:#]*\d+)\s*$", regex.I)
_MAIL = regex.compile(r"[\w.+-]+\s*(?:@|[(\[]\s*at\s*[)\]])\s*[\w-]+(?:\s*(?:\.|\bdot\b)\s*[\w-]+)*", regex.I)
_MAY_MAIL = regex.compile(r"@|[(\[]\s*at\s*[)\]]", regex.I)
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_NO_LETTER = regex.compile(r"[^\p{L}\p{N}]+")


def group_language(text: Column, lang: Column) -> Column:
    """The declared language where the script of the text allows it, else the script."""
    script = F.when(text.rlike(r"\p{IsHebrew}{2}"), "he").when(text.rlike(r"\p{IsCyrillic}{2}"), "cyr").otherwise("lat")
    said = declared(lang)
    fits = ((script == "he") & (said == "he")) | ((script == "cyr") & said.isin("ru", "uk")) | ((script == "lat") & said.isin("en", "fr", "de", "es"))
    return F.when(fits, said).otherwise(script)


def ranked_tokens(documents: DataFrame) -> DataFrame:
    """(doc_id, grp, tokens, ranked): the tokens of every page with their counts, the most frequent first. Digits of links
    are masked."""
    text = F.lower(F.regexp_replace("text", r"\d{2,}", "0"))
    d = documents.where("text is not null and doc_id is not null").select("doc_id", group_language(F.col("text"), F.col("lang")).alias("grp"), text.alias("t"))
    d = d.select("doc_id", "grp", F.sort_array(F.expr(r"regexp_extract_all(t, '#?[\\p{L}\\p{M}\\p{N}]+', 0)")).alias("s")).where("size(s) > 0")
    d = d.select("doc_id", "grp", "s", F.expr("filter(sequence(0, size(s) - 1), i -> i = 0 or s[i] <> s[greatest(i - 1, 0)])").alias("at"))
    runs = F.expr("transform(at, (a, k) -> struct(a - coalesce(get(at, k + 1), size(s)) as less, s[a] as token))")
    return d.select("doc_id", "grp", F.size("s").alias("tokens"), F.sort_array(runs).alias("ranked"))


def prose_reference(pages: DataFrame) -> DataFrame:
    """(grp, token, weight): the share of the pages of a language that hold a token; tokens in fewer than 1 page of 200
    weigh 0 and are left out."""
    n = pages.groupBy("grp").agg(F.count("*").alias("pages"))
    df = pages.select("grp", F.explode("ranked.token").alias("token")).groupBy("grp", "token").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(n), "grp").where(F.col("df") * 200 >= F.col("pages")).select("grp", "token", (F.col("df") / F.col("pages")).alias("weight"))


def curves(pages: DataFrame) -> DataFrame:
    """(doc_id, grp, tokens, types, slope, residual, divergence) of every page."""
    ref = small_side(materialise(prose_reference(pages)))
    ranked = pages.select("doc_id", "grp", "tokens", F.posexplode("ranked").alias("before", "r"))
    ranked = ranked.select("doc_id", "grp", "tokens", (F.col("before") + 1).alias("rank"), (-F.col("r.less")).alias("n"), "r.token").join(ref, ["grp", "token"], "left").na.fill(0.0, ["weight"])
    x, y = F.log("rank"), F.log("n")
    link = F.col("token").startswith("#") | F.col("token").isin("http", "https", "www", "href")
    excess = F.when(link | ((F.col("n") >= 2) & (F.col("n") / F.col("tokens") > 0.01 + 0.1 * F.col("weight"))), F.col("n")).otherwise(0)
    page = ranked.groupBy("doc_id", "grp", "tokens").agg(
        F.count("*").alias("types"), F.regr_slope(y, x).alias("slope"), F.regr_r2(y, x).alias("r2"), F.var_pop(y).alias("spread"),
        (F.sum(excess) / F.max("tokens")).alias("divergence"),
    )
    residual = F.sqrt(F.greatest(F.col("spread") * (1 - F.coalesce("r2", F.lit(1.0))), F.lit(0.0)))
    return page.select("doc_id", "grp", "tokens", "types", F.coalesce(-F.col("slope"), F.lit(0.0)).alias("slope"), residual.alias("residual"), "divergence")


def suspects(pages: DataFrame, spread: float = 2.0) -> DataFrame:
    """pages with flag: of a divergence of at least DIVERGENCE, and slope or residual beyond `spread` robust deviations (0.02 to 0.1) of the median of the same language at
    comparable length, or divergence as far above the language's median (it is a share already, and among
    the longest pages stuffed ones may be the majority, so all lengths make its median)."""
    p = pages.withColumn("bin", F.floor(F.log2("tokens")))
    quartiles = lambda f: F.expr(f"percentile_approx({f}, array(0.25, 0.5, 0.75))").alias(f"q_{f}")
    at_length = p.groupBy("grp", "bin").agg(quartiles("slope"), quartiles("residual"))
    # Pages without a usable label are held against all labelled pages of their script.
    script = F.when(F.col("grp") == "he", "he").when(F.col("grp").isin("ru", "uk", "cyr"), "cyr").otherwise("lat")
    p = p.withColumn("script", script)
    labelled = p.where(~F.col("grp").isin("lat", "cyr")).groupBy("script").agg(F.expr("percentile_approx(divergence, array(0.25, 0.5, 0.75))").alias("q_script"))
    j = p.join(F.broadcast(at_length), ["grp", "bin"]).join(F.broadcast(p.groupBy("grp").agg(quartiles("divergence").alias("q_own"))), "grp").join(F.broadcast(labelled), "script", "left")
    j = j.withColumn("q_divergence", F.when(F.col("grp").isin("lat", "cyr"), F.coalesce("q_script", "q_own")).otherwise(F.col("q_own")))
    features = ("slope", "residual", "divergence")
    z = {f: (F.col(f) - F.col(f"q_{f}")[1]) / F.least(F.greatest((F.col(f"q_{f}")[2] - F.col(f"q_{f}")[0]) / 1.35, F.lit(0.02)), F.lit(0.1)) for f in features}
    j = j.select("doc_id", "grp", "tokens", *(z[f].alias(f"z_{f}") for f in features), *features)
    extreme = (F.abs("z_slope") >= spread) | (F.abs("z_residual") >= spread) | (F.col("z_divergence") >= spread)
    return j.withColumn("flag", extreme & (F.col("divergence") >= DIVERGENCE))


def letters_in(s: str) -> int:
    return len(_NO_LETTER.sub("", s))


def stuffed_share(text: str) -> float:
    """Share of the letters and digits of a page that stand in links with captions, tags or repeated keywords."""
    html, size = "<" in text, letters_in
    whole = size(_HTML.sub(lambda m: m[0] if "href" in m[0].lower() else " ", text) if html else text)
    if not whole:
        return 0.0
    got = 0
    if html or "](" in text:
        got += sum(map(size, _LINK.findall(text)))
        text = _LINK.sub("\n", text)
    lines = []
    for line in text.split("\n"):
        urls = _URL_RE.findall(line) if "http" in line or "www" in line or "HTTP" in line or "WWW" in line else ()
        if urls:
            bare = _URL_RE.sub(" ", line)
            got += sum(map(size, urls))
            if len(_WORD.findall(bare)) <= 6 * len(urls):
                got += size(bare)
                continue
            line = bare
        if "#" in line or "＃" in line:
            got += sum(map(size, _TAG.findall(line)))
            line = _TAG.sub(" ", line)
        if _PRODUCT.search(line) and not _ENTRY.search(_PRODUCT.sub("", line)) and len(_WORD.findall(line)) <= 12:
            got += size(line)
            continue
        if _MAY_MAIL.search(line):
            line = _MAIL.sub(" ", line)
        lines.append(_HTML.sub(" ", line) if html else line)
    got += repeated(lines)
    return got / whole


def repeated(lines: list[str]) -> int:
    """Letters and digits in sentences of repeated keywords. A sentence in which word pairs come back, making up
    a fifth of it or more, is one; so is a sentence that holds a pair which came back that way elsewhere on the
    page. Entries of numbered, timed or dotted lists are no sentences;
    lines without an end of their own run on."""
    text = "\n".join("\n" if _ENTRY.search(line) else line for line in lines)
    sentences = [_WORD.findall(s.lower()) for s in regex.split(r"(?<=[.!?])\s+|\n\s*\n", text)]
    sentences = [s for s in sentences if s]
    looped, loops = set(), []
    for s in sentences:
        inside: dict[tuple, int] = {}
        for pair in zip(s, s[1:]):
            inside[pair] = inside.get(pair, 0) + 1
        back = sum(n for n in inside.values() if n > 1)
        loops.append(back > 2 and back >= 0.2 * len(s) or back == 2 and back >= 0.25 * len(s))
        if loops[-1]:
            looped.update(p for p, n in inside.items() if n > 1)
    return sum(sum(map(len, s)) for s, looping in zip(sentences, loops) if looping or any(p in looped for p in zip(s, s[1:])))


@F.pandas_udf(T.DoubleType())
def share_of(text: pd.Series) -> pd.Series:
    return text.map(stuffed_share).astype(float)


def pages(documents: DataFrame, spread: float = 2.0) -> DataFrame:
    """(doc_id, slope, residual, divergence, z_..., flag, share) of every page with tokens; share only where the curve is
    suspect."""
    s = materialise(suspects(materialise(curves(materialise(ranked_tokens(spread_out(documents.select("doc_id", "text", "lang")))))), spread))
    wanted = small_side(s.where("flag").select("doc_id"))
    texts = spread_out(documents.where("text is not null").select("doc_id", "text").join(wanted, "doc_id", "left_semi"))
    return s.join(small_side(materialise(texts.select("doc_id", share_of("text").alias("share")))), "doc_id", "left")


def found(documents: DataFrame) -> DataFrame:
    return pages(documents).where(F.col("share") >= SHARE).select("doc_id").distinct()
