"""Problem 6: noise in text from scanned pages.

1. Page furniture. Digits of a line are masked. Page numbers are lines of nothing but a number with
   its decoration or page word. Running headers are found by their words: in running text a pair of
   words stands anywhere in a line, since lines break where they are full; in a header it stands at
   one and the same distance from the line end. A line whose pairs are locked that way and that does
   not end a sentence is a header.
2. Divided words. A line that ends in a hyphen is joined with the next body line of the file (window
   over the lines); whether the word has a hyphen of its own is decided by the corpus vocabulary.
3. Misread words. Words are grouped by the skeleton of their confusable glyphs. A form that clean
   files hardly know is replaced by the form of its group that they know well, if a neighbour word
   supports that form in the corpus.
4. Reflow. The corrected body lines are joined into paragraphs.

Scale: all counts are grouped and combined before the shuffle; windows are partitioned by file and
text is never collected but for the lines of one paragraph. Lines are ordered inside their chunk, so a file of very many chunks is
one window partition of numbers, a row for each chunk.

Edge cases: null or blank text has no lines and no cases; a file with null location is ordered by
chunk_index, then id; chunks kept twice are treated each for itself; empty tables give no rows; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.sources import materialise, small_side

OCR_STATUS = "ocr_indexed"
# Words for "page" and "of" beside a page number.
PAGE_WORDS = "page|pages|pg|p|pag|pág|página|seite|blatt|s|стр|страница|лист|с|ст|стор|сторінка|עמ|עמוד|דף"
OF_WORDS = "of|de|von|sur|из|з|із|od|מתוך"
# Glyphs that scans confuse, by the letter that stands for the class; pairs that look like one
# letter; the same for Hebrew.
GLYPHS = {"o": "0о", "l": "1i|!", "s": "5", "c": "eес", "t": "f", "b": "h8вб6", "ш": "щ", "з": "3", "g": "9q", "и": "й", "a": "а", "p": "р", "y": "у", "x": "х"}
GLYPH_PAIRS = (("rn", "m"), ("vv", "w"), ("cl", "d"))
HEBREW_GLYPHS = {"ס": "ם", "נ": "ן", "כ": "ך", "פ": "ף", "צ": "ץ", "ה": "חת", "ר": "ד", "ו": "ז"}


def _translate(column: Column, classes: dict[str, str]) -> Column:
    return F.translate(column, "".join(classes.values()), "".join(k * len(v) for k, v in classes.items()))


def glyph_skeleton(word: Column) -> Column:
    """Lower-cased word in which every class of confusable glyphs is one letter. Single glyphs first, then
    pairs (rn m, vv w, cl d), so that a misread letter inside a pair keeps the group together."""
    s = _translate(F.lower(word), GLYPHS)
    for pair, one in GLYPH_PAIRS:
        s = F.replace(s, F.lit(pair), F.lit(one))
    return _translate(s, HEBREW_GLYPHS)


def ocr_lines(chunks: DataFrame, evidence: DataFrame) -> DataFrame:
    """(chunk_id, evidence_id, start, chunk_index, pos, line, bare) of every line of scanned files."""
    ev = evidence.where(F.col("status") == OCR_STATUS).select(F.col("id").alias("evidence_id")).distinct()
    c = chunks.where("text is not null and id is not null").select(
        F.col("id").alias("chunk_id"), "evidence_id", "chunk_index",
        F.expr(r"try_cast(nullif(regexp_extract(source_location, '^chars:(\\d+)-', 1), '') as bigint)").alias("start"), "text",
    )
    rows = c.join(small_side(ev), "evidence_id", "left_semi").select("chunk_id", "evidence_id", "chunk_index", "start", F.posexplode(F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n")).alias("pos", "line"))
    return rows.withColumn("bare", F.expr(r"regexp_replace(line, '(?U)^\\s+|\\s+$', '')"))


def is_page_number(bare: Column) -> Column:
    number = r"[0-9OolI]{1,4}"
    word = rf"(?:{PAGE_WORDS})(?:\.|'|׳|’)?\s*"
    return F.lower(bare).rlike(rf"(?iu)^[\s\[\](){{}}~\-–—*•.|=_<>]*(?:{word})?[\s#№n°.]*{number}(?:\s*(?:/|{OF_WORDS})\s*{number})?[\s\[\](){{}}~\-–—*•|=_<>]*$") & bare.rlike(r"\d")


EDGES = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"
#: Tokens that are a number or a code: without a letter, or with three digits.
CODE = r"(?<!\S)(?:[^\s\p{L}]*[0-9][^\s\p{L}]*|\S*[0-9]\S*[0-9]\S*[0-9]\S*)(?!\S)"


def bare_word(token: Column) -> Column:
    return F.regexp_replace(token, EDGES, "")


def plain_words(text: Column) -> Column:
    """Lower-cased words without adjoining punctuation; numbers and codes are 0. A code keeps its letters and digits without its
    edges, so CODE is asked of the words, by expressions that most of them leave at once."""
    words = F.filter(F.split(F.regexp_replace(F.lower(text), EDGES, ""), r"[^\p{L}\p{N}]*\s+[^\p{L}\p{N}]*"), lambda x: x != "")
    return F.transform(words, lambda x: F.when(x.rlike("[0-9]") & (x.rlike(r"^\P{L}*\z") | x.rlike("[0-9][^0-9]*[0-9][^0-9]*[0-9]")), "0").otherwise(x))


def without_divided(text: Column) -> Column:
    """The text with a blank for each word divided at a line end; only texts with such a line end are rewritten."""
    return F.when(text.rlike(r"[-\x{ad}]\r?\n"), F.regexp_replace(text, r"(?<!\S)\S+[-\x{ad}]\r?\n\s*\S+", " ")).otherwise(text)


def term_counts(chunks: DataFrame, evidence: DataFrame) -> DataFrame:
    """(term, clean, scanned): words and pairs of neighbouring words (with a blank between) of all texts, by
    whether the file was scanned. Words divided at a line end are left out.

    A text gives a row for each word: with its neighbour, or alone where it is the last. The words themselves are counted
    from the distinct pairs that they begin."""
    ocr = evidence.where(F.col("status") == OCR_STATUS).select(F.col("id").alias("evidence_id")).distinct().withColumn("ocr", F.lit(1))
    w = chunks.where("text is not null").select("evidence_id", "text").join(small_side(ocr), "evidence_id", "left").select("ocr", plain_words(without_divided(F.col("text"))).alias("w"))
    rows = w.select("ocr", F.explode(F.expr("if(size(w) = 0, array(), transform(sequence(0, size(w) - 1), i -> if(i < size(w) - 1, concat(w[i], ' ', w[i + 1]), w[i])))")).alias("term"))
    begun = materialise(rows.groupBy("term").agg((F.count("*") - F.count("ocr")).alias("clean"), F.count("ocr").alias("scanned")))
    words = begun.groupBy(F.substring_index("term", " ", 1).alias("term")).agg(F.sum("clean").alias("clean"), F.sum("scanned").alias("scanned"))
    return begun.where("term like '% %'").unionByName(materialise(words))


def furniture(lines: DataFrame, counts: DataFrame, min_count: int = 3, locked: float = 0.7) -> DataFrame:
    """lines with column `part`: header, pagenum, blank or body."""
    kind = F.when(F.col("bare") == "", "blank").when(is_page_number(F.col("bare")), "pagenum")
    lines = lines.withColumn("kind", kind)
    open_end = ~F.col("bare").rlike(r"[.!?,;:\-\x{ad}…)\"»”]$")
    skeletons = F.split(glyph_skeleton(F.array_join(plain_words(F.col("bare")), " ")), " ")
    lines = materialise(lines.withColumn("open_end", open_end).withColumn("w", F.when(F.col("kind").isNull(), skeletons)))
    pairs = lines.where(F.size("w") >= 2).select("chunk_id", "pos", "open_end", F.explode(F.expr("transform(sequence(0, size(w) - 2), i -> struct(concat(w[i], ' ', w[i + 1]) as pair, size(w) - 2 - i as behind))")).alias("s")).select("chunk_id", "pos", "open_end", "s.pair", "s.behind")
    at = pairs.groupBy("pair", "behind").agg(F.count("*").alias("n"))
    lock = at.groupBy("pair").agg(F.sum("n").alias("total"), F.max_by("behind", "n").alias("usual"), F.max("n").alias("most"))
    running = counts.where("clean > 0 and term like '% %'").withColumnRenamed("term", "pair").groupBy(glyph_skeleton(F.col("pair")).alias("pair")).agg(F.sum("clean").alias("clean"))
    lock = lock.where(F.col("total") >= min_count).join(running, "pair", "left").where(F.coalesce("clean", F.lit(0)) * 10 <= F.col("total"))
    lock = lock.select("pair", "usual", (F.col("most") / F.col("total")).alias("lock"))
    scored = pairs.where("open_end and behind <= 3").join(lock, "pair", "left").groupBy("chunk_id", "pos").agg(
        F.avg(F.when(F.col("behind") == F.col("usual"), F.col("lock")).otherwise(0.0)).alias("score"), F.max_by(F.col("lock"), -F.col("behind")).alias("last")
    )
    heads = scored.where((F.col("score") >= 0.5) | ((F.col("score") >= 0.25) & (F.col("last") >= locked))).select("chunk_id", "pos", F.lit(True).alias("head"))
    return lines.drop("open_end", "w").join(heads, ["chunk_id", "pos"], "left").withColumn("part", F.coalesce("kind", F.when(F.col("head"), "header"), F.lit("body"))).drop("kind", "head")


def divided(parts: DataFrame) -> DataFrame:
    """The body lines in order: cut, left, right (its last token goes on in the next line), joined (its first token
    belongs to the line before), and the words next to the line."""
    w = Window.partitionBy("chunk_id").orderBy("pos")
    body = parts.where(F.col("part") == "body").select("chunk_id", "pos", "bare")
    body = body.withColumn("next", F.lead("bare").over(w)).withColumn("prev", F.lag("bare").over(w))
    ends, starts = r"\p{L}[-\x{ad}]$", r"^\p{L}"
    body = body.withColumn("cut", F.coalesce(F.col("bare").rlike(ends) & F.col("next").rlike(starts), F.lit(False)))
    body = body.withColumn("joined", F.coalesce(F.col("prev").rlike(ends) & F.col("bare").rlike(starts), F.lit(False)))
    left, right = F.regexp_extract("bare", r"(\S+)[-\x{ad}]$", 1), F.regexp_extract("next", r"^(\S+)", 1)
    body = body.withColumn("left", F.when(F.col("cut"), left)).withColumn("right", F.when(F.col("cut"), right))
    return body.withColumn("last_of_prev", F.regexp_extract("prev", r"(\S+)$", 1)).withColumn("first_of_next", F.regexp_extract("next", r"^(\S+)", 1)).drop("next", "prev")


def whole_words(body: DataFrame, counts: DataFrame) -> DataFrame:
    """(chunk_id, pos, word) of every divided word: with its own hyphen where the vocabulary knows that form
    better, or, knowing neither, where the second part begins with a capital."""
    cuts = body.where("cut").select("chunk_id", "pos", F.concat("left", "right").alias("plain"), F.concat_ws("-", "left", "right").alias("own"), F.col("right").rlike(r"^\p{Lu}\p{Ll}").alias("capital"))
    cuts = cuts.withColumn("k1", F.lower(bare_word(F.col("plain")))).withColumn("k2", F.lower(bare_word(F.col("own"))))
    wanted = cuts.select(F.col("k1").alias("word")).unionByName(cuts.select(F.col("k2").alias("word"))).distinct()
    known = counts.withColumnRenamed("term", "word").join(wanted, "word", "left_semi").select("word", (F.col("clean") + F.col("scanned")).alias("n"))
    a = known.select(F.col("word").alias("k1"), F.col("n").alias("n1"))
    b = known.select(F.col("word").alias("k2"), F.col("n").alias("n2"))
    d = cuts.join(a, "k1", "left").join(b, "k2", "left").na.fill(0, ["n1", "n2"])
    own = (F.col("n2") > F.col("n1")) | ((F.col("n1") + F.col("n2") == 0) & F.col("capital"))
    return d.select("chunk_id", "pos", F.when(own, F.col("own")).otherwise(F.col("plain")).alias("word"))


def running_tokens(body: DataFrame, whole: DataFrame) -> DataFrame:
    """(chunk_id, pos, i, raw, before, after, divided): tokens of body lines with their neighbours; a divided word
    stands whole at the end of its line."""
    b = body.join(whole.withColumnRenamed("word", "whole"), ["chunk_id", "pos"], "left")
    t = F.split("bare", r"\s+")
    b = b.withColumn("t", F.when(F.col("joined"), F.slice(t, 2, F.size(t))).otherwise(t))
    b = b.withColumn("t", F.when(F.col("cut"), F.concat(F.slice("t", 1, F.greatest(F.size("t") - 1, F.lit(0))), F.array("whole"))).otherwise(F.col("t"))).where("size(t) > 0")
    rows = b.select("chunk_id", "pos", F.posexplode(F.expr("transform(sequence(0, size(t) - 1), i -> struct(t[i] as raw, if(i > 0, t[greatest(i - 1, 0)], last_of_prev) as before, if(i < size(t) - 1, t[least(i + 1, size(t) - 1)], first_of_next) as after, cut and i = size(t) - 1 as divided))")).alias("i", "s"))
    return rows.select("chunk_id", "pos", "i", "s.*").where("raw <> ''")


def readings(counts: DataFrame, min_known: int = 5, ratio: float = 8.0) -> DataFrame:
    """(key, right, n_right): forms hardly known to clean files, with the well-known forms of their glyph group."""
    v = counts.where("not term rlike '[ @/:_]' and term rlike '\\\\p{L}' and length(term) >= 2").select(F.col("term").alias("word"), "clean", "scanned")
    letters = F.length(F.regexp_replace("word", r"[^\p{L}]", ""))
    digits = F.length(F.regexp_replace("word", r"[^0-9]", ""))
    good = v.where((F.col("clean") >= min_known) & ~F.col("word").rlike("[0-9]")).select(glyph_skeleton(F.col("word")).alias("skeleton"), F.col("word").alias("right"), F.col("clean").alias("n_right"))
    odd = v.where((F.col("scanned") > 0) & (F.col("clean") * 4 <= F.col("scanned")) & (digits <= letters)).withColumn("skeleton", glyph_skeleton(F.col("word")))
    option = odd.join(good, "skeleton").where((F.col("right") != F.col("word")) & (F.col("n_right") >= F.lit(ratio) * F.sqrt("scanned")) & (F.col("n_right") > F.col("scanned")))
    return option.select(F.col("word").alias("key"), "right", "n_right")


def misread(tokens: DataFrame, counts: DataFrame) -> DataFrame:
    """(chunk_id, pos, i, word, divided, right) of every misread token of the running text."""
    option = small_side(materialise(readings(counts)))
    k = tokens.withColumn("word", bare_word(F.col("raw"))).withColumn("key", F.lower("word"))
    plain = lambda c: F.when(F.col(c).rlike(CODE), "0").otherwise(F.lower(bare_word(F.col(c))))
    case = materialise(k.join(option, "key").withColumn("before", plain("before")).withColumn("after", plain("after")).drop("raw"))
    want = case.select(F.concat_ws(" ", "before", "right").alias("term")).unionByName(case.select(F.concat_ws(" ", "right", "after").alias("term"))).distinct()
    support = materialise(counts.join(small_side(want), "term", "left_semi").select("term", (F.col("clean") + F.col("scanned")).alias("n")))
    s = case.join(small_side(support.select(F.col("term").alias("p1"), F.col("n").alias("s1"))), F.concat_ws(" ", "before", "right") == F.col("p1"), "left")
    s = s.join(small_side(support.select(F.col("term").alias("p2"), F.col("n").alias("s2"))), F.concat_ws(" ", "right", "after") == F.col("p2"), "left").na.fill(0, ["s1", "s2"])
    best = s.where(F.col("s1") + F.col("s2") >= 2).groupBy("chunk_id", "pos", "i", "word", "divided").agg(F.max(F.struct(F.col("s1") + F.col("s2"), "n_right", "right")).alias("m")).withColumn("right", F.col("m.right"))
    upper = F.regexp_replace("word", r"[^\p{L}]", "")
    right = F.when((F.upper(upper) == upper) & (F.length(upper) > 1), F.upper("right")).when(F.substring("word", 1, 1).rlike(r"\p{Lu}"), F.concat(F.upper(F.substring("right", 1, 1)), F.expr("substring(right, 2)"))).otherwise(F.col("right"))
    return best.select("chunk_id", "pos", "i", "word", "divided", right.alias("right"))


def analyse(chunks: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(parts, whole, tokens, wrong): the lines with their part, the divided words, the running tokens and
    the misread ones."""
    counts = term_counts(chunks, evidence)
    parts = materialise(furniture(ocr_lines(chunks, evidence), counts))
    body = divided(parts)
    whole = materialise(whole_words(body, counts))
    tokens = running_tokens(body, whole)
    return parts, whole, tokens, misread(tokens, counts)


def found(chunks: DataFrame, evidence: DataFrame) -> DataFrame:
    parts, whole, tokens, wrong = analyse(chunks, evidence)
    lines = parts.where("part in ('header', 'pagenum')").select("chunk_id", F.col("part").alias("defect"), F.col("bare").alias("piece"))
    right = wrong.where("divided").select("chunk_id", "pos", "right")
    hyphen = whole.join(right, ["chunk_id", "pos"], "left").select("chunk_id", F.lit("hyphen").alias("defect"), F.coalesce("right", bare_word(F.col("word"))).alias("piece"))
    glyph = wrong.select("chunk_id", F.lit("glyph").alias("defect"), F.col("right").alias("piece"))
    return lines.unionByName(hyphen).unionByName(glyph).where("piece <> ''").distinct()


def paragraphs(chunks: DataFrame, evidence: DataFrame) -> DataFrame:
    """(evidence_id, paragraph, text): the readable paragraphs of every scanned file, in order. A blank line
    ends a paragraph; the pieces of a file follow one another by source_location."""
    parts, whole, tokens, wrong = analyse(chunks, evidence)
    fixed = tokens.join(wrong.select("chunk_id", "pos", "i", "word", "right"), ["chunk_id", "pos", "i"], "left")
    fixed = fixed.withColumn("out", F.when(F.col("right").isNull(), F.col("raw")).otherwise(F.expr("replace(raw, word, right)")))
    line = fixed.groupBy("chunk_id", "pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "out"))), lambda x: x["out"]), " ").alias("line_text"))
    # Lines are numbered inside their chunk; a file's window goes over one row for each chunk.
    chunk = ["evidence_id", "start", "chunk_index", "chunk_id"]
    file = Window.partitionBy("evidence_id").orderBy(F.col("start").asc_nulls_last(), F.col("chunk_index").asc_nulls_last(), "chunk_id")
    ends = (F.col("part") == "blank").cast("long")
    per = parts.groupBy(*chunk).agg(F.sum(ends).alias("ends")).withColumn("before", F.sum("ends").over(file) - F.col("ends")).withColumn("nth", F.row_number().over(file))
    inside = Window.partitionBy("chunk_id").orderBy("pos")
    p = parts.withColumn("own", F.sum(ends).over(inside)).join(per.select("chunk_id", "before", "nth"), "chunk_id")
    p = p.withColumn("paragraph", F.col("before") + F.col("own")).withColumn("at", F.struct("nth", "pos"))
    rows = p.join(line, ["chunk_id", "pos"])
    return rows.groupBy("evidence_id", "paragraph").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line_text"))), lambda x: x["line_text"]), " ").alias("text"))
