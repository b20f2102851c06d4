"""Column builders used by the operators; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORDS = r"[\p{L}\p{N}_]+"
# The patterns of phone and identity numbers, plates, Hebrew terms and dates.
PHONE = r"(?<!\d)(?:\+972|0)(?:[-\s]?\d){8,10}\b"
ISRAELI_ID = r"\b\d{9}\b"
# Digits and spaces of any script, as the reference reads them.
PLATE = r"\b\p{Nd}{2,3}[-\s\p{Z}\x85\x1c-\x1f]?\p{Nd}{2,3}[-\s\p{Z}\x85\x1c-\x1f]?\p{Nd}{2,3}\b"
HEBREW = r"[\u0590-\u05FF]{2,}"
DATE = r"\b(\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{2,4})\b"
# Letters with accents and their plain letters, as the tokenizer folds them.
ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


def ustrip(c: Column) -> Column:
    """Unicode-aware strip."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_blank(c: Column) -> Column:
    return F.coalesce(F.length(ustrip(c)), F.lit(0)) == 0


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({WORDS})"), F.lit(1))


def tokens(c: Column) -> Column:
    """Search tokens: runs of letters and digits, folded."""
    return F.regexp_extract_all(F.translate(F.lower(c), *ACCENTS), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def all_matches(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def places(c: Column, pattern: str) -> Column:
    """array<struct<match, at>>: every match with its place, from the matches and the lengths of what lies between."""
    m, gaps = all_matches(c, pattern), F.split(c, pattern, -1)
    sizes = F.transform(F.arrays_zip(gaps.alias("g"), m.alias("m")), lambda z: F.struct(F.coalesce(F.length(z["g"]), F.lit(0)).alias("g"), F.coalesce(F.length(z["m"]), F.lit(0)).alias("m"), z["m"].alias("text")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<match:string,at:int>>").alias("out"))
    step = lambda a, z: F.struct((a["at"] + z["g"] + z["m"]).alias("at"), F.when(z["text"].isNull(), a["out"]).otherwise(F.concat(a["out"], F.array(F.struct(z["text"].alias("match"), (a["at"] + z["g"]).alias("at"))))).alias("out"))
    return F.aggregate(sizes, zero, step)["out"]


def dot(a: Column, b: Column) -> Column:
    """Inner product, 0 where a side is empty or the lengths differ."""
    s = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), s).otherwise(F.lit(0.0))


def normalised_date(raw: Column) -> Column:
    """ISO, then day first, then month first, with four or two digits of the year; null where none fits."""
    pivot = lambda d: F.when(F.year(d) >= 2069, F.add_months(d, -1200)).otherwise(d)
    attempt = lambda fmt: F.try_to_date(raw, fmt)
    iso = F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}$") & ~raw.startswith("0000"), attempt("yyyy-MM-dd"))
    four, two = raw.rlike(r"/\d{4}$") & ~raw.rlike("/0000$"), raw.rlike(r"/\d{2}$")
    d = F.coalesce(iso, F.when(four, attempt("d/M/yyyy")), F.when(two, pivot(attempt("d/M/yy"))), F.when(four, attempt("M/d/yyyy")), F.when(two, pivot(attempt("M/d/yy"))))
    return F.date_format(d, "yyyy-MM-dd")


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.coalesce(c, F.lit(""))


def human_size(n: Column) -> Column:
    """B, KB without and MB with one decimal."""
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 * 1024, F.concat(F.floor(n / 1024 + 0.5).cast("string"), F.lit(" KB"))).otherwise(F.format_string("%.1f MB", n / (1024 * 1024)))


def chunks_of(text: Column, size: int = 1200, overlap: int = 150) -> Column:
    """array<struct<chunk_index, start_char, end_char, text>> of overlapping windows; blank windows are left out."""
    n = F.length(text)
    count = F.greatest(F.ceil((n - size) / (size - overlap)), F.lit(0)).cast("int") + 1
    starts = F.transform(F.sequence(F.lit(0), count - 1), lambda i: i * (size - overlap))
    parts = F.transform(starts, lambda s: F.struct(s.alias("start_char"), F.least(s + size, n).alias("end_char"), F.substring(text, s + 1, F.lit(size)).alias("text")))
    return F.when(is_blank(text), F.array().cast("array<struct<start_char:int,end_char:int,text:string>>")).otherwise(F.filter(parts, lambda p: ~is_blank(p["text"])))


def hash_bucket(token: Column, dims: int) -> Column:
    return F.conv(F.substring(F.sha2(token, 256), 1, 2), 16, 10).cast("int") % dims


def hash_buckets(text: Column, dims: int = 384) -> Column:
    """The buckets of the tokens of a text, split at white space, in order; a token as often as it stands there."""
    tokens = F.filter(F.split(F.lower(ustrip(text)), r"(?U)\s+"), lambda t: t != "")
    return F.sort_array(F.transform(tokens, lambda t: hash_bucket(t, dims)))


def bucket_norm(buckets: Column) -> Column:
    """The length of the vector of counts of sorted buckets, in one pass: a run of n adds 2 * n - 1 at its n-th place."""
    zero = F.struct(F.lit(-1).alias("b"), F.lit(0).alias("n"), F.lit(0.0).alias("s"))
    step = lambda a, x: F.when(a["b"] == x, F.struct(x.alias("b"), (a["n"] + 1).alias("n"), (a["s"] + 2 * a["n"] + 1).alias("s"))).otherwise(F.struct(x.alias("b"), F.lit(1).alias("n"), (a["s"] + 1).alias("s")))
    return F.sqrt(F.aggregate(buckets, zero, step)["s"])


def hash_vector(buckets: Column, dims: int = 384) -> Column:
    """The vector of counts of sorted buckets, of unit length; empty where there are none. A bucket is a byte, so only the
    first 256 places can be above 0."""
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(buckets) - 1, F.lit(0))), lambda i: (i == 0) | (F.get(buckets, i) != F.get(buckets, F.greatest(i - 1, F.lit(0)))))
    runs = F.transform(starts, lambda i, k: F.struct(F.get(buckets, i).alias("key"), (F.coalesce(F.get(starts, k + 1), F.size(buckets)) - i).cast("double").alias("value")))
    # What a lambda refers to from outside is computed anew for each element, so the counts and the norm are bound first.
    once = F.array(F.struct(F.map_from_entries(runs).alias("n"), bucket_norm(buckets).alias("norm")))
    places_ = F.sequence(F.lit(0), F.lit(min(dims, 256) - 1))
    some = F.transform(once, lambda z: F.transform(places_, lambda b: F.coalesce(F.try_element_at(z["n"], b), F.lit(0.0)) / z["norm"]))[0]
    return F.when(F.size(buckets) > 0, F.concat(some, F.array_repeat(F.lit(0.0), max(dims - 256, 0)))).otherwise(F.array().cast("array<double>"))


def serialised(v: Column) -> Column:
    """A vector as text: components with six decimals, joined by commas; null as empty text."""
    return F.coalesce(F.array_join(F.transform(v, lambda x: F.format_string("%.6f", x.cast("double"))), ","), F.lit(""))


def deserialised(c: Column) -> Column:
    """The vector of a text; blank parts are skipped, and a null or blank text gives an empty vector."""
    parts = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), ustrip), lambda p: p != "")
    return F.transform(parts, lambda p: p.cast("double"))


def dimension(v: Column) -> Column:
    return F.coalesce(F.when(v.isNotNull(), F.size(v)), F.lit(0))


def minutes_seconds(seconds: Column) -> Column:
    """MM:SS, cut to whole seconds; minutes may pass 59."""
    s = F.floor(seconds).cast("long")
    return F.concat(F.format_string("%02d", F.floor(s / 60).cast("long")), F.lit(":"), F.format_string("%02d", s % 60))


def role_text(text: Column, kind: str, model: str) -> Column:
    """What is handed to an embedding model: models of the e5 family ask for the role of the text before it."""
    return F.concat(F.lit("query: " if kind == "query" else "passage: "), text) if "e5" in model.lower() else text


# MIME types by extension.
MIME_TYPES = {
    "txt": "text/plain", "pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "bmp": "image/bmp", "tif": "image/tiff", "tiff": "image/tiff",
    "gif": "image/gif", "webp": "image/webp", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "eml": "message/rfc822", "msg": "application/vnd.ms-outlook", "wav": "audio/x-wav", "mp3": "audio/mpeg", "m4a": "audio/mp4", "ogg": "audio/ogg", "flac": "audio/flac",
    "mp4": "video/mp4", "avi": "video/x-msvideo", "mkv": "video/x-matroska", "mov": "video/quicktime",
}


def mime_type(filename: Column) -> Column:
    suffix = F.lower(F.regexp_extract(filename, r"\.([^./]+)$", 1))
    return F.coalesce(F.create_map(*(F.lit(x) for kv in MIME_TYPES.items() for x in kv))[suffix], F.lit("application/octet-stream"))


def looks_reversed(text: Column) -> Column:
    """Whether more Hebrew words begin with a final letter than end with one: then they are stored in visual order."""
    w = F.regexp_extract_all(text, F.lit("([\u0590-\u05ff]{2,})"), F.lit(1))
    n = lambda p: F.size(F.filter(w, lambda x: x.rlike(p)))
    return F.coalesce(n("^[םןףץך]") > n("[םןףץך]$"), F.lit(False))


def logical_order(text: Column) -> Column:
    """Text in visual order brought to logical order line by line: a line with Hebrew is turned around, and runs of letters and
    digits that read from left to right are turned back. Other texts stay."""
    back = lambda p: F.when(p.rlike(r"^[A-Za-z0-9]"), p).otherwise(F.translate(F.reverse(p), "()[]{}<>", ")(][}{><"))
    runs = lambda line: F.regexp_extract_all(line, F.lit(r"([A-Za-z0-9](?:[^\u0590-\u05ff\n]*[A-Za-z0-9])?|[^A-Za-z0-9]+)"), F.lit(1))
    turned = F.transform(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]", -1), lambda line: F.when(line.rlike("[\u0590-\u05ff]"), F.array_join(F.reverse(F.transform(runs(line), back)), "")).otherwise(line))
    return F.when(looks_reversed(text), F.array_join(turned, "\n")).otherwise(text)


def shown_time(iso: Column) -> Column:
    """A time in ISO form as it is shown in tables: to the minute, with a blank."""
    return F.replace(F.substring(F.coalesce(iso, F.lit("")), 1, 16), F.lit("T"), F.lit(" "))


def shown_type(mime: Column) -> Column:
    """A MIME type as it is shown in tables: what follows the last slash."""
    return F.substring_index(F.coalesce(mime, F.lit("")), "/", -1)


def needle(snippet: Column) -> Column:
    """What a preview looks for: the snippet without dots and blanks at its ends, at most 60 characters."""
    return F.substring(ustrip(F.regexp_replace(F.coalesce(snippet, F.lit("")), r"^\.+|\.+$", "")), 1, 60)


def answers_in_hebrew(question: Column) -> Column:
    return F.coalesce(question.rlike("[\u0590-\u05ff]"), F.lit(False))
