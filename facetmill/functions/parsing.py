"""Column functions for scraped interface strings. None of them raises; what does not parse is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Star ratings by marketplace language; the first expression that matches decides.
STARS = (r"([\d.]+)\s+out of\s+5", r"([\d,]+)\s+de\s+5", r"5\s*つ星のうち\s*([\d.]+)")
#: Counts of ratings, each with its thousands separator.
RATINGS = (
    (r"([\d,]+)\s+(?:global\s+)?ratings?", ","),
    (r"([\d,]+)\s+(?:global\s+)?reviews?", ","),
    (r"([\d.]+)\s+valoraciones?", "."),
    (r"([\d.]+)\s+calificaciones?", "."),
    (r"([\d,]+)\s*個の評価", ","),
    (r"([\d,]+)\s*件のグローバル評価", ","),
)
#: An optional pair of flag letters, then an `n` left from a lost line break.
_AFTER_COUNTRY = r"\s*[\x{1F1E6}-\x{1F1FF}]{0,2}\s*n?\s*"
#: Review dates; groups are country, then the parts in the order named.
DATE_US = r"Reviewed in (.+?)" + _AFTER_COUNTRY + r"(?:on\s+)?([A-Z][a-z]+)\s+(\d{1,2}),\s*(\d{4})"
DATE_UK = r"Reviewed in (.+?)" + _AFTER_COUNTRY + r"(?:on\s+)?(\d{1,2})\s+([A-Z][a-z]+)\s+(\d{4})"
DATE_ES = r"(?:Revisado|Comentado) en (.+?)" + _AFTER_COUNTRY + r"el\s+(\d{1,2})\s+de\s+(\w+)\s+de\s+(\d{4})"
DATE_JP = r"(\d{4})年\s*(\d{1,2})月\s*(\d{1,2})日に(.+?)でレビュー済み"
#: As DATE_US, but the stray `n` must follow a flag, so names that end in n stay whole.
_STRICT = r"(?:\s*[\x{1F1E6}-\x{1F1FF}]{2}\s*n?)?\s*"
MONTHS = "january february march april may june july august september october november december".split()
MONTHS_ES = "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split()


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(text, pattern, group)


def _unicode(pattern: str) -> str:
    """Blanks and digits as in Unicode, so a no-break space counts as a blank."""
    return "(?U)" + pattern


def parse_stars(text: Column) -> Column:
    """Average rating as a float. A matched number that isn't one gives null without trying on."""
    out = F.lit(None).cast("float")
    for p in reversed([_unicode(p) for p in STARS]):
        out = F.when(text.rlike(p), F.regexp_replace(_first(text, p), ",", ".").try_cast("float")).otherwise(out)
    return out


def parse_ratings(text: Column) -> Column:
    """Number of ratings as an int."""
    out = F.lit(None).cast("int")
    for p, sep in reversed(RATINGS):
        p = _unicode(p)
        out = F.when(text.rlike(p), F.replace(_first(text, p), F.lit(sep), F.lit("")).try_cast("int")).otherwise(out)
    return out


def _month(name: Column, names: list[str], more: dict[str, int] | None = None) -> Column:
    pairs = {n: i + 1 for i, n in enumerate(names)} | (more or {})
    return F.element_at(F.create_map(*[F.lit(v) for kv in pairs.items() for v in kv]), F.lower(name))


def _date(year: Column, month: Column, day: Column) -> Column:
    zero = F.lit(0)
    return F.try_make_timestamp_ntz(year.try_cast("int"), month.try_cast("int"), day.try_cast("int"), zero, zero, zero.cast("decimal(16,6)"))


def parse_review_date(text: Column, strict_country: bool = False) -> Column:
    """struct<country, date>. An unknown month keeps the country and has no date. By default a
    country that ends in n and has no flag loses that letter, as the line break's rest is absorbed;
    ``strict_country`` absorbs it after a flag only."""
    us, uk, es, jp = [_unicode(p.replace(_AFTER_COUNTRY, _STRICT) if strict_country else p) for p in (DATE_US, DATE_UK, DATE_ES, DATE_JP)]
    made = lambda country, date: F.struct(F.trim(country).alias("country"), date.alias("date"))
    out = F.struct(F.lit(None).cast("string").alias("country"), F.lit(None).cast("timestamp_ntz").alias("date"))
    out = F.when(text.rlike(jp), made(_first(text, jp, 4), _date(_first(text, jp, 1), _first(text, jp, 2), _first(text, jp, 3)))).otherwise(out)
    out = F.when(text.rlike(es), made(_first(text, es, 1), _date(_first(text, es, 4), _month(_first(text, es, 3), MONTHS_ES, {"setiembre": 9}), _first(text, es, 2)))).otherwise(out)
    out = F.when(text.rlike(uk), made(_first(text, uk, 1), _date(_first(text, uk, 4), _month(_first(text, uk, 3), MONTHS), _first(text, uk, 2)))).otherwise(out)
    return F.when(text.rlike(us), made(_first(text, us, 1), _date(_first(text, us, 4), _month(_first(text, us, 2), MONTHS), _first(text, us, 3)))).otherwise(out)


def strip(text: Column) -> Column:
    """Without blanks of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapse_spaces(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", " ")


def normalize_facet(text: Column) -> Column:
    return F.lower(strip(text))


def text_length(text: Column) -> Column:
    """Code points; null counts as empty."""
    return F.length(F.coalesce(text, F.lit(""))).cast("int")


def content_hash(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def first_or_null(values: Column) -> Column:
    return F.get(values, F.lit(0))


def strip_control(text: Column) -> Column:
    """Without the control characters that spreadsheets refuse."""
    return F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")


def to_number(text: Column) -> Column:
    return text.try_cast("double")


def canonical_image_url(url: Column, px: int = 256) -> Column:
    """The product image of the given size, or null if the URL names none. Idempotent."""
    image = F.nullif(F.regexp_extract(url, r"/images/I/([^./]+)", 1), F.lit(""))
    return F.concat(F.lit("https://m.media-amazon.com/images/I/"), image, F.lit(f"._SL{px}_.jpg"))


def shard_path(key: Column, root: str = "", suffix: str = ".jpg") -> Column:
    """``ab/cd/abcd….jpg`` under ``root``: two levels keep folders small."""
    parts = [F.substring(key, 1, 2), F.substring(key, 3, 2), F.concat(key, F.lit(suffix))]
    return F.concat_ws("/", *([F.lit(root)] if root else []), *parts)


def minutes_between(first: Column, last: Column) -> Column:
    return F.round(F.timestamp_diff("SECOND", first, last) / 60.0, 1)


#: Fixed value: the DNS namespace of RFC 4122.
DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"


def stable_uuid(name: Column, namespace: str = DNS_NAMESPACE) -> Column:
    """The version 5 UUID of a name."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace)), name.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def sentences(text: Column, least: int = 15) -> Column:
    """Stretches up to a full stop, question or exclamation mark or line break, at least so long."""
    parts = F.transform(F.regexp_extract_all(text, F.lit(r"[^.!?\n]+[.!?]*"), F.lit(0)), lambda s: F.trim(s))
    return F.filter(parts, lambda s: F.length(s) >= least)


def word_shingles(text: Column, width: int = 8) -> Column:
    """The runs of ``width`` words of the lower-cased text; none if it is shorter."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    runs = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - width + 1), lambda i: F.array_join(F.slice(w, i, width), " "))
    one = F.transform(F.array(words), lambda w: F.when(F.size(w) >= width, runs(w)).otherwise(F.array().cast("array<string>")))
    return F.element_at(one, 1)


def shingle_hashes(text: Column, width: int = 8) -> Column:
    """64-bit hashes of the distinct runs of ``word_shingles``, made from hashes of the words, so no run is
    put together."""
    words = F.transform(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""), lambda w: F.xxhash64(w))
    runs = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)]))
    one = F.transform(F.array(words), lambda h: F.when(F.size(h) >= width, runs(h)).otherwise(F.array().cast("array<bigint>")))
    return F.array_distinct(F.element_at(one, 1))


def hash_order(seed: str, *keys: Column) -> Column:
    """A sample order that depends on seed and key alone, whatever the partitions or the engine."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[k.cast("string") for k in keys]).cast("binary"))


def hash_index(n: Column, *keys: Column) -> Column:
    """A pseudo-random index in 0..n-1 of the keys."""
    digest = F.md5(F.concat_ws(":", *[k.cast("string") for k in keys]).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), n.cast("long"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
