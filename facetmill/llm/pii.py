"""Personal data: regular expressions propose spans, checksums confirm them, context adjusts the score.

Spans are code-point offsets. As SQL gives matches but no places, each expression also splits the
text; the lengths of pieces and matches, added up, are the places. Expressions are anchored at run
starts and use possessive groups, so they match the same leftmost spans in linear time and without
deep recursion on very long runs. Running sums and rebuilt texts go by lots of ``LOT`` matches, and
words near a match come from a cut of the text into pieces, so time grows with the text and not with
the square of its matches.

DataFrame expressions only. Defined results: null or empty text has no spans; texts are read whole;
spans of different kinds may overlap, and all are told; repeated rows stay; other columns are kept by
``redact`` and ignored by ``find``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base kinds' expressions, written so that no run is scanned twice. Next to each:
#: a cheap test that a text can hold a match.
PATTERNS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"@"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){15}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
    "iban": (r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:[ ]?[0-9A-Z]{4}){2,7}(?:[ ]?[0-9A-Z]{1,3})?(?![0-9A-Za-z])", r"[A-Z]{2}[0-9]{2}[ ]?[0-9A-Z]{4}"),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
    "secret": (r"(?<![0-9a-fA-F])[0-9a-f]{32,64}(?![0-9a-zA-Z])", r"[0-9a-f]{32}"),
}
BASE = ("email", "ip", "card", "phone")


@dataclass(frozen=True)
class Context:
    """Score of a confirmed span, words near it that raise or lower it, and the least score kept."""

    score: float
    raising: str
    lowering: str = r"(?!)"
    least: float = 0.5


#: Base spans always stay; the others need their score.
CONTEXT = {
    "email": Context(0.9, r"(?i)mail|contact|write"),
    "ip": Context(0.6, r"(?i)\bip\b|address|host|server", r"(?i)version|\bv\."),
    "card": Context(0.8, r"(?i)card|visa|credit|payment", r"(?i)order|invoice|isbn"),
    "phone": Context(0.7, r"(?i)phone|tel|call|mobile|fax", r"(?i)version|isbn"),
    "iban": Context(0.9, r"(?i)iban|account|bank"),
    "ssn": Context(0.3, r"(?i)ssn|social|security|tax"),
    "secret": Context(0.3, r"(?i)token|secret|key|passw|auth|bearer", r"(?i)commit|sha|md5|checksum|digest"),
}
NEAR = 40


def _luhn(digits: Column) -> Column:
    """Whether a string of digits has a Luhn check digit."""
    chars = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    value = lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int"))
    return F.aggregate(F.transform(chars, value), F.lit(0), lambda a, b: a + b) % 10 == 0


def _mod97(iban: Column) -> Column:
    """Whether an IBAN without blanks has the check digits of ISO 7064 mod 97-10."""
    moved = F.concat(F.substring(iban, 5, 64), F.substring(iban, 1, 4))
    chars = F.filter(F.split(moved, ""), lambda c: c != "")
    step = lambda r, c: F.when(c.between("0", "9"), (r * 10 + c.try_cast("int")) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(chars, F.lit(0), step) == 1


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        bare = lambda p: F.regexp_replace(p, "^0+", "")
        small = lambda p: (F.length(bare(p)) <= 3) & (F.coalesce(bare(p).try_cast("int"), F.lit(0)) <= 255)
        return F.forall(F.split(m, r"\."), small)
    if kind == "card":
        return F.length(digits).between(16, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    if kind == "iban":
        plain = F.replace(m, F.lit(" "), F.lit(""))
        return F.length(plain).between(15, 34) & _mod97(plain)
    if kind == "ssn":
        return ~m.rlike("^(000|666|9)") & ~m.rlike("-00-|-0000$")
    if kind == "secret":
        return m.rlike("[0-9]") & m.rlike("[a-f]")
    return F.lit(True)


SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"
#: Matches whose running sums are made together, and code points of a piece of text.
LOT, PIECE = 256, 512


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _lots(items: Column) -> Column:
    """Neighbours in lots of ``LOT``; one empty lot if there are none."""
    number = F.greatest(F.ceil(F.size(items) / LOT), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), number - 1), lambda c: F.slice(items, c * LOT + 1, LOT))


def _running(values: Column, first: Column, add) -> Column:
    """``first``, then the running result of ``add`` after each value; for short arrays."""
    return F.aggregate(values, F.array(first), lambda acc, v: F.concat(acc, F.array(add(F.element_at(acc, -1), v))))


def _starts(gaps: Column, sizes: Column) -> Column:
    """Where each match starts, given the lengths of the pieces before them and of the matches."""
    steps = F.zip_with(F.slice(gaps, 1, F.size(sizes)), sizes, lambda g, n: F.struct(g.alias("g"), n.alias("n")))

    def placed(lots: Column) -> Column:
        ends = F.transform(lots, lambda lot: _running(F.transform(lot, lambda s: s["g"] + s["n"]), F.lit(0), lambda a, v: a + v))
        before = lambda e: _running(F.transform(e, lambda x: F.element_at(x, -1)), F.lit(0), lambda a, v: a + v)
        inside = lambda e: F.zip_with(lots, e, lambda lot, x: F.transform(lot, lambda s, i: F.get(x, i) + s["g"]))
        return _let(ends, lambda e: F.flatten(F.zip_with(inside(e), F.slice(before(e), 1, F.size(lots)), lambda x, b: F.transform(x, lambda v: v + b))))

    return _let(_lots(steps), placed)


def _pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def _between(pieces: Column, start: Column, end: Column) -> Column:
    """The text from ``start`` to ``end``, from the pieces that hold it."""
    first = F.floor(start / PIECE).cast("int")
    last = F.floor(F.greatest(end - 1, start) / PIECE).cast("int")
    return F.substring(F.array_join(F.slice(pieces, first + 1, last - first + 1), ""), start - first * PIECE + 1, F.greatest(end - start, F.lit(0)))


def spans_of(kind: str, text: Column) -> Column:
    """The confirmed spans of one kind, by start; ``text`` must not be null."""
    pattern, quick = PATTERNS[kind]
    context = CONTEXT[kind]

    def placed(found: Column) -> Column:
        sizes, gaps = F.transform(found["match"], lambda m: F.length(m)), F.transform(found["rest"], lambda p: F.length(p))
        return F.zip_with(found["match"], _starts(gaps, sizes), lambda m, s: F.struct(m.alias("m"), s.alias("s"), (s + F.length(m)).alias("e")))

    def scored(valid: Column, pieces: Column) -> Column:
        def score(x: Column) -> Column:
            near = F.concat(_between(pieces, F.greatest(x["s"] - NEAR, F.lit(0)), x["s"]), F.lit(" "), _between(pieces, x["e"], x["e"] + NEAR))
            raised = lambda n: context.score + F.when(n.rlike(context.raising), 0.3).otherwise(0.0) - F.when(n.rlike(context.lowering), 0.3).otherwise(0.0)
            value = _let(near, lambda n: F.round(F.greatest(F.least(raised(n), F.lit(1.0)), F.lit(0.0)), 2))
            return F.struct(F.lit(kind).alias("kind"), x["s"].alias("start"), x["e"].alias("end"), value.alias("score"))

        return F.transform(valid, score)

    none = F.array().cast(SPAN)
    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"), F.split(text, pattern, -1).alias("rest"))
    valid = lambda f: F.filter(placed(f), lambda x: _valid(kind, x["m"]))
    judged = lambda v: F.when(F.size(v) > 0, _let(_pieces(text), lambda p: scored(v, p)).cast(SPAN)).otherwise(none)
    confirmed = _let(found, lambda f: _let(valid(f), judged))
    if kind not in BASE:
        confirmed = F.filter(confirmed, lambda s: s["score"] >= context.least)
    return F.when(text.rlike(quick), confirmed).otherwise(none)


def with_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one array of spans for each kind, in columns ``__pii_<kind>``."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select("*", *[spans_of(kind, t).alias(f"__pii_{kind}") for kind in PATTERNS])


def _listed(kinds: tuple[str, ...]) -> Column:
    parts = [F.transform(f"__pii_{kind}", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))) for kind in kinds]
    return F.array_join(F.concat(*parts), ",")


def find(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, all spans and their number, and their
    scores in the same order, of every row."""
    rows = with_spans(docs.select(F.col(key), F.col(text).alias("text")), "text")
    scores = F.concat(*[F.transform(f"__pii_{kind}", lambda s: s["score"]) for kind in PATTERNS])
    return rows.select(
        key,
        *[F.size(f"__pii_{kind}").cast("long").alias(f"n_{kind}") for kind in BASE],
        F.sha2(_listed(BASE).cast("binary"), 256).alias("base_sha256"),
        _listed(tuple(PATTERNS)).alias("spans"),
        F.size(scores).cast("long").alias("n_spans"),
        F.array_join(F.transform(scores, lambda s: s.cast("string")), ",").alias("scores"),
    )


def _kept(spans: Column) -> Column:
    """Of spans by start those that begin after all earlier ones end, each with that end in ``at``."""
    kind = "array<struct<at:int,start:int,kind:string>>"
    farther = lambda a, b: F.greatest(a, b)

    def of(lots: Column) -> Column:
        reached = _running(F.transform(lots, lambda lot: F.array_max(F.transform(lot, lambda s: s["end"]))), F.lit(0), farther)

        def one(lot: Column, first: Column) -> Column:
            ends = _running(F.transform(lot, lambda s: s["end"]), first, farther)
            each = lambda e: F.transform(lot, lambda s, i: F.when(s["start"] >= F.get(e, i), F.struct(F.get(e, i).alias("at"), s["start"].alias("start"), s["kind"].alias("kind"))))
            return _let(ends, lambda e: F.array_compact(each(e)))

        return F.flatten(F.zip_with(lots, F.slice(reached, 1, F.size(lots)), one))

    return _let(_lots(spans), of).cast(kind)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """Texts with each span replaced by its kind in brackets; overlapping spans become one mark, of the
    kind that starts first (of these, that ends first, then by name)."""
    t = F.col(text)

    def rebuilt(spans: Column) -> Column:
        last = F.array_max(F.transform(spans, lambda s: s["end"]))
        marked = lambda p: F.transform(_kept(spans), lambda k: F.concat(_between(p, k["at"], k["start"]), F.lit("["), F.upper(k["kind"]), F.lit("]")))
        return _let(_pieces(t), lambda p: F.concat(F.array_join(marked(p), ""), F.substring(t, last + 1, F.length(t))))

    names = [f"__pii_{kind}" for kind in PATTERNS]
    ordered = F.array_sort(F.transform(F.concat(*names), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    rows = with_spans(docs, text).withColumn("__pii_spans", ordered)
    return rows.withColumn(text, F.when(F.size("__pii_spans") > 0, rebuilt(F.col("__pii_spans"))).otherwise(t)).drop("__pii_spans", *names)
