"""Contamination checks, schema profiles and descriptive statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetmill.functions import parsing as P
from facetmill.operators.guards import quantiles, sent
from facetmill.session import scratch


def _proposed(runs: DataFrame, corpus: DataFrame, run: str, width: int, doc: str, text: str, keep: list[str]) -> DataFrame:
    """``doc`` and its ``runs`` (structs of ``keep``) whose words, by a hash of them, stand in the text. The
    runs are sent to all tasks where a count shows them to be few, so the corpus isn't shuffled."""
    hashed = runs.withColumn("__h", F.get(P.shingle_hashes(F.col(run), width), F.lit(0)))
    found = corpus.select(doc, F.explode(P.shingle_hashes(F.col(text), width)).alias("__h")).join(sent(hashed), "__h")
    return found.groupBy(doc).agg(F.collect_set(F.struct(*keep)).alias("runs"))


def _shared(corpus: DataFrame, proposed: DataFrame, said: Column, holds: Callable[[Column], Column], example: str, doc: str, text: str) -> DataFrame:
    """Counts of the proposed runs that ``said`` of the text holds. The proposals are written first, so the
    corpus is searched for them once, and only their texts are made ready and compared."""
    path = scratch(corpus.sparkSession, "proposed")
    proposed.write.parquet(path)
    few = corpus.sparkSession.read.schema(proposed.schema).parquet(path)
    hits = corpus.select(doc, text).join(sent(few), doc).select(doc, said.alias("t"), "runs")
    hits = hits.select(doc, F.explode(F.filter("runs", holds)).alias("r"))
    return hits.groupBy(F.col(f"r.{example}").alias(example), doc).agg(F.count("*").alias("shared"))


def shared_shingles(examples: DataFrame, corpus: DataFrame, width: int = 8, example: str = "example_id", doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``example``, ``doc``, ``shared`` distinct runs of ``width`` words. Hashes of runs propose the texts, and
    only those are compared word for word."""
    runs = examples.select(example, F.explode(F.array_distinct(P.word_shingles(F.col(text), width))).alias("s"))
    proposed = _proposed(runs, corpus, "s", width, doc, text, [example, "s"])
    words = F.array_join(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""), " ")
    said = F.concat(F.lit(" "), words, F.lit(" "))
    return _shared(corpus, proposed, said, lambda r: F.contains(F.col("t"), F.concat(F.lit(" "), r["s"], F.lit(" "))), example, doc, text)


def contained_shingles(examples: DataFrame, corpus: DataFrame, width: int = 8, example: str = "example_id", doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The same by plain substring search in the lower-cased text, so a run may start or end inside a
    word and other white space defeats it.

    The inner words of a run stand whole in any text that contains it, so these propose the texts, and
    only those are searched for the run. ``width`` is 3 at least.
    """
    inner = F.substring_index(F.regexp_replace("s", r"^\S+ ", ""), " ", width - 2)
    runs = examples.select(example, F.explode(F.array_distinct(P.word_shingles(F.col(text), width))).alias("s")).withColumn("inner", inner)
    proposed = _proposed(runs, corpus, "inner", width - 2, doc, text, [example, "s"])
    return _shared(corpus, proposed, F.lower(text), lambda r: F.contains(F.col("t"), r["s"]), example, doc, text)


def schema_profile(rows: DataFrame, json: str, *by: str) -> DataFrame:
    """For each key of a JSON object column: share of rows that have it, share where it isn't empty,
    and its types."""
    total = rows.groupBy(*by).agg(F.count("*").alias("__n")) if by else rows.agg(F.count("*").alias("__n"))
    keys = rows.select(*by, F.col(json).alias("j"), F.explode(F.json_object_keys(json)).alias("key"))
    value = F.try_variant_get(F.parse_json("j"), F.concat(F.lit("$['"), F.col("key"), F.lit("']")), "variant")
    kind = F.regexp_extract(F.lower(F.schema_of_variant(value)), r"^([a-z]+)", 1)
    empty = F.is_variant_null(value) | F.to_json(value).isin('""', "[]", "{}")
    each = keys.select(*by, "key", kind.alias("kind"), empty.alias("empty"))
    out = each.groupBy(*by, "key").agg(F.count("*").alias("present"), F.count_if(~F.col("empty")).alias("filled"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("types"))
    out = out.join(total, list(by)) if by else out.crossJoin(F.broadcast(total))
    return out.select(*by, "key", F.round(100.0 * F.col("present") / F.col("__n"), 4).alias("present_pct"), F.round(100.0 * F.col("filled") / F.col("__n"), 4).alias("filled_pct"), "types")


def shares(rows: DataFrame, *by: str) -> DataFrame:
    """Counts of each value with their percentage of all rows."""
    total = rows.agg(F.count("*").alias("__n"))
    counts = rows.groupBy(*by).agg(F.count("*").alias("n")).crossJoin(F.broadcast(total))  # one row
    return counts.withColumn("pct", F.round(100.0 * F.col("n") / F.col("__n"), 4)).drop("__n")


def describe(rows: DataFrame, column: str, *by: str) -> DataFrame:
    """Count, mean, deviation, least and greatest value, and exact quartiles and 95th percentile of each group."""
    key = F.struct(F.lit(0).alias("g"), *[F.col(c) for c in by]).alias("__k")
    base = rows.groupBy(*by).agg(
        F.count(column).alias("n"), F.round(F.avg(column), 4).alias("mean"), F.round(F.stddev_samp(column), 4).alias("std"), F.min(column).alias("min"), F.max(column).alias("max")
    )
    at = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}
    found = quantiles(rows, column, at, *by).select(key, *[F.round(n, 4).alias(n) for n in at])
    out = base.select("*", key).join(found, "__k", "left")
    return out.select(*by, "n", "mean", "std", "min", *at, "max")


def foreign_fraction(rows: DataFrame, locale: str, product: str, foreign: Column) -> DataFrame:
    """Per locale: products, mean and greatest share of foreign reviews, and products that have any."""
    each = rows.groupBy(locale, product).agg(F.avg(foreign.cast("int")).alias("f"))
    return each.groupBy(locale).agg(F.count("*").alias("products"), F.round(F.avg("f"), 6).alias("mean_foreign"), F.round(F.max("f"), 6).alias("max_foreign"), F.count_if(F.col("f") > 0).alias("with_foreign"))


def funnel(rows: DataFrame, steps: dict[str, Column]) -> DataFrame:
    """Rows that pass each step, and their percentage, one row a step."""
    counts = rows.agg(F.count("*").alias("__n"), *[F.count_if(c).alias(n) for n, c in steps.items()])
    listed = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(n).alias("name"), F.col(n).alias("n"), F.round(100.0 * F.col(n) / F.col("__n"), 4).alias("pct")) for i, n in enumerate(steps, 1)])
    return counts.select(F.inline(listed))


def log_minutes(lines: DataFrame, series: str, stamp: str, order: str, least: float = 1.0) -> DataFrame:
    """Minutes between the first and last stamp of each series in line order, if over ``least``."""
    ends = lines.groupBy(series).agg(F.min_by(stamp, order).alias("first"), F.max_by(stamp, order).alias("last"))
    return ends.withColumn("minutes", P.minutes_between(F.col("first"), F.col("last"))).where(F.col("minutes") > least)


def parse_rates(rows: DataFrame, parsers: dict[str, Column]) -> DataFrame:
    """Percentage of rows that each parser reads."""
    counts = rows.agg(F.count("*").alias("__n"), *[F.count(c).alias(n) for n, c in parsers.items()])
    listed = F.array(*[F.struct(F.lit(n).alias("parser"), F.col("__n").alias("n"), F.round(100.0 * F.col(n) / F.col("__n"), 4).alias("parsed_pct")) for n in parsers])
    return counts.select(F.inline(listed))


def overlap(a: DataFrame, b: DataFrame, key: str, a_name: str, b_name: str) -> DataFrame:
    """Distinct keys in both tables and in either alone, by one full outer aggregate."""
    sides = a.select(key, F.lit(1).alias("__a"), F.lit(0).alias("__b")).unionByName(b.select(key, F.lit(0).alias("__a"), F.lit(1).alias("__b")))
    each = sides.groupBy(key).agg(F.max("__a").alias("a"), F.max("__b").alias("b"))
    return each.agg(F.count_if(F.col("a") + F.col("b") == 2).alias("shared"), F.count_if(F.col("b") == 0).alias(f"only_{a_name}"), F.count_if(F.col("a") == 0).alias(f"only_{b_name}"))


def throughput(rows: DataFrame, series: str, stamp: str, target: int) -> DataFrame:
    """Seconds for each row of a series, and the days that ``target`` rows would take."""
    each = rows.groupBy(series).agg(F.count("*").alias("n"), F.timestamp_diff("SECOND", F.min(stamp), F.max(stamp)).alias("s"))
    rate = F.col("s") / F.col("n")
    return each.select(series, "n", F.round(rate, 6).alias("seconds_each"), F.round(rate * target / 86400.0, 4).alias("days"))


def scaling_arms(rows: DataFrame, keys: list[str], shares_: tuple[int, ...] = (25, 50, 75, 100), seed: str = "0") -> DataFrame:
    """``rows`` once for each percentage of the keys, in column ``arm``; a smaller arm is part of a larger
    one, by a hash of seed and keys."""
    place = P.hash_index(F.lit(100), F.lit(seed), *[F.col(k) for k in keys])
    return rows.withColumn("arm", F.explode(F.filter(F.array(*map(F.lit, shares_)), lambda a: place < a)))


def page_after(rows: DataFrame, key: str, last: object, size: int) -> DataFrame:
    """The ``size`` rows that follow key ``last``; the filter reaches the scan, unlike an offset's."""
    after = rows if last is None else rows.where(F.col(key) > F.lit(last))
    return after.orderBy(key).limit(size)
