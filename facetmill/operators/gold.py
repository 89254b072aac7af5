"""Gold sets: strata, reproducible samples, sheet ingestion, agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetmill.functions import aspects as A
from facetmill.functions import parsing as P

TRIVIAL_UNDER, LONG_OVER, HOME = 40, 400, "the United States"
STRATA = ("trivial", "long", "foreign", "low_star", "typical")
#: Words of the reviewed and flag columns.
REVIEWED, FLAGS = ("x", "ok", "yes", "done", "1", "true"), ("", "skip", "unsure")


def stratum(text: Column, country: Column, stars: Column, home: str = HOME, trivial: int = TRIVIAL_UNDER, long: int = LONG_OVER) -> Column:
    """The first stratum that fits; a null never fits."""
    return (
        F.when(F.length(text) < trivial, "trivial")
        .when(F.length(text) > long, "long")
        .when(country != home, "foreign")
        .when(stars.try_cast("double") <= 2, "low_star")
        .otherwise("typical")
    )


def gold_splits(rows: DataFrame, dev_n: int = 250, test_n: int = 350, seed: str = "0", key: str = "asin", ids: tuple[str, ...] = ("asin", "review_no")) -> DataFrame:
    """``split`` for a sample of ``rows`` (deduplicated, with ``stratum``): test uniformly, then dev
    from products that aren't in test, evenly over the strata, topped up from ``typical``.

    Samples go by a hash of seed and ids. Raises if there are fewer rows than ``test_n``.
    """
    ordered = rows.withColumn("__h", P.hash_order(seed, *[F.col(c) for c in ids]))
    order = [F.col("__h"), *[F.col(c) for c in ids]]
    test = ordered.orderBy(*order).limit(test_n).withColumn("split", F.lit("test"))
    if test.count() < test_n:
        raise ValueError(f"fewer than {test_n} rows to sample from")
    pool = ordered.join(test.select(key).distinct(), key, "left_anti")
    each = dev_n // len(STRATA)
    # Both picks keep a few rows of each task only, before anything is shuffled.
    rank = F.row_number().over(Window.partitionBy("stratum").orderBy(*order))
    even = pool.withColumn("__r", rank).where(F.col("__r") <= each).drop("__r")
    short = max(dev_n - even.count(), 0)
    more = pool.where("stratum = 'typical'").orderBy(*order).limit(each + short).join(even.select(*ids), list(ids), "left_anti").select(*even.columns)
    return test.unionByName(even.unionByName(more).withColumn("split", F.lit("dev"))).drop("__h")


def judge_sheet(sheet: DataFrame, manifest: DataFrame) -> DataFrame:
    """Each annotation row with its ``outcome`` and, where one applies, ``errors`` and ``gold``."""
    known = manifest.select("asin", "review_no", "split", F.lit(True).alias("__known"))
    rows = sheet.withColumn("review_no", F.col("review_no").try_cast("int")).join(known, ["asin", "review_no"], "left")
    flag, seen = F.lower(P.strip(F.coalesce("flag", F.lit("")))), F.lower(P.strip(F.coalesce("reviewed", F.lit(""))))
    rows = rows.withColumn("__gold", A.parse_cell(F.col("gold_aspects"))).withColumn("__draft", A.parse_cell(F.col("draft_aspects")))
    outcome = (
        F.when(F.col("__known").isNull(), "not_in_manifest")
        .when(~flag.isin(*FLAGS), "bad_flag")
        .when(flag == "skip", "skipped")
        .when(flag == "unsure", "unsure")
        .when(~seen.isin(*REVIEWED), "unreviewed")
        .when(F.col("__gold.aspects").isNull(), "blank_gold")
        .when(F.size("__gold.errors") > 0, "parse_error")
        .otherwise("frozen")
    )
    return rows.select(*[c for c in sheet.columns], "split", outcome.alias("outcome"), F.col("__gold.errors").alias("errors"), F.col("__gold.aspects").alias("gold"), F.when(F.size("__draft.errors") == 0, F.col("__draft.aspects")).alias("draft"))


def last_by_facet(aspects: Column) -> Column:
    """Aspects with the last polarity of each facet, as a list."""
    return F.filter(F.transform(aspects, lambda a, i: F.when(~F.exists(F.slice(aspects, i + 2, F.size(aspects)), lambda b: b["facet"] == a["facet"]), a)), lambda a: a.isNotNull())


def agreement(frozen: DataFrame) -> DataFrame:
    """Draft against gold over rows that have both: one row of counters."""
    names = lambda c: F.transform(last_by_facet(F.col(c)), lambda a: a["facet"])
    changed = F.size(F.filter(last_by_facet(F.col("gold")), lambda g: F.exists(last_by_facet(F.col("draft")), lambda d: (d["facet"] == g["facet"]) & (d["polarity"] != g["polarity"]))))
    return frozen.where("draft IS NOT NULL").agg(
        F.count("*").alias("rows_compared"),
        F.count_if(F.array_sort("draft") == F.array_sort("gold")).alias("rows_unchanged"),
        F.coalesce(F.sum(F.size(F.array_except(names("gold"), names("draft")))), F.lit(0)).alias("facets_added"),
        F.coalesce(F.sum(F.size(F.array_except(names("draft"), names("gold")))), F.lit(0)).alias("facets_removed"),
        F.coalesce(F.sum(changed), F.lit(0)).alias("polarity_changed"),
    )


def merge_drafts(sheet: DataFrame, drafts: DataFrame) -> DataFrame:
    """Drafts fill the draft column, and the gold column where it is still blank."""
    rows = sheet.join(drafts.select("asin", "review_no", F.col("draft").alias("__d")), ["asin", "review_no"], "left")
    blank = F.length(P.strip(F.coalesce("gold_aspects", F.lit("")))) == 0
    out = rows.withColumn("gold_aspects", F.when(blank & F.col("__d").isNotNull(), F.col("__d")).otherwise(F.col("gold_aspects")))
    return out.withColumn("draft_aspects", F.coalesce("__d", "draft_aspects")).select(*sheet.columns)
