"""Category buckets over a ragged hierarchy of path prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetmill.operators.guards import quantiles

GLOBAL_BUCKET = ("__global__",)


def prefixes(path: Column) -> Column:
    """Every prefix of a path, shortest first; none of an empty path."""
    deep = F.transform(F.sequence(F.lit(1), F.size(path)), lambda d: F.slice(path, 1, d))
    return F.when(F.size(path) > 0, deep).otherwise(F.array().cast("array<array<string>>"))


def node_totals(products: DataFrame, path: str = "category", count: str = "n_reviews") -> DataFrame:
    """``prefix`` and ``total`` reviews of every node."""
    grouped = products.groupBy(path).agg(F.sum(count).alias("n"))  # equal paths meet before they multiply
    return grouped.select(F.explode(prefixes(F.col(path))).alias("prefix"), "n").groupBy("prefix").agg(F.sum("n").alias("total"))


def assign_buckets(products: DataFrame, floor: int = 1000, path: str = "category", count: str = "n_reviews", key: str = "product_id") -> DataFrame:
    """``key``, ``bucket`` and ``depth``: the deepest prefix with at least ``floor`` reviews. Totals
    never grow with depth, so the deepest that qualifies is where backing off stops."""
    nodes = node_totals(products, path, count).where(F.col("total") >= floor)
    paths = products.select(path).distinct()
    chosen = (
        paths.select(path, F.explode(prefixes(F.col(path))).alias("prefix"))
        .join(nodes, "prefix")
        .groupBy(path)
        .agg(F.max_by("prefix", F.size("prefix")).alias("bucket"))
    )
    bucket = F.coalesce("bucket", F.array(*map(F.lit, GLOBAL_BUCKET)))
    return products.join(chosen, path, "left").select(key, bucket.alias("bucket"), F.when(F.col("bucket").isNull(), 0).otherwise(F.size("bucket")).alias("depth"))


def level_statistics(products: DataFrame, levels: int = 6, path: str = "category", count: str = "n_reviews", thin: tuple[int, ...] = (1000, 5000)) -> DataFrame:
    """For each cut level: buckets, median and lower quartile of reviews in one, and the share of the
    products that sit in thin buckets. A path shorter than the level is its own bucket."""
    cut = products.select(count, F.explode(F.sequence(F.lit(1), F.lit(levels))).alias("level"), F.col(path).alias("p"))
    buckets = cut.groupBy("level", F.slice("p", 1, F.col("level")).alias("bucket")).agg(F.sum(count).alias("reviews"), F.count("*").alias("products"))
    share = lambda t: F.round(100.0 * F.sum(F.when(F.col("reviews") < t, F.col("products")).otherwise(0)) / F.sum("products"), 4)
    counts = buckets.groupBy("level").agg(F.count("*").alias("buckets"), *[share(t).alias(f"pct_products_under_{t}") for t in thin])
    found = quantiles(buckets, "reviews", {"median": 0.5, "p25": 0.25}, "level")
    whole = lambda c: F.floor(c).cast("long").alias(f"{c}_reviews")
    return counts.join(found, "level", "left").select("level", "buckets", whole("median"), whole("p25"), *[f"pct_products_under_{t}" for t in thin])


def depth_histogram(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("depth").agg(F.count("*").alias("n"))


def values_by_depth(products: DataFrame, path: str = "category") -> DataFrame:
    """Distinct values at each depth and how many products reach it."""
    return products.select(F.posexplode(path).alias("depth", "value")).groupBy("depth").agg(F.count_distinct("value").alias("values"), F.count("*").alias("products"))


def first_is_top(products: DataFrame, path: str = "category", top: str = "cat_top") -> DataFrame:
    """Products, and the share of them whose path begins with their top category; an empty path doesn't."""
    same = F.coalesce(F.get(F.col(path), F.lit(0)) == F.col(top), F.lit(False))
    return products.agg(F.count("*").alias("products"), F.avg(same.cast("int")).alias("first_is_top"))
