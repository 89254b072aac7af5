"""Checks that raise, sizes that decide, and ranks without one task for all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetmill.session import scratch


class DuplicateKeyError(ValueError):
    """A key that must be unique is not."""


def duplicate_keys(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(rows: DataFrame, *keys: str) -> DataFrame:
    found = duplicate_keys(rows, *keys).take(3)
    if found:
        raise DuplicateKeyError(f"{keys} is not unique: {[r.asDict() for r in found]}")
    return rows


def refuse_prefix(tag: str, prefix: str = "v") -> str:
    """The tag of a search run; released versions own a prefix that runs must not take."""
    if tag.startswith(prefix):
        raise ValueError(f"tag {tag!r} begins with {prefix!r}, which names released versions")
    return tag


def _bytes(column: str, kind: str) -> Column:
    if kind in ("string", "binary"):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 8
    if kind.startswith(("array", "map", "struct")):
        return F.octet_length(F.to_json(F.struct(column))) + 8
    return F.lit(8)


def sent(small: DataFrame, rows: int = 1_000_000, size: int = 64 << 20) -> DataFrame:
    """The table, to be sent to all executors if a count shows that it has few rows and bytes."""
    part = small.limit(rows + 1)
    total = sum((_bytes(f"`{c}`", kind) for c, kind in small.dtypes), F.lit(0))
    n, held = part.agg(F.count("*"), F.sum(total)).first()
    return F.broadcast(small) if n <= rows and (held or 0) <= size else small


#: Ranges that a column's distinct values are cut into, so that none is sorted in one task.
RANGES = 256


def running_before(counts: DataFrame, value: str, n: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``counts`` (distinct ``value`` within the groups ``by``, count ``n``) with ``before``, the rows of all
    lesser values of the group.

    A group's values are cut at their approximate quantiles; each range is summed up in a task of its own,
    and only the ranges' totals meet. So a group that holds most rows is many tasks.
    """
    group = F.struct(*[F.lit(0).alias("g"), *[F.col(c) for c in by]])
    rows = counts.withColumn("__g", group)
    cuts = rows.groupBy("__g").agg(F.percentile_approx(value, [i / RANGES for i in range(1, RANGES)], 10_000).alias("__cuts"))
    rows = rows.join(sent(cuts), "__g")
    rows = rows.withColumn("__part", F.size(F.filter(F.array_distinct("__cuts"), lambda c: c <= F.col(value)))).drop("__cuts")
    totals = rows.groupBy("__g", "__part").agg(F.sum(n).alias("__t"))  # RANGES rows a group at most
    first = Window.partitionBy("__g").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("__g", "__part", F.coalesce(F.sum("__t").over(first), F.lit(0)).alias("__first"))
    own = Window.partitionBy("__g", "__part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("__own", F.coalesce(F.sum(n).over(own), F.lit(0))).join(sent(totals), ["__g", "__part"])
    return out.withColumn("before", F.col("__first") + F.col("__own")).drop("__g", "__part", "__own", "__first")


def quantiles(rows: DataFrame, value: str, at: dict[str, float], *by: str) -> DataFrame:
    """Exact quantiles of each group, interpolated: a column for each name of ``at``. Values are counted first
    and their places found by ranges, so no task has a group's values and no buffer grows with them."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__n"))
    key = F.struct(F.lit(0).alias("g"), *[F.col(c) for c in by]).alias("__k")
    placed = running_before(counts, value, "__n", by).select("*", key)
    totals = counts.select("__n", key).groupBy("__k").agg(F.sum("__n").alias("__all"))
    here = lambda rank: F.max(F.when((F.col("before") <= rank) & (rank < F.col("before") + F.col("__n")), F.col(value))).cast("double")
    ends = []
    for name, q in at.items():
        place = F.lit(q) * (F.col("__all") - 1)
        ends += [here(F.floor(place)).alias(f"{name}__lo"), here(F.ceil(place)).alias(f"{name}__hi"), F.max(place - F.floor(place)).alias(f"{name}__part")]
    found = placed.join(sent(totals), "__k").groupBy(*by).agg(*ends)
    between = lambda n: (F.col(f"{n}__lo") + (F.col(f"{n}__hi") - F.col(f"{n}__lo")) * F.col(f"{n}__part")).alias(n)
    return found.select(*by, *[between(n) for n in at])


def numbered(rows: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """``rows`` with their place, from 0, in an order of all: sorted by ranges, and a range's first place is the
    count of the ranges before it. The sorted rows are written to the shared folder, so pass narrow ones."""
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    path = scratch(spark, "numbered")
    dealt.write.parquet(path)
    sorted_ = spark.read.schema(dealt.schema).parquet(path)
    lot = F.shiftright("__at", 33).cast("long")  # the upper bits are the range
    starts, before = [], 0
    for r in sorted_.groupBy(lot.alias("lot")).agg(F.count("*").alias("n")).orderBy("lot").collect():  # one a range
        starts.append((r["lot"], before))
        before += r["n"]
    offsets = F.broadcast(spark.createDataFrame(starts, "__lot long, __before long"))
    out = sorted_.withColumn("__lot", lot).join(offsets, "__lot")
    return out.withColumn(name, F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__lot", "__before", "__at")
