"""Extraction scores, bootstrap intervals, corrections and rank correlation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetmill.functions import aspects as A
from facetmill.operators.guards import numbered, running_before, sent
from facetmill.session import scratch, ship_package


def _ratio(a: Column, b: Column, empty: float) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(empty))


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def example_scores(gold: DataFrame, pred: DataFrame, keys: list[str], accepted: str | None = None) -> DataFrame:
    """Scores of each gold row; one without predictions misses all, predictions without gold don't
    count. Both tables have ``aspects``. Empty denominators count as 1 here."""
    rows = gold.select(*keys, F.col("aspects").alias("gold"), *([accepted] if accepted else [])).join(pred.select(*keys, F.col("aspects").alias("pred")), keys, "left")
    rows = rows.withColumn("m", A.greedy_match(F.col("pred"), F.col("gold"), F.col(accepted) if accepted else None)).select(*keys, "m.*")
    p, r = _ratio(F.col("tp"), F.col("tp") + F.col("fp"), 1.0), _ratio(F.col("tp"), F.col("tp") + F.col("fn"), 1.0)
    return rows.withColumn("polarity_total", F.col("tp")).withColumn("f1", F.round(_f1(p, r), 4))


def micro_scores(examples: DataFrame, *by: str) -> DataFrame:
    """Micro averages over all rows, or by group. Empty denominators count as 0, polarity as null."""
    s = {c: F.sum(c) for c in ("tp", "fp", "fn", "polarity_hits")}
    p, r = _ratio(s["tp"], s["tp"] + s["fp"], 0.0), _ratio(s["tp"], s["tp"] + s["fn"], 0.0)
    return examples.groupBy(*by).agg(
        F.round(p, 4).alias("facet_precision"),
        F.round(r, 4).alias("facet_recall"),
        F.round(_f1(p, r), 4).alias("facet_f1"),
        F.when(s["tp"] > 0, F.round(s["polarity_hits"] / s["tp"], 4)).alias("polarity_accuracy"),
        F.count("*").alias("n_reviews"),
    )


def worst(examples: DataFrame, n: int, order: list[str]) -> DataFrame:
    return examples.orderBy("f1", F.desc(F.col("fp") + F.col("fn")), *order).limit(n)


def top_facets(examples: DataFrame, column: str, n: int = 15) -> DataFrame:
    return examples.select(F.explode(column).alias("facet")).groupBy("facet").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "facet").limit(n)


#: The modulus and the multipliers of the draws, small enough for 64-bit products.
MODULUS, BY_SAMPLE, BY_PLACE = 2_147_483_647, 1_000_003, 7_919
#: Units of a block, draws made at a time, and the lots that the samples are dealt into.
BLOCK, DRAWS, LOTS = 1_000_000, 1_000_000, 64


def draws(sample: int, n: int, seed: int = 0, first: int = 0, number: int | None = None) -> np.ndarray:
    """The places that sample number ``sample`` draws from 0..n-1, n of them, with replacement: two rounds
    of a quadratic residue map, so any engine with 64-bit integers draws the same. Of the n draws, ``number``
    from the ``first`` on."""
    at = np.arange(first, n if number is None else min(first + number, n), dtype=np.int64)
    h = (seed + sample * BY_SAMPLE + at * BY_PLACE) % MODULUS
    h = (h * h + h + 12_345) % MODULUS
    h = (h * h + 3 * h + 6_789) % MODULUS
    return h * n // MODULUS


def bootstrap(units: DataFrame, order: list[str], columns: list[str], times: int = 10_000, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """``b``, ``n`` and the sum of each of ``columns`` over resample b of the units, which has as many units
    as there are. Sums are all that means and micro averages need, so nothing is matched again.

    Units are numbered in the order of their keys and cut into blocks; a task has one block and a lot of
    the samples, makes each sample's draws a part at a time, and adds up those that fall into its block.
    So no task and not the driver holds all units, however many there are.
    """
    ship_package(units.sparkSession)
    placed = numbered(units.select(*order, *[F.col(c).alias(f"__v{i}") for i, c in enumerate(columns)]), [F.col(c) for c in order])
    n = placed.count()
    kinds = ["double" if units.schema[c].dataType.typeName() in ("double", "float", "decimal") else "long" for c in columns]
    values = [f"__v{i}" for i in range(len(columns))]
    dealt = placed.select("place", *[F.col(v).cast(k).alias(v) for v, k in zip(values, kinds)], F.floor(F.col("place") / block).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(min(LOTS, times) - 1))).alias("lot"))

    def run(group: pa.Table) -> pa.Table:
        lot, number = group.column("lot")[0].as_py(), group.column("block")[0].as_py()
        at = np.argsort(group.column("place").to_numpy())
        held = [group.column(v).to_numpy()[at] for v in values]
        low, high = number * block, number * block + len(at)
        samples = list(range(lot, times, min(LOTS, times)))
        sums = [[] for _ in held]
        for b in samples:
            parts = [0] * len(held)
            for i in range(0, n, DRAWS):
                place = draws(b, n, seed, i, DRAWS)
                place = place[(place >= low) & (place < high)] - low
                parts = [p + v[place].sum() for p, v in zip(parts, held)]
            for s, p in zip(sums, parts):
                s.append(p)
        kinds_ = [pa.float64() if k == "double" else pa.int64() for k in kinds]
        return pa.table([pa.array(samples, pa.int64()), *[pa.array(s, k) for s, k in zip(sums, kinds_)]], ["b", *values])

    part = dealt.groupBy("block", "lot").applyInArrow(run, "b long, " + ", ".join(f"{v} {k}" for v, k in zip(values, kinds)))
    return part.groupBy("b").agg(F.lit(n).cast("long").alias("n"), *[F.sum(v).alias(c) for v, c in zip(values, columns)])


def interval(samples: DataFrame, column: str, n: int, level: float = 0.95) -> DataFrame:
    """Order-statistic bounds ``lo``/``hi`` and interpolated bounds ``lo_i``/``hi_i`` of n samples, which are
    one number a resample."""
    tail = (1 - level) / 2
    ranked = F.array_sort(F.collect_list(column))
    at = lambda q: F.get(F.col("__s"), F.lit(int(q * n)))
    out = samples.agg(ranked.alias("__s"), F.percentile(column, tail).alias("lo_i"), F.percentile(column, 1 - tail).alias("hi_i"))
    return out.select(at(tail).alias("lo"), at(1 - tail).alias("hi"), "lo_i", "hi_i")


def holm_bh(tests: DataFrame, p: str = "p", key: str = "test") -> DataFrame:
    """Holm and Benjamini-Hochberg adjusted p-values of one family of tests, a handful of rows by nature."""
    up = Window.orderBy(p, key)
    ranked = tests.withColumn("__r", F.row_number().over(up)).withColumn("__n", F.count("*").over(Window.partitionBy()))
    holm = F.least(F.lit(1.0), F.max((F.col("__n") - F.col("__r") + 1) * F.col(p)).over(up.rowsBetween(Window.unboundedPreceding, 0)))
    bh = F.least(F.lit(1.0), F.min(F.col("__n") * F.col(p) / F.col("__r")).over(up.rowsBetween(0, Window.unboundedFollowing)))
    return ranked.select(*tests.columns, holm.alias("holm"), bh.alias("bh"))


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Spearman's rho of the rows that have both values, null if one of them never changes. Equal pairs are
    counted first, so what is ranked, joined and summed up are the distinct pairs; middle ranks come from
    the distinct values and their counts, in ranges."""
    pairs = rows.select(F.col(a).alias("__a"), F.col(b).alias("__b")).dropna().groupBy("__a", "__b").agg(F.count("*").alias("__w"))
    path = scratch(rows.sparkSession, "pairs")
    pairs.write.parquet(path)
    pairs = rows.sparkSession.read.schema(pairs.schema).parquet(path)
    middle = ((pairs.agg(F.sum("__w")).first()[0] or 0) + 1) / 2  # the mean of the ranks

    def ranks(c: str) -> DataFrame:
        counts = running_before(pairs.groupBy(c).agg(F.sum("__w").alias("__n")), c, "__n")
        return counts.select(F.col(c), (F.col("before") + (F.col("__n") + 1) / 2.0 - middle).alias(f"{c}r"))

    ranked = pairs.join(sent(ranks("__a")), "__a").join(sent(ranks("__b")), "__b")
    total = lambda x, y: F.sum(F.col("__w") * F.col(x) * F.col(y))
    both, one, other = total("__ar", "__br"), total("__ar", "__ar"), total("__br", "__br")
    return ranked.agg(F.when((one > 0) & (other > 0), both / F.sqrt(one) / F.sqrt(other)).alias("spearman"))


def star_curve(rows: DataFrame, star: str, value: str) -> DataFrame:
    """Levels of ``star``, whether the mean of ``value`` never falls from one level to the next, and the
    smallest step. Only the levels' means are put in order."""
    means = rows.groupBy(star).agg(F.avg(value).alias("__m"))
    step = F.col("__m") - F.lag("__m").over(Window.orderBy(star))  # one row a level
    return means.withColumn("__s", step).agg(F.count("*").alias("levels"), F.coalesce(F.min("__s") >= 0, F.lit(True)).alias("monotone"), F.min("__s").alias("least_step"))
