"""Quantiles, places and resamples without a task that holds a group."""

import random

import numpy as np
from pyspark.sql import functions as F

from facetmill.operators import guards, inspect, scores
from facetmill.plans import catalogue


def test_quantiles_against_plain(spark):
    rng = random.Random(2)
    rows = [("hot", rng.choice([rng.uniform(-5, 5), 3.0])) for _ in range(4000)] + [("few", float(i)) for i in (5, 1, 2)] + [("one", 7.5), ("none", None), (None, 2.0), (None, 4.0)]
    rows += [("same", 1.0)] * 50 + [("hot", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    at = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.95, "e": 1.0}
    got = {r.g: tuple(r[n] for n in at) for r in guards.quantiles(df, "v", at, "g").collect()}
    want = {}
    for g in {g for g, v in rows if v is not None}:
        want[g] = tuple(np.quantile([v for h, v in rows if h == g and v is not None], q) for q in at.values())
    assert got.keys() == want.keys() and all(np.allclose(got[g], want[g], rtol=0, atol=1e-9) for g in want)
    (whole,) = guards.quantiles(df, "v", at).collect()
    assert np.allclose(list(whole), np.quantile([v for _, v in rows if v is not None], list(at.values())))
    described = {r.g: r for r in inspect.describe(df, "v", "g").collect()}
    assert described["none"].n == 0 and described["none"].p50 is None and described["hot"].n == 4000 and described["few"].p50 == 2.0
    assert guards.quantiles(df.where("v > 100"), "v", at, "g").count() == 0


def test_quantiles_plan_has_no_group_buffer(spark):
    df = spark.createDataFrame([("g", 1.0)], "g string, v double")
    plan = inspect.describe(df, "v", "g")._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan and "collect_list" not in plan


def test_numbered_in_any_partitions(spark):
    rows = [(i % 7, i) for i in range(500)]
    random.Random(1).shuffle(rows)
    for parts in (1, 9):
        df = spark.createDataFrame(rows, "k int, i int").repartition(parts)
        got = [(r.k, r.i) for r in guards.numbered(df, [F.col("k"), F.desc("i")]).orderBy("place").collect()]
        assert got == sorted(rows, key=lambda x: (x[0], -x[1]))
        assert guards.numbered(df, [F.col("k")]).agg(F.count_distinct("place"), F.max("place")).first()[:] == (500, 499)
    assert guards.numbered(df.limit(0), [F.col("k")]).count() == 0


def test_bootstrap_in_blocks(spark):
    """Any size of blocks gives the sums of plain draws, so a judged set may be of any size."""
    rng = np.random.default_rng(3)
    n, times = 137, 90
    hits, delta = rng.integers(0, 9, n), rng.normal(size=n)
    order = rng.permutation(n)
    df = spark.createDataFrame([(int(i), int(hits[i]), float(delta[i])) for i in order], "k int, hits int, delta double")
    want = {b: scores.draws(b, n, 4) for b in range(times)}
    for block in (10, 137, 10_000):
        got = {r.b: (r.n, r.hits, r.delta) for r in scores.bootstrap(df, ["k"], ["hits", "delta"], times, 4, block).collect()}
        assert got.keys() == want.keys()
        assert all(got[b][:2] == (n, hits[p].sum()) and abs(got[b][2] - delta[p].sum()) < 1e-9 for b, p in want.items())
    pieces = np.concatenate([scores.draws(5, n, 4, i, 20) for i in range(0, n, 20)])
    assert (pieces == want[5]).all()


def test_spearman_of_a_constant(spark):
    df = spark.createDataFrame([(1, 2), (1, 3), (None, 4)], "a int, b int")
    assert scores.spearman(df, "a", "b").first()[0] is None
    assert abs(scores.spearman(spark.createDataFrame([(1, 9), (2, 5), (3, 1), (3, 1)], "a int, b int"), "a", "b").first()[0] + 1) < 1e-12


def test_best_iteration_takes_the_first_of_ties(spark, tmp_path):
    rows = [(i, u, v) for u in (1, 2) for i, v in ((90 + u, 5.0), (30 + u, 5.0), (60 + u, 5.0), (10 + u, 4.0))]
    rows += [(None, 3, 9.0), (7, 3, 1.0), (8, 4, None)]
    want = {1: (5.0, 31), 2: (5.0, 32), 3: (9.0, 7), 4: (None, None)}
    for n, order in enumerate((rows, rows[::-1])):
        spark.createDataFrame(order, "event_id long, user_id long, value double").repartition(n + 1).write.parquet(f"{tmp_path}/{n}/events.parquet")
        got = catalogue.queries()["best_iteration"](spark, f"{tmp_path}/{n}").collect()
        assert {r.user_id: (r.best, r["at"]) for r in got} == want
