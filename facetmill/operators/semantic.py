"""Facets matched by meaning: an injected encoder, a threshold join of vectors, scores with what it accepts.

Each distinct facet is encoded once. Vectors are sorted into cells by their nearest centroid, and cells into
blocks; two blocks meet in one product if the angle between their centroids, less their radii, leaves room
for the threshold. So each unordered pair is looked at once at most, and only accepted pairs are rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from facetmill.operators import dense, scores
from facetmill.operators.guards import sent
from facetmill.session import scratch, ship_package

#: Fixed value: the least cosine of facets that mean the same.
THRESHOLD = 0.80
CANARY = "canary facet"
#: Facets encoded in one call; vectors of a block; pairs of blocks of a task.
CALL, BLOCK, ROWS = 256, 2048, 8


class EncoderError(RuntimeError):
    """The encoder gives vectors that can't be right."""


def _checked(encode: Callable[[list[str]], list], facets: list[str], before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length 1, and the canary's. The canary goes along with every call: it must be a vector of
    numbers that matches itself, and its vector of the calls before."""
    x = np.array(encode([CANARY, *facets]), np.float64)
    if x.ndim != 2 or len(x) != len(facets) + 1 or not np.isfinite(x).all():
        raise EncoderError("the encoder didn't give one vector of numbers for each facet")
    x = dense.unit(x)
    known = x[0] if before is None else before
    if not x[0] @ known >= 1 - 1e-3:
        raise EncoderError("the encoder's vectors of one and the same text don't match")
    return x[1:], known


def facet_vectors(facets: DataFrame, encode: Callable[[list[str]], list], facet: str = "facet") -> DataFrame:
    """``facet`` and ``vector`` (unit length) of each distinct facet, written to the shared folder, so that
    nothing is encoded twice. ``encode`` is picklable and takes a list of texts."""
    spark = facets.sparkSession
    ship_package(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canary = None
        for batch in batches:
            names = batch.column(0).to_pylist()
            for i in range(0, len(names), CALL):
                x, canary = _checked(encode, names[i : i + CALL], canary)
                yield pa.RecordBatch.from_arrays([pa.array(names[i : i + CALL], pa.string()), pa.array(x.tolist(), pa.list_(pa.float64()))], ["facet", "vector"])

    distinct = facets.where(F.col(facet).isNotNull()).select(F.col(facet).alias("facet")).distinct()
    path = scratch(spark, "facets")
    distinct.mapInArrow(run, "facet string, vector array<double>").write.parquet(path)
    return spark.read.schema("facet string, vector array<double>").parquet(path)


def threshold_pairs(vectors: DataFrame, threshold: float = THRESHOLD, key: str = "facet", vector: str = "vector", cells: int = 256, block: int = BLOCK) -> DataFrame:
    """``a``, ``b`` (a < b) and ``cosine`` of all pairs of ``key`` (unique) whose cosine reaches the threshold."""
    spark = vectors.sparkSession
    ship_package(spark)
    kind = vectors.schema[key].dataType.simpleString()
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector")).where("key IS NOT NULL AND vector IS NOT NULL")
    n = rows.count()
    if not n:
        return spark.createDataFrame([], f"a {kind}, b {kind}, cosine double")
    share = rows if n <= dense.SAMPLE else rows.where(F.pmod(F.xxhash64("key"), F.lit(n)) < dense.SAMPLE)
    picked = [r["vector"] for r in share.select("vector", F.xxhash64("key").alias("h")).orderBy("h").limit(2 * dense.SAMPLE).toLocalIterator()]
    centroids = dense.train(np.array(picked), min(cells, max(1, n // (block // 2))))
    shared = spark.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = dense.unit(np.array(b.column(1).to_pylist()))
                s = x @ shared.value.T
                own = s.argmax(1)
                angle = np.arccos(np.clip(s[np.arange(len(x)), own], -1, 1))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x.tolist(), pa.list_(pa.float64())), pa.array(own, pa.int32()), pa.array(angle)], ["key", "vector", "cell", "angle"])

    path = scratch(spark, "cells")
    rows.mapInArrow(assign, f"key {kind}, vector array<double>, cell int, angle double").write.parquet(path)
    placed = spark.read.schema(f"key {kind}, vector array<double>, cell int, angle double").parquet(path)
    sizes = {r["cell"]: r["n"] for r in placed.groupBy("cell").agg(F.count("*").alias("n")).toLocalIterator()}  # a row for each cell
    parts = spark.createDataFrame([(c, -(-m // block)) for c, m in sizes.items()], "cell int, parts int")
    # A crowded cell is as many blocks as it takes.
    blocked = placed.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))

    def pack(group: pa.Table) -> pa.Table:
        x = np.array(group.column("vector").to_pylist())
        one = (group.column("cell")[0].as_py(), group.column("part")[0].as_py(), max(group.column("angle").to_pylist()), group.column("key").to_pylist(), x.tobytes())
        return pa.table([pa.array([v], t) for v, t in zip(one, (pa.int32(), pa.int32(), pa.float64(), pa.list_(type_), pa.binary()))], ["cell", "part", "angle", "keys", "data"])

    type_ = to_arrow_type(vectors.schema[key].dataType)
    path = scratch(spark, "blocks")
    packed = blocked.select("cell", "part", "angle", "key", "vector").groupBy("cell", "part").applyInArrow(pack, f"cell int, part int, angle double, keys array<{kind}>, data binary")
    packed.write.parquet(path)
    packed = spark.read.schema(packed.schema).parquet(path)
    held = [(r["cell"], r["part"], r["angle"]) for r in packed.select("cell", "part", "angle").orderBy("cell", "part").toLocalIterator()]  # n / BLOCK rows
    between = np.arccos(np.clip(centroids @ centroids.T, -1, 1))
    cell, radius = np.array([c for c, _, _ in held]), np.array([r for _, _, r in held])
    room = np.arccos(np.clip(threshold, -1, 1)) + 1e-6
    meets = [(*held[i][:2], *held[j][:2]) for i in range(len(held)) for j in (np.flatnonzero(between[cell[i], cell[i:]] - radius[i] - radius[i:] <= room) + i).tolist()]
    # A row is two matrices, so a task gets few.
    plan = spark.createDataFrame(meets, "cell int, part int, cell2 int, part2 int").repartition(max(1, -(-len(meets) // ROWS)))
    side = sent(packed.drop("angle"))
    met = plan.join(side, ["cell", "part"]).join(side.withColumnsRenamed({"cell": "cell2", "part": "part2", "keys": "keys2", "data": "data2"}), ["cell2", "part2"])

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                same, left, right, data, data2 = (batch.column(c)[i].as_py() for c in range(5))
                names, names2 = np.array(left), np.array(right)
                x, y = np.frombuffer(data).reshape(len(left), -1), np.frombuffer(data2).reshape(len(right), -1)
                for j in range(0, len(x), 1024):
                    s = x[j : j + 1024] @ y.T
                    a, b = np.nonzero(s >= threshold)
                    u, v = names[j + a], names2[b]
                    ok = u < v if same else u != v
                    low, high = np.where(u < v, u, v)[ok].tolist(), np.where(u < v, v, u)[ok].tolist()
                    yield pa.RecordBatch.from_arrays([pa.array(low, type_), pa.array(high, type_), pa.array(s[a, b][ok])], ["a", "b", "cosine"])

    same = (F.col("cell") == F.col("cell2")) & (F.col("part") == F.col("part2"))
    return met.select(same.alias("same"), "keys", "keys2", "data", "data2").mapInArrow(product, f"a {kind}, b {kind}, cosine double")


def semantic_scores(gold: DataFrame, pred: DataFrame, keys: list[str], encode: Callable[[list[str]], list], threshold: float = THRESHOLD) -> DataFrame:
    """``scores.example_scores`` where facets match whose vectors' cosine reaches the threshold; a facet of
    the gold or the predictions matches itself by its own vector too."""
    one = lambda df: df.select(F.explode("aspects.facet").alias("facet"))
    vectors = facet_vectors(one(gold).unionByName(one(pred)), encode)
    pairs = threshold_pairs(vectors, threshold).select("a", "b")
    itself = vectors.where(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x) >= threshold).select(F.col("facet").alias("a"), F.col("facet").alias("b"))
    path = scratch(gold.sparkSession, "pairs")
    pairs.unionByName(itself).write.parquet(path)
    pairs = gold.sparkSession.read.schema(pairs.schema).parquet(path)
    both = gold.select(*keys, F.col("aspects.facet").alias("g")).join(pred.select(*keys, F.col("aspects.facet").alias("p")), keys)
    met = both.select(*keys, "g", F.explode(F.array_distinct("p")).alias("pred")).select(*keys, "pred", F.explode(F.array_distinct("g")).alias("gold"))
    met = met.withColumns({"a": F.least("pred", "gold"), "b": F.greatest("pred", "gold")}).join(sent(pairs), ["a", "b"])
    accepted = met.groupBy(*keys).agg(F.collect_list(F.struct("pred", "gold")).alias("accepted"))
    rows = gold.join(accepted, keys, "left").withColumn("accepted", F.coalesce("accepted", F.array().cast("array<struct<pred:string,gold:string>>")))
    return scores.example_scores(rows, pred, keys, "accepted")
