"""Nearest vectors by cosine through an inverted file of 8-bit codes, exact.

``build_index`` trains centroids on a bounded sample and puts every vector into the list of its nearest one,
as a code of one byte a component. Lists are cut into blocks where the vectors are read, so no vector is
shuffled and a list that holds a third of all is many blocks. A block knows the widest angle of its
vectors to the centroid and the greatest error of its codes.

``search`` serves all queries with one index. The nearest lists of a query give a threshold that its k-th
best can't fall below. By the triangle inequality of angles most other blocks can't hold a vector over
it; the rest are scored by codes, and vectors that may pass, given the codes' error, are scored again from
the vectors themselves. Fewer lists than that, and an approximate answer, by ``exact=False``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from facetmill.operators.guards import sent
from facetmill.session import scratch, ship_package

#: Vectors that centroids are trained on, lists at most, rounds of training.
SAMPLE, LISTS, ROUNDS = 20_000, 1024, 8
#: Vectors a task holds while it makes blocks, and those of a block; queries that go to every task at a time.
HELD, BLOCK, QUERIES = 32_768, 1024, 20_000
DIGITS, SLACK = 6, 2e-6


@dataclass(frozen=True)
class DenseIndex:
    blocks: DataFrame
    centroids: np.ndarray
    widest: np.ndarray  # angle, of each list
    n: int
    item: str
    vector: str


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; a vector of zeros stays."""
    x = np.asarray(x, np.float64)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def train(sample: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of unit length by alternating assignment and means; an empty one takes the vector that is
    farthest from its own."""
    x = unit(sample)
    centroids = x[np.linspace(0, len(x) - 1, min(lists, len(x))).astype(int)]
    for _ in range(rounds):
        s = x @ centroids.T
        own = s.argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        empty = np.flatnonzero(np.bincount(own, minlength=len(centroids)) == 0)
        sums[empty] = x[np.argsort(s[np.arange(len(x)), own])[: len(empty)]]
        centroids = unit(sums)
    return centroids


def _coded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, scales, and lengths of the errors."""
    scale = np.maximum(np.abs(x).max(1), 1e-12) / 127
    code = np.rint(x / scale[:, None]).astype(np.int8)
    return code, scale, np.linalg.norm(x - code * scale[:, None], axis=1)


def build_index(items: DataFrame, item: str, vector: str, lists: int | None = None, sample: int = SAMPLE, block: int = BLOCK) -> DenseIndex:
    """The index of ``items`` (unique ``item``, ``vector``), written to the shared folder. Null vectors aren't
    in it."""
    spark = items.sparkSession
    ship_package(spark)
    rows = items.where(F.col(vector).isNotNull()).select(F.col(item).alias("item"), F.col(vector).cast("array<float>").alias("vector"))
    n = rows.count()
    lists = lists or int(min(LISTS, max(1, n**0.5)))
    # By a hash of the item, so the same sample whatever the partitions; a bounded part of a large table.
    share = rows if n <= sample else rows.where(F.pmod(F.xxhash64("item"), F.lit(n)) < sample)
    picked = [r["vector"] for r in share.select("vector", F.xxhash64("item").alias("h")).orderBy("h").limit(2 * sample).toLocalIterator()]
    centroids = train(np.array(picked, np.float64), lists) if picked else np.zeros((1, 1))
    shared = spark.sparkContext.broadcast(centroids)  # LISTS vectors
    kind = to_arrow_type(items.schema[item].dataType)
    names = ["cell", "n", "angle", "error", "ids", "codes", "scales"]
    types = [pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.list_(kind), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def close() -> pa.RecordBatch:
            both = pa.Table.from_batches(held)
            ids = both.column(0).to_pylist()
            x = unit(np.array(both.column(1).to_pylist(), np.float32))
            s = x @ shared.value.T
            own = s.argmax(1)
            code, scale, error = _coded(x)
            angle = np.arccos(np.clip(s[np.arange(len(x)), own], -1, 1))
            order = np.lexsort((angle, own))  # near and far vectors of a list in blocks of their own
            out: list[list] = [[] for _ in names]
            first = np.flatnonzero(np.concatenate([[True], own[order][1:] != own[order][:-1]]))
            for s_, e_ in zip(first.tolist(), [*first[1:].tolist(), len(order)]):
                for i in range(s_, e_, block):
                    at = order[i : min(i + block, e_)]
                    for c, v in enumerate((int(own[at[0]]), len(at), float(angle[at].max()), float(error[at].max()), [ids[j] for j in at], code[at].tobytes(), scale[at].tobytes())):
                        out[c].append(v)
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types)], names)

        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= HELD:
                yield close()
                held, size = [], 0
        if size:
            yield close()

    id_kind = items.schema[item].dataType.simpleString()
    made = rows.mapInArrow(run, f"cell int, n int, angle double, error double, ids array<{id_kind}>, codes binary, scales binary")
    path = scratch(spark, "lists")
    made.write.option("compression", "zstd").parquet(path)
    blocks = spark.read.schema(made.schema).parquet(path)
    widest = np.full(len(centroids), -1.0)
    for r in blocks.groupBy("cell").agg(F.max("angle").alias("angle")).toLocalIterator():  # LISTS rows
        widest[r["cell"]] = r["angle"]
    return DenseIndex(blocks, centroids, widest, n, item, vector)


def _scan(index: DenseIndex, qids: np.ndarray, vectors: np.ndarray, mask: np.ndarray, floors: np.ndarray, k: int, kinds: tuple[str, str], exclude_self: bool) -> DataFrame:
    """For each block and query of ``mask`` (queries x lists): items that may be among the k best and over
    the query's floor, ``low`` (at least their cosine) and ``high``; a row without an item tells how many were
    scored."""
    spark = index.blocks.sparkSession
    cells = np.flatnonzero(mask.any(0)).tolist()
    wanted = spark.createDataFrame([(c,) for c in cells], "cell int")
    shared = spark.sparkContext.broadcast((qids, vectors, mask, floors, np.arccos(np.clip(vectors @ index.centroids.T, -1, 1))))  # QUERIES x LISTS
    types = [to_arrow_type(_parse_datatype_string(x)) for x in (*kinds, "double", "double", "long")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, vectors, mask, floors, angles = shared.value
        scored = np.zeros(len(qids), np.int64)
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                cell, n = r["cell"], r["n"]
                best = np.cos(np.maximum(angles[:, cell] - r["angle"], 0.0))
                q = np.flatnonzero(mask[:, cell] & (best >= floors - SLACK))
                if not len(q):
                    continue
                scored[q] += n
                code = np.frombuffer(r["codes"], np.int8).reshape(n, -1) * np.frombuffer(r["scales"], np.float64)[:, None]
                s, error, ids = vectors[q] @ code.T, r["error"] + 1e-9, np.array(r["ids"])
                if exclude_self:
                    s[qids[q][:, None] == ids[None, :]] = -np.inf
                least = floors[q]
                if n > k:
                    least = np.maximum(least, -np.partition(-s, k - 1, axis=1)[:, k - 1] - error)
                a, b = np.nonzero(s + error >= least[:, None] - SLACK)
                out += zip(qids[q[a]].tolist(), ids[b].tolist(), (s[a, b] - error).tolist(), (s[a, b] + error).tolist(), [None] * len(a))
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], t) for c, t in enumerate(types)], names)
        some = np.flatnonzero(scored)
        none = [None] * len(some)
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip((qids[some].tolist(), none, none, none, scored[some].tolist()), types)], names)

    names = ["qid", "item", "low", "high", "scored"]
    rows = index.blocks.join(F.broadcast(wanted), "cell").select(*index.blocks.columns)
    return rows.mapInArrow(run, f"qid {kinds[0]}, item {kinds[1]}, low double, high double, scored long")


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def search(index: DenseIndex, items: DataFrame, queries: DataFrame, qid: str, qvector: str, k: int, probes: int = 8, exact: bool = True, exclude_self: bool = False) -> tuple[DataFrame, DataFrame]:
    """``qid``, ``item``, ``score``, ``rank`` of the k best items of each query, scores equal to
    six digits by item; and a report: of
    each query the vectors ``scored`` by codes and their ``share`` of all. ``items`` are those of the index.

    Without ``exact`` only the ``probes`` nearest lists are searched."""
    spark = items.sparkSession
    ship_package(spark)
    kinds = queries.schema[qid].dataType.simpleString(), items.schema[index.item].dataType.simpleString()
    results, held = [], []
    for r in queries.where(F.col(qvector).isNotNull()).select(F.col(qid).alias("qid"), F.col(qvector).cast("array<float>").alias("vector")).toLocalIterator():
        held.append((r["qid"], np.array(r["vector"], np.float32)))
        if len(held) == QUERIES:
            results.append(_search_block(index, items, held, k, probes, exact, exclude_self, kinds))
            held = []
    if held or not results:
        results.append(_search_block(index, items, held, k, probes, exact, exclude_self, kinds))
    (found, report), *more = results
    for f, r in more:
        found, report = found.unionByName(f), report.unionByName(r)
    return found, report


def _search_block(index: DenseIndex, items: DataFrame, held: list[tuple], k: int, probes: int, exact: bool, exclude_self: bool, kinds: tuple[str, str]) -> tuple[DataFrame, DataFrame]:
    spark = items.sparkSession
    qids = np.array([q for q, _ in held])
    width = index.centroids.shape[1]
    vectors = unit(np.array([v for _, v in held], np.float32).reshape(-1, width))
    near = vectors @ index.centroids.T
    mask = np.zeros(near.shape, bool)
    if len(held):
        nearest = np.argpartition(-near, min(probes, near.shape[1]) - 1, axis=1)[:, :probes]
        np.put_along_axis(mask, nearest, True, 1)
    floors = np.full(len(held), -np.inf)
    probed = _kept(_scan(index, qids, vectors, mask, floors, k, kinds, exclude_self), "probed")
    candidates = probed
    if exact:
        by_low = Window.partitionBy("qid").orderBy(F.desc("low"))
        place = {q: i for i, q in enumerate(qids.tolist())}
        for r in probed.where("item IS NOT NULL").withColumn("r", F.row_number().over(by_low)).where(F.col("r") == k).select("qid", "low").toLocalIterator():  # one a query
            floors[place[r["qid"]]] = r["low"]
        angle = np.arccos(np.clip(near, -1, 1))
        reach = np.cos(np.maximum(angle - np.maximum(index.widest, 0), 0.0)) >= floors[:, None] - SLACK
        rest = reach & ~mask & (index.widest >= 0)
        candidates = probed.unionByName(_kept(_scan(index, qids, vectors, rest, floors, k, kinds, exclude_self), "others"))
    least = spark.createDataFrame([(q, float(f)) for q, f in zip(qids.tolist(), floors)], f"qid {kinds[0]}, least double")
    passing = candidates.where("item IS NOT NULL").join(F.broadcast(least), "qid").where(F.col("high") >= F.col("least") - SLACK).select("qid", "item")
    pairs = items.select(F.col(index.item).alias("item"), F.col(index.vector).cast("array<float>").alias("vector")).join(sent(passing), "item")
    shared = spark.sparkContext.broadcast((dict(zip(qids.tolist(), range(len(qids)))), vectors))

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, vectors = shared.value
        for f in frames:
            if len(f):
                x = unit(np.stack(f["vector"].to_numpy()))
                s = (x * vectors[[place[q] for q in f["qid"].tolist()]]).sum(1)
                yield pd.DataFrame({"qid": f["qid"], "item": f["item"], "score": s})

    scored = pairs.select("qid", "item", "vector").mapInPandas(score, f"qid {kinds[0]}, item {kinds[1]}, score double")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(F.round("score", DIGITS)), "item"))
    report = candidates.where("item IS NULL").groupBy("qid").agg(F.sum("scored").alias("scored")).withColumn("share", F.col("scored") / F.lit(float(max(index.n, 1))))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k), report
