"""The k best items of many vectors each, by the sum over a query's vectors of the best product with any vector
of the item: late interaction; with one vector a query, the maximum similarity of an item's parts.

An item's vectors are summed up by the centroid they lie nearest to: their mean, and how far from the
centroid the farthest is. The best product is no less than that with a mean, and no more than that with a
centroid and the way to the farthest. The k-th of the lower bounds is a threshold; only items whose upper
bound reaches it are scored from their vectors. So no row is made for a pair that can't be an answer, and
an item that holds a third of all vectors is summed up where they are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from facetmill.operators import dense
from facetmill.operators.guards import sent
from facetmill.session import scratch, ship_package

CELLS, DIGITS, SLACK = 64, 6, 2e-6
#: Vectors of queries that go to every task at a time; products that a task holds at a time.
QUERY_VECTORS, PRODUCTS = 20_000, 4_000_000
#: Vectors of an item that are put together; items of more are scored part by part.
TOGETHER = 1024


@dataclass(frozen=True)
class Summary:
    """A row for each item: its ``groups`` of cell, n, mean and farthest."""

    rows: DataFrame
    centroids: np.ndarray
    item: str
    vector: str


def _matrix(a: pa.Array) -> np.ndarray:
    return np.array(a.to_pylist(), np.float64)


def summarise(parts: DataFrame, item: str, vector: str, cells: int = CELLS, sample: int = dense.SAMPLE) -> Summary:
    """The summary of ``parts`` (``item``, ``vector``; an item has any number of rows), written to the shared
    folder. Centroids are trained on a bounded sample; rows without a vector count for nothing."""
    spark = parts.sparkSession
    ship_package(spark)
    rows = parts.where(F.col(vector).isNotNull() & F.col(item).isNotNull()).select(F.col(item).alias("item"), F.col(vector).cast("array<double>").alias("vector"))
    n = rows.count()
    share = rows if n <= sample else rows.where(F.pmod(F.xxhash64("item", "vector"), F.lit(n)) < sample)
    picked = [r["vector"] for r in share.select("vector", F.xxhash64("item", "vector").alias("h")).orderBy("h").limit(2 * sample).toLocalIterator()]
    x = np.array(picked, np.float64) if picked else np.zeros((1, 1))
    centroids = dense.train(x, cells) * np.linalg.norm(x, axis=1).mean()  # of the vectors' usual length
    shared = spark.sparkContext.broadcast(centroids)
    kind, type_ = parts.schema[item].dataType.simpleString(), to_arrow_type(parts.schema[item].dataType)
    names = ["item", "cell", "n", "total", "far"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1))
            gap = ((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)[None, :]).argmin(1)
            far = np.linalg.norm(x - c[gap], axis=1)
            ids, of = np.unique(np.array(b.column(0).to_pylist()), return_inverse=True)
            key, at = np.unique(of * len(c) + gap, return_inverse=True)
            total, most = np.zeros((len(key), x.shape[1])), np.zeros(len(key))
            np.add.at(total, at, x)
            np.maximum.at(most, at, far)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[key // len(c)].tolist(), type_), pa.array(key % len(c), pa.int32()), pa.array(np.bincount(at), pa.int64()), pa.array(total.tolist(), pa.list_(pa.float64())), pa.array(most)], names
            )

    partial = rows.mapInArrow(run, f"item {kind}, cell int, n long, total array<double>, far double")
    width = centroids.shape[1]
    # Sums of a batch meet component by component, as partial aggregates.
    groups = partial.groupBy("item", "cell").agg(F.sum("n").alias("n"), F.max("far").alias("far"), F.array(*[F.sum(F.col("total")[i]) for i in range(width)]).alias("total"))
    group = F.struct("cell", "n", F.transform("total", lambda t: t / F.col("n")).alias("mean"), "far")
    path = scratch(spark, "summary")
    out = groups.groupBy("item").agg(F.collect_list(group).alias("groups"))  # CELLS groups at most
    out.write.parquet(path)
    return Summary(spark.read.schema(out.schema).parquet(path), centroids, item, vector)


def _bounds(summary: Summary, vectors: np.ndarray, first: np.ndarray, qids: list, k: int, floors: np.ndarray | None, kinds: tuple[str, str]) -> DataFrame:
    """Without ``floors`` the k greatest lower bounds of each query in each batch; with them, the items whose
    upper bound reaches them."""
    spark = summary.rows.sparkSession
    shared = spark.sparkContext.broadcast((vectors, first, floors, summary.centroids))
    type_ = to_arrow_type(summary.rows.schema["item"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, first, floors, centroids = shared.value
        length = np.linalg.norm(vectors, axis=1)
        step = max(1, PRODUCTS // max(len(vectors), 1) // len(centroids))
        for batch in batches:
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                ids = np.array(part.column(0).to_pylist())
                held = part.column(1).to_pylist()
                start = np.concatenate([[0], np.cumsum([len(g) for g in held])[:-1]]).astype(int)
                flat = [g for gs in held for g in gs]
                if floors is None:
                    s = vectors @ np.array([g["mean"] for g in flat]).T
                else:
                    s = (vectors @ centroids.T)[:, [g["cell"] for g in flat]] + length[:, None] * np.array([g["far"] for g in flat])[None, :]
                score = np.add.reduceat(np.maximum.reduceat(s, start, axis=1), first, axis=0)
                if floors is None:
                    take = min(k, score.shape[1])
                    at = np.argpartition(-score, take - 1, axis=1)[:, :take]
                    q, c = np.repeat(np.arange(len(first)), take), at.ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(ids[c].tolist(), type_), pa.array(score[q, c])], names)
                else:
                    c, q = np.nonzero((score >= floors[:, None] - SLACK).T)
                    some, at = np.unique(c, return_index=True)
                    asked = pa.ListArray.from_arrays(pa.array([*at.tolist(), len(q)], pa.int32()), pa.array(q, pa.int32()))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[some].tolist(), type_), asked], names)

    names = ["q", "item", "bound"] if floors is None else ["item", "asked"]
    return summary.rows.mapInArrow(run, f"q int, item {kinds[1]}, bound double" if floors is None else f"item {kinds[1]}, asked array<int>")


def search(summary: Summary, parts: DataFrame, queries: DataFrame, qid: str, qvector: str, k: int) -> DataFrame:
    """``qid``, ``item``, ``score``, ``rank`` of the k best items of each query, which has one row a vector;
    ties by item. ``parts`` are those of the summary. At most ``QUERY_VECTORS`` go to the tasks at a time, but
    a query's own are together."""
    out, held, size = None, {}, 0
    kinds = queries.schema[qid].dataType.simpleString(), parts.schema[summary.item].dataType.simpleString()
    asked = queries.where(F.col(qvector).isNotNull()).groupBy(F.col(qid).alias("qid")).agg(F.collect_list(F.col(qvector).cast("array<double>")).alias("vectors"))
    for r in asked.toLocalIterator():
        if held and size + len(r["vectors"]) > QUERY_VECTORS:
            part = _search_block(summary, parts, held, k, kinds)
            out, held, size = part if out is None else out.unionByName(part), {}, 0
        held[r["qid"]] = np.array(r["vectors"], np.float64)
        size += len(r["vectors"])
    if held or out is None:
        part = _search_block(summary, parts, held, k, kinds)
        out = part if out is None else out.unionByName(part)
    return out


def _search_block(summary: Summary, parts: DataFrame, held: dict, k: int, kinds: tuple[str, str]) -> DataFrame:
    spark = parts.sparkSession
    ship_package(spark)
    if not held:
        return spark.createDataFrame([], f"qid {kinds[0]}, item {kinds[1]}, score double, rank int")
    qids, vectors = list(held), np.concatenate(list(held.values()))
    count = np.array([len(v) for v in held.values()])
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    floors = np.full(len(qids), -np.inf)
    by = Window.partitionBy("q").orderBy(F.desc("bound"))
    low = _bounds(summary, vectors, first, qids, k, None, kinds).withColumn("r", F.row_number().over(by)).where(F.col("r") == k)
    for r in low.toLocalIterator():  # one a query
        floors[r["q"]] = r["bound"]
    path = scratch(spark, "reached")
    reached = _bounds(summary, vectors, first, qids, k, floors, kinds)
    reached.write.parquet(path)
    reached = spark.read.schema(reached.schema).parquet(path)
    sizes = summary.rows.select("item", (F.aggregate("groups", F.lit(0).cast("long"), lambda n, g: n + g["n"]) > TOGETHER).alias("large"))
    reached = reached.join(sizes, "item")
    rows = parts.where(F.col(summary.vector).isNotNull()).select(F.col(summary.item).alias("item"), F.col(summary.vector).cast("array<double>").alias("vector"))
    shared = spark.sparkContext.broadcast((vectors, first, count))
    type_ = to_arrow_type(parts.schema[summary.item].dataType)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k best of each query among a task's items, whose vectors are together."""
        vectors, first, count = shared.value
        best: dict[int, list[tuple]] = {}

        def cut(q: int) -> list[tuple]:
            best[q] = sorted(best[q], key=lambda e: (-e[0], e[1]))[:k]
            return best[q]

        for b in batches:
            for item, x, asked in zip(*(b.column(c) for c in range(3))):
                q = np.array(asked.as_py())
                tokens = np.arange(count[q].sum()) + np.repeat(first[q] - (np.cumsum(count[q]) - count[q]), count[q])
                top = (vectors[tokens] @ np.array(x.as_py(), np.float64).T).max(1)
                score = np.add.reduceat(top, np.cumsum(count[q]) - count[q])
                for one, v in zip(q.tolist(), np.round(score, DIGITS).tolist()):
                    held = best.setdefault(one, [])
                    held.append((v, item.as_py()))
                    if len(held) >= 4 * k + 16:
                        cut(one)
        out = [(q, i, v) for q in sorted(best) for v, i in cut(q)]
        yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], t) for c, t in enumerate((pa.int32(), type_, pa.float64()))], ["q", "item", "score"])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each batch, large item, query and query's vector the best product."""
        vectors, first, count = shared.value
        for b in batches:
            out: list[tuple] = []
            ids, of = np.unique(np.array(b.column(0).to_pylist()), return_inverse=True)
            x, asked = _matrix(b.column(1)), b.column(2)
            order = np.argsort(of, kind="stable")
            edges = np.searchsorted(of[order], np.arange(len(ids) + 1))
            for i in range(len(ids)):
                at = order[edges[i] : edges[i + 1]]
                for q in asked[int(at[0])].as_py():
                    top = (vectors[first[q] : first[q] + count[q]] @ x[at].T).max(1)
                    out += [(q, ids[i].item(), t, v) for t, v in enumerate(top.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], t) for c, t in enumerate((pa.int32(), type_, pa.int32(), pa.float64()))], ["q", "item", "t", "top"])

    met = lambda large: rows.join(sent(reached.where(large).drop("large")), "item")
    small = met(~F.col("large")).groupBy("item").agg(F.collect_list("vector").alias("vectors"), F.first("asked").alias("asked"))
    scored = small.mapInArrow(whole, f"q int, item {kinds[1]}, score double")
    # Items of very many vectors are few; the best products of their parts meet.
    tops = met(F.col("large")).select("item", "vector", "asked").mapInArrow(best, f"q int, item {kinds[1]}, t int, top double")
    tops = tops.groupBy("q", "item", "t").agg(F.max("top").alias("top")).groupBy("q", "item").agg(F.round(F.sum("top"), DIGITS).alias("score"))
    scored = scored.unionByName(tops)
    names = spark.createDataFrame(list(enumerate(qids)), f"q int, qid {kinds[0]}")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "item"))
    return scored.join(F.broadcast(names), "q").withColumn("rank", rank).where(F.col("rank") <= k).select("qid", "item", "score", "rank")
