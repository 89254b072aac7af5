"""Ranking metrics and retrieval channels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from facetmill.functions import parsing as P
from facetmill.session import ship_package


def rounded(value: Column, digits: int) -> Column:
    """A double rounded half up as it stands in binary, as DuckDB rounds. A score that was cut to more digits
    before often shows a half that it lies just under; ``F.round`` goes by the digits shown."""
    return F.round(value * float(10**digits), 0) / float(10**digits)


def ndcg(ranked: DataFrame, query: str, order: list[Column], gain: str, k: int | None = None) -> DataFrame:
    """``query`` and ``ndcg`` with linear gains and a log2 discount; queries without any gain go."""
    own, best = Window.partitionBy(query).orderBy(*order), Window.partitionBy(query).orderBy(F.desc(gain))
    rows = ranked.withColumn("__r", F.row_number().over(own)).withColumn("__i", F.row_number().over(best))
    part = lambda r: F.sum(F.when(F.col(r) <= (k or 1 << 30), F.col(gain) / F.log2(F.col(r) + 1.0)).otherwise(0.0))
    out = rows.groupBy(query).agg(part("__r").alias("dcg"), part("__i").alias("ideal"))
    return out.where("ideal > 0").select(query, (F.col("dcg") / F.col("ideal")).alias("ndcg"))


def recall_at(ranked: DataFrame, relevant: DataFrame, query: str, item: str, ks: tuple[int, ...], rank: str = "rank") -> DataFrame:
    """Share of each query's relevant items within the first k: a lower bound where judgments are
    incomplete."""
    hits = relevant.select(query, item).join(ranked.select(query, item, rank), [query, item], "left")
    return hits.groupBy(query).agg(F.count("*").alias("relevant"), *[(F.count_if(F.col(rank) <= k) / F.count("*")).alias(f"recall_{k}") for k in ks])


def rrf(channels: DataFrame, query: str, item: str, channel: str = "channel", score: str = "score", k: int = 60) -> DataFrame:
    """Reciprocal rank fusion; the sum is divided by the number of channels that have the query."""
    ranks = channels.withColumn("__r", F.row_number().over(Window.partitionBy(query, channel).orderBy(F.desc(score), item)))
    present = channels.groupBy(query).agg(F.count_distinct(channel).alias("__c"))
    fused = ranks.groupBy(query, item).agg(F.sum(1.0 / (k + F.col("__r"))).alias("__s"))
    return fused.join(present, query).select(query, item, (F.col("__s") / F.col("__c")).alias("rrf"))


def _blocks(queries: pd.DataFrame, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for i in range(0, len(queries), size):
        part = queries.iloc[i : i + size]
        yield part["qid"].to_numpy(), np.stack(part["vector"].to_numpy()).astype(np.float32)


#: Query vectors that go to every task; a larger set is scored in several passes.
QUERY_BLOCK = 20_000


def dense_top_k(items: DataFrame, queries: DataFrame, k: int, item: str, vector: str, qid: str, qvector: str, exclude_self: bool = False) -> DataFrame:
    """The k items of highest cosine for each query (ties by item): qid, item, score, rank.

    Queries are the stated, bounded side: blocks of them go to all tasks, each task multiplies its
    items with a block, and only its k best for each query are shuffled.
    """
    spark = items.sparkSession
    ship_package(spark)
    schema = f"qid {queries.schema[qid].dataType.simpleString()}, item {items.schema[item].dataType.simpleString()}, score double"
    rows = items.select(F.col(item).alias("item"), F.col(vector).alias("vector"))
    out, held = None, []

    def one_pass(frame: pd.DataFrame) -> DataFrame:
        shared = spark.sparkContext.broadcast(frame)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                if not len(f):
                    continue
                x = np.stack(f["vector"].to_numpy()).astype(np.float32)
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                ids = f["item"].to_numpy()
                for q, v in _blocks(shared.value, 512):
                    v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                    # Rounded before the cut, so ties are the same however rows are dealt.
                    s = np.round((v @ x.T).astype(np.float64), 6)
                    if exclude_self:
                        s[q[:, None] == ids[None, :]] = -2
                    take = min(k, s.shape[1])
                    cut = -np.partition(-s, take - 1, axis=1)[:, take - 1]
                    a, b = np.nonzero((s >= cut[:, None]) & (s > -1.5))
                    found = pd.DataFrame({"qid": q[a], "item": ids[b], "score": s[a, b]})
                    found = found.sort_values(["qid", "score", "item"], ascending=[True, False, True], kind="stable")
                    yield found[found.groupby("qid").cumcount() < k]

        return rows.mapInPandas(run, schema)

    for r in queries.select(F.col(qid).alias("qid"), F.col(qvector).alias("vector")).toLocalIterator():
        held.append((r["qid"], np.array(r["vector"], np.float32)))
        if len(held) == QUERY_BLOCK:
            part = one_pass(pd.DataFrame(held, columns=["qid", "vector"]))
            out, held = part if out is None else out.unionByName(part), []
    if held or out is None:
        part = one_pass(pd.DataFrame(held, columns=["qid", "vector"]))
        out = part if out is None else out.unionByName(part)
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "item")))
    return ranked.where(F.col("rank") <= k)


def max_sim(pairs: DataFrame, query: str, item: str, score: str) -> DataFrame:
    """The best part of each item: parts' scores in, the highest out."""
    return pairs.groupBy(query, item).agg(F.max(score).alias("max_sim"))


def max_sim_vectors(parts: DataFrame, queries: DataFrame, item: str, vector: str, qid: str, qvector: str, part: str | None = None) -> DataFrame:
    """qid, item, max_sim: the highest product of each query with any part of each item; with ``part`` a
    query isn't compared with the part of its own number.

    Queries are the stated, bounded side: blocks of them go to all tasks, which multiply whole batches of
    parts and send the best of each item in a batch.
    """
    spark = parts.sparkSession
    ship_package(spark)
    schema = f"qid {queries.schema[qid].dataType.simpleString()}, item {parts.schema[item].dataType.simpleString()}, max_sim double"
    rows = parts.select(F.col(item).alias("item"), F.col(vector).alias("vector"), F.col(part or item).alias("part"))

    def one_pass(frame: pd.DataFrame) -> DataFrame:
        shared = spark.sparkContext.broadcast(frame)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                if not len(f):
                    continue
                f = f.sort_values("item", kind="stable")
                x, items = np.stack(f["vector"].to_numpy()).astype(np.float64), f["item"].to_numpy()
                first = np.flatnonzero(np.concatenate([[True], items[1:] != items[:-1]]))
                for q, v in _blocks(shared.value, 512):
                    s = v.astype(np.float64) @ x.T
                    if part:
                        s[q[:, None] == f["part"].to_numpy()[None, :]] = -np.inf
                    best = np.maximum.reduceat(s, first, axis=1)
                    a, b = np.nonzero(best > -np.inf)
                    yield pd.DataFrame({"qid": q[a], "item": items[first][b], "max_sim": best[a, b]})

        return rows.mapInPandas(run, schema)

    out, held = None, []
    for r in queries.select(F.col(qid).alias("qid"), F.col(qvector).alias("vector")).toLocalIterator():
        held.append((r["qid"], np.array(r["vector"], np.float32)))
        if len(held) == QUERY_BLOCK:
            found = one_pass(pd.DataFrame(held, columns=["qid", "vector"]))
            out, held = found if out is None else out.unionByName(found), []
    if held or out is None:
        found = one_pass(pd.DataFrame(held, columns=["qid", "vector"]))
        out = found if out is None else out.unionByName(found)
    return out.groupBy("qid", "item").agg(F.max("max_sim").alias("max_sim"))


def row_corrections(pairs: DataFrame, query: str, item: str, review: str, score: str) -> DataFrame:
    """Corrections for items of many rows: ``max_sim``, ``by_log`` (divided by 1 + ln of the rows) and
    ``mean_of_max`` (the best part of each review, averaged)."""
    each = pairs.groupBy(query, item, review).agg(F.max(score).alias("__m"), F.count("*").alias("__n"))
    top = F.max("__m")
    return each.groupBy(query, item).agg(top.alias("max_sim"), (top / (1 + F.log(F.sum("__n")))).alias("by_log"), F.avg("__m").alias("mean_of_max"))


def late_interaction(pairs: DataFrame, query: str, token: str, item: str, score: str) -> DataFrame:
    """Sum over query tokens of the best matching part."""
    return pairs.groupBy(query, item, token).agg(F.max(score).alias("__m")).groupBy(query, item).agg(F.sum("__m").alias("late"))


#: Queries whose words go to every task; pairs that a task scores at a time.
BM25_QUERIES, BM25_CELLS = 20_000, 1 << 18


def bm25(docs: DataFrame, queries: DataFrame, doc: str, words: str, query: str, qwords: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``query``, ``doc``, ``bm25`` for every pair that shares a word.

    Queries are the stated, bounded side: blocks of them go to all tasks with their words' frequencies, and
    a document is scored where it is read, so neither its words nor its pairs are shuffled. Ids that come
    twice, which the tables don't have, are put together before.
    """
    spark = docs.sparkSession
    ship_package(spark)
    size = docs.select(F.col(doc).alias("doc"), F.size(words).cast("double").alias("dl"), F.col(words).alias("words"))
    n, average = size.agg(F.count("*"), F.avg("dl")).first()
    twice = bool(size.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").take(1))
    if twice:
        size = size.groupBy("doc", "dl").agg(F.flatten(F.collect_list("words")).alias("words"))
    asked = queries.groupBy(query).agg(F.flatten(F.collect_list(F.array_distinct(qwords))).alias("words"))
    schema = f"{query} {queries.schema[query].dataType.simpleString()}, {doc} {docs.schema[doc].dataType.simpleString()}, bm25 double"
    out, held = None, []

    def flush() -> None:
        nonlocal out
        part = _bm25_block(size, held, n, average or 0.0, k1, b, schema)
        out = part if out is None else out.unionByName(part)
        held.clear()

    for q, found in asked.toLocalIterator():
        held.append((q, [w for w in found or () if w is not None]))
        if len(held) == BM25_QUERIES:
            flush()
    if held or out is None:
        flush()
    return out.groupBy(query, doc).agg(F.sum("bm25").alias("bm25")) if twice else out


def _bm25_block(docs: DataFrame, asked: list[tuple], n: int, average: float, k1: float, b: float, schema: str) -> DataFrame:
    """The pairs of ``docs`` (doc, dl, words) and the queries ``asked`` (id, words)."""
    spark = docs.sparkSession
    names = sorted({w for _, ws in asked for w in ws})
    number = {w: i for i, w in enumerate(names)}
    wanted = F.broadcast(spark.createDataFrame([(w,) for w in names], "word string"))
    counts = docs.select(F.explode(F.array_distinct("words")).alias("word")).join(wanted, "word", "left_semi").groupBy("word").agg(F.count("*").alias("df"))
    df = np.zeros(len(names))
    for r in counts.collect():  # words of the queries
        df[number[r["word"]]] = r["df"]
    # For each word the places of the queries that have it.
    word = np.array([number[w] for _, ws in asked for w in ws], np.int64)
    place = np.repeat(np.arange(len(asked)), np.array([len(ws) for _, ws in asked], np.int64))[np.argsort(word, kind="stable")]
    held = np.bincount(word, minlength=len(names))
    shared = spark.sparkContext.broadcast((names, np.log(1 + (n - df + 0.5) / (df + 0.5)), place, held, [q for q, _ in asked]))
    kinds = [to_arrow_type(f.dataType) for f in _parse_datatype_string(schema)]
    columns = [f.name for f in _parse_datatype_string(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, idf, place, held, ids = shared.value
        first, known, ids = np.cumsum(held) - held, pa.array(names, pa.string()), pa.array(ids, kinds[0])
        lot = max(1, BM25_CELLS // max(len(ids), 1))
        for batch in batches:
            for i in range(0, batch.num_rows, lot):
                docs, dl, words = batch.slice(i, lot).columns
                sizes = dl.fill_null(0).to_numpy(zero_copy_only=False)
                lengths = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
                at = np.repeat(np.arange(len(docs)), lengths)
                found = pc.fill_null(pc.index_in(words.flatten(), value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                key, tf = np.unique((at * max(len(names), 1) + found)[found >= 0], return_counts=True)
                at, found = key // max(len(names), 1), key % max(len(names), 1)
                part = idf[found] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * sizes[at] / max(average, 1e-12)))
                # Each word of a document meets the queries that have it: their run in ``place``.
                many = held[found]
                met = place[np.repeat(first[found] - np.cumsum(many) + many, many) + np.arange(many.sum())]
                score = np.bincount(np.repeat(at, many) * len(ids) + met, np.repeat(part, many), len(docs) * len(ids))
                pair = np.flatnonzero(score)  # every part is above 0
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(pair % max(len(ids), 1))), docs.take(pa.array(pair // max(len(ids), 1))), pa.array(score[pair], pa.float64())], columns)

    return docs.mapInArrow(run, schema)


def facet_vocabulary(mentions: DataFrame, bucket: str, facet: str, vector: str, top: int = 8, theta: float = 0.85) -> DataFrame:
    """The ``top`` facets of each bucket by count, leaving out one too close to a more frequent one.

    Facets are counted before any vector moves; a facet's vector is the least of its vectors. A bucket's
    facets stream by in order of their counts, and a task holds the vectors it has kept, ``top`` at most.
    """
    counted = mentions.groupBy(bucket, facet).agg(F.count("*").alias("n"), F.min(vector).alias("vector"))
    ship_package(mentions.sparkSession)

    def pick(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, kept = None, []
        for f in frames:
            out = []
            for b, name, n, v in zip(f[bucket], f[facet], f["n"], f["vector"]):
                if b != now:
                    now, kept = b, []
                if len(kept) == top:
                    continue
                x = np.asarray(v, np.float64)
                x = x / max(np.linalg.norm(x), 1e-12)
                if all(x @ k < theta for k in kept):
                    kept.append(x)
                    out.append((b, name, n, len(kept)))
            yield pd.DataFrame(out, columns=[bucket, facet, "n", "place"])

    kinds = {c: counted.schema[c].dataType.simpleString() for c in (bucket, facet)}
    ordered = counted.repartition(bucket).sortWithinPartitions(bucket, F.desc("n"), facet).select(bucket, facet, "n", "vector")
    return ordered.mapInPandas(pick, f"{bucket} {kinds[bucket]}, {facet} {kinds[facet]}, n long, place int")


def factorial_cells(channels: list[str]) -> list[tuple[str, ...]]:
    """Every subset of the channels but the empty one."""
    return [tuple(c for i, c in enumerate(channels) if m >> i & 1) for m in range(1, 1 << len(channels))]


def cell_scores(scored: DataFrame, cells: dict[str, tuple[str, ...]], query: str, item: str, gain: str, k: int, seed: str = "0") -> DataFrame:
    """``cell``, mean ``ndcg`` at k and ``queries`` of each named combination of channels, fused by reciprocal
    ranks; one without channels ranks by a hash of seed, query and item. An item's gain is the greatest of its
    rows.

    A row for each item holds its places in all cells, and no window's rows are told apart by cell; where
    ``scored`` is dealt by ``query``, rows aren't dealt again.
    """
    channels = sorted({c for names in cells.values() for c in names})
    ranks = scored.withColumn("__r", F.row_number().over(Window.partitionBy(query, "channel").orderBy(F.desc("score"), item)))
    mine = lambda c: F.when(F.col("channel") == c, 1.0 / (60 + F.col("__r")))
    sums = [f(mine(c)).alias(f"__{name}{i}") for i, c in enumerate(channels) for name, f in (("s", F.sum), ("c", F.count))]
    rows = ranks.groupBy(query, item).agg(F.max(gain).alias("__gain"), *sums)

    def fused(names: tuple[str, ...]) -> Column:
        """The mean to 12 digits, as a whole number; null where none of the channels has the item."""
        at = [channels.index(c) for c in names]
        total, n = (sum((F.coalesce(f"__{name}{i}", F.lit(0)) for i in at), F.lit(0)) for name in "sc")
        return F.when(n > 0, F.floor(total / n * 1e12 + 0.5))

    places = [f"__f{j}" if names else None for j, names in enumerate(cells.values())]
    rows = rows.select(query, item, "__gain", *[fused(names).alias(f) for f, names in zip(places, cells.values()) if f])
    there = [F.col(f).isNotNull() if f else F.lit(True) for f in places]
    best = Window.partitionBy(query).orderBy(F.desc("__gain")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", *[F.when(here, F.count_if(here).over(best)).alias(f"__i{j}") for j, here in enumerate(there)])
    for j, (f, here) in enumerate(zip(places, there)):
        order = F.desc_nulls_last(f) if f else P.hash_order(seed, F.col(query), F.col(item))
        place = F.when(here, F.row_number().over(Window.partitionBy(query).orderBy(order, item)))
        rows = rows.withColumn(f"__r{j}", place)
        if f:
            rows = rows.drop(f)
    part = lambda r: F.sum(F.when(F.col(r) <= k, F.col("__gain") / F.log2(F.col(r) + 1.0)).otherwise(0.0)).alias(r)
    per_query = rows.groupBy(query).agg(*[part(f"__{r}{j}") for j in range(len(cells)) for r in "ri"])
    ratio = lambda j: F.when(F.col(f"__i{j}") > 0, F.col(f"__r{j}") / F.col(f"__i{j}"))
    total = per_query.agg(*[f(ratio(j)).alias(f"__{name}{j}") for j in range(len(cells)) for name, f in (("m", F.avg), ("n", F.count))])
    listed = [F.struct(F.lit(name).alias("cell"), F.col(f"__m{j}").alias("ndcg"), F.col(f"__n{j}").alias("queries")) for j, name in enumerate(cells)]
    return total.select(F.inline(F.array(*listed))).where("queries > 0")


def factorial_scores(scored: DataFrame, channels: list[str], query: str, item: str, gain: str, k: int) -> DataFrame:
    """Mean NDCG@k of every combination of channels."""
    return cell_scores(scored, {"+".join(c): c for c in factorial_cells(channels)}, query, item, gain, k)


def factorial_effects(cells: DataFrame, base: tuple[str, ...], optional: tuple[str, ...], score: str = "ndcg") -> DataFrame:
    """``kind``, ``term`` and ``effect`` from the cells' scores: what each optional channel adds to the base,
    and for each pair how much more both add together than each alone."""
    name = lambda *more: "+".join(sorted((*base, *more)))
    pairs = [(a, b) for i, a in enumerate(optional) for b in optional[i + 1 :]]
    needed = {name()} | {name(c) for c in optional} | {name(*p) for p in pairs}
    row = cells.agg(*[F.max(F.when(F.col("cell") == n, F.col(score))).alias(n) for n in sorted(needed)])
    at = lambda *more: F.col(f"`{name(*more)}`")
    effects = [("marginal", c, at(c) - at()) for c in optional] + [("interaction", f"{a}+{b}", at(a, b) - at(a) - at(b) + at()) for a, b in pairs]
    return row.select(F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(t).alias("term"), e.alias("effect")) for k, t, e in effects])))


def ladder(scored: DataFrame, rungs: list[tuple[str, tuple[str, ...]]], query: str, item: str, gain: str, k: int, seed: str = "0") -> DataFrame:
    """``rung``, ``system``, mean ``ndcg`` at k and ``queries`` of systems in order; one without channels ranks
    by a hash of seed, query and item."""
    named = cell_scores(scored, dict(rungs), query, item, gain, k, seed)
    place = F.create_map(*[F.lit(v) for i, (name, _) in enumerate(rungs) for v in (name, i)])
    return named.select(F.element_at(place, F.col("cell")).alias("rung"), F.col("cell").alias("system"), "ndcg", "queries")


def payload_filter(equal: dict | None = None, at_least: dict | None = None, at_most: dict | None = None) -> Column:
    """A condition on payload columns (category, price, brand, color, locale, number of ratings) from a
    request's facets; a list of values means any of them, and None asks for nothing."""
    out = F.lit(True)
    for c, v in (equal or {}).items():
        if v is not None:
            out &= F.col(c).isin(*v) if isinstance(v, (list, tuple, set)) else F.col(c) == F.lit(v)
    for c, v in (at_least or {}).items():
        out &= F.lit(True) if v is None else F.col(c) >= F.lit(v)
    for c, v in (at_most or {}).items():
        out &= F.lit(True) if v is None else F.col(c) <= F.lit(v)
    return out


def product_points(products: DataFrame, key: str, payload: list[str], channels: dict[str, DataFrame]) -> DataFrame:
    """One row a product: ``id`` (a stable UUID of the key), the key, ``payload`` and a vector (or list of
    vectors) for each channel. Channels are tables of key and ``vector``; a product that one lacks has a
    null there, which later steps leave out rather than score as zero."""
    out = products.select(P.stable_uuid(F.col(key).cast("string")).alias("id"), key, F.struct(*payload).alias("payload"))
    for name, vectors in channels.items():
        out = out.join(vectors.select(key, F.col("vector").alias(name)), key, "left")
    return out


def two_stage(pairs: DataFrame, query: str, item: str, first: str, second: str, retrieve: int, keep: int) -> DataFrame:
    """The ``retrieve`` best of each query by a first score, reranked by a second: query, item, rank."""
    by = lambda c: Window.partitionBy(query).orderBy(F.desc(c), item)
    found = pairs.withColumn("__r", F.row_number().over(by(first))).where(F.col("__r") <= retrieve)
    return found.withColumn("rank", F.row_number().over(by(second))).where(F.col("rank") <= keep).select(query, item, "rank")
