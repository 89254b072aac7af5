"""BM25 search through an index of impact-ordered posting blocks.

``build_index`` makes shards of documents where these are read: no posting is shuffled, and a word that is
in every document has its postings in every shard. Of each word a shard has blocks of ``BLOCK`` postings,
those of highest impact first, with the block's greatest impact (``top``, without the word's rarity).

``search`` gives the exact k best documents of each query. It looks into a few shards first: the k-th
score there is a threshold that the answer can't fall below, so of the other shards only blocks that
could lift a document over it leave the scan. A shard is searched in one task: words in the order of
their bounds, block by block, while what is left can still make a new document pass; then only for
documents that may still pass. Each shard sends k rows a query.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facetmill.session import scratch, ship_package

#: Postings of a block; documents and words of a shard, at most (a longer document is a shard of its own).
BLOCK, SHARD_DOCS, SHARD_WORDS = 256, 16_384, 2_000_000
#: One in so many shards is searched for thresholds; queries that go to every task at a time.
FIRST, QUERIES = 16, 5_000
#: Scores are told apart by so many digits; equal ones go by document.
DIGITS, SLACK = 6, 2e-6


@dataclass(frozen=True)
class Index:
    """Blocks, and what all shards share."""

    blocks: DataFrame
    n: int
    average: float
    k1: float
    b: float
    pattern: str


def impact(tf: np.ndarray, size: np.ndarray, average: float, k1: float, b: float) -> np.ndarray:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / max(average, 1e-12)))


def _shard(number: int, ids: list, sizes: list[int], found: list[np.ndarray], names: np.ndarray, weigh, block: int) -> dict[str, list]:
    """The rows of one shard: a head with ids and sizes, then the words' blocks. ``found`` has for each
    document the numbers of its words."""
    rows = {"shard": [number], "word": [""], "n": [len(ids)], "top": [None], "at": [None], "tf": [None], "ids": [ids], "sizes": [sizes]}
    words = np.concatenate(found) if found else np.zeros(0, np.int64)
    at = np.repeat(np.arange(len(found)), [len(f) for f in found])
    key, tf = np.unique(words * len(ids) + at, return_counts=True)
    word, at = key // len(ids), key % len(ids)
    u = weigh(tf.astype(np.float64), np.array(sizes, np.float64)[at])
    order = np.lexsort((at, -u, word))
    word, at, tf, u = word[order], at[order].astype(np.int32), tf[order].astype(np.int32), u[order]
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, np.int64)
    for s, e in zip(first.tolist(), [*first[1:].tolist(), len(word)]):
        name = names[word[s]]
        for i in range(s, e, block):
            j = min(i + block, e)
            for c, v in (("shard", number), ("word", name), ("n", j - i), ("top", float(u[i])), ("at", at[i:j].tobytes()), ("tf", tf[i:j].tobytes()), ("ids", None), ("sizes", None)):
                rows[c].append(v)
    return rows


def build_index(docs: DataFrame, doc: str, text: str, only: DataFrame | None = None, pattern: str = "[a-z]+", k1: float = 1.2, b: float = 0.75, block: int = BLOCK, shard_docs: int = SHARD_DOCS) -> Index:
    """The index of the lower-cased texts' words (what ``pattern`` finds), written to the shared folder. With
    ``only`` (one column of words, a bounded list as it goes to every task) others aren't indexed. Null
    texts are empty documents."""
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(doc).alias("doc"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    n, average = rows.agg(F.count("*"), F.coalesce(F.avg(F.regexp_count("text", F.lit(pattern))), F.lit(0.0))).first()
    shared = spark.sparkContext.broadcast({r[0]: i for i, r in enumerate(only.distinct().toLocalIterator())} if only is not None else None)
    kind = docs.schema[doc].dataType.simpleString()
    names = ["shard", "word", "n", "top", "at", "tf", "ids", "sizes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, known = re.compile(pattern).findall, shared.value
        vocabulary = dict(known) if known is not None else {}
        weigh = lambda tf, size: impact(tf, size, average, k1, b)
        number = TaskContext.get().partitionId() << 32
        ids, sizes, found, held = [], [], [], 0
        types = {"ids": pa.list_(batch_type), "sizes": pa.list_(pa.int32()), "shard": pa.int64(), "n": pa.int32(), "top": pa.float64(), "at": pa.binary(), "tf": pa.binary(), "word": pa.string()}

        def close() -> pa.RecordBatch:
            rows = _shard(number, ids, sizes, found, np.array(list(vocabulary), object), weigh, block)
            return pa.RecordBatch.from_arrays([pa.array(rows[c], types[c]) for c in names], names)

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = find(t)
                if ids and (len(ids) >= shard_docs or held + len(words) > SHARD_WORDS):
                    yield close()
                    ids, sizes, found, held = [], [], [], 0
                    number += 1
                    if known is None:
                        vocabulary = {}
                ids.append(i)
                sizes.append(len(words))
                held += len(words)
                if known is None:
                    own = [vocabulary.setdefault(w, len(vocabulary)) for w in words]
                else:
                    own = [known[w] for w in words if w in known]
                found.append(np.array(own, np.int64))
        if ids:
            yield close()

    from pyspark.sql.pandas.types import to_arrow_type

    batch_type = to_arrow_type(docs.schema[doc].dataType)
    made = rows.mapInArrow(run, f"shard long, word string, n int, top double, at binary, tf binary, ids array<{kind}>, sizes array<int>")
    path = scratch(spark, "postings")
    made.write.option("compression", "zstd").parquet(path)
    return Index(spark.read.schema(made.schema).parquet(path), n, average, k1, b, pattern)


def best_of_shard(blocks: dict[str, list[tuple[float, np.ndarray, np.ndarray]]], sizes: np.ndarray, words: list[tuple[str, float]], k: int, floor: float, weigh) -> tuple[np.ndarray, np.ndarray, int]:
    """Places and scores of the k best documents of one shard (all that tie with the last), and the blocks that
    were read. ``words`` come with their rarity, by falling bound; no score under ``floor`` counts."""
    mine = [(blocks[w], r) for w, r in words if w in blocks]
    bounds = [r * held[0][0] for held, r in mine]
    after = np.concatenate([np.cumsum(bounds[::-1])[::-1], [0.0]])
    score, open_, read = np.zeros(len(sizes)), None, 0
    least = floor
    for i, (held, rarity) in enumerate(mine):
        if open_ is None and after[i] < least - SLACK:
            # No document without one of the words so far can pass any more.
            open_ = score + after[i] >= least - SLACK
            open_ &= score > 0
        missing = open_.copy() if open_ is not None else None
        for top, at, tf in held:
            if open_ is None:
                # All other words at their best, whatever came before.
                if rarity * top + after[0] - bounds[i] < least - SLACK:
                    break
            else:
                # Documents not met yet have this block's impact at most.
                missing &= score + rarity * top + after[i + 1] >= least - SLACK
                if not missing.any():
                    break
                at_open = open_[at]
                at, tf = at[at_open], tf[at_open]
                missing[at] = False
            read += 1
            score[at] += rarity * weigh(tf, sizes[at])
            if open_ is None and read & (read - 1) == 0 and len(score) > k:  # the threshold now and then
                least = max(least, float(np.partition(score, len(score) - k)[len(score) - k]))
        if len(score) > k:
            least = max(least, float(np.partition(score, len(score) - k)[len(score) - k]))
        if open_ is not None:
            open_ &= score + after[i + 1] >= least - SLACK
    score = np.round(score, DIGITS)
    place = np.flatnonzero((score > 0) & (score >= least - SLACK))
    if len(place) > k:
        cut = np.partition(score[place], len(place) - k)[len(place) - k]
        place = place[score[place] >= cut]
    return place, score[place], read


def _searched(index: Index, blocks: DataFrame, asked: list[tuple], rarity: dict[str, float], floors: dict, k: int, kinds: tuple[str, str]) -> DataFrame:
    spark = blocks.sparkSession
    shared = spark.sparkContext.broadcast((asked, rarity, floors))  # bounded by QUERIES
    average, k1, b = index.average, index.k1, index.b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, rarity, floors = shared.value
        weigh = lambda tf, size: impact(tf, size, average, k1, b)
        now, ids, sizes, held = None, [], np.zeros(0), {}

        def close() -> Iterator[pa.RecordBatch]:
            if not ids:
                return
            out: list[tuple] = []
            for q, words in asked:
                place, score, read = best_of_shard(held, sizes, [(w, rarity[w]) for w in words], k, floors.get(q, 0.0), weigh)
                some = sorted(zip((-score).tolist(), [ids[p] for p in place.tolist()]))[:k]
                out += [(q, i, -s, 0) for s, i in some]
                out.append((q, None, None, read))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(types)], ["qid", "doc", "score", "read"])

        for batch in batches:
            for r in batch.to_pylist():
                if r["shard"] != now:
                    yield from close()
                    now, ids, sizes, held = r["shard"], [], np.zeros(0), {}
                if r["word"] == "":
                    ids, sizes = r["ids"], np.array(r["sizes"], np.float64)
                else:
                    held.setdefault(r["word"], []).append((r["top"], np.frombuffer(r["at"], np.int32), np.frombuffer(r["tf"], np.int32).astype(np.float64)))
        yield from close()

    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(_parse_datatype_string(x)) for x in (*kinds, "double", "int")]
    dealt = blocks.repartition("shard").sortWithinPartitions("shard", "word", F.desc("top"))
    return dealt.mapInArrow(run, f"qid {kinds[0]}, doc {kinds[1]}, score double, read int")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "doc"))
    return found.where("doc IS NOT NULL").withColumn("rank", rank).where(F.col("rank") <= k).select("qid", "doc", "score", "rank")


def search(index: Index, queries: DataFrame, query: str, text: str, k: int = 10, first: int = FIRST) -> DataFrame:
    """``qid``, ``doc``, ``score``, ``rank`` of the k best documents of each query; documents without a word
    of it have no row. ``QUERIES`` queries go through the index at a time; ids must be unique."""
    out, held, find = None, [], re.compile(index.pattern).findall
    kinds = queries.schema[query].dataType.simpleString(), index.blocks.schema["ids"].dataType.elementType.simpleString()
    asked = queries.select(query, F.lower(F.coalesce(F.col(text), F.lit(""))))

    def flush() -> None:
        nonlocal out
        part = _search_block(index, held, k, kinds, first)
        out = part if out is None else out.unionByName(part)
        held.clear()

    for q, t in asked.toLocalIterator():
        held.append((q, list(dict.fromkeys(find(t)))))
        if len(held) == QUERIES:
            flush()
    if held or out is None:
        flush()
    return out


def _search_block(index: Index, asked: list[tuple], k: int, kinds: tuple[str, str], one_in: int) -> DataFrame:
    spark = index.blocks.sparkSession
    ship_package(spark)
    words = sorted({w for _, ws in asked for w in ws})
    wanted = F.broadcast(spark.createDataFrame([(w,) for w in words], "word string"))
    by_word = index.blocks.where("word <> ''").join(wanted, "word").groupBy("word").agg(F.sum("n").alias("df"), F.max("top").alias("top")).collect()  # words of the queries
    rarity = {r["word"]: float(np.log(1 + (index.n - r["df"] + 0.5) / (r["df"] + 0.5))) for r in by_word}
    bound = {r["word"]: rarity[r["word"]] * r["top"] for r in by_word}
    # One order of words in all shards, so equal documents have equal sums.
    plans = [(q, sorted((w for w in ws if w in bound), key=lambda w: (-bound[w], w))) for q, ws in asked]
    some = F.xxhash64("shard") % one_in == 0
    take = lambda rows, table: rows.join(F.broadcast(table), "word").where("top >= least").select(*rows.columns).unionByName(rows.where("word = ''"))
    every = spark.createDataFrame([(w, 0.0) for w in bound], "word string, least double")
    first = _ranked(_searched(index, take(index.blocks.where(some), every), plans, rarity, {}, k, kinds), k)
    path = scratch(spark, "first-shards")
    first.write.parquet(path)
    first = spark.read.schema(first.schema).parquet(path)
    floors = {r["qid"]: r["score"] for r in first.where(F.col("rank") == k).select("qid", "score").toLocalIterator()}
    # A block matters if, for some query, its best document could pass with all other words at their best.
    least: dict[str, float] = {}
    for q, ws in plans:
        total = sum(bound[w] for w in ws)
        for w in ws:
            need = (floors.get(q, 0.0) - SLACK - (total - bound[w])) / max(rarity[w], 1e-12)
            least[w] = min(least.get(w, np.inf), need)
    passing = spark.createDataFrame([(w, float(x)) for w, x in least.items()], "word string, least double")
    rest = _searched(index, take(index.blocks.where(~some), passing), plans, rarity, floors, k, kinds)
    return _ranked(first.select("qid", "doc", "score").unionByName(rest.select("qid", "doc", "score")), k)
