"""Importance resampling towards a target distribution, over hashed n-grams of words.

Two passes over the texts. The first counts each partition's features by bucket with ``bincount``, in a
vector of fixed length, and a tree of reductions adds the vectors up; source and target counts give a
gain for each bucket. The second pass gathers the gains of each document's features and adds them up
with a weighted ``bincount``. Gumbel noise, a function of seed and id alone, turns weights into scores
whose greatest are a draw without replacement. Ranks come from a sort by ranges and the ranges' counts.

What one task holds is a vector of buckets, a window of ``WINDOW`` bytes and its words; what the driver
holds is the vectors of the last level and a count for each range.

Defined results: null and empty texts have no features and weight 0; a null id draws its noise as the
empty id, and comes before all others among ties; rows that are equal in all keep ranks of their own, in
the order in which they were read; an empty table gives no rows; an empty target, or one without words,
gives gains by the source alone; columns of ``docs`` are kept, except those named as the results.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetmill.llm.common import bound_batches, discard, materialize

#: Fixed values of the task: buckets, the longest run of words, least words of a drawn document, share drawn.
BUCKETS, MOST, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, "2024"
#: Bytes of a text whose words are held at a time.
WINDOW = 1 << 20
_LOWER = bytes(range(0x41)) + bytes(range(0x61, 0x7B)) + bytes(range(0x5B, 0x100))
_WORDS, _GAP = re.compile(rb"[0-9a-z\x80-\xff]+"), re.compile(rb"[^0-9A-Za-z\x80-\xff]")


def _windows(data: bytes, window: int) -> Iterator[bytes]:
    """``data`` in stretches of at least ``window`` bytes that end at a gap between words."""
    at = 0
    while at < len(data):
        gap = _GAP.search(data, at + window)
        end = gap.end() if gap else len(data)
        yield data[at:end]
        at = end


def features(text: bytes, buckets: int, most: int, window: int = WINDOW) -> Iterator[tuple[np.ndarray, int]]:
    """Buckets of the runs of 1 to ``most`` words, and the number of words, for each window of a text."""
    held: list[bytes] = []
    for part in _windows(text, window):
        new = _WORDS.findall(part.translate(_LOWER))
        words = held + new
        runs = [np.fromiter(map(zlib.crc32, new), np.int64, len(new))]
        for n in range(2, most + 1):
            first = max(0, len(held) - n + 1)
            runs.append(np.fromiter((zlib.crc32(b" ".join(words[i : i + n])) for i in range(first, len(words) - n + 1)), np.int64))
        held = words[-(most - 1) :] if most > 1 else []
        yield np.concatenate(runs) % buckets, len(new)


def _texts(column: pa.Array) -> Iterator[bytes]:
    for x in column.cast(pa.large_binary()):
        yield x.as_py() or b""


def bucket_counts(rows: DataFrame, text: str = "text", buckets: int = BUCKETS, most: int = MOST) -> np.ndarray:
    """How many features of all texts fall into each bucket."""
    bound_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for t in _texts(batch.column(0)):
                for found, _ in features(t, buckets, most):
                    total += np.bincount(found, minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    parts = rows.select(F.col(text).cast("string")).mapInArrow(run, "part binary").rdd.map(lambda r: np.frombuffer(bytes(r[0]), np.int64))
    n = parts.getNumPartitions()
    # Each level leaves about the cube root of the partitions for the next, so no task and not the driver adds up many.
    return parts.treeReduce(np.add, depth=3 if n > 64 else 2) if n else np.zeros(buckets, np.int64)


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of target over source share) of each bucket, one added to every count."""
    of_all, of_target = float(source.sum() + len(source)), float(target.sum() + len(target))
    ratio = lambda s, t: ((t + 1.0) * of_all) / ((s + 1.0) * of_target)
    return np.array([math.floor(1000 * math.log(ratio(float(s), float(t)))) for s, t in zip(source, target)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, text: str = "text", most: int = MOST) -> DataFrame:
    """``docs`` without the text, with ``n_words``, ``n_features`` and ``weight``."""
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(gain)  # a number for each bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value.astype(np.float64)  # sums stay exact below 2**53
        for batch in batches:
            n = batch.num_rows
            weight, count, words = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
            found, of, size = [], [], 0

            def flush(found=found, of=of, weight=weight, count=count, n=n):
                at, row = np.concatenate(found), np.repeat(np.array([r for r, _ in of]), [k for _, k in of])
                weight += np.bincount(row, weights=gain[at], minlength=n)
                count += np.bincount(row, minlength=n)
                found.clear(), of.clear()

            for row, t in enumerate(_texts(batch.column(batch.num_columns - 1))):
                for at, k in features(t, len(gain), most):
                    found.append(at)
                    of.append((row, len(at)))
                    words[row] += k
                    size += len(at)
                    if size > WINDOW // 4:
                        flush()
                        size = 0
            if found:
                flush()
            made = [pa.array(words), pa.array(count), pa.array(weight.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names)

    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in (text, "n_words", "n_features", "weight")], F.col(f"`{text}`").cast("string").alias("__text"))
    names = [*rows.columns[:-1], "n_words", "n_features", "weight"]
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, fields + "n_words long, n_features long, weight long")


def noise(key: str, seed: str):
    """floor(-1000 ln(-ln u)), u from the first 32 bits of the digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u))).cast("long")


def draw(weighed: DataFrame, key: str = "doc_id", percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED) -> DataFrame:
    """``weighed`` with ``score`` and ``rank``: 1, 2, 3, ... for the ``percent`` of the rows of enough words
    with the greatest scores, ties to the lesser id; null for the others.

    The narrow rows are sorted by ranges; a range's first rank is the count of the ranges before.
    """
    spark = weighed.sparkSession
    rows = weighed.drop("score", "rank").withColumn("score", (F.col("weight") + noise(key, seed)).cast("long"))
    # The row's number splits equal rows among ranges; written, so that sample and sort see the same rows.
    scored = materialize(rows.withColumn("__row", F.monotonically_increasing_id()).withColumn("__in", F.col("n_words") >= least_words), "scored")
    order = [F.desc("__in"), F.desc("score"), F.asc(key), F.asc("__row")]
    dealt = scored.repartitionByRange(*order).sortWithinPartitions(*order)
    # The upper bits are the range, the lower 33 the place in it.
    placed = materialize(dealt.withColumn("__at", F.monotonically_increasing_id()), "placed")
    lot = F.shiftright("__at", 33)
    counts = placed.groupBy(lot.alias("lot")).agg(F.count("*").alias("n"), F.count_if("__in").alias("n_in")).orderBy("lot").collect()  # a row for each range
    drawn = percent * sum(r["n_in"] for r in counts) // 100
    starts, before = [], 0
    for r in counts:
        starts.append((r["lot"], before))
        before += r["n"]
    offsets = F.broadcast(spark.createDataFrame(starts, "__lot long, __before long"))
    rank = F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1
    out = placed.withColumn("__lot", lot.cast("long")).join(offsets, "__lot", "left")
    out = out.withColumn("rank", F.when(rank <= drawn, rank))
    discard(scored)
    return out.drop("__lot", "__before", "__at", "__row", "__in")


def resample(docs: DataFrame, target: DataFrame, text: str = "text", key: str = "doc_id", target_text: str = "text", buckets: int = BUCKETS, most: int = MOST,
             percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED) -> DataFrame:
    """``docs`` without their texts, with ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank``."""
    gain = gains(bucket_counts(docs, text, buckets, most), bucket_counts(target, target_text, buckets, most))
    return draw(weigh(docs, gain, text, most), key, percent, least_words, seed)
