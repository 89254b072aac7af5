"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

The statistics of every whole text are computed once and kept as a narrow table. Random cosine
features with a fixed seed approximate a Gaussian kernel; each partition sums its part of the normal
equations, the parts are added in levels of a few a task, and the ridge system is solved on the
driver, whose size is that of the features alone. Scores are calibrated by pooled adjacent violators over a
histogram of the training scores.

Defined results: null and empty texts have statistics 0 and a score like any other; texts are read
whole, however long; without a labelled row every score is 0.5; a label other than 0 or 1 is ignored;
repeated label rows of one document count once each; repeated documents get equal scores and, if
labelled, count once each; columns beyond the key and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetmill.llm import kernels as K
from facetmill.llm.common import bound_batches, discard, materialize, sum_arrays

STATS = (
    "log_bytes log_words word_length upper digit symbol bang pipe dot comma other_punct non_ascii lines dup_lines "
    "repeat_next distinct_words top_word repeat_5 short_words long_words"
).split()
COSINES = 256
SEED = 20240917
GAMMA = 0.05
RIDGE = 1e-3
BINS = 400


def statistics(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A row of ``STATS`` for each text."""
    n = len(offs) - 1
    out = np.zeros((n, len(STATS)))
    start, end, at = K.words(buf, offs, K.WHITE)
    p = K.prefix_hash(buf)
    h = K.span_hash(p, start, end)
    size = end - start
    in_class = {}
    for name, chars in (("symbol", b"#*$%&|<>"), ("bang", b"!"), ("pipe", b"|"), ("dot", b"."), ("comma", b","), ("other_punct", b"?;:\"'()[]{}@+=~^_\\/`-")):
        table = np.zeros(256, bool)
        table[list(chars)] = True
        in_class[name] = table[buf]
    in_class["upper"] = (buf >= 0x41) & (buf <= 0x5A)
    in_class["digit"] = (buf >= 0x30) & (buf <= 0x39)
    in_class["non_ascii"] = buf >= 0x80
    newline = buf == 0x0A
    in_class["lines"] = newline
    for name, mask in in_class.items():
        total = np.concatenate([[0], np.cumsum(mask)])
        out[:, STATS.index(name)] = total[offs[1:]] - total[offs[:-1]]
    length = (offs[1:] - offs[:-1]).astype(float)
    count = np.diff(at).astype(float)
    per_char, per_word = np.maximum(length, 1), np.maximum(count, 1)
    letters = np.concatenate([[0], np.cumsum(size)])
    out[:, 0], out[:, 1] = np.log1p(length), np.log1p(count)
    out[:, 2] = (letters[at[1:]] - letters[at[:-1]]) / per_word
    for name in ("upper", "digit", "non_ascii"):
        out[:, STATS.index(name)] /= per_char
    for name in ("symbol", "bang", "pipe", "dot", "comma", "other_punct", "lines"):
        k = STATS.index(name)
        out[:, k] = np.log1p(20 * out[:, k] / per_word)
    breaks = np.flatnonzero(newline)
    for i in range(n):
        s, e = at[i], at[i + 1]
        w = h[s:e]
        if not len(w):
            continue
        _, times = np.unique(w, return_counts=True)
        out[i, STATS.index("repeat_next")] = (w[1:] == w[:-1]).mean() if len(w) > 1 else 0
        out[i, STATS.index("distinct_words")] = len(times) / len(w)
        out[i, STATS.index("top_word")] = times.max() / len(w)
        five = K.shingles(w, 5)
        if len(five):
            out[i, STATS.index("repeat_5")] = 1 - len(np.unique(five)) / len(five)
        out[i, STATS.index("short_words")] = (size[s:e] <= 3).mean()
        out[i, STATS.index("long_words")] = (size[s:e] >= 12).mean()
        cuts = breaks[np.searchsorted(breaks, offs[i]) : np.searchsorted(breaks, offs[i + 1])]
        if len(cuts):
            a, b = np.concatenate([[offs[i]], cuts + 1]), np.concatenate([cuts, [offs[i + 1]]])
            full = b > a
            lines = K.span_hash(p, a[full], b[full])
            out[i, STATS.index("dup_lines")] = 1 - len(np.unique(lines)) / max(len(lines), 1)
    return out


def statistics_table(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key`` and ``stats`` (array<double>) of every row, one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = statistics(*K.column(batch))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, len(STATS)), pa.int32()), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), flat], ["key", "stats"])
        K.release()

    kind = docs.schema[key].dataType.simpleString()
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, stats array<double>").withColumnRenamed("key", key)


def _matrix(stats: pd.Series) -> np.ndarray:
    return np.stack(stats.to_numpy()) if len(stats) else np.zeros((0, len(STATS)))


class Scorer:
    """Standardised statistics -> random cosines -> ridge score -> isotonic probability."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = mean, scale
        self.omega = rng.normal(0, np.sqrt(2 * GAMMA), (len(mean), COSINES))
        self.phase = rng.uniform(0, 2 * np.pi, COSINES)
        self.weight = np.zeros(COSINES + 1)
        self.steps: tuple[np.ndarray, np.ndarray] = (np.zeros(1), np.full(1, 0.5))

    def expand(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        return np.hstack([np.sqrt(2 / COSINES) * np.cos(z @ self.omega + self.phase), np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(self.expand(stats) @ self.weight, -0.5, 1.5)

    def score(self, stats: np.ndarray) -> np.ndarray:
        x, y = self.steps
        return np.clip(np.interp(self.raw(stats), x, y), 0, 1)


def pooled_adjacent_violators(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The non-decreasing step means closest to y (weights w, x ascending): block centres, values."""
    blocks: list[list[float]] = []
    for xi, yi, wi in zip(x, y, w):
        blocks.append([xi * wi, yi * wi, wi])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            top = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], top)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def fit(labelled: DataFrame) -> Scorer:
    """``labelled`` has ``stats`` and ``label`` (0 or 1). Every labelled row counts."""
    bound_batches(labelled.sparkSession)
    rows = labelled.where(F.col("label").isin(0, 1)).select("stats", F.col("label").cast("double").alias("label"))
    rows = materialize(rows, "labelled")  # read three times: moments, normal equations, calibration
    width = len(STATS)
    sums = [F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(width)] + [F.sum(F.col("stats")[i] * F.col("stats")[i]).alias(f"q{i}") for i in range(width)]
    m = rows.agg(F.count("*").alias("n"), *sums).first()
    n = m["n"]
    if not n:
        discard(rows)
        return Scorer(np.zeros(width), np.ones(width))
    mean = np.array([m[f"s{i}"] for i in range(width)]) / n
    var = np.array([m[f"q{i}"] for i in range(width)]) / n - mean**2
    model = Scorer(mean, np.sqrt(np.maximum(var, 1e-4)))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros((COSINES + 1, COSINES + 2))
        some = False
        for batch in batches:
            if batch.num_rows:
                x = model.expand(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width))
                total[:, :-1] += x.T @ x
                total[:, -1] += x.T @ batch.column(1).to_numpy(zero_copy_only=False)
                some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["lot", "part"])

    whole = sum_arrays(rows.mapInArrow(partial, "lot int, part binary"), (COSINES + 1) * (COSINES + 2)).reshape(COSINES + 1, COSINES + 2)
    gram, right = whole[:, :-1], whole[:, -1]
    penalty = RIDGE * n * np.eye(COSINES + 1) / COSINES
    penalty[-1, -1] = 1e-9 * n
    model.weight = np.linalg.solve(gram + penalty, right)

    raw = F.pandas_udf(lambda s: pd.Series(model.raw(_matrix(s))), "double")
    cell = F.floor((raw("stats") + 0.5) / 2 * BINS).cast("int")
    hist = rows.groupBy(cell.alias("cell")).agg(F.count("*").alias("w"), F.avg("label").alias("y")).orderBy("cell").collect()
    x = np.array([(r["cell"] + 0.5) / BINS * 2 - 0.5 for r in hist])
    discard(rows)
    model.steps = pooled_adjacent_violators(x, np.array([r["y"] for r in hist]), np.array([float(r["w"]) for r in hist]))
    return model


def score(stats: DataFrame, model: Scorer) -> DataFrame:
    """Adds ``score`` and ``predicted`` and drops the statistics."""
    calibrated = F.pandas_udf(lambda s: pd.Series(model.score(_matrix(s))), "double")
    out = stats.withColumn("score", calibrated("stats")).drop("stats")
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Scores every row of ``docs``; ``labels`` has ``key`` and ``label``."""
    stats = materialize(statistics_table(docs, text, key), "quality-stats")
    return score(stats, fit(stats.join(labels.select(key, "label"), key)))
