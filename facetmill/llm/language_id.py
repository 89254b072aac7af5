"""Language identification by hierarchical discrimination.

A text is first given to a language family by one-versus-rest linear support vector machines; then
one-versus-one machines vote between the closely related languages of that family. Features are
hashed byte trigrams of the whole lower-cased text, square-rooted and scaled to unit length.

Defined results: null text, or a text with no letter, is ``und`` with score 0; with nothing to learn
from, every text is ``und``. Texts are read whole, however long. Between languages of equal votes and
belief, or families of equal score, the first by name wins. Repeated rows get equal answers. Rows
without an id are identified like others, but not learned from. Columns beyond id, text and, in
training, the language are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetmill.llm import kernels as K
from facetmill.llm.common import bound_batches

#: Families of ISO 639-1 codes; a code not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi".split(),
    "romance": "fr es it pt ro ca gl oc".split(),
    "slavic": "ru uk be pl cs sk sl hr sr bs mk bg".split(),
    "baltic": "lt lv".split(),
    "uralic": "fi et hu".split(),
    "turkic": "tr az kk uz".split(),
    "indic": "hi bn ur mr gu pa ne".split(),
    "semitic": "ar he mt am".split(),
}
DIM = 2048
#: Bounds of the training sample: about so many rows of each language, picked by a hash of the id, and
#: so many of all languages (8 KB each on the driver), whatever their number; each language is learned.
SAMPLE_PER_LANGUAGE, SAMPLE_ROWS, LEAST_ROWS = 1000, 16_000, 16


def family_of(lang: str) -> str:
    return next((name for name, codes in FAMILIES.items() if lang.lower().split("-")[0] in codes), f"own:{lang}")


def _fold_case(buf: np.ndarray) -> np.ndarray:
    """ASCII letters in lower case, other ASCII as a space, Latin-1 capitals in lower case."""
    table = np.full(256, 0x20, np.uint8)
    table[0x61:0x7B] = table[0x41:0x5B] = np.arange(0x61, 0x7B)
    table[0x80:] = np.arange(0x80, 0x100)
    out = table[buf]
    if len(out) > 1:
        capital = (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[:-1] == 0xC3)
        out[1:][capital] += 0x20
    return out


def features(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A unit row of trigram weights for each text (zero if it has none)."""
    t = _fold_case(buf).astype(np.uint32)
    out = np.zeros((len(offs) - 1, DIM), np.float32)
    if len(t) < 3:
        return out
    h = (t[:-2] * np.uint32(0x01000193) + t[1:-1]) * np.uint32(0x01000193) + t[2:]
    h = (h * np.uint32(2654435761)) >> np.uint32(32 - 11)
    h[(t[:-2] == 0x20) & (t[1:-1] == 0x20)] = DIM
    for i, (s, e) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist())):
        if e - s >= 3:
            out[i] = np.bincount(h[s : e - 2], minlength=DIM + 1)[:DIM]
    np.sqrt(out, out=out)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def has_letter(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    ascii_letter = ((buf | 0x20) >= 0x61) & ((buf | 0x20) <= 0x7A)
    seen = np.concatenate([[0], np.cumsum(ascii_letter)])
    out = seen[offs[1:]] > seen[offs[:-1]]
    for i in np.flatnonzero(~out):
        part = buf[offs[i] : offs[i + 1]]
        if (part >= 0x80).any():
            out[i] = any(c.isalpha() for c in part.tobytes().decode("utf-8", "ignore"))
    return out


def svm(x: np.ndarray, y: np.ndarray, reg: float = 1e-4, rounds: int = 250) -> tuple[np.ndarray, float]:
    """Linear support vector machine: squared hinge loss, classes weighted alike, accelerated
    gradient steps. y is +1 or -1."""
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    w, b, pw, pb = np.zeros(x.shape[1], np.float32), 0.0, np.zeros(x.shape[1], np.float32), 0.0
    step = 1 / (4 + reg)
    for k in range(rounds):
        m = k / (k + 3)
        vw, vb = w + m * (w - pw), b + m * (b - pb)
        slack = np.maximum(0, 1 - y * (x @ vw + vb)) * weight * y
        pw, pb = w, b
        w, b = vw - step * (reg * vw - 2 * (slack @ x)), vb + step * 2 * float(slack.sum())
    return w, b


@dataclass
class Model:
    families: list[str] = field(default_factory=list)
    members: dict[str, list[str]] = field(default_factory=dict)
    family_w: np.ndarray | None = None
    family_b: np.ndarray | None = None
    pairs: dict[str, list] = field(default_factory=dict)

    @classmethod
    def fit(cls, x: np.ndarray, lang: list[str]) -> Model:
        labels = np.array(lang, dtype=object)
        out = cls()
        for code in sorted(set(lang)):
            out.members.setdefault(family_of(code), []).append(code)
        out.families = sorted(out.members)
        fams = np.array([family_of(c) for c in lang], dtype=object)
        if len(out.families) > 1:
            fit = [svm(x, np.where(fams == f, 1, -1).astype(np.float32)) for f in out.families]
            out.family_w, out.family_b = np.stack([w for w, _ in fit], 1), np.array([b for _, b in fit])
        for f, codes in out.members.items():
            out.pairs[f] = []
            for i in range(len(codes)):
                for j in range(i + 1, len(codes)):
                    rows = (labels == codes[i]) | (labels == codes[j])
                    w, b = svm(x[rows], np.where(labels[rows] == codes[i], 1, -1).astype(np.float32))
                    out.pairs[f].append((i, j, w, b))
        return out

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        n = len(x)
        if self.family_w is None:
            pick, sure = np.zeros(n, int), np.ones(n)
        else:
            p = 1 / (1 + np.exp(-3 * (x @ self.family_w + self.family_b)))
            pick, sure = p.argmax(1), p.max(1) / np.maximum(p.sum(1), 1e-9)
        lang = np.empty(n, dtype=object)
        for k, f in enumerate(self.families):
            rows = np.flatnonzero(pick == k)
            codes = self.members[f]
            votes, belief = np.zeros((len(rows), len(codes))), np.zeros((len(rows), len(codes)))
            for i, j, w, b in self.pairs[f]:
                p = 1 / (1 + np.exp(-3 * (x[rows] @ w + b)))
                votes[:, i] += p >= 0.5
                votes[:, j] += p < 0.5
                belief[:, i] += p
                belief[:, j] += 1 - p
            best = (votes + belief / (2 * len(codes))).argmax(1)
            for i, c in enumerate(codes):
                lang[rows[best == i]] = c
            if len(codes) > 1:
                sure[rows] *= belief[np.arange(len(rows)), best] / (len(codes) - 1)
        return lang.tolist(), np.clip(sure, 0.0, 1.0)


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model:
    """Learn from a bounded sample: ``SAMPLE_PER_LANGUAGE`` rows of each language are expected, fewer
    where the languages are so many that ``SAMPLE_ROWS`` must do for all. They are picked by a hash of
    the key, so the pick doesn't hang on order or partitions."""
    bound_batches(labelled.sparkSession)
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull())
    counts = rows.groupBy(lang).count().orderBy(lang).collect()
    if not counts:
        return Model()
    spread = F.pmod(F.xxhash64(key), F.lit(1 << 40)) / float(1 << 40)
    each = min(SAMPLE_PER_LANGUAGE, max(SAMPLE_ROWS // len(counts), LEAST_ROWS))
    often = [r for r in counts if r["count"] > each]
    share = F.element_at(F.create_map(*[F.lit(v) for r in often for v in (r[lang], each / r["count"])]), F.col(lang)) if often else F.lit(None)
    picked = rows.where(spread < F.coalesce(share, F.lit(1.0))).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(*K.column(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.astype(np.float16).tobytes() for v in x], pa.binary())], ["lang", "x"])

    got = picked.mapInArrow(vectors, "lang string, x binary").toArrow().sort_by([("lang", "ascending"), ("x", "ascending")])
    x = np.zeros((got.num_rows, DIM), np.float32)
    for i, row in enumerate(got.column("x")):
        x[i] = np.frombuffer(row.as_buffer(), np.float16)
    return Model.fit(x, got.column("lang").to_pylist()) if len(x) else Model()


def identify(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``lang_pred``, ``score`` of every row; only the text enters the prediction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = K.column(batch)
            lang, score = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            rows = np.flatnonzero(has_letter(buf, offs)) if model.families and batch.num_rows else np.zeros(0, int)
            if len(rows):
                said, sure = model.predict(features(buf, offs)[rows])
                for i, c in zip(rows, said):
                    lang[i] = c
                score[rows] = sure
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["key", "lang_pred", "score"])

    kind = docs.schema[key].dataType.simpleString()
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, lang_pred string, score double").withColumnRenamed("key", key)
