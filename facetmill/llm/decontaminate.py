"""Benchmark decontamination by latent semantic retrieval.

Terms are the words of the benchmark that aren't common in the corpus; document frequencies are
counted over all documents. A randomised singular value decomposition of TF-IDF passages (the
benchmark's items, all of them) gives the latent space. Then every passage of every document is projected, and its cosine with each item proposes candidates. A candidate is
confirmed when the longest common subsequence of words covers enough of the item and enough of its
telling words, the answer's marks, stand in the place; so reworded passages count as well. Items too short
for that are found where their words stand one after another, unchanged, by the same scan.

The benchmark is the stated query set, looked up in blocks of bounded size; several blocks share each
scan of the documents: one that counts terms, and one that searches.

Defined results: null or empty texts and items, and items without a word, match nothing; items of fewer
than ``LEAST_WORDS`` words match exact places only, with cosine and share 1; repeated items and rows are each reported; texts are searched
whole, however long; of passages with equal cosines the first in the text counts. A passage proposes
candidates if it has two words of the benchmark or more, which any passage of an item has. Rows without
an id are searched like others; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetmill.llm import kernels as K
from facetmill.llm.common import bound_batches, materialize, sum_arrays

#: Words of a passage and between the starts of passages.
PASSAGE, STRIDE = 24, 12
#: Dimensions of the latent space, and more for the randomised search of it; power steps.
RANK, SPARE, POWER = 64, 16, 2
#: Terms in more than this share of the documents tell nothing, but for so many of each item, and in any
#: passage of an item for one in so many words.
COMMON, LEAST_TERMS, SPARSE = 0.1, 12, 6
#: Least cosine of a candidate: this share of what an exact copy has, within these bounds. Least share of an item's words in common order; of its telling words.
SHARE, LEAST_COSINE, COSINE = 0.5, 0.03, 0.25
#: But never more than this share of the best passage of an exact copy, wherever passages begin.
EXACT = 0.8
LCS, ANSWER = 0.6, 0.5
LEAST_WORDS = 5
#: Items that share one latent space, and such blocks that share the scans of the documents.
BLOCK, BLOCKS = 500, 8
GAP = ~K.ALNUM


def word_hashes(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts, and where each text's words begin."""
    low = K.lower_latin(buf)
    start, end, at = K.words(low, offs, GAP)
    return K.span_hash(K.prefix_hash(low), start, end), at


class Terms:
    """Numbers the benchmark's words; others get -1."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        self.table = np.zeros(1 << 20, bool)
        self.table[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def number(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the known words among ``h`` and their numbers."""
        if not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        may = np.flatnonzero(self.table[(h >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, h[may]), len(self.hashes) - 1)
        same = self.hashes[at] == h[may]
        return may[same], at[same]


def _windows(number: int) -> np.ndarray:
    """Starts of the passages of a text; the last one reaches its end."""
    last = max(number - PASSAGE, 0)
    return np.append(np.arange(0, last, STRIDE), last)


def _dense(t: np.ndarray, df: np.ndarray, use: np.ndarray) -> None:
    """Marks the rarest terms of an item's sparse stretches in ``use``. A copy holds a whole passage if it
    is long enough for one to begin anywhere, else one that has a stride of it."""
    width = PASSAGE if len(t) >= PASSAGE + STRIDE - 1 else min(len(t), STRIDE)
    for s in range(len(t) - width + 1):
        part = t[s : s + width]
        while use[part].sum() < max(width // SPARSE, 2):
            left = part[~use[part]]
            use[left[np.argmin(df[left])]] = True


def lcs_length(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        m = where.get(x)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


class Retriever:
    """A block of items in a latent space, ready to search texts."""

    def __init__(self, ids: list[int], items: list[np.ndarray]):
        self.ids, self.items = ids, items
        self.terms = Terms(np.concatenate(items))
        self.idf = np.zeros(len(self.terms.hashes))
        self.space = np.zeros((len(self.idf), 0))

    def weigh(self, df: np.ndarray, n_docs: int) -> None:
        """Sets the weights of the terms by the number of documents that hold each."""
        use = df <= COMMON * n_docs
        for item in self.items:  # an item whose words are all common, or that is copied often, keeps its rarest
            t = np.unique(self.terms.number(item)[1])
            use[t[np.argsort(df[t], kind="stable")[:LEAST_TERMS]]] = True
            _dense(self.terms.number(item)[1], df, use)
        self.idf = np.where(use, np.maximum(np.log((n_docs + 1) / (df + 1)), 0.05), 0.0)

    def _rows(self, h: np.ndarray, at: np.ndarray, passages: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entries (row, term, weight) of unit TF-IDF rows of texts or of their passages."""
        rows, terms, base = [], [], 0
        pos, t = self.terms.number(h)
        use = self.idf[t] > 0
        pos, t = pos[use], t[use]
        for s, e in zip(at[:-1], at[1:]):
            starts = s + _windows(e - s) if passages else np.array([s])
            lo = np.searchsorted(pos, starts)
            hi = np.searchsorted(pos, np.minimum(starts + PASSAGE, e) if passages else [e])
            n = hi - lo
            rows.append(np.repeat(base + np.arange(len(starts)), n))
            terms.append(t[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())])
            base += len(starts)
        row, term = np.concatenate(rows), np.concatenate(terms)
        weight = self.idf[term]
        norm = np.sqrt(np.bincount(row, weight**2, minlength=base))
        return row, term, weight / np.maximum(norm[row], 1e-9)

    def fit(self) -> None:
        """The space in which the items are told apart best, from all of them; no document is fitted on."""
        width = len(self.idf)
        h, at = np.concatenate(self.items), np.cumsum([0] + [len(x) for x in self.items])
        row, term, weight = self._rows(h, at, False)
        q = np.linalg.qr(np.random.default_rng(7).normal(size=(width, min(RANK + SPARE, width))))[0]
        for _ in range(POWER):
            y, z = np.zeros((len(self.items), q.shape[1])), np.zeros(q.shape)
            np.add.at(y, row, weight[:, None] * q[term])
            np.add.at(z, term, weight[:, None] * y[row])
            q, r = np.linalg.qr(z)
        u, _, _ = np.linalg.svd(r)
        self.space = (q @ u)[:, :RANK]
        projected = np.zeros((len(self.items), self.space.shape[1]))
        np.add.at(projected, row, weight[:, None] * self.space[term])
        # An exact copy scores the length of the item's own projection; half of that is enough.
        self.least = np.clip(SHARE * np.linalg.norm(projected, axis=1), LEAST_COSINE, COSINE).astype(np.float32)
        self.queries = (projected / np.maximum(np.linalg.norm(projected, axis=1, keepdims=True), 1e-9)).astype(np.float32)
        self.weights = (self.idf[:, None] * self.space).astype(np.float32)
        self.least = np.minimum(self.least, EXACT * np.array([self._copy(i) for i in range(len(self.items))], np.float32))
        self.rare = []
        for item in self.items:
            _, t = self.terms.number(item)
            self.rare.append(set(self.terms.hashes[t[self.idf[t] > 0]].tolist()))

    def _copy(self, i: int) -> float:
        """The cosine that some passage of an exact copy of item ``i`` has, wherever passages begin."""
        t = self.terms.number(self.items[i])[1]
        sums, mass = np.zeros((len(t) + 1, self.weights.shape[1])), np.zeros(len(t) + 1)
        np.cumsum(self.weights[t], axis=0, out=sums[1:])
        np.cumsum(self.idf[t] ** 2, out=mass[1:])
        known = np.concatenate([[0], np.cumsum(self.idf[t] > 0)])
        start = np.arange(STRIDE - PASSAGE, max(len(t) - STRIDE, 0) + 1)
        lo, hi = np.maximum(start, 0), np.clip(start + PASSAGE, 0, len(t))
        cosine = ((sums[hi] - sums[lo]) @ self.queries[i]) / np.sqrt(np.maximum(mass[hi] - mass[lo], 1e-9))
        cosine[known[hi] - known[lo] < 2] = 0
        return min(cosine[r::STRIDE].max() for r in range(STRIDE))

    def candidates(self, h: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(text, first word of the passage, item, cosine) above the least cosine, best passage of
        each neighbourhood."""
        pos, t = self.terms.number(h)
        use = self.idf[t] > 0
        pos, t = pos[use], t[use]
        if not len(pos):
            return []
        sums = np.zeros((len(pos) + 1, self.weights.shape[1]), np.float32)
        np.cumsum(self.weights[t], axis=0, out=sums[1:])
        mass = np.concatenate([[0], np.cumsum(self.idf[t] ** 2)])
        counts = np.diff(at)
        texts = np.flatnonzero(counts)
        starts = [at[i] + _windows(counts[i]) for i in texts]
        owner = np.repeat(texts, [len(s) for s in starts])
        start = np.concatenate(starts)
        lo, hi = np.searchsorted(pos, start), np.searchsorted(pos, np.minimum(start + PASSAGE, at[owner + 1]))
        full = np.flatnonzero(hi - lo >= 2)  # any item's copies have such passages
        owner, start, lo, hi = owner[full], start[full], lo[full], hi[full]
        out = []
        for a in range(0, len(start), 8192):
            b = slice(a, a + 8192)
            x = sums[hi[b]] - sums[lo[b]]
            cosine = (x @ self.queries.T) / np.sqrt(np.maximum(mass[hi[b]] - mass[lo[b]], 1e-9))[:, None]
            w, item = np.nonzero(cosine >= self.least)
            out.extend(zip(owner[b][w].tolist(), start[b][w].tolist(), item.tolist(), cosine[w, item].tolist()))
        return out

    def matches(self, h: np.ndarray, at: np.ndarray) -> list[tuple[int, int, float, float]]:
        """(text, item id, cosine, share in common order) of the confirmed pairs."""
        best: dict[tuple[int, int], tuple[float, float]] = {}
        found = sorted(self.candidates(h, at), key=lambda c: (c[0], c[2], -c[3], c[1]))
        for text, start, item, cosine in found:
            if best.get((text, item), (0, 0))[1] == 1.0:
                continue
            words = self.items[item]
            a, b = max(start - len(words), int(at[text])), min(start + PASSAGE + len(words), int(at[text + 1]))
            place = h[a:b].tolist()
            if self.rare[item] and len(self.rare[item].intersection(place)) < ANSWER * len(self.rare[item]):
                continue
            share = lcs_length(words.tolist(), place) / len(words)
            if share >= LCS and share > best.get((text, item), (0, 0))[1]:
                best[text, item] = cosine, share
        return [(text, self.ids[item], c, s) for (text, item), (c, s) in sorted(best.items())]


class Phrases:
    """Items of few words, found where their words stand consecutively; as ``Retriever`` to those who search."""

    def __init__(self, ids: list[int], items: list[np.ndarray]):
        self.ids = ids
        self.by_width: dict[int, tuple[np.ndarray, list[list[int]]]] = {}
        for width in sorted({len(x) for x in items}):
            mine = sorted((tuple(x.tolist()), i) for x, i in zip(items, ids) if len(x) == width)
            phrases = sorted({p for p, _ in mine})
            owners: dict[tuple, list[int]] = {p: [] for p in phrases}
            for p, i in mine:
                owners[p].append(i)
            self.by_width[width] = np.array(phrases, np.uint64).reshape(-1, width), [owners[p] for p in phrases]

    def matches(self, h: np.ndarray, at: np.ndarray) -> list[tuple[int, int, float, float]]:
        """(text, item id, 1, 1) of each item that stands in a text, once."""
        out = []
        for width, (phrases, owners) in self.by_width.items():
            # Places are narrowed word by word; only those left are looked up whole.
            start = np.flatnonzero(np.isin(h[: max(len(h) - width + 1, 0)], phrases[:, 0]))
            text = np.searchsorted(at, start, side="right") - 1
            start, text = start[start + width <= at[text + 1]], text[start + width <= at[text + 1]]
            for k in range(1, width):
                stays = np.isin(h[start + k], phrases[:, k])
                start, text = start[stays], text[stays]
            number = {tuple(p): n for n, p in enumerate(phrases.tolist())}
            places = h[start[:, None] + np.arange(width)].tolist()
            found = {(t, number[tuple(p)]) for t, p in zip(text.tolist(), places) if tuple(p) in number}
            out.extend((t, i, 1.0, 1.0) for t, n in sorted(found) for i in owners[n])
        return out


def _count(rows: DataFrame, terms: Terms) -> np.ndarray:
    """One scan of the documents: how many hold each term."""
    width = len(terms.hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total, some = np.zeros(width), False
        for batch in batches:
            if not batch.num_rows:
                continue
            h, at = word_hashes(*K.column(batch))
            pos, t = terms.number(h)
            pair = np.unique((np.searchsorted(at, pos, side="right") - 1) * width + t)
            total += np.bincount(pair % width, minlength=width)
            some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["lot", "part"])
        K.release()

    return sum_arrays(rows.select("text").mapInArrow(run, "lot int, part binary"), width)


def _models(rows: DataFrame, blocks: list[tuple[list[int], list[np.ndarray]]], n_docs: int) -> list[Retriever]:
    """Each block of items in its latent space, with the terms' frequencies in all documents."""
    terms = Terms(np.concatenate([w for _, items in blocks for w in items]))
    df = _count(rows, terms)
    models = [Retriever(*b) for b in blocks]
    for m in models:
        m.weigh(df[np.searchsorted(terms.hashes, m.terms.hashes)], n_docs)
        m.fit()
    return models


def _search(rows: DataFrame, models: list[Retriever | Phrases]) -> DataFrame:
    """The confirmed pairs of some blocks of items, as a written table."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(models)  # bounded by BLOCK items, BLOCKS times

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            words = word_hashes(*K.column(batch)) if batch.num_rows else None
            got = [x for m in shared.value for x in m.matches(*words)] if words else []
            columns = [[ids[t] for t, *_ in got], [i for _, i, _, _ in got], [c for _, _, c, _ in got], [s for *_, s in got]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.float64()))], ["id", "item", "cosine", "lcs_share"])
        K.release()

    out = materialize(rows.mapInArrow(run, SCHEMA), "contaminated")
    shared.destroy()
    return out


SCHEMA = "id long, item long, cosine double, lcs_share double"


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id") -> DataFrame:
    """``key``, ``item``, ``cosine`` and ``lcs_share`` of each confirmed pair; other documents have no
    row."""
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    n_docs = rows.count()
    out = spark.createDataFrame([], SCHEMA)
    if not n_docs:
        return out.withColumnsRenamed({"id": key, "item": item})
    blocks: list[tuple[list[int], list[np.ndarray]]] = []
    short: tuple[list[int], list[np.ndarray]] = [], []
    listed = benchmark.where(F.col(text).isNotNull()).select(F.col(item).cast("long").alias("item"), F.col(text).alias("text")).orderBy("item", "text")
    for r in listed.toLocalIterator():
        h, _ = word_hashes(np.frombuffer(r["text"].encode(), np.uint8), np.array([0, len(r["text"].encode())]))
        if not len(h):
            continue
        if len(h) < LEAST_WORDS:
            if len(short[0]) == BLOCK * BLOCKS:
                out, short = out.unionByName(_search(rows, [Phrases(*short)])), ([], [])
            short[0].append(r["item"]), short[1].append(h)
            continue
        if not blocks or len(blocks[-1][0]) == BLOCK:
            if len(blocks) == BLOCKS:
                out, blocks = out.unionByName(_search(rows, _models(rows, blocks, n_docs))), []
            blocks.append(([], []))
        blocks[-1][0].append(r["item"]), blocks[-1][1].append(h)
    models = [*(_models(rows, blocks, n_docs) if blocks else []), *([Phrases(*short)] if short[0] else [])]
    if models:
        out = out.unionByName(_search(rows, models))
    return out.withColumnsRenamed({"id": key, "item": item})
