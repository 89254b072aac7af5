"""Exact substring deduplication with a run-length index of repeated regions.

Every byte covered by a string of ``length`` bytes that starts in a second place anywhere is removed;
strings of ``mark`` bytes (at most ``length``) that do so are reported as shared. The work is dealt out
so that each place where such a string can start is judged in exactly one task:

1. The anchor of a place is the leftmost of the least k-gram hashes of the ``mark`` bytes from there, so
   equal strings have equal anchors at equal offsets. The places of one anchor that lie side by side
   form a stretch; its context is the bytes up to ``length`` after the last of them.
2. Contexts that are equal byte for byte (by a 64-bit anchor and a 64-bit context hash) are one class;
   a class with two members is repeated throughout. Copies are settled here, by counting.
3. Anchors with several classes are searched: one context of each class goes to the lot of its anchor. A
   lot is indexed as a run-compressed Burrows-Wheeler transform: suffixes are sorted up to ``length``
   bytes, and common-prefix lengths are taken at the ends of the runs only. Streaming over the text, the
   match at a place is the longest one sampled there or one less than at the place before: matching
   statistics, which tell where ``mark`` and ``length`` are reached.
4. The contexts of an anchor with more classes than a lot should hold are split: places at ``NEAR``
   neighbouring distances from the anchor share most of their ``mark`` bytes, so only parts in which
   these are equal need to meet, and each such set of parts is a lot of its own. Sets that are still too
   large are settled by counting hashes of their strings, spread over all tasks.

Marked places go back to their documents, which cut the covered bytes.

Defined results: null or empty text has no bytes; texts shorter than ``length`` keep all; matches never
cross documents. Rows are told apart by key and text: a row that occurs twice is a copy of itself, one
key may stand on several texts, and rows without a key are judged like others. Other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetmill.llm import kernels as K
from facetmill.llm.common import bound_batches, discard, join_hot, materialize

#: Bytes of an anchor's k-gram.
GRAM = 48
#: Places looked at in one piece of a long text.
PIECE = 2 << 20
#: Distances to the anchor whose places make a part, for crowded anchors.
NEAR = 32
#: Bytes of a lot, and classes of one anchor that a lot takes; bytes of the lots dealt to one task.
LOT_BYTES, LOT_CLASSES, TASK_BYTES = 512 << 10, 2000, 64 << 20
#: Rows of one context, or classes of one anchor, beyond which the rows stay where they are in a join.
HOT = 100_000


def _window_min(key: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours, by block-wise running minima from both sides."""
    n = len(key)
    pad = -n % w
    blocks = np.concatenate([key, np.full(pad, ~np.uint64(0))]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def gram_of(mark: int) -> int:
    return min(GRAM, max(1, mark // 4))


def stretches(text: np.ndarray, mark: int) -> Iterator[tuple[int, int, int]]:
    """(first place, number of places, anchor hash) for every string of ``mark`` bytes, in order."""
    gram = gram_of(mark)
    for base in range(0, max(len(text) - mark + 1, 0), PIECE):
        part = text[base : base + PIECE + mark - 1]
        p = K.prefix_hash(part)
        at = np.arange(len(part) - gram + 1)
        h = K.span_hash(p, at, at + gram)
        key = (h & ~np.uint64(0xFFFFFF)) | at.astype(np.uint64)
        anchor = (_window_min(key, mark - gram + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        number = np.diff(np.append(first, len(anchor)))
        for s, n, a in zip(first.tolist(), number.tolist(), h[anchor[first]].view(np.int64).tolist()):
            yield base + s, n, a


def matching_statistics(texts: list[bytes], places: list[int], longest: int, least: int) -> list[np.ndarray]:
    """For the first ``places`` bytes of each text, how long a string from there also starts at another
    such place: exact from ``least`` to ``longest`` bytes, shorter or longer matches only on the right
    side of these bounds. The bytes after them are read on, but start nothing, as they may be places of
    another text. Run-compressed transform, samples at run ends, streamed match lengths."""
    size = np.array([len(t) for t in texts], np.int64)
    bounds = np.concatenate([[0], np.cumsum(size + 1)])
    s = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8)
    n = len(s)
    # Rank by 8 bytes, then by three ranks at a time, sorting only places whose rank is still shared.
    padded = np.concatenate([s, np.zeros(8, np.uint8)])
    eight = np.zeros(n, np.uint64)
    for k in range(8):
        eight = (eight << np.uint64(8)) | padded[k : k + n]
    order = np.argsort(eight).astype(np.int32)
    word = eight[order]
    fresh = np.concatenate([[True], word[1:] != word[:-1]])
    count = np.arange(n, dtype=np.int32)
    rank = np.zeros(n + 2 * longest, np.int32)  # from 1; 0 behind the end
    rank[order] = np.maximum.accumulate(np.where(fresh, count, 0)) + 1
    span, digits = 8, max(int(n).bit_length(), 1)
    early = fresh.copy() if span <= least else np.zeros(n, bool)  # told apart within ``least`` bytes
    while span < longest:
        shared = np.flatnonzero(~(fresh & np.append(fresh[1:], True))).astype(np.int32)
        if not len(shared):
            break
        pos = order[shared]
        key = rank[pos].astype(np.int64)
        steps = 2 if 2 * span < longest and 3 * digits <= 63 else 1  # more ranks that fit into the key
        for k in range(1, steps + 1):
            key = (key << digits) | rank[pos + k * span]
        inner = np.argsort(key)
        pos, key = pos[inner], key[inner]
        order[shared] = pos
        new = np.concatenate([[True], key[1:] != key[:-1]])
        fresh[shared] = new
        rank[pos] = np.maximum.accumulate(np.where(new, shared, 0)) + 1
        span *= steps + 1
        if span <= least:
            early = fresh.copy()
    starts = np.zeros(n + 1, np.int8)
    np.add.at(starts, bounds[:-1], 1)
    np.add.at(starts, bounds[:-1] + np.array(places, np.int64), -1)
    starts = np.cumsum(starts[:n], dtype=np.int8).astype(bool)[order]
    # Equal numbers: not told apart at all, or not within ``least`` bytes.
    alike, near = np.cumsum(fresh, dtype=np.int32)[starts], np.cumsum(early, dtype=np.int32)[starts]
    order = order[starts]
    # Run ends of the transform: where the byte before differs from that of the suffix next in order.
    before = s[order - 1].astype(np.int16)
    before[order == 0] = -1
    # Starts of texts count as different, and so do suffixes that were not told apart.
    ends = (before[1:] != before[:-1]) | (before[1:] == 0xFF) | (alike[1:] == alike[:-1])  # between neighbours i and i+1
    # Neighbours told apart earlier have too little in common to be of use as samples.
    sampled = np.flatnonzero(ends & (near[1:] == near[:-1]))
    left, right = order[sampled], order[sampled + 1]
    room = np.repeat(bounds[1:] - 1, size + 1).astype(np.int32) - count  # to the end of the place's text
    common = np.minimum(np.minimum(_common_prefix(eight, left, right, max(span, longest)), room[left]), room[right])  # all that isn't told apart is sampled
    # Streaming: the match at x+1 is at least that at x less one. Inside a run both neighbours go on
    # to the left with the same byte, and what is left of a place in its text is one, so only the
    # samples start anything new.
    match = count.copy()
    np.maximum.at(match, left, left + common)
    np.maximum.at(match, right, right + common)
    match = np.maximum.accumulate(match) - count
    return [match[a : a + number] for a, number in zip(bounds[:-1].tolist(), places)]


def _common_prefix(eight: np.ndarray, a: np.ndarray, b: np.ndarray, longest: int) -> np.ndarray:
    """Length of the common prefix of pairs of suffixes, up to ``longest`` and a bit, by words of the 8
    bytes from each place."""
    out = np.zeros(len(a), np.int32)
    live = np.arange(len(a), dtype=np.int32)
    last = len(eight) - 1
    while len(live):
        x, y = a[live] + out[live], b[live] + out[live]
        differ = eight[np.minimum(x, last)] ^ eight[np.minimum(y, last)]
        equal = np.full(len(live), 8, np.int32)
        for k in range(8):  # the byte k from the end tells that fewer are equal
            equal[(differ >> np.uint64(8 * k)) != 0] = 7 - k
        out[live] += equal
        live = live[(equal == 8) & (out[live] < longest) & (np.maximum(x, y) < last)]
    return out


def _anchors(docs: DataFrame, length: int, mark: int) -> DataFrame:
    """A row for each stretch: id and digest of the text, start, number of places, anchor, context hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            buf, offs = K.column(batch)
            view = memoryview(np.ascontiguousarray(buf)).cast("B") if len(buf) else b""
            rows: list[tuple] = []
            for i, (s, e) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist())):
                if e - s >= mark:
                    for start, number, anchor in stretches(buf[s:e], mark):
                        at = s + start
                        rows.append((i, start, number, anchor, xxhash.xxh3_64_intdigest(view[at : min(at + number + length - 1, e)]) - (1 << 63)))
            columns = list(zip(*rows)) if rows else [[]] * 5
            row = pa.array(columns[0], pa.int64())
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), *[pa.array(c, k) for c, k in zip(columns[1:], kinds)]], ["id", "digest", "start", "number", "anchor", "context"])
        K.release()

    return docs.select("id", "digest", "text").mapInArrow(run, "id long, digest long, start int, number int, anchor long, context long")


def _contexts(docs: DataFrame, length: int) -> DataFrame:
    """``docs`` has text and wanted (array of start, number, anchor, context, crowded); gives one row
    with the bytes of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = K.column(batch)
            rows = []
            for i, wanted in enumerate(batch.column(batch.schema.get_field_index("wanted")).to_pylist()):
                s, e = int(offs[i]), int(offs[i + 1])
                for w in wanted:
                    at = s + w["start"]
                    rows.append((w["anchor"], w["context"], w["number"], w["crowded"], buf[at : min(at + w["number"] + length - 1, e)].tobytes()))
            columns = list(zip(*rows)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["anchor", "context", "number", "crowded", "bytes"])
        K.release()

    return docs.select("text", "wanted").mapInArrow(run, "anchor long, context long, number int, crowded boolean, bytes binary")


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _run_lists(mask: np.ndarray, at: np.ndarray, some: np.ndarray) -> pa.Array:
    """The runs of the mask in each part (from ``at`` to the next) that ``some`` picks, as lists."""
    first, last = mask.copy(), mask.copy()
    first[1:] &= ~mask[:-1]
    first[at[:-1]] = mask[at[:-1]]
    last[:-1] &= ~mask[1:]
    last[at[1:] - 1] = mask[at[1:] - 1]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    part = np.searchsorted(at, a, side="right") - 1
    keep = some[part]
    a, b, part = a[keep], b[keep], part[keep]
    number = np.bincount(part, minlength=len(some))[some]
    offsets = np.concatenate([[0], np.cumsum(number)]).astype(np.int32)
    spans = pa.StructArray.from_arrays([pa.array((x - at[part]).astype(np.int32)) for x in (a, b)], fields=list(SPAN_TYPE.value_type))
    return pa.ListArray.from_arrays(pa.array(offsets), spans)


SPANS, SPAN_TYPE = "array<struct<a:int,b:int>>", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
#: Marked places of a class (or part): starts of strings of ``length`` bytes, and of ``mark`` bytes.
MARKS = f"lot long, member long, spans {SPANS}, shared {SPANS}"


def _search(contexts: DataFrame, length: int, mark: int, tasks: int) -> DataFrame:
    """The marks of each row of lot, member, number, bytes, whose lots are put together to lots of some
    size; rows of one lot stay together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []
        size, lot = 0, None

        def close() -> pa.RecordBatch:
            columns = [np.zeros(0, np.int64)] * 2
            listed = [pa.array([], SPAN_TYPE)] * 2
            if len(held) > 1:
                match = matching_statistics([h[3] for h in held], [h[2] for h in held], length, mark)
                at = np.cumsum([0] + [len(m) for m in match])
                match = np.concatenate(match)
                some = np.add.reduceat(match >= mark, at[:-1]) > 0
                columns = [np.array([h[i] for h in held], np.int64)[some] for i in range(2)]
                listed = [_run_lists(match >= least, at, some) for least in (length, mark)]
            held.clear()
            return pa.RecordBatch.from_arrays([*map(pa.array, columns), *listed], ["lot", "member", "spans", "shared"])

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if held and held[-1][:2] == row[:2]:
                    continue  # from a document that occurs twice
                if size >= LOT_BYTES and row[0] != lot:
                    yield close()
                    size = 0
                lot = row[0]
                held.append(row)
                size += len(row[3])
        yield close()
        K.release()

    dealt = contexts.select("lot", "member", "number", "bytes").repartition(tasks, "lot").sortWithinPartitions("lot", "member")
    return dealt.mapInArrow(run, MARKS)


def _anchor_place(s: np.ndarray, anchor: int, number: int, mark: int) -> int:
    """Where a context's anchor starts: the first such k-gram that the strings of all its places hold."""
    gram = gram_of(mark)
    at = np.arange(number - 1, mark - gram + 1)
    h = K.span_hash(K.prefix_hash(s), at, at + gram).view(np.int64)
    return int(at[np.flatnonzero(h == anchor)[0]])


def _parts(crowded: DataFrame, length: int, mark: int) -> DataFrame:
    """The contexts by classes of ``NEAR`` distances to the anchor: lot (a hash of the anchor, the class and
    the bytes that its strings share), member, where the part begins, number of places, bytes."""
    near = min(NEAR, mark // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            rows = []
            for anchor, context, number, data in zip(*(batch.column(i).to_pylist() for i in range(4))):
                place = _anchor_place(np.frombuffer(data, np.uint8), anchor, number, mark)
                for j in range((place - number + 1) // near, place // near + 1):
                    last = place - near * j
                    a, b = max(last - near + 1, 0), min(last, number - 1)
                    lot = xxhash.xxh3_64(f"{anchor}:{j}:")
                    lot.update(data[last : last + mark - near + 1])
                    member = xxhash.xxh3_64_intdigest(f"{anchor}:{context}:{j}")
                    rows.append((anchor, context, lot.intdigest() - (1 << 63), member - (1 << 63), a, b - a + 1, data[a : b + length]))
            columns = list(zip(*rows)) if rows else [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["anchor", "context", "lot", "member", "first", "number", "bytes"])

    return crowded.mapInArrow(run, "anchor long, context long, lot long, member long, first int, number int, bytes binary")


def _counted(parts: DataFrame, length: int, mark: int) -> DataFrame:
    """The marks of parts by counting hashes of their strings of both lengths."""
    sizes = sorted({mark, length})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lot, member, number, data in zip(*(batch.column(i).to_pylist() for i in range(4))):
                s = np.frombuffer(data, np.uint8)
                p = K.prefix_hash(s)
                for size in sizes:
                    at = np.arange(max(min(number, len(s) - size + 1), 0))
                    h = K.span_hash(p, at, at + size).view(np.int64)
                    fixed = [pa.array(np.full(len(at), v), pa.int64()) for v in (lot, member)]
                    yield pa.RecordBatch.from_arrays([*fixed, pa.array(np.full(len(at), size), pa.int32()), pa.array(at.astype(np.int32)), pa.array(h)], ["lot", "member", "size", "at", "string"])

    rows = materialize(parts.select("lot", "member", "number", "bytes").mapInArrow(run, "lot long, member long, size int, at int, string long"), "strings")
    string = ["lot", "size", "string"]
    twice = materialize(rows.groupBy(*string).agg(F.count("*").alias("n")).where("n > 1"), "twice")
    marked = join_hot(rows, twice, string, F.col("n") > HOT)
    spans = lambda size: F.array_sort(F.collect_list(F.when(F.col("size") == size, F.struct(F.col("at").alias("a"), (F.col("at") + 1).alias("b"))))).cast(SPANS)
    return marked.groupBy("lot", "member").agg(spans(length).alias("spans"), spans(mark).alias("shared"))


def _moved(spans: str, by: str) -> Column:
    return F.transform(spans, lambda s: F.struct((s["a"] + F.col(by)).alias("a"), (s["b"] + F.col(by)).alias("b")))


def _gathered(rows: DataFrame, by: str, *keys: str) -> DataFrame:
    """All spans of each key, moved by a column."""
    moved = rows.select(*keys, _moved("spans", by).alias("spans"), _moved("shared", by).alias("shared"))
    return moved.groupBy(*keys).agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("shared")).alias("shared"))


def _crowded(contexts: DataFrame, length: int, mark: int, tasks: int) -> DataFrame:
    """The marks of classes whose anchors have very many."""
    parts = contexts.select("anchor", "context", "number", "bytes").dropDuplicates(["anchor", "context"])
    parts = materialize(_parts(parts, length, mark), "parts")
    lots = materialize(parts.groupBy("lot").agg(F.count("*").alias("members")).where("members > 1"), "lots")
    dealt = join_hot(parts, lots, ["lot"], F.col("members") > LOT_CLASSES)
    found = _search(dealt.where(F.col("members") <= LOT_CLASSES), length, mark, tasks)
    if lots.where(F.col("members") > LOT_CLASSES).limit(1).count():
        found = found.unionByName(_counted(dealt.where(F.col("members") > LOT_CLASSES), length, mark))
    placed = found.join(parts.select("lot", "member", "anchor", "context", "first"), ["lot", "member"])
    return _gathered(placed, "first", "anchor", "context")


def _cut(docs: DataFrame, length: int, mark: int, kind: str) -> DataFrame:
    """The digest columns of each document; ``spans`` and ``shared`` are its marked places."""

    def covered(size: int, spans: list, width: int) -> np.ndarray:
        gone = np.zeros(size + 1, np.int32)
        for sp in spans or ():
            if sp["a"] + width <= size:  # the last places of a text have only ``mark`` bytes left
                gone[sp["a"]] += 1
                gone[min(sp["b"] + width - 1, size)] -= 1
        return np.cumsum(gone)[:-1] > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = K.column(batch)
            out: list[tuple] = []
            for i, (spans, shared) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                text = buf[offs[i] : offs[i + 1]]
                gone = covered(len(text), spans, length)
                out.append((int(len(text)), int(gone.sum()), len(_runs(gone)), text[~gone].tobytes(), int(covered(len(text), shared, mark).sum())))
            sizes, removed, runs, rest, common = zip(*out) if out else ([], [], [], [], [])
            digests = [hashlib.sha256(r).hexdigest() for r in rest]
            columns = [batch.column(0), *[pa.array(c, pa.int64()) for c in (sizes, removed, runs)], pa.array(digests, pa.string()), pa.array(common, pa.int64())]
            names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared"]
            if kind == "text":
                columns.append(pa.array([r.decode("utf-8", "replace") for r in rest], pa.string()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(columns, names)
        K.release()

    return docs.select("id", "text", "spans", "shared").mapInArrow(run, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared long" + (", kept string" if kind == "text" else ""))


def deduplicate(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = 400, mark: int | None = None, kind: str = "digest") -> DataFrame:
    """``key``, n_bytes, n_removed, n_spans, kept_sha256 of every document; with ``mark`` also n_shared, the
    bytes covered by strings of that many bytes that also start anywhere else; with kind "text" also
    ``kept``, the remaining text."""
    spark = docs.sparkSession
    bound_batches(spark)
    shared, mark = mark is not None, min(mark or length, length)
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    # Rows are known by key and text; 0 stands for no key, told apart by the digest.
    rows = rows.withColumn("no", F.coalesce("id", F.lit(0))).withColumn("digest", F.xxhash64(F.col("id").isNull(), "text"))
    row = ["no", "digest"]
    anchors = materialize(_anchors(rows.select(F.col("no").alias("id"), "digest", "text"), length, mark).withColumnRenamed("id", "no"), "anchors")
    # The first ones are of one row, as all three are taken from each row together; any row will do.
    classes = anchors.groupBy("anchor", "context", "number").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in (*row, "start")])
    by_anchor = classes.groupBy("anchor").agg(F.sum("n").alias("total"), F.count("*").alias("classes")).where("total > 1")
    # Repeated anchors only; unique ones, the bulk of ordinary text, end here.
    repeated = materialize(classes.join(by_anchor, "anchor").select("anchor", "context", "number", "n", *row, "start", "classes"), "classes")
    searched = repeated.where("classes > 1").withColumn("crowded", F.col("classes") > LOT_CLASSES)
    wanted = searched.groupBy(*row).agg(F.collect_list(F.struct("start", "number", "anchor", "context", "crowded")).alias("wanted"))
    wanted = materialize(wanted, "wanted")
    size = searched.agg(F.coalesce(F.sum(F.col("number") + length), F.lit(0))).first()[0]
    contexts = materialize(_contexts(rows.join(wanted, row), length), "contexts")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    usual = contexts.where("NOT crowded").select(F.col("anchor").alias("lot"), F.col("context").alias("member"), "number", "bytes")
    found = _search(usual, length, mark, tasks).withColumnsRenamed({"lot": "anchor", "member": "context"})
    if searched.where("crowded").limit(1).count():
        found = found.unionByName(_crowded(contexts.where("crowded"), length, mark, tasks))
    found = materialize(found, "found")
    # A class that is repeated throughout needs no search of its own.
    places = lambda n: F.array(F.struct(F.lit(0).alias("a"), n.alias("b"))).cast(SPANS)
    whole = repeated.where("n > 1").select("anchor", "context", places(F.col("number")).alias("spans"), places(F.col("number")).alias("shared"), "n")
    partly = found.join(repeated.select("anchor", "context", "n"), ["anchor", "context"]).where("n = 1")
    marks = materialize(whole.unionByName(partly), "marks")
    placed = join_hot(anchors, marks, ["anchor", "context"], F.col("n") > HOT, 400)
    spans = _gathered(placed, "start", *row)
    spans = materialize(spans, "spans")
    discard(anchors, repeated, wanted, contexts, found, marks)
    out = _cut(rows.join(spans, row, "left"), length, mark, kind).withColumnRenamed("id", key)
    return out if shared else out.drop("n_shared")
