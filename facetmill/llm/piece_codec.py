"""SentencePiece encoding and decoding by a streaming Viterbi search.

The best segmentation of a text is the one whose piece scores add up highest; ties go to the longest
last piece. ``stream_viterbi`` keeps scores for a window bounded by the longest piece, and commits ids
whenever all surviving backpointer paths meet at one boundary. Where two neighbouring bytes stand
side by side in no piece, every path meets by construction; texts are cut there, equal stretches of
a batch are solved once, and short ones all together, position by position, in NumPy. Longer
stretches go through ``stream_viterbi`` itself. The results are the same.

The vocabulary file is a parameter; nothing is trained. Piece scores are used as the file has them,
also where the file comes from merges, so ids may differ from those of a merging encoder.

Defined results: null text gives null ids; empty text gives no ids; characters that no piece covers,
and U+2581 itself, become byte pieces, so decoding gives back every text exactly. Unknown ids and
control ids decode to nothing. Repeated rows stay; other columns are kept.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetmill.llm import kernels as K
from facetmill.llm.common import bound_batches

#: Where the vocabulary is looked for unless a path is given.
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text solved at a time, and the longest stretch solved together with others.
LOT_BYTES, LONG = 1 << 20, 40
_MARK = "▁"
#: As for unigram models: an uncovered character costs this much more than the worst piece.
UNKNOWN_PENALTY = 10.0


class PieceModel:
    """Pieces as bytes, blanks standing for the word mark."""

    def __init__(self, pieces: list[tuple[int, bytes, float]], byte_ids: list[int], size: int):
        self.size, self.byte_ids = size, np.array(byte_ids, np.int32)
        self.pieces = {p: (s, i) for i, p, s in pieces}
        self.longest = max((len(p) for p in self.pieces), default=1)
        self.lengths = sorted({len(p) for p in self.pieces})
        self.unknown = min((s for s, _ in self.pieces.values()), default=0.0) - UNKNOWN_PENALTY
        # Pairs of neighbouring bytes inside some piece; elsewhere a text can be cut.
        self.joined = np.zeros((256, 256), bool)
        self.joined[:, 0x80:0xC0] = True
        texts = [b""] * size
        hashes = np.zeros(len(pieces), np.uint64)
        for k, (i, p, _) in enumerate(pieces):
            texts[i] = p
            a = np.frombuffer(p, np.uint8)
            self.joined[a[:-1], a[1:]] = True
            hashes[k] = K.span_hash(K.prefix_hash(a), np.array([0]), np.array([len(p)]))[0]
        for b, i in enumerate(byte_ids):
            texts[i] = bytes([b])
        order = np.argsort(hashes)
        self.hashes, self.ids, self.scores = hashes[order], np.array([p[0] for p in pieces], np.int32)[order], np.array([p[2] for p in pieces])[order]
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(hashes >> np.uint64(44)).astype(np.int64)] = True
        self.flat = np.frombuffer(b"".join(texts), np.uint8)
        self.bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])

    @classmethod
    def load(cls, path: str = DEFAULT_MODEL) -> PieceModel:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        normal, byte_ids = [], [0] * 256
        for i in range(sp.get_piece_size()):
            if sp.is_byte(i):
                byte_ids[int(sp.id_to_piece(i)[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                normal.append((i, sp.id_to_piece(i).replace(_MARK, " ").encode(), sp.get_score(i)))
        return cls(normal, byte_ids, sp.get_piece_size())

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are pieces, and where in ``hashes``."""
        hit = np.flatnonzero(self.filter[(h >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, h[hit]), len(self.hashes) - 1)
        same = self.hashes[at] == h[hit]
        return hit[same], at[same]


def stream_viterbi(data: bytes, model: PieceModel) -> Iterator[int]:
    """Ids of the best segmentation of ``data``, committed as soon as they are certain.

    Scores are kept for a window of the longest piece, backpointers (8 bytes a place) until the paths of
    the window meet. Runs of one byte may never let them meet; so meetings are looked for at growing
    distances, and the time stays in proportion to the text."""
    width = max(model.longest, 4)
    best, starts = {0: 0.0}, [0]
    step, piece = array("i", [0]), array("i", [0])  # of the places from ``done`` on; a character as bytes is -1
    done, look = 0, 2 * width

    def path(end: int) -> list[int]:
        out: list[int] = []
        while end > done:
            a, i = end - step[end - done], piece[end - done]
            out.extend([i] if i >= 0 else model.byte_ids[np.frombuffer(data[a:end], np.uint8)[::-1]].tolist())
            end = a
        return out[::-1]

    for end in range(1, len(data) + 1):
        if end < len(data) and 0x80 <= data[end] < 0xC0:  # inside a character
            step.append(0), piece.append(0)
            continue
        while end - starts[0] > width and len(starts) > 1:
            del best[starts.pop(0)]
        top, at, token = -np.inf, 0, 0
        for a in starts:
            if end - a <= width and (hit := model.pieces.get(data[a:end])) and best[a] + hit[0] > top:
                top, at, token = best[a] + hit[0], a, hit[1]
        a = starts[-1]
        if data[a:end] not in model.pieces and best[a] + model.unknown > top:
            top, at, token = best[a] + model.unknown, a, -1
        best[end] = top
        step.append(end - at), piece.append(token)
        starts.append(end)
        if end >= look:
            alive = {a for a in starts if end - a < width or a == end}
            while len(alive) > 1 and max(alive) > done:  # the boundary that all surviving paths share
                last = max(alive)
                alive.remove(last)
                alive.add(last - step[last - done])
            meet = alive.pop() if len(alive) == 1 else done
            if meet > done:
                yield from path(meet)
                step, piece = step[meet - done :], piece[meet - done :]
                done = meet
            look = end + max(2 * width, end - done)
    yield from path(len(data))


def _solve_short(m: np.ndarray, size: np.ndarray, model: PieceModel) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each row of bytes (sizes descending), right-aligned, and their number."""
    n, width = m.shape
    up, down = K.powers(width)
    p = np.zeros((width + 1, n), np.uint64)
    np.cumsum((m.T.astype(np.uint64) + np.uint64(1)) * up[:width, None], axis=0, out=p[1:])
    score = np.full((width + 1, n), -np.inf)
    score[0] = 0
    step = np.zeros((width + 1, n), np.uint8)
    piece = np.zeros((width + 1, n), np.int32)  # -1: a character as bytes
    lead = np.zeros(256, np.uint8)  # bytes of the character that starts with this byte
    lead[:0x80], lead[0xC0:0xE0], lead[0xE0:0xF0], lead[0xF0:] = 1, 2, 3, 4
    rows_at = np.searchsorted(-size, -np.arange(width + 1), side="right")  # rows with size >= j
    for j in range(1, width + 1):
        r = rows_at[j]
        if not r:
            break
        for length in reversed([x for x in model.lengths if x <= j]):
            s = j - length
            h = K.mix((p[j, :r] - p[s, :r]) * down[s] + np.uint64(length * int(K._MIX2) % (1 << 64)))
            hit, at = model.look_up(h)
            new = score[s, hit] + model.scores[at]
            better = new > score[j, hit]
            hit, at = hit[better], at[better]
            score[j, hit], step[j, hit], piece[j, hit] = new[better], length, model.ids[at]
        for length in (4, 3, 2, 1):
            if length > j:
                continue
            s = j - length
            whole = np.flatnonzero(lead[m[:r, s]] == length)
            new = score[s, whole] + model.unknown
            # A covered character has a piece of its own, which is no worse than this.
            better = new > score[j, whole]
            whole = whole[better]
            score[j, whole], step[j, whole], piece[j, whole] = new[better], length, -1
    out = np.zeros((n, width), np.int32)
    count = np.zeros(n, np.int64)
    at, owed = size.copy(), np.zeros(n, np.int64)
    live = np.arange(n)
    while len(live):
        j = at[live]
        fresh = owed[live] == 0
        token, length = piece[j, live], step[j, live].astype(np.int64)
        as_bytes = ~fresh | (token < 0)
        owed[live] = np.where(fresh & (token < 0), length, owed[live])
        token = np.where(as_bytes, model.byte_ids[m[live, j - 1]], token)
        owed[live] -= as_bytes
        at[live] -= np.where(as_bytes, 1, length)
        count[live] += 1
        out[live, width - count[live]] = token
        live = live[at[live] > 0]
    return out, count


def _spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... (count[0] of them), start[1], ..."""
    total = np.cumsum(count)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(start - (total - count), count)


def encode_batch(buf: np.ndarray, offs: np.ndarray, model: PieceModel) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts end to end, and their bounds."""
    full = offs[1:] > offs[:-1]
    data = np.insert(buf, offs[:-1][full], 0x20)
    bounds = np.concatenate([[0], np.cumsum(np.diff(offs) + full)])
    if not len(data):
        return np.zeros(0, np.int32), bounds
    cut = np.ones(len(data), bool)
    cut[1:] = ~model.joined[data[:-1], data[1:]]
    cut[bounds[:-1][full]] = True
    start = np.flatnonzero(cut)
    end = np.append(start[1:], len(data))
    h = K.span_hash(K.prefix_hash(data), start, end)
    _, first, back = np.unique(h, return_index=True, return_inverse=True)
    s, size = start[first], (end - start)[first]
    tokens: list[np.ndarray] = []
    place, number = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
    filled = 0
    short = np.flatnonzero(size <= LONG)
    short = short[np.argsort(-size[short], kind="stable")]
    for lot in np.array_split(short, max(1, len(short) // 20000)):
        if not len(lot):
            continue
        width = int(size[lot[0]])
        m = data[np.minimum(s[lot][:, None] + np.arange(width), len(data) - 1)]
        m[np.arange(width) >= size[lot][:, None]] = 0x80
        out, count = _solve_short(m, size[lot], model)
        tokens.append(out.ravel()[_spread(np.arange(len(lot)) * width + width - count, count)])
        place[lot], number[lot] = filled + np.cumsum(count) - count, count
        filled += int(count.sum())
    for k in np.flatnonzero(size > LONG):
        ids = np.fromiter(stream_viterbi(data[s[k] : s[k] + size[k]].tobytes(), model), np.int32)
        tokens.append(ids)
        place[k], number[k] = filled, len(ids)
        filled += len(ids)
    each = number[back]
    ids = np.concatenate(tokens)[_spread(place[back], each)]
    before = np.concatenate([[0], np.cumsum(each)])
    return ids, before[np.searchsorted(start, bounds)]


def decode_batch(ids: np.ndarray, bounds: np.ndarray, model: PieceModel) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and their bounds."""
    ids = np.where((ids >= 0) & (ids < model.size), ids, 0)
    size = (model.bounds[1:] - model.bounds[:-1])[ids]
    data = model.flat[_spread(model.bounds[ids], size)]
    offs = np.concatenate([[0], np.cumsum(size)])[bounds]
    lead = offs[:-1][offs[1:] > offs[:-1]]
    lead = lead[data[lead] == 0x20]  # the blank put before a text
    gone = np.zeros(len(offs), np.int64)
    gone[1:] = np.searchsorted(lead, offs[1:], side="left")
    return np.delete(data, lead), offs - gone


def _lots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together to about ``LOT_BYTES``, so that more stretches are equal."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= LOT_BYTES:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def _lists(values: np.ndarray, bounds: np.ndarray, null: np.ndarray) -> pa.Array:
    offsets = pa.array(bounds.astype(np.int32), pa.int32(), mask=np.append(null, False))
    return pa.ListArray.from_arrays(offsets, pa.array(values, pa.int32()))


def encode(docs: DataFrame, model: PieceModel, text: str = "text", check: bool = False) -> DataFrame:
    """``docs`` with ``ids`` (array<int>); with ``check`` also ``round_trip``, whether decoding
    gives the text back."""
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _lots(batches):
            buf, offs = K.column(batch, text)
            null = batch.column(batch.schema.get_field_index(text)).is_null().to_numpy(zero_copy_only=False)
            ids, bounds = encode_batch(buf, offs, shared.value)
            columns = [*batch.columns, _lists(ids, bounds, null)]
            names = [*batch.schema.names, "ids"]
            if check:
                data, ends = decode_batch(ids, bounds, shared.value)
                equal = np.array_equal(data, buf) and np.array_equal(ends, offs)
                same = np.ones(len(null), bool) if equal else np.array([bytes(data[ends[i] : ends[i + 1]]) == bytes(buf[offs[i] : offs[i + 1]]) for i in range(len(null))], bool)
                columns.append(pa.array(same, pa.bool_()))
                names.append("round_trip")
            yield pa.RecordBatch.from_arrays(columns, names)
        K.release()

    rows = docs.drop("ids", "round_trip")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, fields + ", ids array<int>" + (", round_trip boolean" if check else ""))


def decode(encoded: DataFrame, model: PieceModel, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``, the text of its ids; invalid UTF-8 gives replacement characters."""
    spark = encoded.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = batch.column(batch.schema.get_field_index(ids))
            number = np.array([0 if x is None else x for x in pa.compute.list_value_length(a).to_pylist()], np.int64)
            flat = a.flatten().fill_null(0).to_numpy(zero_copy_only=False)
            data, offs = decode_batch(flat, np.concatenate([[0], np.cumsum(number)]), shared.value)
            texts = [None if null else bytes(data[s:e]).decode("utf-8", "replace") for s, e, null in zip(offs[:-1], offs[1:], a.is_null().to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    rows = encoded.drop("decoded")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, fields + ", decoded string")


def codec_report(docs: DataFrame, model: PieceModel, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``n_ids``, ``ids`` and ``round_trip`` of every row."""
    out = encode(docs.select(key, F.col(text).alias("text")), model, "text", check=True)
    return out.select(key, F.coalesce(F.size("ids"), F.lit(0)).alias("n_ids"), "ids", "round_trip")
