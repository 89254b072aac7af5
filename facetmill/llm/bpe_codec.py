"""BPE encoding and decoding by forced boundaries.

Two neighbouring bytes that stand side by side inside no token of the vocabulary can never be merged, so
the boundary between them is certain. A text is cut at all such places; each fragment is encoded on its
own, merges in the order of their ranks, and the ids are put one after another. Fragments recur, so a
worker keeps the ids of those it has met, in two tables of bounded size: fragments, and whole stretches
between blanks. White space stands inside no token at all, so it is a forced boundary of every text,
and stretches between blanks can be normalised and split into words one at a time.

The vocabulary file is a parameter; nothing is trained. Its normaliser and word pattern are run by the
tokenizers library, merges and cuts are done here. Ids are those of that library.

Texts are taken together, and long ones cut at blanks, into windows of about ``WINDOW`` bytes. What is held
beside them is the longest stretch without a blank, and a text's ids.

Defined results: null text gives null ids, and null when decoded; empty text and white space give no
ids. Strings of special tokens in a text become these tokens. Decoding is that of the file: without a
decoder, tokens are joined by a blank; ids outside the vocabulary decode to nothing. Repeated rows stay;
other columns are kept, but those named as the results.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetmill.llm import kernels as K
from facetmill.llm.common import bound_batches

#: Where the vocabulary is looked for unless a path is given.
DEFAULT_MODEL = "/opt/tokenizers/word_bpe_49k.json"
#: Bytes of a text encoded at a time; stretches and fragments remembered, and the longest of them.
WINDOW, REMEMBERED, LONGEST_KEY = 1 << 20, 200_000, 64
#: Fragments of so many bytes at most are merged together with others, so many rows at a time.
SHORT, LOT_ROWS = 40, 8192
_BLANK, _ODD_SPACE = re.compile(rb"[ \t\n\r\x0b\x0c]"), re.compile(r"[^\S\n]")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves,
    the others in order from U+0100 on."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


class BpeModel:
    """Tokens, ranks of merges and forced boundaries of a vocabulary file (its JSON text)."""

    def __init__(self, text: str):
        self.text = text
        self.ready = False

    @classmethod
    def load(cls, path: str = DEFAULT_MODEL) -> BpeModel:
        with open(path, encoding="utf-8") as f:
            return cls(f.read())

    def __getstate__(self) -> dict:
        return {"text": self.text, "ready": False}

    def prepare(self) -> BpeModel:
        """The tables, built once in each process."""
        if self.ready:
            return self
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(self.text)
        spec = json.loads(self.text)
        model = spec["model"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)]
        if odd or spec.get("decoder") or model["type"] != "BPE":
            raise ValueError(f"not a vocabulary this codec reads: {odd or spec.get('decoder') or model['type']}")
        self.normalize = tokenizer.normalizer.normalize_str if tokenizer.normalizer else str
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        shape = [(x["type"], x.get("behavior"), x.get("invert"), x.get("add_prefix_space"), x.get("use_regex")) for x in steps]
        known = shape == [("Split", "Removed", True, None, None), ("ByteLevel", None, None, False, False)] and "Regex" in steps[0]["pattern"]
        self.pattern = regex.compile(steps[0]["pattern"]["Regex"]) if known else None
        self.split = tokenizer.pre_tokenizer.pre_tokenize_str
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("added tokens with conditions are not supported")
        by_length = sorted(self.special, key=len, reverse=True)
        self.special_at = re.compile("(" + "|".join(map(re.escape, by_length)) + ")") if by_length else re.compile("(?!)")
        vocab, self.end = model["vocab"], model.get("end_of_word_suffix") or ""
        self.tokens = [""] * (max([*vocab.values(), *self.special.values()], default=-1) + 1)
        for t, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = t
        letters = _byte_letters()
        byte_of = {c: b for b, c in letters.items()}
        # A symbol is a byte, or 256 + a byte that ends a word.
        symbol_ids = [vocab.get(letters[b]) for b in range(256)] + [vocab.get(letters[b] + self.end) for b in range(256)]
        if None in symbol_ids:
            raise ValueError("the vocabulary lacks single bytes")
        self.symbol_ids = np.array(symbol_ids, np.int64)
        self.byte_of = np.zeros(0x200, np.int64)
        for c, b in byte_of.items():
            self.byte_of[ord(c)] = b
        self.forced = np.ones((256, 512), bool)
        for t in vocab:
            ends = bool(self.end) and t.endswith(self.end) and t != self.end
            try:
                s = np.array([byte_of[c] for c in (t[: -len(self.end)] if ends else t)], np.int64)
            except KeyError:  # a token that no bytes make
                continue
            follows = s[1:].copy()
            if ends and len(follows):
                follows[-1] += 256
            self.forced[s[:-1], follows] = False
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a], vocab[b]] = rank, vocab[a + b]
        keys = np.array([a * len(self.tokens) + b for a, b in self.merges] or [-1], np.int64)
        found = np.array(list(self.merges.values()) or [(0, 0)], np.int64)
        order = np.argsort(keys)
        self.pairs, self.ranks, self.made, self.never = keys[order], found[order, 0], found[order, 1], len(self.merges) + 1
        self.fragments: dict[str, bytes] = {}
        self.stretches: dict[bytes, bytes] = {}
        self.ready = True
        return self

    def look_up(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of pairs of ids (``never`` where they don't merge), and what they merge into."""
        key = np.where((a >= 0) & (b >= 0), a * len(self.tokens) + b, -2)
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.ranks[at], self.never), self.made[at]


def merge(fragment: str, model: BpeModel) -> list[int]:
    """Ids of one fragment of any length: the pair of the least rank is merged first, the leftmost of
    equal ones."""
    ids = model.symbol_ids[[ord(c) for c in fragment]].tolist()
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    queue = [(found[0], i, found[1], ids[i], ids[i + 1]) for i in range(n - 1) if (found := model.merges.get((ids[i], ids[i + 1])))]
    heapq.heapify(queue)
    while queue:
        _, i, new, a, b = heapq.heappop(queue)
        j = after[i]
        if ids[i] != a or j >= n or ids[j] != b:
            continue
        ids[i], ids[j], after[i] = new, -1, after[j]
        if after[j] < n:
            before[after[j]] = i
            if found := model.merges.get((new, ids[after[j]])):
                heapq.heappush(queue, (found[0], i, found[1], new, ids[after[j]]))
        if before[i] >= 0 and (found := model.merges.get((ids[before[i]], new))):
            heapq.heappush(queue, (found[0], before[i], found[1], ids[before[i]], new))
    return [x for x in ids if x >= 0]


def merge_short(lot: list[str], model: BpeModel) -> list[bytes]:
    """As ``merge``, of many fragments of about one length at a time: a row each, a merge in each row a
    step, so only the two pairs beside a merge are looked up anew."""
    size = np.array([len(f) for f in lot])
    width, row = int(size.max()), np.arange(len(lot))
    ids = np.full((len(lot), width + 2), -1, np.int64)
    ids[:, :width][np.arange(width) < size[:, None]] = model.symbol_ids[np.frombuffer("".join(lot).encode("utf-16-le"), np.uint16)]
    rank, new = model.look_up(ids[:, :width], ids[:, 1 : width + 1])
    column = np.arange(width + 2)
    live = row
    while len(live):
        at = rank[live].argmin(1)
        some = rank[live, at] < model.never
        live, at = live[some], at[some]
        if not len(live):
            break
        made = new[live, at]
        drop = column[None, : width + 1] + (column[None, : width + 1] > at[:, None])
        ids[live, : width + 1] = np.take_along_axis(ids[live], drop, 1)
        ids[live, at] = made
        # Ranks and products of pairs: the merged one goes, those behind move up.
        move = drop[:, : width - 1]
        rank[live, : width - 1] = np.take_along_axis(rank[live], move, 1)
        new[live, : width - 1] = np.take_along_axis(new[live], move, 1)
        rank[live, width - 1] = model.never
        for k in (at, at - 1):
            ok = k >= 0
            r, k = live[ok], k[ok]
            rank[r, k], new[r, k] = model.look_up(ids[r, k], ids[r, k + 1])
    ids = ids.astype(np.int32)
    count = (ids >= 0).sum(1).tolist()
    return [ids[i, :n].tobytes() for i, n in enumerate(count)]


def fragments(symbols: np.ndarray, ends: np.ndarray, model: BpeModel) -> tuple[list[str], np.ndarray]:
    """Words (bytes end to end, and where each ends), cut at their forced boundaries, and the word each
    fragment is of. A letter of a fragment is a symbol: a byte, or 256 + a byte that ends a word."""
    follows = symbols.copy()
    if model.end:
        follows[ends - 1] += 256
    cut = np.ones(len(symbols), bool)
    cut[1:] = model.forced[symbols[:-1], follows[1:]]
    cut[ends[:-1]] = True
    start = np.flatnonzero(cut)
    text = follows.astype(np.uint16).tobytes().decode("utf-16-le")
    bounds = [*start.tolist(), len(text)]
    return [text[s:e] for s, e in zip(bounds, bounds[1:])], np.searchsorted(ends, start, side="right")


def _words(norm: str, model: BpeModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the words of a normalised text end to end, where each ends there, and its place in the
    text. In ASCII, where all Unicode tables agree, the file's pattern is run by ``regex``."""
    if model.pattern is not None and norm.isascii():
        spans = np.array([m.span() for m in model.pattern.finditer(norm)], np.int64).reshape(-1, 2)
        size = spans[:, 1] - spans[:, 0]
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(spans[:, 0] - (ends - size), size)
        return np.frombuffer(norm.encode(), np.uint8)[at].astype(np.int64), ends, spans[:, 0]
    split = model.split(norm)
    words, places = zip(*split) if split else ((), ())
    size = np.fromiter(map(len, words), np.int64, len(words))
    symbols = model.byte_of[np.frombuffer("".join(words).encode("utf-16-le"), np.uint16)]
    return symbols, np.cumsum(size), np.fromiter((a for a, _ in places), np.int64, len(places))


def _fragment_ids(found: list[str], model: BpeModel) -> list[bytes]:
    """Ids of each fragment, as 32-bit integers; new ones are encoded and remembered."""
    known = model.fragments
    fresh = [f for f in dict.fromkeys(found) if f not in known]
    if len(known) + len(fresh) > REMEMBERED:
        known.clear()
        fresh = list(dict.fromkeys(found))
    short = sorted((f for f in fresh if len(f) <= SHORT), key=len)
    at = 0
    while at < len(short):  # rows of like length together, so that few cells are empty
        lot = short[at : at + LOT_ROWS]
        lot = [f for f in lot if len(f) <= 2 * len(lot[0])]
        known.update(zip(lot, merge_short(lot, model)))
        at += len(lot)
    for f in fresh:
        if len(f) > SHORT:
            known[f] = np.array(merge(f, model), np.int32).tobytes()
    ids = list(map(known.__getitem__, found))
    for f in fresh:
        if len(f) > LONGEST_KEY:
            del known[f]
    return ids


def _encode_parts(parts: list[str], joined: str, model: BpeModel) -> list[bytes]:
    """Ids of texts without blanks and special tokens; ``joined`` by line ends, they are normalised and
    split in one call."""
    norm = model.normalize(joined)
    blanks = np.flatnonzero(np.frombuffer(norm.encode("utf-32-le", "surrogatepass"), np.uint32) == 32)
    if len(parts) > 1 and (_ODD_SPACE.search(joined) or len(blanks) != len(parts) - 1):
        # White space beside the blanks: such texts are split one by one.
        odd = [bool(_ODD_SPACE.search(p)) for p in parts]
        if not any(odd) or len(parts) == sum(odd):
            return [_encode_parts([p], p, model)[0] for p in parts]
        rest = [p for p, o in zip(parts, odd) if not o]
        plain = iter(_encode_parts(rest, "\n".join(rest), model))
        return [_encode_parts([p], p, model)[0] if o else next(plain) for p, o in zip(parts, odd)]
    symbols, ends, places = _words(norm, model)
    if not len(ends):
        return [b""] * len(parts)
    of = np.searchsorted(blanks, places) if len(parts) > 1 else np.zeros(len(ends), np.int64)
    found, word = fragments(symbols, ends, model)
    ids = _fragment_ids(found, model)
    size = np.bincount(of[word], weights=np.fromiter(map(len, ids), np.int64, len(ids)), minlength=len(parts)).astype(np.int64)
    bounds, flat = np.concatenate([[0], np.cumsum(size)]).tolist(), b"".join(ids)
    return [flat[s:e] for s, e in zip(bounds, bounds[1:])]


def _encode_stretches(stretches: list[bytes], model: BpeModel) -> list[bytes]:
    """Ids, as 32-bit integers, of stretches without blanks."""
    if not stretches:
        return []
    joined = b"\n".join(stretches).decode("utf-8", "replace")
    if not model.special_at.search(joined):
        parts = joined.split("\n")
        if joined.isascii():
            return _encode_parts(parts, joined, model)
        groups = [p for p in parts if p.isascii()], [p for p in parts if not p.isascii()]
        plain, other = (iter(_encode_parts(g, "\n".join(g), model) if g else ()) for g in groups)
        return [next(plain) if p.isascii() else next(other) for p in parts]
    parts, pattern = [], []  # of each stretch: numbers of parts, or ids of special tokens
    for text in joined.split("\n"):
        if not model.special_at.search(text):
            pattern.append((len(parts),))
            parts.append(text)
            continue
        own = []
        for k, p in enumerate(model.special_at.split(text)):
            if k % 2:
                own.append(np.int32(model.special[p]).tobytes())
            elif p:
                own.append(len(parts))
                parts.append(p)
        pattern.append(own)
    ids = _encode_parts(parts, "\n".join(parts), model) if parts else []
    return [b"".join(x if isinstance(x, bytes) else ids[x] for x in own) for own in pattern]


def _windows(text: bytes, window: int) -> Iterator[bytes]:
    at = 0
    while at < len(text):
        blank = _BLANK.search(text, at + window)
        end = blank.end() if blank else len(text)
        yield text[at:end]
        at = end


def encode_texts(texts: list[bytes], model: BpeModel, window: int = WINDOW) -> list[bytes]:
    """Ids of each text, as 32-bit integers. Texts, and windows of long ones, are taken together up to
    about ``window`` bytes."""
    out: list[list[bytes]] = [[] for _ in texts]
    held: list[tuple[int, list[bytes]]] = []
    size = 0

    def flush() -> None:
        known = model.stretches
        met = dict.fromkeys(s for _, stretches in held for s in stretches)
        fresh = [s for s in met if s not in known]
        if len(known) + len(fresh) > REMEMBERED:
            known.clear()
            fresh = list(met)
        known.update(zip(fresh, _encode_stretches(fresh, model)))
        for i, stretches in held:
            out[i].append(b"".join(map(known.__getitem__, stretches)))
        for s in fresh:
            if len(s) > LONGEST_KEY:
                del known[s]
        held.clear()

    for i, text in enumerate(texts):
        for part in _windows(text, window):
            held.append((i, part.split()))
            size += len(part)
            if size >= window:
                flush()
                size = 0
    flush()
    return list(map(b"".join, out))


def _names(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)


def encode(docs: DataFrame, model: BpeModel, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (array<int>)."""
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # bounded by the vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value.prepare()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary()).to_pylist()
            found = encode_texts([t or b"" for t in texts], model)
            number, null = [len(x) // 4 for x in found], [t is None for t in texts]
            offsets = pa.array(np.concatenate([[0], np.cumsum(number)]).astype(np.int32), pa.int32(), mask=np.array([*null, False]))
            ids = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(found), np.int32), pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], [*batch.schema.names, "ids"])
        K.release()

    rows = docs.drop("ids")
    return rows.mapInArrow(run, _names(rows) + ", ids array<int>")


def decode(encoded: DataFrame, model: BpeModel, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``, the text of its ids, special tokens included."""
    spark = encoded.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = shared.value.prepare().tokens
        known = range(len(tokens))
        for batch in batches:
            texts = []
            for x in batch.column(batch.schema.get_field_index(ids)):
                values = x.values
                if values is None:
                    texts.append(None)
                    continue
                a = values.fill_null(-1).to_numpy(zero_copy_only=False)
                if len(a) and (a.min() < 0 or a.max() >= len(tokens)):
                    a = [i for i in a.tolist() if i in known and tokens[i]]
                else:
                    a = a.tolist()
                texts.append(" ".join(map(tokens.__getitem__, a)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])
        K.release()

    rows = encoded.drop("decoded")
    return rows.mapInArrow(run, _names(rows) + ", decoded string")


def codec_report(docs: DataFrame, model: BpeModel, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``n_tokens``, and digests of the ids and of the decoded text, of every row."""
    rows = encode(docs.select(F.col(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")), model).drop("text")
    out = decode(rows, model)
    digest = lambda c: F.sha2(c, 256)
    return out.select(key, F.size("ids").cast("long").alias("n_tokens"), digest(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256"))
