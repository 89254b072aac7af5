"""NumPy kernels over the UTF-8 buffers of Arrow string columns.

All kernels work on one batch: ``buf`` holds the texts end to end and ``offs`` their bounds, so no
Python string is made per document or word.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C55)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` once A-Z are lower-cased.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x41:0x5B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0..n and their inverses modulo 2**64."""
    if len(_powers.get("up", ())) <= n:
        size = max(1 << 16, 1 << int(n + 1).bit_length())
        for name, base in (("up", int(_BASE)), ("down", pow(int(_BASE), -1, 1 << 64))):
            a = np.full(size, np.uint64(base))
            a[0] = 1
            _powers[name] = np.multiply.accumulate(a)
    return _powers["up"][: n + 1], _powers["down"][: n + 1]


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """p with p[e] - p[s] the polynomial of buf[s:e], shifted by s."""
    up, _ = powers(len(buf))
    p = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=p[1:])
    return p


def span_hash(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(p) - 1)
    return mix((p[end] - p[start]) * down[start] + (end - start).astype(np.uint64) * _MIX2)


def release() -> None:
    """Give freed memory back to the system: workers live on between stages and share a machine's
    memory with the JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def column(batch: pa.RecordBatch, name: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    a = batch.column(batch.schema.get_field_index(name))
    if a.null_count:
        a = a.fill_null("")
    if pa.types.is_large_string(a.type):
        kind = np.int64
    else:
        a, kind = a.cast(pa.string()), np.int32
    offs = np.frombuffer(a.buffers()[1], kind)[a.offset : a.offset + len(a) + 1].astype(np.int64) if len(a) else np.zeros(1, np.int64)
    data = a.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def lower_latin(buf: np.ndarray) -> np.ndarray:
    """A-Z and the capitals of Latin-1 in lower case."""
    out = LOWER[buf]
    if len(out) > 1:
        capital = (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97) & (buf[:-1] == 0xC3)
        out[1:][capital] += 0x20
    return out


def words(buf: np.ndarray, offs: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes outside ``gap``, none across texts; and, for
    each text, the index of its first word (one more entry at the end)."""
    inside = ~gap[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = offs[:-1][offs[:-1] < len(buf)]
    first[cut] |= inside[cut]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = offs[1:][offs[1:] > 0] - 1
    last[cut] |= inside[cut]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, offs)


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the windows of k consecutive word hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = (out + h[j : j + n]) * _BASE
    return mix(out)
