"""Array code on the UTF-8 bytes of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that array code takes at once: its arrays have 8 bytes for each, and workers keep what they once took.
AT_ONCE = 1 << 18
#: Bytes 0x20 and 0x09 to 0x0D separate words.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd constant and of its inverse modulo 2**64; kept up to a few MB."""
    have = _POWERS.get("p")
    if have is not None and len(have) >= n:
        return have, _POWERS["i"]
    size = 1 << max(16, (n - 1).bit_length())
    base = np.full(size, _ODD, dtype=np.uint64)
    inv = np.full(size, _INV, dtype=np.uint64)
    base[0] = inv[0] = 1
    p, i = np.multiply.accumulate(base), np.multiply.accumulate(inv)
    if size <= 1 << 22:
        _POWERS["p"], _POWERS["i"] = p, i
    return p, i


def byte_table(seed: int, lower: bool = False) -> np.ndarray:
    """A random 64-bit number for each byte; with ``lower``, A-Z have those of a-z."""
    t = np.random.default_rng(seed).integers(0, 1 << 64, 256, dtype=np.uint64, endpoint=False)
    if lower:
        t[ord("A") : ord("Z") + 1] = t[ord("a") : ord("z") + 1]
    return t


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """64-bit hashes of many spans: differences of a prefix sum, moved to one origin."""
    p, inv = _powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(table[buf] * p[: len(buf)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * inv[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def span_hashes_blocked(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """:func:`span_hashes` of spans that are short against ``block``, with arrays of about that size."""
    out = np.empty(len(starts), dtype=np.uint64)
    order = np.argsort(starts, kind="stable")
    s = starts[order]
    at = 0
    while at < len(s):
        to = int(np.searchsorted(s, s[at] + block))
        own = order[at:to]
        lo, hi = int(s[at]), int(ends[own].max())
        out[own] = span_hashes(buf[lo:hi], starts[own] - lo, ends[own] - lo, table)
        at = to
    return out


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and the n + 1 offsets. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if column.type != kind:
        column = column.cast(pa.large_string()).cast(kind) if pa.types.is_string(column.type) else column.cast(kind)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = AT_ONCE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes; a longer text has a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words and, for each text, the index of its first word (n + 1 numbers)."""
    word = ~IS_SPACE[buf]
    before = np.zeros(len(buf) + 1, dtype=bool)
    before[1:] = word
    after = before[1:].copy()
    before = before[:-1].copy()
    edges = offsets[(offsets > 0) & (offsets < len(buf))]
    before[edges] = False
    nxt = np.zeros(len(buf), dtype=bool)
    nxt[:-1] = after[1:]
    nxt[edges - 1] = False
    starts = np.flatnonzero(word & ~before)
    ends = np.flatnonzero(word & ~nxt) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of range(s, s + n) for each s and n."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - first, lengths)
