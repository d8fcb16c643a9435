"""Tokenizing many texts with a word-level BPE vocabulary, with array code for plain units.

The vocabulary lower-cases, drops white space and cuts words into letter runs,
single digits and runs of other symbols; each such unit is encoded by itself.
Plain units (ASCII and the accented letters of Latin-1, no apostrophe) are encoded
here, all units of one length together: in each round every unit merges its pair
of lowest rank, leftmost first, which is the order of the library. Words with any
other character go to the library. A direct-mapped cache keeps the ids of units;
an entry is replaced when another unit needs its place, so memory is fixed.
"""

from __future__ import annotations

import json

import numpy as np

from ._bytes import byte_table, ranges, span_hashes, word_spans

_NONE = np.iinfo(np.int32).max
_WIDTH, _BITS = 12, 21
_LOADED: dict[str, WordBpe] = {}

_LETTER, _DIGIT, _SYMBOL, _SPACE, _OTHER = range(5)


def _byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself if printable, else the next code point from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in shown else next(rest)) for b in range(256)]


def load(path: str) -> WordBpe:
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


class WordBpe:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        names = _byte_symbols()
        self.symbol = np.array([vocab[c] for c in names], dtype=np.int64)
        self.last_symbol = np.array([vocab[c + suffix] for c in names], dtype=np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], dtype=np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self._hash_pairs(keys)
        self._classes()
        self.table = byte_table(71)
        self.key = np.zeros(1 << _BITS, dtype=np.uint64)
        self.count = np.zeros(1 << _BITS, dtype=np.uint8)
        self.kept = np.zeros((1 << _BITS, _WIDTH), dtype=np.uint16)

    def _hash_pairs(self, keys: np.ndarray) -> None:
        """Open addressing; lookups probe as often as the longest chain needs."""
        self.bits = 18
        slots = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)
        self.pair_key = np.full(1 << self.bits, -1, dtype=np.int64)
        self.pair_rank = np.full(1 << self.bits, _NONE, dtype=np.int32)
        self.probes = 1
        for rank, (key, slot) in enumerate(zip(keys.tolist(), slots.tolist(), strict=True)):
            tries = 1
            while self.pair_key[slot] >= 0:
                slot, tries = (slot + 1) & ((1 << self.bits) - 1), tries + 1
            self.pair_key[slot], self.pair_rank[slot] = key, rank
            self.probes = max(self.probes, tries)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << 20 | b).ravel()
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        found = self.pair_key[slot]
        out = np.where(found == key, self.pair_rank[slot], _NONE)
        open_ = np.flatnonzero((found != key) & (found >= 0))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            found = self.pair_key[slot[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.pair_rank[slot[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out.reshape(a.shape)

    def _classes(self) -> None:
        kind = np.full(256, _OTHER, dtype=np.uint8)
        kind[33:127] = _SYMBOL
        for lo, hi, k in (("a", "z", _LETTER), ("A", "Z", _LETTER), ("0", "9", _DIGIT)):
            kind[ord(lo) : ord(hi) + 1] = k
        kind[ord("'")] = _OTHER  # contractions are the library's
        kind[[0x20, *range(0x09, 0x0E)]] = _SPACE
        self.kind = kind
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32

    def _units(self, buf: np.ndarray, offsets: np.ndarray):
        """Lower-cased bytes; starts, ends and plainness of the units; first unit of each text."""
        kind, low = self.kind[buf], self.lower[buf]
        lead = np.flatnonzero(buf[:-1] == 0xC3) if len(buf) else np.zeros(0, np.int64)
        second = buf[lead + 1]
        upper = (second >= 0x80) & (second <= 0x9E) & (second != 0x97)
        low[lead[upper] + 1] += 0x20
        fine = (second != 0x97) & (second != 0xB7)
        kind[lead[fine]] = kind[lead[fine] + 1] = _LETTER
        ws, we, first = word_spans(buf, offsets)
        odd = np.zeros(len(buf) + 1, dtype=np.int64)
        np.cumsum(kind == _OTHER, out=odd[1:])
        foreign = odd[we] > odd[ws]
        # a special token's text must reach the library whole
        marks = np.flatnonzero((buf[:-1] == ord("<")) & (buf[1:] == ord("|"))) if len(buf) > 1 else np.zeros(0, np.int64)
        if len(marks):
            foreign[np.unique(np.searchsorted(ws, marks, side="right") - 1)] = True
        cut = np.zeros(len(buf) + 1, dtype=bool)
        if len(buf) > 1:
            cut[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        for s, e in zip(ws[foreign].tolist(), we[foreign].tolist(), strict=True):
            cut[s + 1 : e] = False
        cut[ws] = cut[we] = True
        starts = np.flatnonzero(cut[:-1] & (self.kind[buf] != _SPACE)) if len(buf) else np.zeros(0, np.int64)
        marks = np.flatnonzero(cut)
        ends = marks[np.searchsorted(marks, starts, side="right")] if len(starts) else starts
        plain = np.ones(len(starts), dtype=bool)
        if foreign.any():
            plain[np.isin(starts, ws[foreign])] = False
        return low, starts, ends, plain, np.searchsorted(starts, offsets)

    def _encode_plain(self, rows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Rows of bytes of one length -> (row numbers, ids) for each number of ids."""
        out, at = [], np.arange(len(rows))
        s = self.symbol[rows]
        s[:, -1] = self.last_symbol[rows[:, -1]]
        ranks = self._ranks(s[:, :-1], s[:, 1:])
        while s.shape[1] > 1:
            j = ranks.argmin(axis=1)
            i = np.arange(len(s))
            best = ranks[i, j]
            done = best == _NONE
            if done.any():
                out.append((at[done], s[done]))
                go = ~done
                if not go.any():
                    return out
                at, s, ranks, j, best = at[go], s[go], ranks[go], j[go], best[go]
                i = np.arange(len(s))
            s[i, j] = self.merged[best]
            column = np.arange(s.shape[1] - 1)[None, :]
            s = np.take_along_axis(s, column + (column > j[:, None]), axis=1)
            n = s.shape[1]
            if n == 1:
                break
            column = column[:, : n - 1]
            ranks = np.take_along_axis(ranks, column + (column >= j[:, None]), axis=1)
            left = np.flatnonzero(j > 0)
            ranks[left, j[left] - 1] = self._ranks(s[left, j[left] - 1], s[left, j[left]])
            right = np.flatnonzero(j < n - 1)
            ranks[right, j[right]] = self._ranks(s[right, j[right]], s[right, j[right] + 1])
        out.append((at, s))
        return out

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and n + 1 offsets."""
        low, starts, ends, plain, first = self._units(buf, offsets)
        if not len(starts):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(offsets), dtype=np.int64)
        h = span_hashes(low, starts, ends, self.table)
        if not plain.all():  # case and normal form are the library's there
            f = ~plain
            h[f] = span_hashes(buf, starts[f], ends[f], self.table) ^ np.uint64(0x5555555555555555)
        h |= np.uint64(1)
        slot = (h >> np.uint64(64 - _BITS)).astype(np.int64)
        hit = self.key[slot] == h
        lens = self.count[slot].astype(np.int64)
        todo = np.flatnonzero(~hit)
        if len(todo):
            _, one, back = np.unique(h[todo], return_index=True, return_inverse=True)
            pick = todo[one]
            ids, n = self._encode_new(buf, low, starts[pick], ends[pick], plain[pick])
            lens[todo] = n[back]
            begin = (np.cumsum(n) - n)[back]
        at = np.cumsum(lens) - lens
        out = np.empty(int(lens.sum()), dtype=np.uint32)
        known = np.flatnonzero(hit)
        for k in range(int(lens[known].max()) if len(known) else 0):
            known = known[lens[known] > k]
            out[at[known] + k] = self.kept[slot[known], k]
        if len(todo):
            out[ranges(at[todo], lens[todo])] = ids[ranges(begin, lens[todo])]
            small = n <= _WIDTH
            where, nn = slot[pick[small]], n[small]
            base = (np.cumsum(n) - n)[small]
            # of several units for one slot the last written counts: write each row whole
            last = np.unique(where[::-1], return_index=True)[1]
            last = len(where) - 1 - last
            where, nn, base = where[last], nn[last], base[last]
            self.key[where], self.count[where] = h[pick[small]][last], nn
            for k in range(int(nn.max()) if len(nn) else 0):
                more = nn > k
                self.kept[where[more], k] = ids[base[more] + k]
        total = np.concatenate([[0], np.cumsum(lens)])
        return out, total[first]

    def _encode_new(self, buf, low, starts, ends, plain) -> tuple[np.ndarray, np.ndarray]:
        size = ends - starts
        n = np.zeros(len(starts), dtype=np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        short = plain & (size <= 64)
        for length in np.unique(size[short]).tolist():
            rows = np.flatnonzero(short & (size == length))
            for block in range(0, len(rows), 20_000):
                own = rows[block : block + 20_000]
                for r, ids in self._encode_plain(low[starts[own][:, None] + np.arange(length)]):
                    n[own[r]] = ids.shape[1]
                    parts.append((own[r], ids))
        rest = np.flatnonzero(~short)
        if len(rest):
            texts = [buf[s:e].tobytes().decode("utf-8", "replace") for s, e in zip(starts[rest].tolist(), ends[rest].tolist(), strict=True)]
            for i, e in zip(rest.tolist(), self.library.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                got = np.array(e.ids, dtype=np.int64)[None, :]
                n[i] = got.shape[1]
                parts.append((np.array([i]), got))
        begin = np.cumsum(n) - n
        out = np.empty(int(n.sum()), dtype=np.uint32)
        for r, ids in parts:
            if ids.shape[1]:
                out[begin[r][:, None] + np.arange(ids.shape[1])] = ids
        return out, n
