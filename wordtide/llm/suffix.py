"""Removal of repeated passages with suffix arrays sorted in two stages.

A byte goes if it lies in a string of ``length`` bytes that also starts in a document
with a smaller id. Work is dealt so that equal strings meet in one task:

1. Every string of ``length`` bytes has an anchor, the leftmost of its grams (16
   bytes) with the least hash, which depends on the string alone. Strings that start
   one after the other and share their anchor form a run; its bytes are its context.
   Tasks for ranges of anchor hashes find the anchors that occur in two documents.
2. Contexts of such anchors go to tasks by anchor. There they become one text whose
   suffixes are sorted in two stages: suffixes smaller than their successors directly,
   the others induced by scanning the buckets of first bytes from the least to the
   largest. Neighbours in the suffix array whose common prefix reaches ``length`` are
   equal strings; all but those of the smallest id are marked.
3. The marks come back to the documents.

Copies within one batch of rows are told apart before any shuffle: of equal contexts
only those of the smallest id are sent, the others are marked at once, so a passage
that very many documents hold adds one context for each batch. Where an anchor has very
many holders, as the edges of a very common line have, a run is cut further: strings
go to tasks by the eight-byte steps around the anchor that they cover, so contexts part
where the texts around the line do. At most ``hot_keys`` anchors can have so many
holders, since all documents together hold no more anchors than bytes; that bounds what
is broadcast.

Defined cases: null is empty; texts shorter than ``length`` keep everything; rows with
one id never remove from each other; null ids count as smaller than all others and are
told apart by a hash of their text; repeated rows get equal results; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import byte_table, chunks, ranges, span_hashes_blocked, utf8
from ._common import partitions, ship, text_of, written

_TABLE = byte_table(91)
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_LOW48 = np.uint64((1 << 48) - 1)
_POSITION = np.uint64((1 << 20) - 1)
GRAM = 16
#: Rows without an id get numbers from here down, by a hash of their text.
NAMELESS = -(1 << 62)
#: Steps by which strings of a hot anchor part, and holders that make an anchor hot.
STEP, HOT = 8, 131_072


# ---- suffix arrays


def _words(buf: np.ndarray) -> np.ndarray:
    """At each place, the next eight bytes as a big-endian number (zeros after the end)."""
    w = np.concatenate([buf, np.zeros(8, dtype=np.uint8)]).astype(np.uint64)
    for step in (1, 2, 4):
        w = (w[:-step] << np.uint64(8 * step)) | w[step:]
    return w[: len(buf)]


def _direct(words: np.ndarray, at: np.ndarray, end: np.ndarray, depth: int) -> np.ndarray:
    """``at`` ordered by the first ``depth`` bytes of the suffixes, eight at a time; only ties go on."""
    order = np.argsort(words[at], kind="stable")
    at, end = at[order], end[order]
    first = words[at]
    same = np.zeros(len(at) + 1, dtype=bool)
    same[1:-1] = first[1:] == first[:-1]
    for skip in range(8, depth, 8):
        tied = np.flatnonzero(same[:-1] | same[1:])
        if not len(tied):
            break
        run = np.cumsum(~same[:-1][tied])
        key = words[np.minimum(at[tied] + skip, end[tied])]
        order = np.lexsort((key, run))
        at[tied], end[tied] = at[tied][order], end[tied][order]
        key = key[order]
        split = np.zeros(len(tied), dtype=bool)
        split[1:] = key[1:] != key[:-1]
        same[tied] &= ~split
    return at


def two_stage_sort(buf: np.ndarray, begin: np.ndarray, end: np.ndarray, count: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``count`` suffixes of each text buf[begin:end], ordered to ``depth`` bytes.

    buf[end] must exist and be zero for eight bytes. Suffixes smaller than their
    successors are sorted directly. Each other suffix follows its successor: when the
    scan of the buckets meets a suffix, the one before it goes to the next free place of
    its bucket. Suffixes after the first ``count`` take part up to the next one that is
    sorted directly, from where order can be induced. Returns the order and the words.
    """
    n = len(buf)
    words = _words(buf)
    last = np.zeros(n, dtype=bool)
    last[end - 1] = True
    turn = last.copy()
    turn[:-1] |= buf[:-1] != buf[1:]
    ascending = np.zeros(n, dtype=bool)
    ascending[:-1] = (buf[:-1] < buf[1:]) & ~last[:-1]
    turns = np.flatnonzero(turn)
    # within a run of equal bytes all suffixes are of the kind of the run's end
    up = np.repeat(ascending[turns], np.diff(turns, prepend=-1))
    up = np.concatenate([up, np.zeros(n - len(up), dtype=bool)])
    # suffixes beyond the asked ones, up to one that is sorted directly or the text's end
    ups = np.append(np.flatnonzero(up), n)
    reach = np.minimum(ups[np.searchsorted(ups, begin + count - 1)], end - 1) - begin + 1
    mine = ranges(begin, reach)
    stop = np.repeat(end, reach)
    direct = up[mine]
    ordered = _direct(words, mine[direct], stop[direct], depth)
    heads = np.zeros(n + 1, dtype=bool)
    heads[begin] = True
    edges = np.searchsorted(buf[ordered], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]

    def induce(found: np.ndarray, c: int) -> np.ndarray:
        """Hands the predecessors with larger bytes to their buckets; returns those with the same byte."""
        before = found[~heads[found]] - 1
        byte = buf[before]
        bigger = byte > c
        same = before[byte == c]
        before, byte = before[bigger], byte[bigger]
        if not len(byte):
            return same
        order = np.argsort(byte, kind="stable")
        before, byte = before[order], byte[order]
        cuts = np.flatnonzero(np.diff(byte.astype(np.int16), prepend=-1))
        for lo, hi in zip(cuts, np.append(cuts[1:], len(byte)), strict=True):
            waiting[int(byte[lo])].append(before[lo:hi])
        return same

    seeds = begin + reach - 1
    seeds = seeds[~up[seeds]]  # one byte before the end of its text: the empty suffix comes first of all
    order = np.argsort(buf[seeds], kind="stable")
    seeds = seeds[order]
    for c in np.unique(buf[seeds]).tolist():
        waiting[c].append(seeds[buf[seeds] == c])
    out: list[np.ndarray] = []
    for c in range(256):
        part = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, dtype=np.int64)
        waiting[c] = []
        while len(part):  # descending suffixes, then those that they induce in the same bucket
            out.append(part)
            part = induce(part, c)
        part = ordered[edges[c] : edges[c + 1]]
        if len(part):
            out.append(part)
            induce(part, c)
    return (np.concatenate(out) if out else np.zeros(0, dtype=np.int64)), words


def reaches(words: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each suffix but the first: whether its common prefix with the one before reaches ``length``."""
    same = np.ones(max(0, len(order) - 1), dtype=bool)
    for skip in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        live = np.flatnonzero(same)
        same[live] = words[order[live] + skip] == words[order[live + 1] + skip]
    return same


# ---- anchors


def _gram_hashes(buf: np.ndarray) -> np.ndarray:
    h, size = _TABLE[buf], 1
    while size < GRAM:
        h = h[:-size] * np.uint64(pow(_BASE, size, 1 << 64)) + h[size:]
        size *= 2
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def anchor_runs(buf: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last start of each run of strings with one anchor, the anchor's hash and its place."""
    found = []
    for i, j in chunks(offsets, 900_000):
        lo, hi = int(offsets[i]), int(offsets[j])
        # a text too long for one piece is read in pieces that overlap by length - 1
        for at in range(lo, max(hi, lo + 1), 900_000 if j - i == 1 else max(1, hi - lo)):
            stop = min(hi, at + 900_000 + length - 1) if j - i == 1 else hi
            if stop - at < length:
                continue
            h = _gram_hashes(buf[at:stop])
            m = (h & ~_POSITION) | np.arange(len(h), dtype=np.uint64)
            grams, step = length - GRAM + 1, 1
            while 2 * step <= grams:
                m = np.minimum(m[:-step], m[step:])
                step *= 2
            if step < grams:
                m = np.minimum(m[: len(m) - (grams - step)], m[grams - step :])
            anchor = (m & _POSITION).astype(np.int64)
            last = np.repeat(offsets[i + 1 : j + 1], np.diff(offsets[i : j + 1]))[at - lo : at - lo + len(anchor)] - at
            start = np.flatnonzero(np.arange(len(anchor)) + length <= last)
            if not len(start):
                continue
            anchor = anchor[start]
            new = np.ones(len(start), dtype=bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
            first = np.flatnonzero(new)
            final = np.append(first[1:], len(start)) - 1
            found.append((start[first] + at, start[final] + at, h[anchor[first]], anchor[first] + at))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def by_steps(first: np.ndarray, last: np.ndarray, anchor: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cuts runs where their strings cover other eight-byte steps around the anchor.

    Returns the run, first and last start of each part, and begin and end of the bytes that all its strings
    cover. Equal strings hold the anchor at one place, so they cover equal bytes.
    """
    n = last - first + 1
    run = np.repeat(np.arange(len(first)), n)
    start = ranges(first, n)
    place = anchor[run]
    left, right = (place - start) // STEP, (start + length - place - GRAM) // STEP
    new = np.ones(len(start), dtype=bool)
    new[1:] = (run[1:] != run[:-1]) | (left[1:] != left[:-1]) | (right[1:] != right[:-1])
    at = np.flatnonzero(new)
    final = np.append(at[1:], len(start)) - 1
    return run[at], start[at], start[final], place[at] - left[at] * STEP, place[at] + GRAM + right[at] * STEP


# ---- blocks of numbers in binary columns


def _blobs(data: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """data[cuts[i]:cuts[i + 1]] as binary values, without a copy for each."""
    raw = np.ascontiguousarray(data)
    width = raw.dtype.itemsize * (raw.shape[1] if raw.ndim > 1 else 1)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((np.asarray(cuts) * width).astype(np.int32)), pa.py_buffer(raw)])


def _joined(column: pa.ChunkedArray | pa.Array, dtype) -> np.ndarray:
    return utf8(column)[0].copy().view(dtype)


def _runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, and the end."""
    return np.concatenate([[0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1, [len(sorted_keys)]]) if len(sorted_keys) else np.zeros(1, np.int64)


_ANCHORS = "part long, own boolean, doc_id long, grams binary, docs binary, times binary"


def _find_anchors(length: int, parts: int, kind: str, several_docs: int):
    """Of each batch: its anchors by part of the hash range (unique in the batch, with their document
    or ``several_docs`` and how many hold it), and by document the anchors that several documents of the batch have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            buf, offsets = utf8(batch.column(1))
            first, _, h, _ = anchor_runs(buf, offsets, length)
            if not len(h):
                continue
            doc = np.searchsorted(offsets, first, side="right") - 1
            order = np.argsort(h, kind="stable")
            h, doc = h[order], doc[order]
            cuts = _runs(h)
            several = np.minimum.reduceat(doc, cuts[:-1]) != np.maximum.reduceat(doc, cuts[:-1])
            one = h[cuts[:-1]]
            holder = np.where(several, several_docs, ids[doc[cuts[:-1]]]).astype(kind)
            part = ((one >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            by = _runs(part)
            grams = one.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
            times = np.diff(cuts)[several].astype("<u4")
            by_times = np.concatenate([[0], np.cumsum(several)])[by]
            yield _block(part[by[:-1]], None, _blobs(grams, by), _blobs(holder, by), _blobs(times, by_times))
            known = np.repeat(several, np.diff(cuts))
            doc, h = doc[known], h[known] & _LOW48
            order = np.lexsort((h, doc))
            doc, h = doc[order], h[order]
            by = _runs(doc)
            if len(by) > 1:
                own = ids[doc[by[:-1]]]
                yield _block(own % parts, own, _blobs(h, by), None, None)

    def _block(part, own, grams, docs, times) -> pa.RecordBatch:
        n = len(part)
        columns = [
            pa.array(part.astype(np.int64)),
            pa.array(np.full(n, own is not None)),
            pa.nulls(n, pa.int64()) if own is None else pa.array(own),
            grams,
            pa.nulls(n, pa.binary()) if docs is None else docs,
            pa.nulls(n, pa.binary()) if times is None else times,
        ]
        return pa.RecordBatch.from_arrays(columns, names=["part", "own", "doc_id", "grams", "docs", "times"])

    return run


_CANDIDATES = "doc_id long, grams binary, hot boolean"


def _shared_anchors(kind: str, several_docs: int, hot_above: int):
    """Of one part: the anchors of two or more documents, by document, and the hot ones."""
    schema = pa.schema([("doc_id", pa.int64()), ("grams", pa.binary()), ("hot", pa.bool_())])

    def run(table: pa.Table) -> pa.Table:
        own = table.filter(table.column("own"))
        out = [pa.table([own.column("doc_id"), own.column("grams"), pa.array(np.zeros(len(own), bool))], schema=schema)]
        rest = table.filter(pa.array(~table.column("own").to_numpy()))
        if len(rest):
            raw = _joined(rest.column("grams"), np.uint8).reshape(-1, 6)
            h = np.zeros((len(raw), 8), dtype=np.uint8)
            h[:, :6] = raw
            h = h.view("<u8").reshape(-1)
            docs = _joined(rest.column("docs"), kind)
            held = np.ones(len(docs), dtype=np.int64)
            held[docs == several_docs] = _joined(rest.column("times"), "<u4")
            order = np.argsort(h, kind="stable")
            h, docs, held = h[order], docs[order], held[order]
            cuts = _runs(h)
            times = np.diff(cuts)
            hit = (times > 1) | np.logical_or.reduceat(docs == several_docs, cuts[:-1])
            hot = h[cuts[:-1]][np.add.reduceat(held, cuts[:-1]) > hot_above]
            keep = np.repeat(hit, times) & (docs != several_docs)
            h, docs = h[keep], docs[keep].astype(np.int64)
            n = len(h)  # a row for each anchor: rows by document and part would grow with their product
            if n:
                out.append(pa.table([pa.array(docs), _blobs(h, np.arange(n + 1)), pa.array(np.zeros(n, bool))], schema=schema))
            if len(hot):
                out.append(pa.table([pa.nulls(1, pa.int64()), _blobs(hot, np.array([0, len(hot)])), pa.array([True])], schema=schema))
        return pa.concat_tables(out)

    return run


# ---- contexts

_CONTEXTS = "part long, doc_id long, row_id long, spans binary, docs binary, rows binary, starts binary, sizes binary, text binary"
_FIELDS = [c.split()[0] for c in _CONTEXTS.split(", ")]
_ARROW = pa.schema([(n, pa.int64() if i < 3 else pa.binary()) for i, n in enumerate(_FIELDS)])


def _gathered(buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return buf[ranges(starts, sizes)]


def _leaders(buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups of equal strings: the least id among the group of each, and a member of the group to stand for it.

    Groups are found by hash and their bytes compared; a string that differs from its group's first is its own group.
    """
    h = span_hashes_blocked(buf, starts, starts + sizes, _TABLE)
    order = np.lexsort((docs, h))
    cuts = _runs(h[order])
    first = np.repeat(order[cuts[:-1]], np.diff(cuts))
    lead = np.arange(len(starts))
    lead[order] = first
    check = order[(order != first) & (sizes[order] == sizes[first])]
    for lo in range(0, len(check), 50_000):
        own = check[lo : lo + 50_000]
        n = sizes[own]
        differ = _gathered(buf, starts[own], n) != _gathered(buf, starts[lead[own]], n)
        bad = np.logical_or.reduceat(differ, np.cumsum(n) - n) if len(own) else np.zeros(0, bool)
        lead[own[bad]] = own[bad]
    odd = sizes != sizes[lead]
    lead[odd] = np.flatnonzero(odd)
    return docs[lead], lead


def _merged(group: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of the intervals of each group, in order."""
    if not len(group):
        return group, starts, ends
    order = np.lexsort((starts, group))
    group, starts, ends = group[order], starts[order], ends[order]
    width = int(ends.max()) + 2
    rank = np.cumsum(np.concatenate([[0], (group[1:] != group[:-1]).astype(np.int64)]))
    far = np.maximum.accumulate(ends + rank * width)
    fresh = np.ones(len(group), dtype=bool)
    fresh[1:] = starts[1:] + rank[1:] * width > far[:-1]
    at = np.flatnonzero(fresh)
    return group[at], starts[at], far[np.append(at[1:], len(group)) - 1] - rank[at] * width


def _spans(docs: np.ndarray, rows: np.ndarray, starts: np.ndarray, ends: np.ndarray, part: np.ndarray | None) -> pa.RecordBatch:
    """Marked intervals by row; (start, end) pairs as 64-bit numbers."""
    keys, group = np.unique(rows, return_inverse=True)
    of = np.zeros(len(keys), dtype=np.int64)
    of[group] = docs
    group, starts, ends = _merged(group, starts, ends)
    by = _runs(group)
    rows = keys[group[by[:-1]]]
    n = len(rows)
    columns = [pa.array(rows if part is None else rows % part), pa.array(of[group[by[:-1]]]), pa.array(rows), _blobs(np.stack([starts, ends], axis=1).astype("<i8"), by)]
    return pa.RecordBatch.from_arrays([*columns, *[pa.nulls(n, pa.binary())] * 5], schema=_ARROW)


def _cut_contexts(length: int, parts: int, shared):
    """Contexts of the candidate anchors of each batch, by part; of equal ones those of the least id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("__id").to_numpy(zero_copy_only=False)
            rows = batch.column("__row").to_numpy(zero_copy_only=False)
            buf, offsets = utf8(batch.column("text"))
            lists = batch.column("grams")
            first, last, h, anchor = anchor_runs(buf, offsets, length)
            if not len(h):
                continue
            h &= _LOW48
            doc = np.searchsorted(offsets, first, side="right") - 1
            keep = np.zeros(len(h), dtype=bool)
            edges = np.searchsorted(doc, np.arange(len(ids) + 1)).tolist()
            flat, places = lists.values, lists.offsets.to_pylist()
            data, at = utf8(flat.slice(places[0], places[-1] - places[0]))
            for d in range(len(ids)):
                lo, hi = edges[d], edges[d + 1]
                a, b = at[places[d] - places[0]], at[places[d + 1] - places[0]]
                if hi > lo and b > a:
                    keep[lo:hi] = np.isin(h[lo:hi], data[a:b].view("<u8"))
            first, last, h, doc, anchor = first[keep], last[keep], h[keep], doc[keep], anchor[keep]
            if len(hot) and len(h):
                wide = np.isin(h, hot)
                if wide.any():
                    run, start, final, begin, end = by_steps(first[wide], last[wide], anchor[wide], length)
                    own = span_hashes_blocked(buf, begin, end, _TABLE) & _LOW48
                    first, last = np.concatenate([first[~wide], start]), np.concatenate([last[~wide], final])
                    h, doc = np.concatenate([h[~wide], own]), np.concatenate([doc[~wide], doc[wide][run]])
            if not len(h):
                continue
            sizes = last - first + length
            who = ids[doc]
            least, _ = _leaders(buf, first, sizes, who)
            gone = who > least
            base = offsets[doc]
            if gone.any():
                yield _spans(who[gone], rows[doc[gone]], (first - base)[gone], (last + length - base)[gone], parts)
            stay = np.flatnonzero(~gone)
            part = (h[stay] % np.uint64(parts)).astype(np.int64)
            stay = stay[np.argsort(part, kind="stable")]
            part = np.sort(part)
            for lo in range(0, len(stay), 100_000):
                own, p = stay[lo : lo + 100_000], part[lo : lo + 100_000]
                by = _runs(p)
                size = sizes[own]
                text = np.concatenate([[0], np.cumsum(size)])[by]
                n = len(by) - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(p[by[:-1]]),
                        pa.nulls(n, pa.int64()),
                        pa.nulls(n, pa.int64()),
                        pa.nulls(n, pa.binary()),
                        _blobs(who[own].astype("<i8"), by),
                        _blobs(rows[doc[own]].astype("<i8"), by),
                        _blobs((first - base)[own].astype("<i4"), by),
                        _blobs(size.astype("<i4"), by),
                        _blobs(_gathered(buf, first[own], size), text),
                    ],
                    schema=_ARROW,
                )

    return run


def _mark(length: int):
    """Of one part: sorts the suffixes of all its contexts and marks strings that a smaller id has as well."""
    schema = pa.schema([_ARROW.field(i) for i in (1, 2, 3)])

    def run(table: pa.Table) -> pa.Table:
        done = table.filter(pa.array(table.column("spans").is_valid().to_numpy())).select(["doc_id", "row_id", "spans"]).cast(schema)
        rest = table.filter(pa.array(table.column("spans").is_null().to_numpy()))
        if not len(rest):
            return done
        docs, rows = (_joined(rest.column(c), "<i8") for c in ("docs", "rows"))
        starts, sizes = (_joined(rest.column(c), "<i4").astype(np.int64) for c in ("starts", "sizes"))
        raw = _joined(rest.column("text"), np.uint8)
        at = np.cumsum(sizes) - sizes
        least, lead = _leaders(raw, at, sizes, docs)
        gone = docs > least
        out_docs, out_rows, out_a, out_b = [docs[gone]], [rows[gone]], [starts[gone]], [(starts + sizes)[gone]]
        # one text for each group of equal contexts, eight zeros after each
        heads = np.flatnonzero(lead == np.arange(len(lead)))
        size = sizes[heads]
        begin = np.cumsum(size + 8) - size - 8
        buf = np.zeros(int((size + 8).sum()), dtype=np.uint8)
        buf[ranges(begin, size)] = _gathered(raw, at[heads], size)
        windows = size - length + 1
        order, words = two_stage_sort(buf, begin, begin + size, windows, length)
        text = np.searchsorted(begin, order, side="right") - 1
        asked = order - begin[text] < windows[text]
        order, text = order[asked], text[asked]
        group = np.concatenate([[0], np.cumsum(~reaches(words, order, length))]) if len(order) else np.zeros(0, np.int64)
        own = least[heads][text]
        cuts = _runs(group)
        smallest = np.repeat(np.minimum.reduceat(own, cuts[:-1]), np.diff(cuts))
        marked = own > smallest
        text, offset = text[marked], (order - begin[text])[marked]
        # runs of marked strings of a context, given to every member that is still in question
        text, lo, hi = _merged(text, offset, offset + length)
        members = np.flatnonzero(~gone)
        slot = np.searchsorted(heads, lead[members])
        by = np.searchsorted(text, np.arange(len(heads) + 1))
        count = (by[1:] - by[:-1])[slot]
        which = np.repeat(members, count)
        span = ranges(by[:-1][slot], count)
        out_docs.append(docs[which])
        out_rows.append(rows[which])
        out_a.append(starts[which] + lo[span])
        out_b.append(starts[which] + hi[span])
        found = [np.concatenate(x) for x in (out_docs, out_rows, out_a, out_b)]
        if not len(found[0]):
            return done
        return pa.concat_tables([done, pa.Table.from_batches([_spans(*found, None)]).select(["doc_id", "row_id", "spans"]).cast(schema)])

    return run


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    for batch in batches:
        rows = batch.column("__row").to_pylist()
        buf, offsets = utf8(batch.column("text"))
        found = batch.column("found")
        out = []
        for i, lists in enumerate(found):
            own = buf[offsets[i] : offsets[i + 1]]
            spans = [np.frombuffer(x["spans"].as_buffer(), dtype="<i8").reshape(-1, 2) for x in lists.values or [] if x["row_id"].as_py() == rows[i]] if lists.is_valid else []
            if not spans:
                kept = own.tobytes()
                out.append((len(own), 0, 0, hashlib.sha256(kept).hexdigest(), kept))
                continue
            both = np.concatenate(spans)
            _, a, b = _merged(np.zeros(len(both), np.int64), both[:, 0], both[:, 1])
            gone, at, keep = int((b - a).sum()), 0, []
            for s, e in zip(a.tolist(), b.tolist(), strict=True):
                keep.append(own[at:s].tobytes())
                at = e
            kept = b"".join([*keep, own[at:].tobytes()])
            out.append((len(own), gone, len(a), hashlib.sha256(kept).hexdigest(), kept))
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)]], names=names)


def remove_repeats(docs: DataFrame, length: int = 50, hot_keys: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = 3 << 20, task_bytes: int = 32 << 20) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes): one row per document."""
    if length < GRAM + 1:
        raise ValueError(f"length must be over {GRAM}")
    spark = docs.sparkSession
    ship(spark)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    # never null for the planner, or the joins below would shuffle texts twice
    nameless = F.lit(NAMELESS) - F.xxhash64("text").bitwiseAND(F.lit((1 << 61) - 1))
    own = own.select(F.coalesce("doc_id", nameless).alias("__id"), "text")
    size, low, high = own.agg(F.sum(F.octet_length("text").cast("long")), F.min("__id"), F.max("__id")).first()
    size = size or 0
    parts = max(partitions(spark), min(1 << 22, math.ceil(size / part_bytes)))
    narrow = size and low >= 0 and high < 2**32 - 1
    kind, several = ("<u4", 2**32 - 1) if narrow else ("<i8", -(1 << 63) + 1)

    anchors = own.select("__id", "text").mapInArrow(_find_anchors(length, parts, kind, several), _ANCHORS)
    # at most hot_keys anchors can have more holders than this
    hot_above = max(HOT, math.ceil(size / hot_keys))
    # tasks of a bounded size: beyond what the session's number of partitions is made for, more of them
    tasks = math.ceil(size / task_bytes)
    dealt = lambda df: df.repartition(tasks, "part") if tasks > partitions(spark) else df
    found = written(dealt(anchors).groupBy("part").applyInArrow(_shared_anchors(kind, several, hot_above), _CANDIDATES), "suffix-anchors")
    hot = found.filter("hot").select("grams").collect()
    hot = np.unique(np.frombuffer(b"".join(bytes(r[0]) for r in hot), dtype="<u8"))
    shared = spark.sparkContext.broadcast(hot)

    asked = found.filter("not hot").groupBy(F.col("doc_id").alias("__id")).agg(F.collect_list("grams").alias("grams"))
    wanted = own.select("text", "__id").hint("merge").join(asked, "__id").select("__id", F.xxhash64("__id", "text").alias("__row"), "text", "grams")
    contexts = wanted.mapInArrow(_cut_contexts(length, parts, shared), _CONTEXTS)
    marks = dealt(contexts).groupBy("part").applyInArrow(_mark(length), "doc_id long, row_id long, spans binary")
    marks = marks.groupBy(F.col("doc_id").alias("__id")).agg(F.collect_list(F.struct("row_id", "spans")).alias("found"))
    # the same two columns by the same key as above: the texts are shuffled once
    own_id = F.when(F.col("__id") > NAMELESS, F.col("__id")).alias("doc_id")
    last = own.select("text", "__id").hint("merge").join(marks, "__id", "left").select(own_id, F.xxhash64("__id", "text").alias("__row"), "text", "found")
    return last.mapInArrow(_cut_out, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
