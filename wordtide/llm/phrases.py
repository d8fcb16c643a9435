"""Phrase collocation mining with a minimal perfect hash over Apriori-safe candidates.

Texts are read once into blocks of words of one language. Level by level, a block holds the
positions at which a frequent phrase of n - 1 words begins, as ids; two neighbours make the key
(id of the first n - 1 words, id of the last n - 1 words) of a phrase of n words, an exact 64-bit
number. So a key exists only where both parts are frequent, and no frequent phrase is lost.

Each block counts its own keys and sends them, as arrays, to segments of hash space. A segment
adds the counts of hashed buckets first and drops keys whose bucket stays under the minimum
(safe: a bucket holds at least its keys' counts). The keys that are left are the
candidates; a minimal perfect hash gives each its slot, the key stored at the slot verifies
every look-up, bincount adds each block's counts by slot, and slots under the minimum are cut. The
block gets back the ids of those of its keys that stay. Segments grow in number with the corpus, not in size: a
key comes at most once from a block, however frequent it is.

What a phrase's cuts need (counts of its first and of its last words) is read from the slots of
its two parts, down to words.

Defined cases: a null text has no words, a null language is ``und``; repeated rows count as
often as they occur; an empty table gives an empty result; extra columns are ignored. Ids have
32 bits: beyond 2**32 frequent phrases of one length in one language the operator raises.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._bytes import byte_table, mix, span_hashes
from ._common import discard, ship, text_of, written

#: Fixed: bytes that end a piece, and bytes between words.
BREAKS, SPACES = b".,;:!?\n\x0b\x0c\r", b" \t"

FIRST = "lang string, block long, n long, gaps binary, words binary, named long, list binary, counts binary"
STEP = "lang string, block long, segment int, gaps binary, ids binary, keys binary, counts binary"
COUNTED = "lang string, block long, keys binary, ids binary, id long, first long, last long, word string, a long"

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[list(SPACES)] = 1
_KIND[list(BREAKS)] = 2
_TABLE = byte_table(1_117)


def arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in ddl.split(", "))])


def _rows(rows: list[dict], ddl: str) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=arrow_schema(ddl))


def packed(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as the byte planes of their differences, which compress well."""
    return np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, dtype=np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


class PerfectHash:
    """Distinct 64-bit keys -> slots 0 to n - 1, with the key stored at its slot.

    Keys that meet no other key in a level's bits are placed there; the rest goes to the next
    level. A slot is the number of set bits before its own.
    """

    def __init__(self, keys: np.ndarray, room: float = 2.0):
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        self.stored = np.zeros(len(keys), dtype=np.uint64)
        left, placed = keys, 0
        while len(left):
            size = max(64, int(room * len(left)))
            at = self._at(left, len(self.levels), size)
            bits = np.zeros(-(-size // 64) * 64, dtype=bool)
            bits[:size] = np.bincount(at, minlength=size) == 1
            words = np.packbits(bits, bitorder="little").view("<u8")
            ones = np.bitwise_count(words).astype(np.int64)
            self.levels.append((size, words, placed + np.cumsum(ones) - ones))
            alone = bits[at]
            self.stored[self._rank(len(self.levels) - 1, at[alone])] = left[alone]
            placed += int(alone.sum())
            left = left[~alone]

    @staticmethod
    def _at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + np.uint64(0x9E3779B97F4A7C15 * (level + 1) & (2**64 - 1))) % np.uint64(size)).astype(np.int64)

    def _rank(self, level: int, at: np.ndarray) -> np.ndarray:
        _, words, before = self.levels[level]
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return before[at >> 6] + np.bitwise_count(words[at >> 6] & below)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 where the stored key is another one."""
        out = np.full(len(keys), -1, dtype=np.int64)
        open_ = np.arange(len(keys))
        for level, (size, words, _) in enumerate(self.levels):
            at = self._at(keys[open_], level, size)
            hit = (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            out[open_[hit]] = self._rank(level, at[hit])
            open_ = open_[~hit]
        found = out >= 0
        found[found] = self.stored[out[found]] == keys[found]
        return np.where(found, out, -1)


def candidates(keys: np.ndarray, counts: np.ndarray, least: int) -> np.ndarray:
    """The distinct keys whose hashed bucket reaches ``least``."""
    size = 1 << max(10, (len(keys) // 2).bit_length())
    bucket = (mix(keys ^ np.uint64(0xA5A5A5A5A5A5A5A5)) & np.uint64(size - 1)).astype(np.int64)
    return np.unique(keys[np.bincount(bucket, weights=counts, minlength=size)[bucket] >= least])


# ---- blocks of words


def _read(block_bytes: int, held_bytes: int):
    """Texts -> blocks: positions as gaps, each word's number in the block's list, the list and its counts."""

    def block(lang: str, number: int, texts: list[bytes]) -> dict:
        raw = b"\n".join(texts).translate(_LOWER)
        buf = np.frombuffer(raw, dtype=np.uint8)
        kind = _KIND[buf]
        inside = np.concatenate([[False], kind == 0, [False]])
        starts, ends = np.flatnonzero(inside[1:-1] & ~inside[:-2]), np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
        piece = np.searchsorted(np.flatnonzero(kind == 2), starts)
        gaps = 1 + np.minimum(np.diff(piece, prepend=0), 1).astype(np.uint8)
        offsets = np.concatenate([[0], np.cumsum(ends - starts)])
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(buf[kind == 0]))])
        words = words.dictionary_encode()
        at = words.indices.to_numpy()
        counts = np.bincount(at, minlength=len(words.dictionary))
        return {"lang": lang, "block": number, "n": len(at), "gaps": gaps.tobytes(), "words": at.astype("<i4").tobytes(), "named": len(counts), "list": b"\n".join(words.dictionary.to_pylist()), "counts": counts.astype("<i8").tobytes()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}
        number = TaskContext.get().partitionId() << 32

        def flush(lang: str) -> Iterator[pa.RecordBatch]:
            nonlocal number
            row = block(lang, number, held.pop(lang))
            del size[lang]
            if row["n"]:
                number += 1
                yield from _rows([row], FIRST).to_batches()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = text.as_buffer().to_pybytes()
                held.setdefault(lang, []).append(data)
                size[lang] = size.get(lang, 0) + len(data) + 1
                if size[lang] >= block_bytes:
                    yield from flush(lang)
                elif sum(size.values()) >= held_bytes:
                    yield from flush(max(size, key=size.get))
        for lang in list(held):
            yield from flush(lang)

    return run


def _deal_words(segments: int):
    """A block's word list -> parts of it, by a hash of the word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, number, list_, counts in zip(*(b.column(c).to_pylist() for c in ("lang", "block", "list", "counts")), strict=True):
                words = list_.split(b"\n")
                buf = np.frombuffer(list_, dtype=np.uint8)
                ends = np.concatenate([np.flatnonzero(buf == 10), [len(buf)]])
                starts = np.concatenate([[0], ends[:-1] + 1])
                segment = (span_hashes(buf, starts, ends, _TABLE) % np.uint64(segments)).astype(np.int64)
                counts = np.frombuffer(counts, dtype="<i8")
                order = np.argsort(segment, kind="stable")
                edges = np.searchsorted(segment[order], np.arange(segments + 1))
                rows = []
                for s in np.flatnonzero(np.diff(edges)).tolist():
                    own = order[edges[s] : edges[s + 1]]
                    rows.append({"lang": lang, "block": number, "segment": s, "ids": own.astype("<i4").tobytes(), "keys": b"\n".join([words[i] for i in own.tolist()]), "counts": counts[own].tobytes()})
                yield from _rows(rows, STEP).to_batches()

    return run


def _numbered(slots: np.ndarray, segment: int, segments: int) -> np.ndarray:
    """Ids of what stays in a segment: no other segment has them."""
    ids = np.arange(len(slots), dtype=np.int64) * segments + segment
    if len(ids) and ids[-1] >= 1 << 32:
        raise ValueError("more than 2**32 frequent phrases of one length in one language")
    return ids


def _count_words(segments: int, least: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        lang, segment = key[0].as_py(), key[1].as_py()
        blocks = table.column("block").to_pylist()
        lists = [x.split(b"\n") for x in table.column("keys").to_pylist()]
        counts = [np.frombuffer(x, "<i8") for x in table.column("counts").to_pylist()]
        words = pa.chunked_array([pa.array(x, pa.large_binary()) for x in lists]).combine_chunks().dictionary_encode()
        code = words.indices.to_numpy()
        total = np.bincount(code, weights=np.concatenate(counts), minlength=len(words.dictionary)).astype(np.int64)
        often = np.flatnonzero(total >= least)
        ids = np.full(len(total), -1, dtype=np.int64)
        ids[often] = _numbered(often, segment, segments)
        rows = [{"lang": lang, "id": i, "word": w.decode(), "a": a} for i, w, a in zip(ids[often].tolist(), words.dictionary.take(pa.array(often)).to_pylist(), total[often].tolist(), strict=True)]
        edges = np.cumsum([0, *map(len, lists)])
        for k, (number, local) in enumerate(zip(blocks, table.column("ids").to_pylist(), strict=True)):
            own = ids[code[edges[k] : edges[k + 1]]]
            stay = own >= 0
            if stay.any():
                rows.append({"lang": lang, "block": number, "keys": np.frombuffer(local, "<i4")[stay].tobytes(), "ids": own[stay].astype("<u4").tobytes()})
        return _rows(rows, COUNTED)

    return run


# ---- phrases of two words and more


def _keys(pos: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where two phrases begin one word apart: position and key of the phrase that is one word longer."""
    next_ = np.flatnonzero(pos[1:] == pos[:-1] + 1)
    return pos[next_], ids[next_] << np.uint64(32) | ids[next_ + 1]


def _advance(level: int, segments: int):
    """A block and the ids that its keys got -> the block one level on, and its keys by segment."""

    def run(block: pa.Table, named: pa.Table) -> pa.Table:
        if not block.num_rows or not named.num_rows:
            return _rows([], STEP)
        row = {c: block.column(c)[0].as_py() for c in block.column_names}
        pos = np.cumsum(np.frombuffer(row["gaps"], np.uint8 if level == 2 else "<u4"), dtype=np.int64)
        new = np.concatenate([np.frombuffer(x, "<u4") for x in named.column("ids").to_pylist()]).astype(np.uint64)
        if level == 2:
            table = np.full(row["named"], 2**64 - 1, dtype=np.uint64)
            table[np.concatenate([np.frombuffer(x, "<i4") for x in named.column("keys").to_pylist()])] = new
            ids = table[np.frombuffer(row["words"], "<i4")]
            stay = ids != np.uint64(2**64 - 1)
        else:
            pos, keys = _keys(pos, np.frombuffer(row["ids"], "<u4").astype(np.uint64))
            known = np.concatenate([unpacked(x) for x in named.column("keys").to_pylist()])
            order = np.argsort(known)
            known, new = known[order], new[order]
            at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            stay, ids = known[at] == keys, new[at]
        pos, ids = pos[stay], ids[stay]
        rows = [{"lang": row["lang"], "block": row["block"], "gaps": np.diff(pos, prepend=0).astype("<u4").tobytes(), "ids": ids.astype("<u4").tobytes()}]
        keys, counts = np.unique(_keys(pos, ids)[1], return_counts=True)
        segment = (mix(keys) % np.uint64(segments)).astype(np.int64)
        order = np.argsort(segment, kind="stable")
        edges = np.searchsorted(segment[order], np.arange(segments + 1))
        for s in np.flatnonzero(np.diff(edges)).tolist():
            own = order[edges[s] : edges[s + 1]]
            rows.append({"lang": row["lang"], "block": row["block"], "segment": s, "keys": packed(keys[own]), "counts": counts[own].astype("<u4").tobytes()})
        return _rows(rows, STEP)

    return run


def _count_phrases(segments: int, least: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        lang, segment = key[0].as_py(), key[1].as_py()
        parts = [unpacked(x) for x in table.column("keys").to_pylist()]
        keys = np.concatenate(parts)
        counts = np.concatenate([np.frombuffer(x, "<u4") for x in table.column("counts").to_pylist()])
        table_of = PerfectHash(candidates(keys, counts, least))
        slots = table_of.slots(keys)
        hit = slots >= 0
        total = np.bincount(slots[hit], weights=counts[hit], minlength=len(table_of.stored)).astype(np.int64)
        often = np.flatnonzero(total >= least)
        ids = np.full(len(total) + 1, -1, dtype=np.int64)
        ids[often] = _numbered(often, segment, segments)
        stored = table_of.stored[often]
        rows = [
            {"lang": lang, "id": i, "first": k >> 32, "last": k & (2**32 - 1), "a": a}
            for i, k, a in zip(ids[often].tolist(), stored.tolist(), total[often].tolist(), strict=True)
        ]
        got, edges = ids[slots], np.cumsum([0, *map(len, parts)])
        for k, number in enumerate(table.column("block").to_pylist()):
            own = got[edges[k] : edges[k + 1]]
            stay = own >= 0
            if stay.any():
                rows.append({"lang": lang, "block": number, "keys": packed(parts[k][stay]), "ids": own[stay].astype("<u4").tobytes()})
        return _rows(rows, COUNTED)

    return run


def frequent_phrases(docs: DataFrame, least: int, longest: int, block_bytes: int, segment_rows: int, lang_col: str, text_col: str) -> tuple[DataFrame, list[DataFrame]]:
    """All phrases of 1 to ``longest`` words that occur ``least`` times, by length, and the words of each language.

    Returns (lang, n) and for each length (lang, id, first, last, word, a).
    """
    ship(docs.sparkSession)
    own = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text_of(text_col).alias("text"))
    first = written(own.mapInArrow(_read(block_bytes, 2 * block_bytes), FIRST), "phrase-words")
    blocks = first.select("lang", "block", "gaps", "words", "named")
    many = first.agg(F.sum("named")).first()[0] or 0
    segments = max(1, math.ceil(many / segment_rows))
    dealt = first.select("lang", "block", "list", "counts").mapInArrow(_deal_words(segments), STEP)
    counted = written(dealt.groupBy("lang", "segment").applyInArrow(_count_words(segments, least), COUNTED), "phrase-counts")
    levels = [counted.filter("id is not null").select("lang", "id", "first", "last", "word", "a")]
    totals = written(first.groupBy("lang").agg(F.sum("n").alias("n")), "phrase-totals")
    for level in range(2, longest + 1):
        positions = levels[-1].agg(F.sum("a")).first()[0] or 0
        if not positions:
            break
        segments = max(1, math.ceil(positions / (2 * segment_rows)))
        named = counted.filter("block is not null").select("block", F.col("keys").alias("known"), F.col("ids").alias("new"))
        step = blocks.groupBy("block").cogroup(named.groupBy("block")).applyInArrow(_renamed(_advance(level, segments)), STEP)
        step = written(step, "phrase-blocks")
        discard(first)
        counted = step.filter("segment is not null").select("lang", "block", "segment", "keys", "counts")
        counted = written(counted.groupBy("lang", "segment").applyInArrow(_count_phrases(segments, least), COUNTED), "phrase-counts")
        levels.append(counted.filter("id is not null").select("lang", "id", "first", "last", "word", "a"))
        first, blocks = step, step.filter("segment is null").select("lang", "block", "gaps", "ids")
    discard(first)
    return totals, levels


def _renamed(run):
    return lambda block, named: run(block, named.rename_columns([{"known": "keys", "new": "ids"}.get(c, c) for c in named.column_names]))


# ---- scores

_CUT = """array_min(transform(sequence(1, size(heads)), k -> named_struct(
    'score', (cast(a as decimal(38,0)) * cast(n as decimal(38,0)) * 1000)
             div (cast(element_at(heads, k) as decimal(38,0)) * cast(element_at(tails, size(tails) - k + 1) as decimal(38,0))),
    'k', k, 'l', element_at(heads, k), 'r', element_at(tails, size(tails) - k + 1))))"""


def mine(
    docs: DataFrame,
    least: int = 100,
    longest: int = 5,
    top: int = 2000,
    absorb_percent: int = 100,
    block_bytes: int = 4 << 20,
    segment_rows: int = 1 << 20,
    lang_col: str = "lang",
    text_col: str = "text",
) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase inside a longer one with at least ``absorb_percent`` of its count is dropped. It is enough to look
    at phrases of one word more: what holds for a longer one holds for those between.
    """
    totals, levels = frequent_phrases(docs, least, longest, block_bytes, segment_rows, lang_col, text_col)
    none = F.array().cast("array<bigint>")
    known = levels[0].select("lang", "id", "a", F.col("word").alias("phrase"), F.col("word").alias("end"), none.alias("heads"), none.alias("tails"))
    found = None
    for level, own in enumerate(levels[1:], 1):
        head = known.select("lang", F.col("id").alias("first"), F.col("phrase").alias("h"), F.concat("heads", F.array("a")).alias("heads"))
        tail = known.select("lang", F.col("id").alias("last"), F.col("end"), F.concat("tails", F.array("a")).alias("tails"))
        own = own.select("lang", "id", "first", "last", "a").join(head, ["lang", "first"]).join(tail, ["lang", "last"])
        known = written(own.select("lang", "id", "a", F.concat_ws(" ", "h", "end").alias("phrase"), "end", "heads", "tails"), "phrases")
        kept = known
        if level + 1 < len(levels):
            longer = levels[level + 1]
            longer = longer.select("lang", F.explode(F.array("first", "last")).alias("id"), F.col("a").alias("longer"))
            longer = longer.groupBy("lang", "id").agg(F.max("longer").alias("longer"))
            kept = known.join(longer, ["lang", "id"], "left").filter(f"longer is null or 100 * longer < {int(absorb_percent)} * a")
        kept = kept.select("lang", "phrase", "a", "heads", "tails")
        found = kept if found is None else found.unionByName(kept)
    if found is None:
        found = known.filter("false").select("lang", "phrase", "a", "heads", "tails")
    scored = found.join(totals, "lang").withColumn("cut", F.expr(_CUT))
    scored = scored.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # a language with most phrases is ranked in parts first
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    best = scored.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return best.filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
