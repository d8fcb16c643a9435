"""Packing documents into training sequences by harmonic classes.

Each document is tokenized whole and ended by an end id; it is cut into full
sequences and a remainder. A piece belongs to the class k whose bins hold k pieces
of at most capacity // k tokens. Every worker fills the bins of each class with k
pieces by itself, whatever the other workers do. A remainder that would leave much
of its share of a bin empty is cut at the top of the next class, so bins are nearly
full.

Each worker is left with fewer than k pieces per class. These few are packed once
more, by class, by a second round of workers (one for 64 of the first). What is
still left in an open bin is cut into sequences whose lengths are powers of two,
which need no padding.

Defined cases: a null or empty text is its end id alone; repeated rows are packed
as often as they occur; null doc_ids are carried; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import ship, tidy, written

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
)
_FULL = _ARROW.append(pa.field("klass", pa.int32())).append(pa.field("worker", pa.int64()))


def classes(capacity: int) -> list[int]:
    """Documents per bin: 1 to 16 one by one, then growing by about a tenth."""
    out, k = [], 1
    while k <= capacity:
        out.append(k)
        k = max(k + 1, int(k * 1.1))
    return out


class Harmonic:
    """Cuts lengths into pieces and names the class of each."""

    def __init__(self, capacity: int, waste: float = 1 / 32, least: int = 32):
        self.capacity = capacity
        ks = classes(capacity)
        self.klass = np.zeros(capacity + 1, dtype=np.int64)
        for k in ks:
            self.klass[: capacity // k + 1] = k
        following = dict(zip(ks, ks[1:], strict=False))
        self.cuts: list[list[int]] = [[]]
        for n in range(1, capacity + 1):
            k = int(self.klass[n])
            top = capacity // following.get(k, capacity)
            if n > least and capacity - k * n > waste * capacity and 0 < top < n:
                self.cuts.append([top, *self.cuts[n - top]])
            else:
                self.cuts.append([n])

    def pieces(self, n: int) -> list[int]:
        full, rest = divmod(n, self.capacity)
        return [self.capacity] * full + (self.cuts[rest] if rest else [])


class _Bins:
    """Open bins of one worker. A bin closes when it holds its class's number of pieces."""

    def __init__(self, first_id: int, capacity: int):
        self.next, self.capacity = first_id, capacity
        self.open: dict[int, list[tuple]] = {}
        self.rows: list[tuple] = []

    def add(self, k: int, piece: tuple) -> None:
        held = self.open.setdefault(k, [])
        held.append(piece)
        if len(held) == k:
            self.close(held)
            self.open[k] = []

    def close(self, held: list[tuple]) -> None:
        at = 0
        for doc, start, length, ids, tokens in held:
            self.rows.append((doc, start, length, ids, tokens, self.next, at))
            at += length
        self.next += 1

    def split(self, held: list[tuple]) -> None:
        """Lay the pieces end to end and cut into sequences of power-of-two lengths."""
        left = sum(p[2] for p in held)
        room, bin_ = 0, []
        for doc, start, length, ids, tokens in held:
            at = 0
            while at < length:
                if not room:
                    room = 1 << (min(left, self.capacity).bit_length() - 1)
                take = min(room, length - at)
                bin_.append((doc, start + at, take, ids[4 * at : 4 * (at + take)], tokens))
                at, room, left = at + take, room - take, left - take
                if not room:
                    self.close(bin_)
                    bin_ = []


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _first_round(tokenizer: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ._bpe import load
        from ._bytes import chunks, utf8

        bpe, rule = load(tokenizer), Harmonic(capacity)
        worker = TaskContext.get().partitionId()
        bins = _Bins(worker << 32, capacity)
        klass = rule.klass.tolist()
        for batch in batches:
            docs = batch.column(0).to_pylist()
            buf, offsets = utf8(batch.column(1))
            for i, j in chunks(offsets, 1 << 20):
                ids, first = bpe.encode(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                data, end = ids.astype("<u4").tobytes(), int(end_id).to_bytes(4, "little")
                edges = first.tolist()
                for d in range(j - i):
                    own = data[4 * edges[d] : 4 * edges[d + 1]] + end
                    tokens, at = edges[d + 1] - edges[d] + 1, 0
                    for n in rule.pieces(tokens):
                        bins.add(klass[n], (docs[i + d], at, n, own[4 * at : 4 * (at + n)], tokens))
                        at += n
                if len(bins.rows) > 2_000:
                    yield _batch([(*r, None, None) for r in bins.rows], _FULL)
                    bins.rows = []
        rest = [(*p, None, None, k, worker) for k, held in bins.open.items() for p in held]
        yield _batch([(*r, None, None) for r in bins.rows] + rest, _FULL)

    return run


def _second_round(capacity: int, ids_from: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        k, group = (x.as_py() for x in key)
        table = table.sort_by([("worker", "ascending"), ("doc_id", "ascending"), ("start", "ascending")])
        bins = _Bins(ids_from + (group << 34) + (k << 20), capacity)
        for p in zip(*(table.column(c).to_pylist() for c in ("doc_id", "start", "length", "ids", "doc_tokens")), strict=True):
            bins.add(k, p)
        for held in bins.open.values():
            bins.split(held)
        return pa.Table.from_batches([_batch(bins.rows, _ARROW)])

    return run


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset."""
    ship(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    first = own.mapInArrow(tidy(_first_round(tokenizer or default_tokenizer(), end_id, capacity)), f"{PIECES}, klass int, worker long")
    first = written(first, "packing")
    left = first.filter("sequence_id is null").withColumn("group", F.expr("worker div 64"))
    second = left.groupBy("klass", "group").applyInArrow(_second_round(capacity, 1 << 60), PIECES)
    return first.filter("sequence_id is not null").drop("klass", "worker").unionByName(second)
