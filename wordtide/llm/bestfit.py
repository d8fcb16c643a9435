"""Best-fit packing by sums of squares: few sequences, and only documents beyond a sequence are cut.

Each document is tokenized whole and ended by an end id. What is longer than a sequence is
cut into full sequences and a last piece. The other pieces are dealt by a hash to groups of
about ``group_pieces``; a group reads lengths only. A piece goes where the sum of squared
counts of open bins per residual gap becomes smallest, an unopened bin being one of the
choices: taking a bin from gap g to gap g - s changes the sum by 2 (N[g-s] - N[g]) + 2,
filling one exactly by 1 - 2 N[s], opening one by 2 N[capacity-s] + 1, and of equal changes
the tightest gap wins. The shortest pieces of a group (``last`` of them) come after
all others, longest first, and fill what is still open. Ids never pass through a group: they
join their places by piece.

Defined cases: a null or empty text is its end id alone; repeated rows are packed as often
as they occur; null doc_ids are carried; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import ship, written
from .packing import default_tokenizer

PIECES = "piece_no long, doc_id long, piece int, start long, length long, ids binary, doc_tokens long"
_ARROW = pa.schema(
    [("piece_no", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64())]
)


def _cut(tokenizer: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ._bpe import load
        from ._bytes import chunks, utf8

        bpe, end = load(tokenizer), int(end_id).to_bytes(4, "little")
        number, rows = TaskContext.get().partitionId() << 36, []
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)
        for batch in batches:
            docs = batch.column(0).to_pylist()
            buf, offsets = utf8(batch.column(1))
            for i, j in chunks(offsets, 4 << 20):
                ids, first = bpe.encode(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                data, edges = ids.astype("<u4").tobytes(), first.tolist()
                for d in range(j - i):
                    own = data[4 * edges[d] : 4 * edges[d + 1]] + end
                    tokens = len(own) // 4
                    for piece, start in enumerate(range(0, tokens, capacity)):
                        part = own[4 * start : 4 * (start + capacity)]
                        rows.append((number, docs[i + d], piece, start, len(part) // 4, part, tokens))
                        number += 1
                    if len(rows) > 1_000:
                        yield batch_of(rows)
                        rows = []
        if rows:
            yield batch_of(rows)

    return run


class SumOfSquares:
    """Open bins by residual gap. Costs are kept doubled and ready to subtract."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.after = np.zeros(capacity + 1)  # 2 N[gap]; a full bin counts as -1
        self.after[0] = -1
        self.before = np.full(capacity + 1, -np.inf)  # 2 N[gap] where a bin is open
        self.before[capacity] = 1  # an unopened bin can always be had
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bins = 0

    def place(self, size: int) -> tuple[int, int]:
        """The bin and the offset of a piece of 1 to capacity tokens."""
        gap = int(np.argmin(self.after[: self.capacity - size + 1] - self.before[size:])) + size
        if gap == self.capacity:
            bin_, self.bins = self.bins, self.bins + 1
        else:
            bin_ = self.open[gap].pop()
            self._count(gap)
        if rest := gap - size:
            self.open[rest].append(bin_)
            self._count(rest)
        return bin_, self.capacity - gap

    def _count(self, gap: int) -> None:
        n = 2 * len(self.open[gap])
        self.after[gap] = n
        self.before[gap] = n or -np.inf


def order_of_placing(sizes: np.ndarray, last: float) -> np.ndarray:
    """The given order, with the shortest share of the pieces moved to the end, longest first."""
    by_size = np.argsort(sizes, kind="stable")
    short = by_size[: int(len(sizes) * last)]
    return np.concatenate([np.sort(by_size[len(short) :]), short[::-1]])


def pack_sizes(sizes: Iterable[int], capacity: int, last: float) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every size."""
    sizes = np.asarray(sizes, dtype=np.int64)
    rule, bins, offsets = SumOfSquares(capacity), np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for i in order_of_placing(sizes, last).tolist():
        bins[i], offsets[i] = rule.place(int(sizes[i]))
    return bins, offsets


def _place(capacity: int, last: float):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by([("draw", "ascending"), ("piece_no", "ascending")])
        bins, offsets = pack_sizes(table.column("length").to_numpy(), capacity, last)
        return pa.table({"piece_no": table.column("piece_no"), "sequence_id": pa.array((key[0].as_py() << 32) + bins), "offset": pa.array(offsets)})

    return run


def pack(
    docs: DataFrame,
    tokenizer: str | None = None,
    end_id: int = 1,
    capacity: int = 4096,
    group_pieces: int = 1 << 16,
    last: float = 0.2,
    content: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids, doc_tokens, sequence_id, offset.

    ``ids`` are little-endian 32-bit numbers. ``content`` is what travels to a piece's place
    instead of them, computed from ``ids`` (a digest, say). Sequences of groups have
    numbers from 0, those of full pieces negative ones.
    """
    ship(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = written(own.mapInArrow(_cut(tokenizer or default_tokenizer(), end_id, capacity), PIECES), "best-fit-pieces")
    full = F.col("length") == capacity
    groups = max(1, math.ceil(pieces.filter(~full).count() / group_pieces))
    dealt = F.pmod(F.xxhash64("piece_no", F.lit("group")), F.lit(groups))
    lengths = pieces.filter(~full).select("piece_no", "length", F.xxhash64("piece_no").alias("draw"), dealt.alias("group"))
    places = lengths.groupBy("group").applyInArrow(_place(capacity, last), "piece_no long, sequence_id long, offset long")
    pieces = pieces.withColumn("ids", F.col("ids") if content is None else content)
    whole = pieces.filter(full).withColumns({"sequence_id": -1 - F.col("piece_no"), "offset": F.lit(0).cast("long")})
    return whole.unionByName(pieces.filter(~full).join(places, "piece_no")).drop("piece_no")
