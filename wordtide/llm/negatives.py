"""Hard-negative mining by distributed radix selection.

Every anchor meets every row in cells of one block of anchors and one group of rows.
A window is what one selection may take from: for the positives of an anchor all other
rows of its label, for the negatives of an anchor and a positive the rows of other labels
whose score lies between two fractions of the positive's. In each pass a cell counts, per
open window, the rows by one digit of (highest score - score); the histograms are summed,
the bucket that holds the k-th row becomes the window's interval, and the next digit refines
it. Where all rows of the interval have one score, the digits of the id go on. A cell sends
no bucket behind the one in which its own count reaches k, since the k-th row of all cells
cannot lie there. A window closes when few rows are left in it; then only those are gathered,
at most k from a cell, and ranked.

Scores are integer inner products: exact in doubles while every sum stays under 2**53, in
64-bit integers under 2**63, else in Python integers.

Defined cases: rows without id, label or vector and vectors with a null or non-finite
component take no part; of vectors of different lengths the missing components are 0;
repeated rows are rows of their own, but rows with the anchor's id are none of its positives;
of equal scores the smaller id comes first; a score beyond 64 bits counts as the largest or
smallest 64-bit number; an empty table or one without anchors gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import discard, ship, written

STATE = "anchor_no long, w int, positive_id long, positive_score long, lo long, hi long, x long, y long, above long, by_id boolean, u long, v long, open boolean"
#: Bounds of a score, and bits of a digit.
LEAST, MOST, DIGIT = -(2**63), 2**63 - 1, 8

_FIELDS = ["w", "lo", "hi", "x", "y", "above", "by_id", "u", "v"]


def prepared(rows: DataFrame, anchor: Column, id_col: str, label_col: str, vector_col: str, scale: float) -> DataFrame:
    """The rows that take part: row_no, id, label, q (scaled and floored components), anchor."""
    finite = lambda x: ~F.isnan(x) & (F.abs(x) != F.lit(math.inf))
    own = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("q"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    own = own.filter("id is not null and label is not null and q is not null").filter(F.forall("q", lambda x: F.coalesce(finite(x), F.lit(False))))
    own = own.withColumn("q", F.transform("q", lambda x: F.floor(F.lit(float(scale)) * x).cast("long")))
    return own.withColumn("row_no", F.monotonically_increasing_id())


def _matrix(column: pa.ChunkedArray, dims: int, kind: type) -> np.ndarray:
    """List column -> rows x dims, missing components 0."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    lens = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), dims), dtype=np.int64)
    if len(flat):
        row = np.repeat(np.arange(len(column)), lens)
        out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)] = flat
    return out.astype(kind)


def _scores(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    s = left @ right.T
    return np.clip(s, LEAST, MOST).astype(np.int64) if s.dtype == object else s.astype(np.int64)


def number_kind(largest: int, dims: int) -> type:
    """The cheapest number type in which no inner product overflows."""
    bound = largest * largest * max(dims, 1)
    return np.float64 if bound < 2**53 else np.int64 if bound < 2**63 else object


def _cells(rows: pa.Table, anchors: pa.Table, dims: int, kind: type, same: bool):
    """For each anchor of a cell: number, its windows, and scores and ids of the rows that it may take."""
    if not rows.num_rows or not anchors.num_rows:
        return
    ids = rows.column("id").to_numpy()
    labels = rows.column("label").to_numpy()
    right = _matrix(rows.column("q"), dims, kind)
    for at in range(0, anchors.num_rows, 128):
        part = anchors.slice(at, 128)
        scores = _scores(_matrix(part.column("own_q"), dims, kind), right)
        for s, no, own, label, windows in zip(scores, *(part.column(c).to_pylist() for c in ("anchor_no", "own_id", "own_label", "windows")), strict=True):
            fit = np.flatnonzero((labels == label) & (ids != own) if same else labels != label)
            yield no, windows, s[fit], ids[fit]


def _offset(values: np.ndarray, origin: int) -> np.ndarray:
    """values - origin for values >= origin, whatever the distance."""
    return values.astype(np.uint64) - np.uint64(origin & (2**64 - 1))


def digit_shift(first: int, last: int) -> int:
    """How far to shift offsets within [first, last] so that one digit is left."""
    return max(0, (last - first).bit_length() - DIGIT)


def _histograms(dims: int, kind: type, same: bool, k: int):
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], [], []]
        for no, windows, s, ids in _cells(rows, anchors, dims, kind, same):
            for win in windows:
                if win["by_id"]:
                    at = ids[(s == win["y"]) & (ids >= win["u"]) & (ids <= win["v"])]
                    digit = _offset(at, win["u"]) >> np.uint64(digit_shift(win["u"], win["v"]))
                else:
                    at = s[(s >= win["x"]) & (s <= win["y"])]
                    # the distance from the highest score, whatever its sign
                    digit = (np.uint64(win["y"] & (2**64 - 1)) - at.astype(np.uint64)) >> np.uint64(digit_shift(win["x"], win["y"]))
                counts = np.bincount(digit.astype(np.int64), minlength=1)
                before = np.cumsum(counts) - counts
                buckets = np.flatnonzero((counts > 0) & (before < k - win["above"]))
                for column, values in zip(out, (np.full(len(buckets), no), np.full(len(buckets), win["w"]), buckets, counts[buckets]), strict=True):
                    column.append(values)
        columns = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
        return pa.table({n: pa.array(c, type=t) for n, c, t in zip(("anchor_no", "w", "bucket", "n"), columns, (pa.int64(), pa.int32(), pa.int32(), pa.int64()), strict=True)})

    return run


def _gather(dims: int, kind: type, same: bool, k: int):
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        for no, windows, s, ids in _cells(rows, anchors, dims, kind, same):
            for win in windows:
                fit = (s <= win["hi"]) & ((s > win["y"]) | (s == win["y"]) & (ids <= win["v"]) if win["by_id"] else s >= win["x"])
                fit = np.flatnonzero(fit)
                best = fit[np.lexsort((ids[fit], ~s[fit]))[:k]]
                for column, values in zip(out, ([no] * len(best), [win["w"]] * len(best), ids[best].tolist(), s[best].tolist()), strict=True):
                    column.extend(values)
        return pa.table({n: pa.array(c, type=t) for n, c, t in zip(("anchor_no", "w", "id", "score"), out, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)})

    return run


def narrowed(win: dict, hit: dict | None, k: int, most: int, ids: tuple[int, int]) -> dict:
    """A window's next state, given the bucket in which the k-th row lies (none: it holds fewer than k)."""
    if hit is None:
        return win | {"open": False}
    first, last = (win["u"], win["v"]) if win["by_id"] else (win["x"], win["y"])
    step, through = 1 << digit_shift(first, last), win["above"] + hit["through"]
    win = win | {"above": through - hit["n"]}
    if win["by_id"]:
        u = first + hit["bucket"] * step
        win |= {"u": u, "v": min(last, u + step - 1)}
        return win | {"open": through > most and win["u"] < win["v"]}
    y = last - hit["bucket"] * step
    win |= {"y": y, "x": max(first, y - step + 1)}
    if through <= most:
        return win | {"open": False}
    if win["x"] == win["y"]:
        win |= {"by_id": True, "u": ids[0], "v": ids[1]}
        return win | {"open": ids[0] < ids[1]}
    return win | {"open": True}


def _narrow(k: int, most: int, ids: tuple[int, int]):
    names = [f.split()[0] for f in STATE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [narrowed({n: r[n] for n in names}, r["hit"], k, most, ids) for r in b.to_pylist()]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([b.schema.field(n) for n in names]))

    return run


class _Selection:
    """Anchors and rows laid out in cells; selects the first k rows of every window."""

    def __init__(self, rows: DataFrame, anchor_block: int, row_group: int):
        self.rows = rows
        s = rows.agg(
            F.count("*").alias("n"), F.count_if("anchor").alias("anchors"), F.max(F.size("q")).alias("dims"), F.min("id").alias("low"), F.max("id").alias("high"),
            F.max(F.array_max("q")).alias("top"), F.min(F.array_min("q")).alias("bottom"),
        ).first()
        self.anchors, self.dims, self.ids = s["anchors"], s["dims"] or 0, (s["low"], s["high"])
        largest = max(abs(s["top"] or 0), abs(s["bottom"] or 0))
        self.kind, self.bound = number_kind(largest, self.dims), min(largest * largest * max(self.dims, 1), MOST)
        self.blocks, self.groups = max(1, math.ceil(s["anchors"] / anchor_block)), max(1, math.ceil(s["n"] / row_group))

    def _laid_out(self, windows: DataFrame):
        """Cells of the anchors that have windows: rows beside anchors, each repeated for the blocks of the other."""
        dealt = lambda n: F.pmod(F.xxhash64("row_no"), F.lit(n)).cast("int")
        numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        rows = self.rows.select(dealt(self.groups).alias("g"), numbers(self.blocks).alias("b"), "id", "label", "q")
        windows = windows.groupBy("anchor_no").agg(F.collect_list(F.struct(*_FIELDS)).alias("windows"))
        own = self.rows.filter("anchor").select(F.col("row_no").alias("anchor_no"), F.col("id").alias("own_id"), F.col("label").alias("own_label"), F.col("q").alias("own_q")).join(windows, "anchor_no")
        own = own.select(F.pmod(F.xxhash64("anchor_no"), F.lit(self.blocks)).cast("int").alias("b"), "anchor_no", "own_id", "own_label", "own_q", "windows")
        own = own.select(numbers(self.groups).alias("g"), "*")
        return rows.groupBy("b", "g").cogroup(own.groupBy("b", "g"))

    def select(self, windows: DataFrame, same: bool, k: int, most: int) -> DataFrame:
        """``windows``(STATE) -> anchor_no, w, positive_id, positive_score, rank, id, score."""
        open_, closed = written(windows, "radix-windows"), []
        while not open_.isEmpty():
            sums = self._laid_out(open_).applyInArrow(_histograms(self.dims, self.kind, same, k), "anchor_no long, w int, bucket int, n long")
            sums = sums.groupBy("anchor_no", "w", "bucket").agg(F.sum("n").alias("n")).join(open_.select("anchor_no", "w", "above"), ["anchor_no", "w"])
            through = F.sum("n").over(Window.partitionBy("anchor_no", "w").orderBy("bucket"))
            sums = sums.withColumn("through", through).filter(F.col("through") >= k - F.col("above"))
            hits = sums.groupBy("anchor_no", "w").agg(F.min(F.struct("bucket", "through", "n")).alias("hit"))
            now = written(open_.join(hits, ["anchor_no", "w"], "left").mapInArrow(_narrow(k, most, self.ids), STATE), "radix-windows")
            discard(open_)
            open_ = now.filter("open")
            closed.append(now.filter("not open"))
        done = closed[0] if closed else open_
        for c in closed[1:]:
            done = done.unionByName(c)
        found = self._laid_out(done).applyInArrow(_gather(self.dims, self.kind, same, k), "anchor_no long, w int, id long, score long")
        order = Window.partitionBy("anchor_no", "w").orderBy(F.desc("score"), F.asc("id"))
        found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        return found.join(done.select("anchor_no", "w", "positive_id", "positive_score"), ["anchor_no", "w"])

    def windows(self, source: DataFrame, w: Column, lo: Column, hi: Column, positive_id: Column, positive_score: Column) -> DataFrame:
        no = F.lit(None).cast("long")
        return source.select("anchor_no", w.cast("int").alias("w"), positive_id.cast("long").alias("positive_id"), positive_score.cast("long").alias("positive_score"), lo.alias("lo"), hi.alias("hi"), lo.alias("x"), hi.alias("y"), F.lit(0).cast("long").alias("above"), F.lit(False).alias("by_id"), no.alias("u"), no.alias("v"), F.lit(True).alias("open"))


def mine(
    rows: DataFrame,
    anchor: Column,
    positives: int = 5,
    negatives: int = 10,
    low_percent: int = 30,
    high_percent: int = 90,
    scale: float = 256.0,
    anchor_block: int = 1024,
    row_group: int = 2048,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchor`` says which rows are anchors. A negative of another label lies between
    ``low_percent`` and ``high_percent`` of its positive's score, bounds included.
    """
    ship(rows.sparkSession)
    own = written(prepared(rows, anchor, id_col, label_col, vector_col, scale), "radix-rows")
    cells = _Selection(own, anchor_block, row_group)
    anchors = own.filter("anchor").select(F.col("row_no").alias("anchor_no"), F.col("id").alias("anchor_id"))
    edge = F.lit(cells.bound).cast("long")
    no = F.lit(None)
    near = written(cells.select(cells.windows(anchors, F.lit(0), -edge, edge, no, no), True, positives, 4 * positives), "radix-positives")
    wide = lambda percent: F.col("score").cast("decimal(38,0)") * percent
    # 100 s >= low p and 100 s <= high p; where p is negative no score fits
    lo, hi = F.ceil(wide(low_percent) / 100).cast("long"), F.floor(wide(high_percent) / 100).cast("long")
    windows = cells.windows(near, F.col("rank"), lo, hi, F.col("id"), F.col("score")).filter("lo <= hi")
    hard = cells.select(windows, False, negatives, 4 * negatives).join(anchors, "anchor_no")
    return hard.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
