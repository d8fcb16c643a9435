"""Sharding by a two-pass external shuffle.

Pass one scatters the records uniformly into buckets that fit in memory, by a
seeded hash. Pass two loads one bucket per task, puts it in a canonical order and
applies a Fisher-Yates shuffle with a generator seeded by (seed, bucket). The
buckets, one after the other, are a random permutation of the corpus; shards are
equal stretches of it, so their row counts differ by one at most (law ``rows``),
and a task writes to one or two shards.

Copies of a text are records like any other and spread over the shards. Records are
dealt by all their columns. Rows that repeat in all of them more than ``most_repeats`` times
are counted and their copies numbered, and they are dealt by number as well;
so no bucket fills with one row's copies.

Defined cases: null texts count one byte; null and repeated ids are told apart by their
text; an empty table gives an empty result; columns of the input named ``shard`` or
``slot`` are replaced. Reruns and recomputed tasks give the same shards.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import discard, partitions, shared_dir, ship, text_of, written


def fisher_yates(n: int, rng: np.random.Generator) -> np.ndarray:
    """A uniform permutation of range(n): swap each place from the last down with one at or below it."""
    order = list(range(n))
    picks = (rng.random(n) * (np.arange(n) + 1)).astype(np.int64).tolist()
    for i in range(n - 1, 0, -1):
        j = picks[i]
        order[i], order[j] = order[j], order[i]
    return np.array(order, dtype=np.int64)


def _shuffle_buckets(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        # arrival order is not stable between runs: sort by bucket, hash and content first
        keys = ["__bucket", "__hash", "__id", "__text_hash"]
        table = pa.Table.from_batches(held).sort_by([(k, "ascending") for k in keys])
        held.clear()
        buckets = table.column("__bucket").to_numpy()
        table = table.drop_columns(["__hash", "__id", "__text_hash"])
        edges = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), len(buckets)]
        for lo, hi in zip(edges, edges[1:], strict=False):
            order = fisher_yates(hi - lo, np.random.default_rng([seed, int(buckets[lo])])) + lo
            for i in range(0, len(order), 2_000):
                part = table.take(pa.array(order[i : i + 2_000]))
                part = part.append_column("__place", pa.array(np.arange(i, i + part.num_rows, dtype=np.int64)))
                yield from part.combine_chunks().to_batches()

    return run


def _unhashable(kind: T.DataType) -> bool:
    """Maps, alone or inside."""
    if isinstance(kind, T.ArrayType):
        return _unhashable(kind.elementType)
    return isinstance(kind, T.MapType) or isinstance(kind, T.StructType) and any(_unhashable(f.dataType) for f in kind)


def _numbered(hashed: DataFrame, most_repeats: int) -> DataFrame:
    """Adds ``__copy``: 0, but for rows that repeat very often the number of the copy among equal rows."""
    spark, columns = hashed.sparkSession, hashed.columns
    often = written(hashed.groupBy("__hash").agg(F.count("*").alias("n")).filter(F.col("n") > most_repeats).select("__hash"), "shard-repeats")
    plain = F.lit(0).cast("long")
    if often.isEmpty():
        discard(often)
        return hashed.withColumn("__copy", plain)
    rest = hashed.join(often, "__hash", "left_anti").select(*[f"`{c}`" for c in columns]).withColumn("__copy", plain)
    many = hashed.join(often, "__hash", "left_semi").groupBy(*[f"`{c}`" for c in columns]).agg(F.count("*").alias("__n"))
    # numbered in two steps, so that one row's copies are made by many tasks
    step = most_repeats
    many = many.withColumn("__first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1, F.lit(step).cast("long"))))
    many = many.repartition(partitions(spark), "__hash", "__first")
    last = F.least(F.col("__first") + step, F.col("__n")) - 1
    return rest.unionByName(many.withColumn("__copy", F.explode(F.sequence("__first", last))).drop("__n", "__first"))


def external_shuffle(
    docs: DataFrame, shards: int = 16, seed: int = 41, bucket_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text", most_repeats: int = 1_000
) -> DataFrame:
    """The rows of ``docs`` with ``shard`` and ``slot`` (gapless in its shard), in shuffled order.

    ``bucket_bytes`` bounds what one Python worker holds (about three times that).
    The number of buckets grows with the data; per-bucket counts stay a table.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.drop(*[c for c in ("shard", "slot") if c in docs.columns])
    hashed = docs.withColumn("__text_hash", F.xxhash64(F.lit(seed), text_of(text_col)))
    others = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if _unhashable(f.dataType) else F.col(f"`{f.name}`") for f in docs.schema if f.name not in (id_col, text_col)]
    hashed = hashed.withColumn("__hash", F.xxhash64(F.lit(seed), F.col(id_col), F.col("__text_hash"), *others)).withColumn("__id", F.col(id_col))
    size = docs.agg(F.sum(F.octet_length(text_of(text_col)) + 64)).first()[0] or 0
    n = max(partitions(spark), math.ceil(size / bucket_bytes))
    hashed = _numbered(hashed, most_repeats)
    hashed = hashed.withColumn("__hash", F.when(F.col("__copy") > 0, F.xxhash64("__hash", "__copy")).otherwise(F.col("__hash")))
    hashed = hashed.withColumn("__bucket", F.pmod("__hash", F.lit(n)).cast("long"))

    counts = hashed.groupBy("__bucket").agg(F.count("*").alias("n"))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        "__bucket",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"),
        F.sum("n").over(Window.partitionBy()).alias("__total"),
    )
    schema = T.StructType([*docs.schema, T.StructField("__bucket", T.LongType()), T.StructField("__place", T.LongType())])
    scattered = hashed.repartitionById(n, F.col("__bucket").cast("int")).select(*[f"`{c}`" for c in docs.columns], "__bucket", "__hash", "__id", "__text_hash")
    shuffled = scattered.mapInArrow(_shuffle_buckets(seed), schema)
    if n <= 1_000_000:  # 24 bytes for each bucket; beyond that, a shuffled join
        starts = F.broadcast(starts)
    placed = shuffled.join(starts, "__bucket").withColumn("__at", F.col("__start") + F.col("__place"))
    shard = F.least(F.greatest(F.expr(f"cast(__at * {shards} div __total as int)"), F.lit(0)), F.lit(shards - 1))
    first = F.expr(f"(shard * __total + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard).withColumn("slot", F.col("__at") - first).drop("__bucket", "__place", "__start", "__total", "__at")


def write_shards(docs: DataFrame, path: str | None = None, **options) -> str:
    """Shuffle and write Parquet files under ``path``/shard=N; returns the path."""
    path = path or shared_dir(docs.sparkSession, "shards")
    external_shuffle(docs, **options).write.option("compression", "zstd").partitionBy("shard").parquet(path)
    return path
