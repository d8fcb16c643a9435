"""Mixing sources to target weights.

Tokens are summed per source, targets follow from the weights (a source stops at
``max_repeat`` times its size; what it cannot take is shared among the others),
and each document is emitted floor(rate) times plus one copy that a hash-seeded
Bernoulli draw grants with probability equal to the fraction of the rate.

Defined cases: a null text has size 0; a null source is a source of its own, the
last in order; repeated rows are documents of their own and share their draw; rows
without an id draw by a hash of their text;
an empty table gives an empty result; columns of the input that are named like a
result column are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import WORD_PATTERN, text_of, written


def word_count(text: str | Column) -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD_PATTERN)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, max_repeat: float) -> DataFrame:
    """``sizes``(source, source_size) -> with ``weight``, ``target`` and ``rate``.

    Closed form of sharing by weight with caps: with sources ordered by how soon
    they reach their cap (cap / weight), the capped ones are a prefix, and the
    water level of the rest is (total - caps of the prefix) / weights of the rest.
    One row per source, so the one-partition windows hold as many rows as there
    are sources, whatever the number of documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ws = F.array(*[F.lit(float(w)) for w in weights])
    t = sizes.withColumn("weight", F.get(ws, (F.row_number().over(by_name) - 1) % len(weights)))
    t = t.withColumn("cap", F.col("source_size") * F.lit(float(max_repeat)))
    everything = Window.partitionBy()
    t = t.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    t = t.withColumn(
        "level",
        (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward),
    )
    # the first source that stays under its cap sets the level of all that follow
    free = F.col("cap") > F.col("weight") * F.col("level")
    t = t.withColumn("level", F.min_by(F.when(free, F.col("level")), F.when(free, F.col("cap") / F.col("weight"))).over(everything))
    t = t.withColumn("target", F.coalesce(F.least("cap", F.col("weight") * F.col("level")), F.col("cap")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return t.select("source", "source_size", "weight", "target", rate.alias("rate"))


def bernoulli(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the key and the seed alone (12 hex digits of an MD5)."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") / F.lit(float(2**48))


def mixing_plan(
    docs: DataFrame,
    weights: Sequence[float] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    max_repeat: float = 2.0,
    seed: int = 17,
    size: Column | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    broadcast_bytes: int = 16 << 20,
) -> DataFrame:
    """The input's rows with ``size``, ``source_size``, ``target``, ``rate`` and ``copies``.

    The per-source table is written and joins back on the source. It is broadcast if
    its rows take at most ``broadcast_bytes``; beyond that both sides are shuffled, where a
    source with a third of all rows is a skewed probe side that adaptive execution splits. ``copies`` never exceeds ``max_repeat``, or the next whole
    number where that is a fraction.
    """
    size = word_count(text_col) if size is None else size
    extra = ("size", "source_size", "target", "rate", "copies")
    key = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null:"), F.md5(text_of(text_col))))
    base = docs.drop(*[c for c in extra if c in docs.columns]).withColumns({"size": size, "__draw": bernoulli(key, seed)})
    sums = base.groupBy(F.col(source_col).alias("source")).agg(F.sum("size").alias("source_size"))
    targets = source_targets(sums, weights, share, max_repeat).drop("weight").withColumnRenamed("source", "__source")
    targets = written(targets, "mixing-targets")
    held = targets.agg(F.sum(F.coalesce(F.octet_length("__source"), F.lit(0)) + 64)).first()[0] or 0
    targets = F.broadcast(targets) if held <= broadcast_bytes else targets
    out = base.join(targets, base[source_col].eqNullSafe(targets["__source"]), "left").drop("__source")
    whole = F.floor("rate")
    extra_copy = (F.col("__draw") < F.col("rate") - whole).cast("long")
    return out.withColumn("copies", F.least(whole + extra_copy, F.lit(math.ceil(max_repeat))).cast("long")).drop("__draw")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: every document as many times as the plan says, with its columns."""
    plan = mixing_plan(docs, **options).filter("copies > 0")
    return plan.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])
