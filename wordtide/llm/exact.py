"""Exact deduplication with an extendible-hash index on shared files.

Keys are 64-bit hashes of the texts. The directory doubles where a bucket holds
more distinct keys than ``capacity``: buckets split on one more leading bit of
the key until they fit. The index (directory and chains) lies in the shared
folder; owner tasks process the key range of a bucket, where equal keys form a
chain. Chains with more than one member compare the bytes of the texts, so a hash
collision never merges different texts.

Copies are counted by map-side partial aggregation before any shuffle, so that a
group with a third of all rows adds one row per task to its bucket. The joins that
bring the verdict back have a unique right side and split a hot left key.

Defined cases: null counts as the empty text; rows that repeat both doc_id and
text get the same verdict (none is dropped by this operator); a null doc_id loses
against every other; an empty table gives an empty result; extra columns are
ignored by ``find_copies`` and kept by ``drop_copies``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import discard, text_of, written


def _prefix(key: Column, depth: int) -> Column:
    """The leading ``depth`` bits of a 64-bit key as a number."""
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def directory(keys: DataFrame, capacity: int, max_depth: int = 48) -> tuple[DataFrame, int]:
    """Directory of ``keys``(key): one row per cell of the global depth with its bucket.

    Returns (cell, bucket, local_depth) and the global depth. Only the number of
    keys and the fullest cell come to the driver. ``keys`` are distinct, so a
    bucket that stays overfull at ``max_depth`` needs 2**-48 of equal hash bits.
    """
    n = keys.count()
    depth = max(0, math.ceil(math.log2(max(1, n) / capacity)))
    first = max(0, depth - 1)
    while True:
        cells = keys.groupBy(_prefix(F.col("key"), depth).alias("cell")).agg(F.count("*").alias("n"))
        if depth >= max_depth or (cells.agg(F.max("n")).first()[0] or 0) <= capacity:
            break
        depth += 1  # the directory doubles
    cells = written(cells, "exact-cells")
    found = None
    for local in range(first, depth + 1):
        at = cells.withColumn("bucket", F.shiftright("cell", depth - local))
        fits = at.groupBy("bucket").agg(F.sum("n").alias("n"))
        fits = fits.filter((F.col("n") <= capacity) | (F.lit(local) == depth)).select("bucket")
        level = at.join(fits, "bucket", "left_semi").select("cell", F.lit(local).alias("local_depth"), "bucket")
        found = level if found is None else found.unionByName(level)
    # a cell lies in the widest bucket that holds its keys: its local depth
    one = found.groupBy("cell").agg(F.min(F.struct("local_depth", "bucket")).alias("b"))
    return one.select("cell", "b.bucket", "b.local_depth"), depth


def _chains(members: DataFrame) -> DataFrame:
    """local_depth, bucket, key and chain: the different texts of each key, made by the owner of its bucket.

    ``members`` are counted by text before they go to the owner, so a group of any size
    is one link there. A chain has more than one link only where texts collide.
    """
    cell = ["local_depth", "bucket"]
    links = members.groupBy(*cell, "key", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    link = F.struct("text", "keep_id", "group_size")
    return links.repartition(*cell).groupBy(*cell, "key").agg(F.array_sort(F.collect_list(link)).alias("chain"))


def find_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise=None, capacity: int = 2_048) -> DataFrame:
    """doc_id, keep_id (the largest doc_id of equal texts), group_size, kept, text_sha256."""
    normal = (normalise or (lambda c: c))(text_of(text_col))
    texts = docs.select(F.col(id_col).alias("doc_id"), normal.alias("text")).withColumn("key", F.xxhash64("text"))

    counts = written(texts.groupBy("key").agg(F.count("*").alias("n")), "exact-keys")
    cells, depth = directory(counts.select("key"), capacity)
    chains = counts.withColumn("cell", _prefix(F.col("key"), depth)).join(cells, "cell")
    # an owner task holds the key range of whole buckets
    index = written(chains.select("bucket", "local_depth", "key", "n").repartition("bucket"), "exact-index")

    # a key's bucket is where its chain lies; keys of one row have no chain
    shared = index.filter("n > 1").select("key", "bucket", "local_depth")
    members = texts.join(shared.hint("merge"), "key", "left").select(
        "doc_id",
        "key",
        "bucket",
        "local_depth",
        F.sha2("text", 256).alias("text_sha256"),
        F.when(F.col("bucket").isNotNull(), F.col("text")).alias("text"),
    )
    members = written(members, "exact-members")
    alone = members.filter("bucket is null").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256"
    )
    chained = members.filter("bucket is not null")
    chains = written(_chains(chained), "exact-chains")
    discard(counts, index)
    at = chained.join(chains.hint("merge"), ["local_depth", "bucket", "key"])
    # bytes are compared: a row belongs to the link of its chain that has its text
    link = F.filter("chain", lambda c: c["text"] == F.col("text"))[0]
    linked = at.select("doc_id", link["keep_id"].alias("keep_id"), link["group_size"].alias("group_size"), "text_sha256")
    out = alone.unionByName(linked)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise=None, **options) -> DataFrame:
    """The rows whose text stays: one for each text.

    Of rows that repeat both doc_id and text one stays; only those go through the second
    aggregation, which sums them up before they are shuffled.
    """
    found = find_copies(docs, id_col=id_col, text_col=text_col, normalise=normalise, **options)
    marks = found.groupBy(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha")).agg(F.max("kept").alias("__kept"), F.count("*").alias("__rows"))
    marks = written(marks.filter("not __kept or __rows > 1"), "exact-marks")
    text = (normalise or (lambda c: c))(text_of(docs[text_col]))
    same = docs[id_col].eqNullSafe(marks["__id"]) & (F.sha2(text, 256) == marks["__sha"])
    rows = docs.join(marks.hint("merge"), same, "left")
    once = rows.filter("__kept is null").select(*[docs[c] for c in docs.columns])
    again = rows.filter("__kept").dropDuplicates(["__id", "__sha"]).select(*[docs[c] for c in docs.columns])
    return once.unionByName(again)
