"""A stored index of sentences by lemma: blocks of corpus order, read for the lemmas that are asked for.

A row holds a lemma's places within one block of turns, as differences. Rows lie in buckets of a hash of the lemma, sorted by it,
so a list of lemmas opens its buckets and their matching row groups only. How many places a block has is told by
a column of its own: a systematic sample sums those up and unpacks the blocks that it falls into, no others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tokens import index, strided

#: Turns of a block, and buckets of the hash.
BLOCK, BUCKETS = 512, 64
POSTINGS = "lemma string, block long, n int, turns array<bigint>, sents array<int>, bucket int"


def bucket_of(lemma: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(lemma), F.lit(buckets)).cast("int")


def _lists(store: DataFrame) -> DataFrame:
    """lemma, block, at: sentences travel whole to the task of their block, where lists are made. Tokens have no blanks.

    A place is one number, sent_no and then the turn's place in the block.
    """
    dealt = store.select(F.expr(f"(turn_id - pmod(turn_id, {BLOCK})) div {BLOCK}").alias("block"), "turn_id", "sent_no", F.array_join("tokens", " ").alias("t")).repartition("block")
    rows = index(dealt.withColumn("tokens", F.split("t", " ")), "block")
    place = F.col("sent_no").cast("bigint") * BLOCK + (F.col("turn_id") - F.col("block") * BLOCK)
    return rows.groupBy("lemma", "block").agg(F.collect_list(place).alias("at"))


def write(store: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """The index of ``store`` (turn_id a number). A row holds what one block of turns has of a lemma, so no list grows with the corpus."""
    bucket = bucket_of(F.col("lemma"), buckets)
    lists = _lists(store).repartition(buckets, bucket).withColumn("bucket", bucket).sortWithinPartitions("bucket", "lemma", "block")
    # multiples of a power of two below 2 ** 40: the division is exact
    whole = lambda p: ((p - F.pmod(p, F.lit(BLOCK))) / BLOCK).cast("int")
    at = F.array_sort(F.transform("at", lambda p: F.struct((F.col("block") * BLOCK + F.pmod(p, F.lit(BLOCK))).alias("turn_id"), whole(p).alias("sent_no"))))
    turns = F.transform("at", lambda x: x["turn_id"])
    gaps = F.zip_with(turns, F.concat(F.array(F.lit(0).cast("bigint")), turns), lambda a, b: a - b)
    out = lists.withColumn("at", at).select("lemma", "block", F.size("at").alias("n"), F.slice(gaps, F.lit(1), F.size("at")).alias("turns"), F.transform("at", lambda x: x["sent_no"]).alias("sents"), "bucket")
    out.write.partitionBy("bucket").parquet(path)


def of_lemmas(spark: SparkSession, path: str, lemmas: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """The rows of some lemmas. The list is a caller's own: the words of a report, or those that are vetted."""
    own = list(dict.fromkeys(lemmas))
    rows = spark.read.schema(POSTINGS).parquet(path)
    if not own:
        return rows.filter(F.lit(False))
    asked = spark.createDataFrame([(x,) for x in own], "lemma string").select(bucket_of(F.col("lemma"), buckets).alias("b")).distinct().collect()
    return rows.filter(F.col("bucket").isin([r.b for r in asked]) & F.col("lemma").isin(own))


def _unpacked(rows: DataFrame) -> DataFrame:
    """turn_id and sent_no of each place, with its 0-based number in the block."""
    sums = F.aggregate("turns", F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("out")), lambda a, g: F.struct((a["at"] + g).alias("at"), F.concat(a["out"], F.array(a["at"] + g)).alias("out")), lambda a: a["out"])
    at = F.posexplode(F.arrays_zip(sums.alias("turn_id"), F.col("sents").alias("sent_no")))
    return rows.select(*[c for c in rows.columns if c not in ("turns", "sents", "bucket")], at.alias("inside", "p")).select("*", "p.turn_id", "p.sent_no").drop("p")


def uses(postings: DataFrame, most: int) -> DataFrame:
    """lemma, turn_id, sent_no, use_no: at most ``most`` places of each lemma, the same systematic sample as ``tokens.uses``."""
    group = Window.partitionBy("lemma")
    before = group.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # lists stay where they are until it is known which blocks the sample falls into
    blocks = postings.select("lemma", "block", "n").withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("all", F.sum("n").over(group))
    if most > 0:
        i = F.ceil(F.col("start") * most / F.col("all"))
        first = F.floor(i * F.col("all") / most)
        blocks = blocks.filter((F.col("all") <= most) | ((i < most) & (first < F.col("start") + F.col("n"))))
    out = _unpacked(postings.drop("n").join(blocks.drop("n"), ["lemma", "block"])).withColumn("rank", F.col("start") + F.col("inside"))
    out = out.filter(strided(F.col("rank"), F.col("all"), most))
    number = F.row_number().over(group.orderBy("rank"))
    return out.select("lemma", "turn_id", "sent_no", number.alias("use_no"))


def sentences_of(sample: DataFrame, store: DataFrame) -> DataFrame:
    """The sampled sentences' tokens and text."""
    return sample.join(store.select("turn_id", "sent_no", "tokens", "raw"), ["turn_id", "sent_no"])


def counts(postings: DataFrame) -> DataFrame:
    """lemma, uses: in how many stored sentences each lemma is; no list is opened."""
    return postings.groupBy("lemma").agg(F.sum("n").alias("uses"))
