"""The driver's tables as the engine's inputs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.thesaurus import Thesaurus
from ..operators.vectors import normalized

NOW = datetime(2024, 3, 4)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as turns; days and hours before NOW follow from the id."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    cores = spark.sparkContext.defaultParallelism
    if docs.rdd.getNumPartitions() < cores:  # one small file is one task: deal it out; large tables have splits enough
        docs = docs.repartition(cores)
    age = F.make_dt_interval(F.col("doc_id") % 63, F.col("doc_id") % 24)
    return docs.select(F.col("doc_id").alias("turn_id"), F.col("source").alias("project"), (F.lit(NOW) - age).alias("ts"), F.coalesce("text", F.lit("")).alias("text"))


def vectors(spark: SparkSession, sf_dir: str, ranked: DataFrame) -> DataFrame:
    """word, v: the r-th most frequent lemma has the r-th embedding."""
    emb = table(spark, sf_dir, "embeddings").select((F.col("vec_id") + 1).alias("r"), F.col("embedding").alias("v"))
    return normalized(ranked.join(emb, "r").select(F.col("lemma").alias("word"), "v"))


def taxonomy(spark: SparkSession, sf_dir: str) -> Thesaurus:
    """Regions over nations over suppliers as a hypernym tree; counts of customers below a node as its weight."""
    region, nation, supplier, customer = (table(spark, sf_dir, n) for n in ("region", "nation", "supplier", "customer"))
    word = lambda c: F.translate(F.lower(c), " ", "_")
    r = region.select(F.concat(F.lit("r"), "r_regionkey").alias("key"), word("r_name").alias("w"))
    n = nation.select(F.concat(F.lit("n"), "n_nationkey").alias("key"), word("n_name").alias("w"), F.concat(F.lit("r"), "n_regionkey").alias("up"))
    s = supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("key"), word("s_name").alias("w"), F.concat(F.lit("n"), "s_nationkey").alias("up"))
    nodes = r.unionByName(n.select("key", "w")).unionByName(s.select("key", "w"))
    synset = nodes.select("key", F.lit("n").alias("pos"), F.concat(F.lit("node "), "w").alias("gloss"))
    words = nodes.select("key", F.lit(0).alias("ord"), F.col("w").alias("word")).unionByName(s.select("key", F.lit(1).alias("ord"), F.concat("w", F.lit("_co")).alias("word")))
    ptr = lambda df: df.select("key", F.lit(0).alias("ord"), F.lit("@").alias("sym"), F.col("up").alias("target"))
    below = customer.groupBy(F.concat(F.lit("n"), "c_nationkey").alias("key")).agg(F.count("*").alias("c"))
    by_region = below.join(n, "key").groupBy(F.col("up").alias("key")).agg(F.sum("c").alias("c"))
    counts = below.unionByName(by_region)
    ic = counts.crossJoin(F.broadcast(customer.agg(F.count("*").alias("all")))).select("key", (-F.ln(F.col("c") / F.col("all"))).alias("ic"))
    freq = s.join(below.select(F.col("key").alias("up"), "c"), "up", "left").select(F.col("w").alias("lemma"), F.coalesce("c", F.lit(0)).alias("n"))
    index = nodes.select(F.lit("n").alias("pos"), F.col("w").alias("lemma"), F.lit(0).alias("sense_ord"), "key")
    return Thesaurus(index, synset, words, ptr(n).unionByName(ptr(s)), ic, freq)
