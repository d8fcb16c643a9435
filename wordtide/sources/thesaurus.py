"""Thesaurus text files: data.<pos>, index.<pos>, index.sense and an information-content table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators.thesaurus import Thesaurus

#: File suffixes and their part-of-speech letters.
FILES = {"noun": "n", "verb": "v", "adj": "a", "adv": "r"}


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).filter((F.col("value") != "") & ~F.col("value").startswith("  "))


def data_file(spark: SparkSession, path: str, pos: str) -> DataFrame:
    """key, pos, gloss, words (array of word), ptrs (array of sym, target); malformed lines are skipped."""
    rows = _lines(spark, path).withColumn("f", F.split(F.trim(F.substring_index("value", "|", 1)), r"\s+"))
    rows = rows.withColumn("gloss", F.trim(F.when(F.instr("value", "|") > 0, F.regexp_replace("value", r"^[^|]*\|", "")).otherwise("")))
    n = F.conv(F.get("f", F.lit(3)), 16, 10).try_cast("int")
    rows = rows.filter(F.get("f", F.lit(3)).rlike("^[0-9A-Fa-f]+$")).withColumn("n", n).filter("n > 0 AND size(f) >= 5 + 2 * n")
    rows = rows.withColumn("words", F.expr("transform(sequence(0, n - 1), i -> get(f, 4 + 2 * i))"))
    rows = rows.withColumn("p", F.expr("try_cast(get(f, 4 + 2 * n) as int)")).filter("p >= 0 AND size(f) >= 5 + 2 * n + 4L * p")
    quads = F.expr(
        "CASE WHEN p > 0 THEN transform(sequence(0, p - 1), i -> struct(get(f, 5 + 2 * n + 4 * i) as sym, get(f, 6 + 2 * n + 4 * i) as offset, get(f, 7 + 2 * n + 4 * i) as pos)) "
        "ELSE cast(array() as array<struct<sym:string,offset:string,pos:string>>) END"
    )
    ptrs = F.transform(quads, lambda q: F.struct(q["sym"].alias("sym"), F.concat(q["offset"], tx.norm_pos(q["pos"])).alias("target")))
    key = F.concat(F.get("f", F.lit(0)), F.lit(pos))
    return rows.select(key.alias("key"), F.lit(pos).alias("pos"), "gloss", "words", ptrs.alias("ptrs"))


def index_file(spark: SparkSession, path: str, pos: str) -> DataFrame:
    """pos, lemma, sense_ord, key; of lines for one lemma the last wins."""
    rows = _lines(spark, path).select(F.split(F.trim("value"), r"\s+").alias("f"), F.monotonically_increasing_id().alias("place"))
    rows = rows.withColumn("n", F.expr("try_cast(get(f, 2) as int)")).filter("n > 0 AND size(f) > n")
    last = rows.groupBy(F.get("f", F.lit(0)).alias("lemma")).agg(F.max_by(F.struct("f", "n"), "place").alias("r"))
    keys = F.expr("slice(r.f, size(r.f) - r.n + 1, r.n)")
    return last.select("lemma", F.posexplode(keys).alias("sense_ord", "offset")).select(F.lit(pos).alias("pos"), "lemma", "sense_ord", F.concat("offset", F.lit(pos)).alias("key"))


def sense_counts(spark: SparkSession, path: str) -> DataFrame:
    """lemma, n: tag counts by the part of the sense key before %; lines of other than four fields are skipped."""
    rows = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("f")).filter("size(f) = 4")
    return rows.groupBy(F.substring_index(F.get("f", F.lit(0)), "%", 1).alias("lemma")).agg(F.sum(F.expr("coalesce(try_cast(get(f, 3) as bigint), 0)")).alias("n"))


def ic_table(spark: SparkSession, path: str) -> DataFrame:
    """key, ic: -ln(count / counts of the roots of its part of speech)."""
    rows = spark.read.text(path).filter(~F.col("value").startswith("wnver")).select(F.split(F.trim("value"), r"\s+").alias("f")).filter("size(f) >= 2")
    entry = F.get("f", F.lit(0))
    rows = rows.select(
        F.lpad(F.regexp_extract(entry, r"^(\d+)", 1), 8, "0").alias("offset"),
        F.regexp_extract(entry, r"^\d+([a-z])$", 1).alias("pos"),
        F.expr("try_cast(get(f, 1) as double)").alias("count"),
        (F.coalesce(F.get("f", F.lit(2)), F.lit("")) == "ROOT").alias("root"),
    ).filter("pos <> '' AND count > 0")
    roots = rows.filter("root").groupBy("pos").agg(F.sum("count").alias("all"))
    return rows.join(roots, "pos").select(F.concat("offset", "pos").alias("key"), (-F.ln(F.col("count") / F.col("all"))).alias("ic"))


def read(spark: SparkSession, directory: str, ic_path: str | None = None) -> Thesaurus:
    """All files of a thesaurus directory; every data and index file must exist."""
    data = index = None
    for name, pos in FILES.items():
        d, i = data_file(spark, f"{directory}/data.{name}", pos), index_file(spark, f"{directory}/index.{name}", pos)
        data, index = (d, i) if data is None else (data.unionByName(d), index.unionByName(i))
    words = data.select("key", F.posexplode("words").alias("ord", "word"))
    ptrs = data.select("key", F.posexplode("ptrs").alias("ord", "p")).select("key", "ord", "p.sym", "p.target")
    ic = ic_table(spark, ic_path) if ic_path else spark.createDataFrame([], "key string, ic double")
    return Thesaurus(index, data.select("key", "pos", "gloss"), words, ptrs, ic, sense_counts(spark, f"{directory}/index.sense"))
