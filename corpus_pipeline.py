"""The corpus pipeline: five stages, each written as Parquet and reread as the next one's documents.

A stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return
the columns of documents; sf_dir is not read by any stage, so each one judges all
that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordtide.llm import exact, langid, minhash, mixing, packing
from wordtide.llm._common import documents, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; of those that stay ``lang`` becomes the language that was found."""
    own = docs.select(*COLUMNS)
    model = langid.fit(own.filter(~langid.held_out()))
    found = langid.predict(own, model).filter(~F.col("rejected"))
    return found.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact.drop_copies(docs.select(*COLUMNS))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (five words, similarity 0.8)."""
    return minhash.drop_near_copies(docs.select(*COLUMNS), words=5, percent=80)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight asks for."""
    return mixing.mix(docs.select(*COLUMNS))


def harmonic_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: one row per piece of a document."""
    pieces = packing.pack(docs.select("doc_id", "text"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact_dedup),
    ("MinHash near-dedup", near_dedup),
    ("mixing sources to target weights", mixing_sources),
    ("packing", harmonic_packing),
]

#: SQL cannot express the classifier, the signatures or the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs, name.split()[0].lower())
    return docs
