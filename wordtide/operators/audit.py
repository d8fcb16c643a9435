"""Audit of a curated list: what each entry catches and why it is or is not reported."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Statuses in order of precedence.
STATUSES = ("reported", "never fires", "read as name", "term of art", "below cutoff")


def run(curated: DataFrame, uses: DataFrame, full_total: DataFrame, ranks: DataFrame, names: DataFrame, terms: DataFrame) -> DataFrame:
    """curated(term, is_phrase), uses(term, project, n), full_total(full_total), ranks(term, rank), names(lemma), terms(word)
    -> term, is_phrase, hits, projects, rate, rank, status; most hits first."""
    counts = uses.groupBy("term").agg(F.sum("n").alias("hits"), F.count_distinct("project").alias("projects"))
    out = curated.join(counts, "term", "left").join(ranks.groupBy("term").agg(F.max("rank").alias("rank")), "term", "left")
    out = out.join(names.select(F.col("lemma").alias("term"), F.lit(True).alias("is_name")).distinct(), "term", "left")
    out = out.join(terms.select(F.col("word").alias("term"), F.lit(True).alias("is_term")).distinct(), "term", "left")
    out = out.crossJoin(F.broadcast(full_total)).withColumns({c: F.coalesce(c, F.lit(0)) for c in ("hits", "projects", "rank")})
    status = (
        F.when(F.col("rank") > 0, STATUSES[0])
        .when(F.col("hits") == 0, STATUSES[1])
        .when(~F.col("is_phrase") & F.col("is_name"), STATUSES[2])
        .when(F.col("is_term"), STATUSES[3])
        .otherwise(STATUSES[4])
    )
    rate = F.when(F.col("full_total") > 0, F.col("hits") / F.col("full_total") * 1000).otherwise(0.0)
    return out.select("term", "is_phrase", "hits", "projects", rate.alias("rate"), "rank", status.alias("status")).orderBy(F.desc("hits"), "term")


def tallies(audited: DataFrame) -> DataFrame:
    """One row: entries by status, and those that only one project used once or twice."""
    by = [F.count_if(F.col("status") == s).alias(s.replace(" ", "_")) for s in STATUSES]
    return audited.agg(*by, F.count_if((F.col("projects") == 1) & (F.col("hits") <= 2)).alias("self_cited"))


def never(audited: DataFrame) -> DataFrame:
    return audited.filter(F.col("status") == STATUSES[1])
