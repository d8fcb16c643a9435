"""Windowed counts and drift scores."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..options import REPORT, Options


def in_recent(ts: Column, now: datetime, o: Options) -> Column:
    """No upper bound: a turn of the future is recent."""
    return ts >= F.lit(now) - F.make_dt_interval(F.lit(o.recent_days))


def in_baseline(ts: Column, now: datetime, o: Options) -> Column:
    start = F.lit(now) - F.make_dt_interval(F.lit(o.recent_days + o.baseline_days))
    return (ts >= start) & ~in_recent(ts, now, o)


def lemma_project_counts(tokens: DataFrame, now: datetime, o: Options = REPORT) -> DataFrame:
    """lemma, project, recent, baseline, full: one partial and one final aggregation."""
    ts = F.col("ts")
    return tokens.groupBy("lemma", "project").agg(
        F.count_if(in_recent(ts, now, o)).alias("recent"), F.count_if(in_baseline(ts, now, o)).alias("baseline"), F.count("*").alias("full")
    )


def lemma_counts(by_project: DataFrame) -> DataFrame:
    """lemma, recent, baseline, full, top_recent (its loudest project), recent_projects, projects."""
    return by_project.groupBy("lemma").agg(
        F.sum("recent").alias("recent"),
        F.sum("baseline").alias("baseline"),
        F.sum("full").alias("full"),
        F.max("recent").alias("top_recent"),
        F.count_if(F.col("recent") > 0).alias("recent_projects"),
        F.count("*").alias("projects"),
    )


def totals(lemmas: DataFrame) -> DataFrame:
    """One row: recent_total, baseline_total, full_total."""
    return lemmas.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"{c}_total") for c in ("recent", "baseline", "full")])


def turn_totals(turns: DataFrame, now: datetime, o: Options = REPORT) -> DataFrame:
    ts = F.col("ts")
    return turns.agg(
        F.count_if(in_recent(ts, now, o)).alias("recent_turns"), F.count_if(in_baseline(ts, now, o)).alias("baseline_turns"), F.count("*").alias("full_turns")
    )


def risers(lemmas: DataFrame, o: Options = REPORT) -> DataFrame:
    """Lemmas that rose outside their loudest project, best first.

    The ratio compares rates smoothed by half a use; the rates shown are not smoothed.
    The totals are one row, so joining them is a broadcast of one row.
    """
    t = lemmas.crossJoin(F.broadcast(totals(lemmas))).filter("recent_total > 0 AND baseline_total > 0")
    per = lambda n, total, add: (F.col(n) + add) / F.col(total) * 1000
    t = t.withColumn("ratio", per("recent", "recent_total", 0.5) / per("baseline", "baseline_total", 0.5))
    t = t.withColumn("outside", F.col("recent") - F.col("top_recent"))
    t = t.filter((F.col("recent") >= o.min_count) & (F.col("ratio") > 1) & (F.col("ratio") >= o.min_ratio) & (F.col("outside") > 0))
    out = t.select(
        "lemma",
        "recent",
        "outside",
        F.col("recent_projects").alias("projects"),
        per("recent", "recent_total", 0.0).alias("recent_rate"),
        per("baseline", "baseline_total", 0.0).alias("baseline_rate"),
        "ratio",
        (F.col("outside") * F.ln("ratio")).alias("score"),
    ).orderBy(F.desc("score"), "lemma")
    return out.limit(o.top) if o.top else out


def week_bucket(ts: Column, now: datetime, weeks: int) -> Column:
    """Bucket 0 to weeks - 1, the last one this week; truncates toward zero, so a near future is this week."""
    micros = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))
    return (F.lit(weeks - 1) - (micros / (7 * 86_400 * 1_000_000)).cast("long")).cast("int")


def weekly(tokens: DataFrame, now: datetime, weeks: int, n: Column | None = None) -> DataFrame:
    """lemma, bucket, n; buckets outside the range are left out. ``n`` is what a row counts for (else one)."""
    own = tokens.withColumn("bucket", week_bucket(F.col("ts"), now, weeks)).filter(F.col("bucket").between(0, weeks - 1))
    return own.groupBy("lemma", "bucket").agg((F.count("*") if n is None else F.sum(n)).alias("n"))


def trend(tokens: DataFrame, lemmas: Sequence[str] | DataFrame, now: datetime, weeks: int = 8, n: Column | None = None) -> DataFrame:
    """lemma, bucket, tokens, n, rate per thousand; rate is null where a bucket has no token (a gap)."""
    spark = tokens.sparkSession
    asked = lemmas if isinstance(lemmas, DataFrame) else spark.createDataFrame([(x,) for x in dict.fromkeys(lemmas)], "lemma string")
    counts = weekly(tokens, now, weeks, n)
    every = counts.groupBy("bucket").agg(F.sum("n").alias("tokens"))
    grid = asked.select("lemma").distinct().withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(weeks - 1))))
    out = grid.join(every, "bucket", "left").join(counts, ["lemma", "bucket"], "left")
    out = out.withColumn("tokens", F.coalesce("tokens", F.lit(0))).withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("rate", F.when(F.col("tokens") > 0, F.col("n") / F.col("tokens") * 1000))


def series(trended: DataFrame) -> DataFrame:
    """lemma, rates: one array in order of the buckets, null for gaps."""
    ordered = F.array_sort(F.collect_list(F.struct("bucket", "rate")))
    return trended.groupBy("lemma").agg(F.transform(ordered, lambda x: x["rate"]).alias("rates"))


def first_last(trended: DataFrame) -> DataFrame:
    """lemma, first_rate, last_rate over buckets that are no gap; zeros if all are."""
    there = F.when(F.col("rate").isNotNull(), F.col("bucket"))
    return trended.groupBy("lemma").agg(
        F.coalesce(F.min_by("rate", there), F.lit(0.0)).alias("first_rate"), F.coalesce(F.max_by("rate", there), F.lit(0.0)).alias("last_rate")
    )


def phrase_entries(matches: DataFrame, full_total: DataFrame, o: Options = REPORT) -> DataFrame:
    """phrase, count, projects, rate: the most used phrases over the floor; ``phrase_top`` 0 gives none.

    ``full_total``(full_total) is one row, so joining it is a broadcast of one row.
    """
    out = matches.groupBy("phrase").agg(F.count("*").alias("count"), F.count_distinct("project").alias("projects"))
    out = out.filter(F.col("count") >= o.phrase_min).crossJoin(F.broadcast(full_total.select("full_total"))).filter("full_total > 0")
    out = out.select("phrase", "count", "projects", (F.col("count") / F.col("full_total") * 1000).alias("rate"))
    return out.orderBy(F.desc("count"), "phrase").limit(o.phrase_top)


def chronic_pool(lemmas: DataFrame, flagged: DataFrame | None, o: Options = REPORT) -> DataFrame:
    """lemma, full, projects, rate: high over the whole history in enough projects and not flagged yet."""
    t = lemmas.crossJoin(F.broadcast(totals(lemmas))).filter("full_total > 0").withColumn("rate", F.col("full") / F.col("full_total") * 1000)
    t = t.filter((F.col("rate") >= o.min_chronic_rate) & (F.col("projects") >= o.min_projects))
    if flagged is not None:
        t = t.join(flagged.select("lemma"), "lemma", "left_anti")
    return t.select("lemma", "full", "projects", "rate")


def cascade(pool: DataFrame, o: Options = REPORT) -> DataFrame:
    """Takes the pool's lemmas by route: curated first, then framed, then rare, each up to its budget.

    ``pool``(lemma, rate, known, frame_frac, word_ic). A lemma is looked at by a later route
    only if the earlier one did not take it. The pool is the few lemmas over the rate floor.
    """
    order = Window.partitionBy("open").orderBy(F.desc("rate"), "lemma")
    out = pool.withColumn("route", F.lit(None).cast("string"))
    rare = (F.octet_length("lemma") >= o.rarity_bytes) & (F.col("word_ic") >= o.rarity_floor)
    for name, test in (("known", F.col("known")), ("frame", F.col("frame_frac") >= o.frame_floor), ("rarity", rare)):
        out = out.withColumn("open", F.col("route").isNull() & F.coalesce(test, F.lit(False)))
        taken = F.col("open") & (F.row_number().over(order) <= o.chronic_top)
        out = out.withColumn("route", F.when(taken, F.lit(name)).otherwise(F.col("route")))
    return out.filter("route is not null").drop("open")
