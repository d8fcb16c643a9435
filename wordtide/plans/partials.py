"""Counts of a growing tree of transcripts, kept as partials, so that a scan opens new files only.

A partial counts a file's kept tokens by lemma, project and hour, those on the hour's first instant apart, since
the weeks of a trend end with theirs and the windows of a scan begin with it. Files are known by path, time of
modification and length; one that has changed is counted anew and its former partial no longer
fits what is there. A scan or trend adds up the partials of the files that are there now. Windows
begin at whole hours, so results are those of a scan at ``now``, where that is a whole hour.

Partials are added as whole batches, each with the files it covers: an update that stops half-way leaves
nothing that counts, and the next one does its work.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import drift
from ..options import SCAN, Options
from ..sources import transcripts
from ..work import cut, discard

PARTIAL = "path string, modified timestamp, length long, lemma string, project string, hour timestamp, sharp boolean, n long"
FILE = ["path", "modified", "length"]
#: A file is counted whole, whatever a scan asks for.
EVER = datetime(1970, 1, 2)


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path, modified, length of the transcripts under a root; no file is opened."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").load(root)
    path = F.regexp_replace("path", r"^[A-Za-z]+:/*(?=/)", "")
    return found.select(path.alias("path"), F.col("modificationTime").alias("modified"), "length").filter(~F.col("path").contains(f"/{transcripts.SKIPPED}/"))


def _batches(spark: SparkSession, state: str, name: str, schema: str) -> DataFrame:
    """A table of batches of which both parts are whole: the files are written last."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{state}/files")
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []
    whole = sorted(n for n in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{state}/files/{n}/_SUCCESS")))
    return spark.read.schema(schema).parquet(*[f"{state}/{name}/{n}" for n in whole]) if whole else spark.createDataFrame([], schema)


def known_files(spark: SparkSession, state: str) -> DataFrame:
    return _batches(spark, state, "files", "path string, modified timestamp, length long")


def update(spark: SparkSession, root: str, state: str, since: datetime, stopwords: list[str]) -> int:
    """Counts the files that are new or have changed and are not older than ``since``; returns how many."""
    there = listing(spark, root).filter(F.col("modified") >= F.lit(since))
    new = cut(there.join(known_files(spark, state), FILE, "left_anti"), "new-files")
    seen = new.agg(F.count("*"), F.min("modified")).first()
    if not seen[0]:
        discard(new)
        return 0
    # files older than the oldest new one are not opened; of those that are, known ones are passed over
    turns = transcripts.read_turns(spark, root, EVER, opened_from=seen[1])
    turns = turns.withColumn("path", F.col("turn_id.path")).join(new, "path")
    kept = tx.tokens(tx.clean(F.col("text")), stopwords)
    hour = F.date_trunc("hour", "ts")
    rows = turns.select(*FILE, "project", hour.alias("hour"), (hour == F.col("ts")).alias("sharp"), F.explode(kept).alias("lemma"))
    counts = rows.groupBy(*FILE, "lemma", "project", "hour", "sharp").agg(F.count("*").alias("n"))
    name = f"{uuid.uuid4().hex}"
    counts.write.parquet(f"{state}/partials/{name}")
    new.write.parquet(f"{state}/files/{name}")
    discard(new)
    return seen[0]


def hourly(spark: SparkSession, root: str, state: str, since: datetime | None = None) -> DataFrame:
    """lemma, project, hour, sharp, n of the files that are there, as far as they are counted."""
    counts = _batches(spark, state, "partials", PARTIAL).join(listing(spark, root), FILE, "left_semi")
    return counts.filter(F.col("hour") >= F.date_trunc("hour", F.lit(since))) if since is not None else counts


def lemma_project_counts(counts: DataFrame, now: datetime, o: Options) -> DataFrame:
    """As ``drift.lemma_project_counts``, from hourly counts."""
    hour = F.col("hour")
    part = lambda inside: F.coalesce(F.sum(F.when(inside, F.col("n"))), F.lit(0))
    return counts.groupBy("lemma", "project").agg(
        part(drift.in_recent(hour, now, o)).alias("recent"), part(drift.in_baseline(hour, now, o)).alias("baseline"), F.sum("n").alias("full")
    )


def scan(spark: SparkSession, root: str, state: str, now: datetime, stopwords: list[str], since: datetime, o: Options = SCAN) -> DataFrame:
    """``commands.scan`` over what is under the root, after an update."""
    update(spark, root, state, since, stopwords)
    return drift.risers(drift.lemma_counts(lemma_project_counts(hourly(spark, root, state, since), now, o)), o)


def trend(spark: SparkSession, root: str, state: str, lemmas: Sequence[str], now: datetime, stopwords: list[str], since: datetime, weeks: int = 8) -> DataFrame:
    """``commands.trend`` over what is under the root, after an update."""
    update(spark, root, state, since, stopwords)
    asked = [tx.lemma_of(x.lower()) for x in lemmas]
    end = F.when(F.col("sharp") | (F.col("hour") >= F.lit(now)), F.col("hour")).otherwise(F.col("hour") + F.make_dt_interval(hours=F.lit(1)))
    return drift.trend(hourly(spark, root, state, since).withColumn("ts", end), asked, now, weeks, n=F.col("n"))

