"""Turns from a tree of JSONL transcripts: <root>/<project>/<session>.jsonl."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Longest line read, and the folder name that is passed over.
MAX_LINE_BYTES = 64 << 20
SKIPPED = "subagents"
RFC3339 = r"^\d{4}-\d\d-\d\d[Tt]\d\d:\d\d:\d\d(?:\.\d+)?(?:[Zz]|[+-]\d\d:\d\d)$"
LINE = "type string, isSidechain boolean, timestamp string, message struct<content:string>"


def _text(content: Column) -> Column:
    """Non-empty text blocks of a content array joined by newlines; null for any other shape."""
    is_list = F.left(F.ltrim(content), F.lit(1)) == "["
    blocks = F.from_json(content, "array<struct<type:string,text:string>>")
    said = F.filter(blocks, lambda b: (b["type"] == "text") & (F.coalesce(b["text"], F.lit("")) != ""))
    joined = F.array_join(F.transform(said, lambda b: b["text"]), "\n")
    return F.when(is_list & (F.size(said) > 0), joined)


def project_of(path: Column, root: Column) -> Column:
    """First component of the path under the root; a file in the root is its own project."""
    rest = F.substring(path, F.length(root) + 1, F.length(path))
    return F.get(F.split(F.ltrim(rest, F.lit("/")), "/"), F.lit(0))


def read_turns(spark: SparkSession, root: str, since: datetime, opened_from: datetime | None = None) -> DataFrame:
    """turn_id, project, ts, text of assistant turns since a time; a missing root is an error.

    Files older than ``since`` (or than ``opened_from``, if that is later) are not opened, lines that are too long or no JSON are
    skipped, and cheap filters come before content is parsed. ``turn_id`` follows path and
    line order: the rank of the file (one row per file) and the place in its split.
    """
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl")
    # a filter on file metadata prunes files before they are opened
    oldest = since if opened_from is None else max(since, opened_from)
    raw = reader.text(root).filter(F.col("_metadata.file_modification_time") >= F.lit(oldest))
    jvm = spark._jvm.org.apache.hadoop.fs.Path(root)
    full = jvm.getFileSystem(spark._jsc.hadoopConfiguration()).resolvePath(jvm).toUri().getPath()
    path = F.url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B"))
    # the place is taken right after the scan, where rows are in file order
    rows = raw.select("value", path.alias("path"), F.monotonically_increasing_id().alias("place"))
    rows = rows.withColumn("path", F.regexp_replace("path", r"^[A-Za-z]+:/*(?=/)", ""))
    rows = rows.filter(~F.col("path").contains(f"/{SKIPPED}/") & (F.octet_length("value") <= MAX_LINE_BYTES))
    line = rows.withColumn("v", F.from_json("value", LINE)).filter("v.type = 'assistant' AND NOT coalesce(v.isSidechain, false)")
    line = line.filter(F.col("v.timestamp").rlike(RFC3339)).withColumn("ts", F.try_to_timestamp("v.timestamp"))
    line = line.filter(F.col("ts") >= F.lit(since)).withColumn("text", _text(F.col("v.message.content"))).filter("text is not null")
    turn_id = F.struct("path", "place")
    return line.select(turn_id.alias("turn_id"), project_of(F.col("path"), F.lit(full)).alias("project"), "ts", "text")
