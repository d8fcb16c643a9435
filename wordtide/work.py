"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def place(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder of ``spark.checkpoint.dir``; only where that is absent (tests, one machine) in a local one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_wordtide_work", None)
    if not root:
        root = spark._wordtide_work = tempfile.mkdtemp(prefix="wordtide-work-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def at_exit(spark: SparkSession, path: str) -> None:
    """What is still there when the driver ends, also after a failure, goes then."""
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    top.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(top)


def rename_files(spark: SparkSession, root: str, ending: str, to: str) -> None:
    """Gives files under ``root`` another ending, in whatever store they lie."""
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.listFiles(top, True)
    names = []
    while found.hasNext():
        names.append(found.next().getPath().toString())
    for n in names:
        if n.endswith(ending):
            old, new = (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (n, n.removesuffix(ending) + to))
            fs.rename(old, new)


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back.

    Several branches of a large plan then share one small scan: neither the analysis nor
    the work is repeated, and a lost executor loses nothing.
    """
    spark = df.sparkSession
    path = place(spark, name)
    try:
        df.write.parquet(path)
    finally:
        at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``cut`` that nothing still to be computed reads."""
    for df in tables:
        if path := getattr(df, "_cut_to", None):
            spark = df.sparkSession
            top = spark._jvm.org.apache.hadoop.fs.Path(path)
            top.getFileSystem(spark._jsc.hadoopConfiguration()).delete(top, True)
