"""What the operators of this subpackage share: the shared work folder and code shipping."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: blank and tab to carriage return.
SPACE_CLASS = r"\x20\x09-\x0D"
WORD_PATTERN = rf"[^{SPACE_CLASS}]+"


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path in the folder that driver and executors share.

    The cluster names the folder in ``spark.checkpoint.dir``. Only where that is
    unset (tests, one machine) a local folder is made and set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = getattr(spark, "_wordtide_dir", None)
        if not root:
            root = spark._wordtide_dir = tempfile.mkdtemp(prefix="wordtide-")
            spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str, codec: str = "zstd") -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    try:
        df.write.option("compression", codec).parquet(path)
    finally:  # what nobody discards goes when the driver ends, also after a failure
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that nothing still to be computed reads."""
    for df in tables:
        if path := getattr(df, "_written_to", None):
            sc = df.sparkSession.sparkContext
            place = sc._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once, so that Python workers can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_wordtide_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    path = os.path.join(tempfile.mkdtemp(prefix="wordtide-code-"), f"{top.name}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent).as_posix())
    sc.addPyFile(path)
    sc._wordtide_shipped = True


def tidy(run: Callable) -> Callable:
    """``run`` of batches; what Arrow keeps in reserve goes after the last one, since workers live on beside other stages."""

    def runs(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return runs


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def text_of(col: str | Column) -> Column:
    """A text as operators see it: null is the empty text."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df
