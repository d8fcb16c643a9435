"""Vector tables, curated lists, logs and report documents."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import lemma_of
from ..operators.vectors import normalized
from . import store

#: Fixed value: largest report document that is read.
MAX_REPORT_BYTES = 8 << 20
VERDICTS = "word string, ladder_hash string, model string, schema_version int, role string, demote_to string, note string, well_formed boolean, safe boolean, at string"
SWAPS = "t timestamp, w string, `to` string, n long"


def read_vectors(spark: SparkSession, path: str, vocabulary: DataFrame | None = None, kind: str = "float") -> DataFrame:
    """word, v (unit, floats or another ``kind``) of a text table "word f1 f2 ...".

    The dimension is that of the first kept line; other lengths, words with a part that is
    no number and zero vectors are dropped; of lines for one word the last wins. With a
    vocabulary only its words are parsed. Files of a folder follow each other by name.
    """
    line = F.trim("value")
    # files are read in an order of their sizes, so ids alone do not tell which line comes first
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    rows = spark.read.text(path).select(F.substring_index(line, " ", 1).alias("word"), line.alias("line"), place.alias("place"))
    if vocabulary is not None:  # the line is whole until its word is known to be asked for
        rows = rows.join(vocabulary.select("word").distinct(), "word", "left_semi")
    rows = rows.withColumn("f", F.split("line", " +"))
    rows = rows.select("word", F.slice("f", F.lit(2), F.greatest(F.size("f") - 1, F.lit(0))).alias("s"), "place").withColumn("v", F.transform("s", lambda x: x.try_cast("float"))).filter(~F.exists("v", lambda x: x.isNull()) & (F.size("v") > 0))
    dim = rows.agg(F.min_by(F.size("v"), "place").alias("dim"))
    rows = rows.crossJoin(F.broadcast(dim)).filter(F.size("v") == F.col("dim"))
    last = rows.groupBy("word").agg(F.max_by("v", "place").alias("v"))
    return normalized(last, kind)


def curated_list(spark: SparkSession, path: str, seed: list[str]) -> tuple[list[str], list[str]]:
    """Words (lemmas) and phrases of a list; the first use copies the seed to the path."""
    try:
        held = store.read_bytes(spark, path)
        if held is None:
            held = ("\n".join(seed) + "\n").encode()
            store.write_bytes(spark, path, held)
        lines = held.decode("utf-8", "replace").splitlines()
    except Exception:  # noqa: BLE001 - where the store cannot be read or written the seed serves
        lines = seed
    own = [x.strip().lower() for x in lines]
    own = [x for x in own if x and not x.startswith("#")]
    return list(dict.fromkeys(lemma_of(x) for x in own if " " not in x)), list(dict.fromkeys(x for x in own if " " in x))


def proper_nouns(spark: SparkSession, *paths: str) -> list[str]:
    out: dict[str, None] = {}
    for path in paths:
        for line in (store.read_bytes(spark, path) or b"").decode("utf-8", "replace").splitlines():
            if (x := line.strip()) and not x.startswith("#"):
                out[lemma_of(x.lower())] = None
    return list(out)


#: Order of a log's rows: time and name of the file, place in it.
SEQ = "struct<written:timestamp,file:string,place:bigint>"


def _log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a file, or of all files of a folder, with ``seq`` in the order in which they were
    written; malformed lines are skipped, an absent log is empty."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], f"{schema}, seq {SEQ}")
    seq = F.struct(F.col("_metadata.file_modification_time").alias("written"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("place"))
    rows = spark.read.option("recursiveFileLookup", True).text(path).select("value", seq.alias("seq"))
    parsed = rows.select(F.from_json("value", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("v"), "seq")
    return parsed.filter("v is not null AND v._corrupt is null").select("v.*", "seq").drop("_corrupt")


def verdict_log(spark: SparkSession, path: str) -> DataFrame:
    return _log(spark, path, VERDICTS).filter("word is not null")


def swap_log(spark: SparkSession, path: str) -> DataFrame:
    return _log(spark, path, SWAPS).filter("coalesce(w, '') <> ''").withColumnRenamed("w", "lemma")


def append_batch(rows: DataFrame, path: str, batch: str, kind: str = "json") -> bool:
    """Adds rows to a log as the batch of that name; a batch that is already whole is left as it is, half a one is replaced."""
    spark = rows.sparkSession
    target = f"{path.rstrip('/')}/batch-{batch}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/_SUCCESS")
    if done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        return False
    rows.write.mode("overwrite").format(kind).save(target)
    return True


def read_report(spark: SparkSession, path: str) -> dict | None:
    """The newest version of the report document; none if absent, refused if a link or too large."""
    held = store.latest(spark, path, MAX_REPORT_BYTES)
    return None if held is None else json.loads(held)


def write_document(spark: SparkSession, document: dict, path: str) -> int:
    """Publishes a version of a document; a reader sees the one before or this one, whole."""
    return store.publish(spark, path, json.dumps(document, ensure_ascii=False, default=str).encode())
