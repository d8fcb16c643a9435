"""Words replaced while text streams by: the flow around the rewriter.

A stream of deltas gets its fence states; each micro-batch then reads the table of swaps
anew, rewrites its deltas, and stores what was shown and what was swapped. Both are stored under the
micro-batch's number: one that is replayed finds them there and adds nothing, and the log of
swaps is read off what was shown, so the two agree.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators import swaps
from ..sources import files
from ..streaming.processors import stream_fences
from . import hook

#: Fixed value: age from which a report's words are no longer replaced.
MAX_AGE = timedelta(days=7)
SHOWN = "session_id string, message_id string, batch_seq long, shown string, swaps array<struct<lemma:string,`to`:string,n:bigint>>, at timestamp"


def table_of(spark: SparkSession, state: str, now: datetime, pairs: dict[str, str] | None = None, every: bool = False, max_age: timedelta = MAX_AGE) -> dict[str, str]:
    """lemma -> replacement: of the last report unless it is too old, and the pairs that are given, which win.

    A report has some tens of entries, so its table is small.
    """
    entries = hook.entries_of_last(spark, state, now, max_age)
    return {r.lemma: r.replacement for r in swaps.swap_table(entries, pairs, every).collect()}


def show_batch(batch: DataFrame, number: int, out: str, log: str | None, table: dict[str, str], now: datetime) -> bool:
    """Shows one micro-batch (FENCED rows) under its number; false where that had been done."""
    spark = batch.sparkSession
    done = swaps.apply_swaps(batch, "delta", table, fence="in_fence")
    to = F.create_map(*[F.lit(x) for pair in table.items() for x in pair]) if table else F.create_map().cast("map<string,string>")
    swapped = F.transform("swap_counts", lambda s: F.struct(s["lemma"].alias("lemma"), F.try_element_at(to, s["lemma"]).alias("to"), s["n"].alias("n")))
    shown = done.select("session_id", "message_id", "batch_seq", F.col("swapped").alias("shown"), swapped.alias("swaps"), F.lit(now).alias("at"))
    new = files.append_batch(shown, out, f"{number:012d}", "parquet")
    if log is not None:
        rows = spark.read.schema(SHOWN).parquet(f"{out}/batch-{number:012d}").select("at", F.explode("swaps").alias("s"))
        stamp = F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
        files.append_batch(rows.select(stamp.alias("t"), F.col("s.lemma").alias("w"), F.col("s.to").alias("to"), F.col("s.n").alias("n")), log, f"{number:012d}")
    return new


def display(
    deltas: DataFrame,
    state: str,
    out: str,
    checkpoint: str,
    log: str | None = None,
    pairs: dict[str, str] | None = None,
    every: bool = False,
    max_age: timedelta = MAX_AGE,
    wait_ms: int | None = 60_000,
    clock: Callable[[], datetime] = datetime.now,
) -> DataStreamWriter:
    """A writer that shows streaming ``deltas``(session_id, message_id, batch_seq, delta); start it with a trigger.

    What was shown lies in ``out`` (SHOWN), by micro-batch; swaps go to the log at ``log``.
    """

    def each(batch: DataFrame, number: int) -> None:
        now = clock()
        show_batch(batch, number, out, log, table_of(batch.sparkSession, state, now, pairs, every, max_age), now)

    return stream_fences(deltas, wait_ms).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def shown(spark: SparkSession, out: str) -> DataFrame:
    """Everything that was shown."""
    return spark.read.schema(SHOWN).option("recursiveFileLookup", True).parquet(out)


def swap_report(spark: SparkSession, log: str, now: datetime) -> str:
    """What was replaced on screen, as text."""
    return swaps.render_totals(swaps.swap_totals(files.swap_log(spark, log)), now)
