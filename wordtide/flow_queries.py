"""Queries of the flows that keep state between runs, over the driver's tables, with their DuckDB twins.

Each runs its flow more than once, as it would be over days, and returns what it then holds.
"""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import gate, ledger, postings, thesaurus, tokens
from .options import SCAN
from .plans import display, partials
from .queries import _FENCED, _LADDER, _LEDGER, ORACLE, STOP, SWAPS, _ladders, _lemma, _query, _rounded, _top
from .sources import files
from .sources.adapters import NOW, table, turns
from .work import cut, place, rename_files


def _scripted(word: str, ladder: list[str], samples: list[list[str]]) -> str:
    """A judge of fixed opinions: by the word's last three digits it fails, accepts, or answers what must be refused."""
    k, first = int(word[-3:]) % 5, ladder[0] if ladder else "none"
    if k == 0:
        raise TimeoutError
    role, to = [("term_of_art", "none"), ("tic", first), ("mixed", "no such rung"), ("term_of_art", first)][k - 1]
    return json.dumps({"role": role, "demote_to": to, "note": f"{len(samples)} samples"})


@_query(
    f"""{_LADDER}, w AS (SELECT lemma, list(word ORDER BY rung_ord) AS ws FROM lad GROUP BY lemma),
o AS (SELECT lemma AS word, CAST(right(lemma, 3) AS INT) AS k, list_filter(list_slice(ws, greatest(list_position(ws, lemma) - 4, 1), list_position(ws, lemma)), lambda x: x <> lemma) AS rungs FROM w),
a AS (SELECT *, coalesce(rungs[1], 'none') AS first, k % 5 IN (1, 2) OR (k % 5 = 4 AND len(rungs) = 0) AS good FROM o)
SELECT word, CASE WHEN good THEN CASE k % 5 WHEN 2 THEN 'tic' ELSE 'term_of_art' END END AS role, CASE WHEN good THEN CASE WHEN k % 5 = 2 AND first <> 'none' THEN first ELSE '' END END AS demote_to,
  CASE WHEN good THEN CASE WHEN k % 2 = 0 THEN 'log' ELSE 'asked' END END AS origin,
  CAST(CASE WHEN k % 5 = 0 THEN 0 WHEN good OR k % 2 = 1 THEN 1 ELSE 2 END AS BIGINT) AS logged FROM a"""
)
def judge_gate(spark: SparkSession, d: str) -> DataFrame:
    """Every other word is judged in a first run, then all of them: what the log answers is not asked again, what was refused or failed is."""
    ordered = F.array_sort(F.collect_list(F.struct("rung_ord", "word")))
    words = _ladders(spark, d).groupBy("lemma").agg(F.transform(ordered, lambda x: x["word"]).alias("ws"))
    samples = F.array().cast("array<array<string>>")
    asks = cut(words.select(F.col("lemma").alias("word"), thesaurus.demote_options(F.col("ws"), F.col("lemma")).alias("ladder"), samples.alias("samples")), "query-asks")
    judge = gate.Gate(_scripted, place(spark, "query-verdicts"), "scripted", 1, batch=16)
    judge(asks.filter(F.right("word", F.lit(3)).cast("int") % 2 == 0))
    said = judge(asks)
    logged = files.verdict_log(spark, judge.log).groupBy("word").agg(F.count("*").alias("logged"))
    out = asks.select("word").join(said, "word", "left").join(logged, "word", "left")
    return out.select("word", "role", "demote_to", "origin", F.coalesce("logged", F.lit(0)).alias("logged"))


@_query(f"{_LEDGER} SELECT * REPLACE (round(first_rate, 6) AS first_rate, round(last_rate, 6) AS last_rate) FROM g")
def ledger_merged(spark: SparkSession, d: str) -> DataFrame:
    """The ledger from partials of four groups of refreshes and three of injections, merged out of order and compacted once."""
    e = table(spark, d, "events")
    keys = [F.date_trunc("day", "ts").cast("timestamp_ntz").alias("refresh_at"), F.concat(F.lit("w"), "user_id").alias("lemma"), F.when(F.col("user_id") % 3 == 0, "riser").otherwise("chronic").alias("kind")]
    rows = e.groupBy(*keys).agg(F.avg("value").alias("rate"), (F.count("*") % 2 == 0).alias("known"))
    lemma = F.when(F.col("event_id") % 5 == 0, "stray").otherwise(F.concat(F.lit("w"), "user_id"))
    shown = e.filter("event_id % 3 = 0 AND user_id % 4 <> 1").select("event_id", lemma.alias("lemma"))
    of = lambda g: ledger.partial(rows.filter(F.dayofyear("refresh_at") % 4 == g), shown.filter(F.col("event_id") % 7 % 3 == g) if g < 3 else None)
    base = cut(ledger.merged(of(2), of(0)), "query-ledger")
    return _rounded(ledger.of_partial(ledger.merged(of(3), base, of(1)), rows.select("refresh_at")), "first_rate", "last_rate")


_RUN = r"""x AS (SELECT conv_id, turn, ord, line, regexp_matches(line, '^\s{0,3}(```+|~~~+)') AS is_fence FROM m),
p AS (SELECT *, coalesce(sum(is_fence::INT) OVER (PARTITION BY conv_id ORDER BY turn, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS in_fence FROM x)"""


@_query(
    rf"""WITH {_FENCED}, {_RUN}, b AS (SELECT conv_id, turn, bool_or(in_fence) FILTER (WHERE ord = 0) AS in_fence FROM p GROUP BY ALL),
w AS (SELECT conv_id, turn, lower(unnest(regexp_extract_all(line, '[\p{{L}}][\p{{L}}''-]*'))) AS x FROM p WHERE NOT is_fence AND NOT in_fence),
n AS (SELECT conv_id, turn, count(*) FILTER (WHERE CASE WHEN x IN ('the', 'des', 'die') THEN x ELSE {_lemma("x")} END IN ('the', 'des', 'die')) AS n FROM w GROUP BY ALL)
SELECT 'c' || conv_id AS session_id, turn + 1 AS batch_seq, coalesce(n, 0) AS n_swaps, coalesce(n, 0) AS logged FROM b LEFT JOIN n USING (conv_id, turn)"""
)
def display_stream(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as one message each, their turns as deltas that arrive in any order in three micro-batches: what was shown, and what the log says of it."""
    c = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n", -1)).alias("ord", "said"))
    kind = F.length("said") % 7
    opened = F.concat(F.repeat(F.lit(" "), F.length("said") % 5), F.lit("```"), "said")
    lines = c.withColumn("line", F.when(kind == 0, opened).when(kind == 3, "~~~~").otherwise(F.col("said")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n")
    deltas = lines.groupBy("conv_id", "turn").agg(text.alias("delta"))
    deltas = deltas.select(F.concat(F.lit("c"), "conv_id").alias("session_id"), F.lit("m").alias("message_id"), (F.col("turn") + 1).alias("batch_seq"), "delta")
    source, out, log = (place(spark, f"query-{x}") for x in ("deltas", "shown", "swaps"))
    deltas.repartition(3, F.xxhash64("session_id", "batch_seq")).write.json(source)
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(deltas.schema).option("maxFilesPerTrigger", 1).json(source)
        run = display.display(stream, place(spark, "query-state"), out, place(spark, "query-checkpoint"), log, SWAPS, wait_ms=None, clock=lambda: datetime(2024, 3, 4)).trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        spark.conf.set(provider, before)
    shown = display.shown(spark, out)
    n = F.aggregate("swaps", F.lit(0).cast("long"), lambda a, s: a + s["n"])
    # the log has no session; its rows are set against what was shown by micro-batch and lemma, so all of them must agree
    logged = files.swap_log(spark, log).groupBy("lemma", "to").agg(F.sum("n").alias("all"))
    said = shown.select(F.explode("swaps").alias("s")).groupBy(F.col("s.lemma").alias("lemma"), F.col("s.to").alias("to")).agg(F.sum("s.n").alias("seen"))
    off = said.join(logged, ["lemma", "to"], "full").agg(F.coalesce(F.sum(F.abs(F.coalesce("seen", F.lit(0)) - F.coalesce("all", F.lit(0)))), F.lit(0)).alias("off"))
    return shown.crossJoin(F.broadcast(off)).select("session_id", "batch_seq", n.alias("n_swaps"), (n + F.col("off")).alias("logged"))


def _transcripts(df: DataFrame, root: str) -> None:
    """Turns as transcripts under ``root``, a folder for each project."""
    said = F.struct(F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))).alias("content"))
    line = F.to_json(F.struct(F.lit("assistant").alias("type"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), said.alias("message")))
    df.select(F.coalesce("project", F.lit("none")).alias("project"), line.alias("value")).write.mode("append").partitionBy("project").text(root)
    rename_files(df.sparkSession, root, ".txt", ".jsonl")


@_query(ORACLE["rising_lemmas"])
def rising_from_partials(spark: SparkSession, d: str) -> DataFrame:
    """Documents as transcripts that come in two parts; each is counted when it is there, and the scan reads counts only."""
    root, state = place(spark, "query-transcripts"), place(spark, "query-partials")
    docs = turns(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    for part in range(2):
        _transcripts(docs.filter(F.col("turn_id") % 2 == part), root)
        partials.update(spark, root, state, partials.EVER, STOP)
    return _rounded(partials.scan(spark, root, state, NOW, STOP, partials.EVER, SCAN), "recent_rate", "baseline_rate", "ratio", "score")


@_query(ORACLE["uses_sample"])
def uses_from_postings(spark: SparkSession, d: str) -> DataFrame:
    """The sample of the uses of 40 lemmas from the stored index of all."""
    path = place(spark, "query-postings")
    # texts are read twice: a copy of their sentences would lie on the disk beside the index
    asked = [r.lemma for r in _top(tokens.tokens(turns(spark, d), STOP), 40).collect()]
    postings.write(tokens.stored(tokens.sentences(turns(spark, d), STOP).select("turn_id", "sent_no", "tokens")), path)
    return postings.uses(postings.of_lemmas(spark, path, asked), 50)
