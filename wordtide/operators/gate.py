"""The judge as a flow: verdicts that the log holds are served, the rest is asked for, once, and logged.

A verdict is known by word, set of rungs, model and version. What no accepted verdict of the log
answers goes to executors in batches of a bounded size, with a bounded number of calls in flight in
each. Answers are written before anything reads them, so neither a lost executor nor a second
branch of the plan logs one twice, and are appended to the log as one batch. An answer that is malformed or
incoherent is logged, since the log is also what calibration reads, but never served: the
next run asks again. A call that fails leaves no row. A word without a verdict keeps its entry.
"""

from __future__ import annotations

import json
import math
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import files
from ..work import cut, discard
from . import verdicts

#: Given a word, the rungs that it may be demoted to and samples of its use: a raw answer; raises where there is none.
Ask = Callable[[str, list[str], list[list[str]]], str]
JUDGED = "word string, role string, demote_to string, note string, origin string"
_ANSWERS = "word string, ladder_hash string, ladder array<string>, raw string, failure string"


def ladder_hash(ladder: Column) -> Column:
    """Fixed format: the first 16 hex digits of SHA-256 over the sorted rungs, joined by a zero character."""
    return F.left(F.sha2(F.array_join(F.array_sort(F.coalesce(ladder, F.array().cast("array<string>"))), "\x00"), 256), F.lit(16))


def _asking(ask: Ask, at_once: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(row) -> tuple[str | None, str | None]:
            try:
                return str(ask(row.word, list(row.ladder), [list(s) for s in row.samples])), None
            except Exception as e:  # noqa: BLE001 - whatever fails is no answer
                return None, f"{type(e).__name__}: {e}"[:500]

        with ThreadPoolExecutor(at_once) as pool:
            for b in batches:
                rows = list(b.itertuples(index=False))
                got = list(pool.map(one, rows))
                yield pd.DataFrame({"word": b["word"], "ladder_hash": b["ladder_hash"], "ladder": b["ladder"], "raw": [g[0] for g in got], "failure": [g[1] for g in got]})

    return run


def graded(answers: DataFrame) -> DataFrame:
    """Raw answers as rows of the log: role, demote_to, note, well_formed, safe."""
    v = F.from_json("raw", "role string, demote_to string, note string")
    text = lambda name: F.coalesce(v[name], F.lit(""))
    ok = verdicts.well_formed(F.col("raw"), F.col("ladder"))
    return answers.select(
        "word", "ladder_hash", text("role").alias("role"), F.when(text("demote_to") == verdicts.NONE, "").otherwise(text("demote_to")).alias("demote_to"), text("note").alias("note"),
        ok.alias("well_formed"), (ok & verdicts.safe(v["role"], v["demote_to"])).alias("safe"),
    )


@dataclass(frozen=True)
class Gate:
    """Judges words through ``ask``, with the log of verdicts as its cache."""

    ask: Ask
    log: str
    model: str
    version: int
    batch: int = 8
    at_once: int = 4

    def __call__(self, asks: DataFrame) -> DataFrame:
        """``asks``(word, ladder, samples) -> JUDGED: one row for each word with a verdict, origin ``log`` or ``asked``."""
        spark = asks.sparkSession
        first = Window.partitionBy("word", "ladder_hash").orderBy(F.to_json("samples"))
        own = asks.select("word", "ladder", "samples", ladder_hash(F.col("ladder")).alias("ladder_hash"))
        own = cut(own.withColumn("__r", F.row_number().over(first)).filter("__r = 1").drop("__r"), "asks")
        known = verdicts.cache(files.verdict_log(spark, self.log)).filter((F.col("model") == self.model) & (F.col("schema_version") == self.version % 10))
        known = cut(known.select("word", "ladder_hash", "role", "demote_to", "note").join(own.select("word", "ladder_hash"), ["word", "ladder_hash"], "left_semi"), "known")
        missing = own.join(known, ["word", "ladder_hash"], "left_anti")
        n = missing.count()
        served = known.select("word", "role", F.coalesce("demote_to", F.lit("")).alias("demote_to"), "note", F.lit("log").alias("origin"))
        if not n:
            discard(own)
            return served
        # a word goes to a task of some others: the number of calls in a task does not grow with their number
        dealt = missing.repartition(math.ceil(n / self.batch))
        answers = cut(dealt.mapInPandas(_asking(self.ask, self.at_once), _ANSWERS), "answers")
        rows = cut(graded(answers.filter("raw is not null")), "graded")
        now = datetime.now(UTC)
        if not rows.isEmpty():
            files.append_batch(verdicts.record(rows.coalesce(1), self.model, self.version), self.log, f"{now:%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}")
        discard(own, answers)
        new = rows.filter("well_formed AND safe").select("word", "role", "demote_to", "note", F.lit("asked").alias("origin"))
        return served.unionByName(new)


def within_budget(candidates: DataFrame, judge: Callable[[DataFrame], DataFrame], most: Column) -> tuple[DataFrame, int]:
    """``candidates``(lemma, budget, place, options, samples) -> those that a budget admits, with role, demote_to and note.

    Terms of art go and do not count, so the next of their budget moves up and is asked in the next
    round; the words asked are those that going through a budget one by one would ask. Without a
    verdict a candidate stays. Returns the rows and the number of rounds.
    """
    order = Window.partitionBy("budget").orderBy("place", "lemma")
    blank = [F.lit(None).cast("string").alias(c) for c in ("role", "demote_to", "note")]
    judged = cut(candidates.limit(0).select("lemma", *blank), "judged")
    rounds = 0
    while True:
        live = candidates.join(judged.withColumn("asked", F.lit(True)), "lemma", "left").filter("coalesce(role, '') <> 'term_of_art'")
        live = live.withColumn("used", F.row_number().over(order)).filter(F.col("used") <= most)
        new = cut(live.filter("asked is null").select(F.col("lemma").alias("word"), F.col("options").alias("ladder"), "samples"), "asked")
        if new.isEmpty():
            return live.drop("asked", "used"), rounds
        rounds += 1
        said = judge(new).select(F.col("word").alias("lemma"), "role", "demote_to", "note")
        judged = cut(judged.unionByName(new.select(F.col("word").alias("lemma")).join(said, "lemma", "left")), "judged")


@dataclass(frozen=True)
class HttpJudge:
    """An ``Ask`` over HTTP: the question as JSON to ``endpoint``, the answer's text read from the reply.

    ``headers`` may name environment variables of the executors ("${KEY}"), so that no secret is part of a plan.
    """

    endpoint: str
    model: str
    instructions: str
    headers: dict[str, str] = field(default_factory=dict)
    timeout: float = 45.0

    def body(self, word: str, ladder: list[str], samples: list[list[str]]) -> dict:
        return {
            "model": self.model,
            "temperature": 0,
            "system": self.instructions,
            "messages": [{"role": "user", "content": verdicts.payload(word, ladder, samples)}],
            "schema": verdicts.schema(ladder),
        }

    @staticmethod
    def answer(reply: dict) -> str:
        if reply.get("error"):
            raise ValueError(str(reply["error"]))
        said = reply["answer"]
        return said if isinstance(said, str) else json.dumps(said)

    def __call__(self, word: str, ladder: list[str], samples: list[list[str]]) -> str:
        from os.path import expandvars

        headers = {"content-type": "application/json", **{k: expandvars(v) for k, v in self.headers.items()}}
        request = urllib.request.Request(self.endpoint, json.dumps(self.body(word, ladder, samples)).encode(), headers)  # noqa: S310
        with urllib.request.urlopen(request, timeout=self.timeout) as reply:  # noqa: S310
            return self.answer(json.load(reply))
