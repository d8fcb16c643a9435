"""On-screen replacement of words: tables, the rewriter, fences, the log, and injection claims."""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import display as dp
from ..functions.console import aligned
from ..functions.text import lemma_of

FENCE_LINE = re.compile(r"^\s{0,3}(?:`{3,}|~{3,})")
#: Copied as they are: inline code, URLs, paths.
PROTECTED = re.compile(r"`[^`\n]*`|https?://\S+|(?:[\w.-]*/)+[\w.-]+", re.ASCII)
SWAP_WORD = re.compile(r"[^\W\d_](?:[^\W\d_]|['-])*")
#: Shape of a session id, hours between claims, days that a claim is remembered.
SESSION_ID = r"^[A-Za-z0-9_-]{1,128}$"
CLAIM_HOURS, CLAIM_DAYS = 4, 30


def swap_table(entries: DataFrame, pairs: dict[str, str] | None = None, every: bool = False) -> DataFrame:
    """lemma, replacement: from a report's entries (curated only, unless ``every``); explicit pairs win."""
    own = entries.filter((F.col("kind") != "phrase") & (F.coalesce("demote_to", F.lit("")) != "") & (F.lower("lemma") != F.lower("demote_to")))
    own = own if every else own.filter("known")
    rows = own.select(F.lower("lemma").alias("lemma"), F.col("demote_to").alias("replacement"), F.lit(0).alias("p"))
    if pairs:
        extra = [(lemma_of(a.lower()), b, 1) for a, b in pairs.items()]
        rows = rows.unionByName(entries.sparkSession.createDataFrame(extra, "lemma string, replacement string, p int"))
    return rows.groupBy("lemma").agg(F.max_by("replacement", "p").alias("replacement"))


def swap_words(text: str, swaps: dict[str, str], counts: dict[str, int]) -> str:
    """Replaces words outside protected spans; counts by lemma."""

    def one(m: re.Match) -> str:
        word, lower = m[0], m[0].lower()
        if lower in swaps:
            counts[lower] = counts.get(lower, 0) + 1
            return dp.match_case_of(word, swaps[lower])
        lemma = lemma_of(lower)
        if lemma not in swaps:
            return word
        counts[lemma] = counts.get(lemma, 0) + 1
        return dp.match_case_of(word, dp.inflected(lower, lemma, swaps[lemma]))

    out, at = [], 0
    for m in PROTECTED.finditer(text):
        out += [SWAP_WORD.sub(one, text[at : m.start()]), m[0]]
        at = m.end()
    return "".join([*out, SWAP_WORD.sub(one, text[at:])])


def rewrite(delta: str, in_fence: bool, swaps: dict[str, str]) -> tuple[str, bool, dict[str, int]]:
    """A delta line by line: fence lines and what they enclose stay; returns the state after it."""
    counts: dict[str, int] = {}
    lines = delta.split("\n")
    for i, line in enumerate(lines):
        if FENCE_LINE.match(line):
            in_fence = not in_fence
        elif not in_fence:
            lines[i] = swap_words(line, swaps, counts)
    return "\n".join(lines), in_fence, counts


def apply_swaps(texts: DataFrame, column: str, swaps: dict[str, str], fence: str | None = None) -> DataFrame:
    """Adds ``swapped`` and ``swap_counts`` (array of lemma, n): whole texts, Arrow batches. ``fence`` names the
    column that says whether a text begins inside one."""
    kind = T.StructType([T.StructField("swapped", T.StringType()), T.StructField("swap_counts", T.ArrayType(T.StructType([T.StructField("lemma", T.StringType()), T.StructField("n", T.LongType())])))])

    @F.pandas_udf(kind)
    def udf(values: pd.Series, inside: pd.Series) -> pd.DataFrame:
        done = [rewrite(v or "", bool(f), swaps) for v, f in zip(values, inside, strict=True)]
        return pd.DataFrame({"swapped": [d[0] for d in done], "swap_counts": [[{"lemma": k, "n": n} for k, n in sorted(d[2].items())] for d in done]})

    begins = F.coalesce(F.col(fence), F.lit(False)) if fence else F.lit(False)
    out = texts.withColumn("__s", udf(F.col(column), begins))
    return out.select(*texts.columns, "__s.swapped", "__s.swap_counts")


def is_fence(line: Column) -> Column:
    """Whether a line opens or closes a fence."""
    return line.rlike(FENCE_LINE.pattern)


def fence_state(lines: DataFrame) -> DataFrame:
    """``lines``(session_id, message_id, ord, is_fence) with ``in_fence`` before the line: parity of the fences
    of its message so far. A message's lines are one window; sessions are many."""
    before = Window.partitionBy("session_id", "message_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("in_fence", F.coalesce(F.sum(F.col("is_fence").cast("int")).over(before), F.lit(0)) % 2 == 1)


def swap_totals(log: DataFrame) -> DataFrame:
    """``log``(seq, t, lemma, to, n) -> per lemma total, last replacement, distinct ones, first and last time, per day."""
    out = log.filter(F.coalesce("lemma", F.lit("")) != "").groupBy("lemma").agg(
        F.sum("n").alias("total"),
        F.max_by("to", "seq").alias("last_to"),
        F.count_distinct("to").alias("replacements"),
        F.min("t").alias("first_at"),
        F.max("t").alias("last_at"),
    )
    days = F.floor((F.unix_micros("last_at") - F.unix_micros("first_at")) / (86_400 * 1_000_000)) + 1
    return out.withColumn("per_day", F.col("total") / days).orderBy(F.desc("total"), "lemma")


def render_totals(totals: DataFrame, now: datetime) -> str:
    """Swaps as text: words by how often they were replaced, then all of them by day. One row per replaced word."""
    rows = totals.collect()
    if not rows:
        return "nothing replaced yet\n"
    n, first = sum(r.total for r in rows), min(r.first_at for r in rows)
    days = int((now - min(first, now)).total_seconds() // 86_400) + 1
    also = lambda r: " (and others)" if r.replacements > 1 else ""
    cells = [[f"{r.lemma} → {r.last_to}{also(r)}", f"{r.total}×", f"last {r.last_at:%Y-%m-%d}"] for r in rows]
    return "replaced on screen, not in what was written:\n" + aligned(cells) + f"{n} replacement{'' if n == 1 else 's'} in {days} day{'' if days == 1 else 's'}, {n / days:.1f} a day\n"


def _claims(hours: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, fired = object(), None
        for b in batches:
            mark = []
            for s, at in zip(b["session_id"], b["at"], strict=True):
                if s != session:
                    session, fired = s, None
                fire = fired is None or at - fired >= pd.Timedelta(hours=hours)
                fired = at if fire else fired
                mark.append(fire)
            yield b.assign(fires=mark)

    return run


def claims(events: DataFrame, hours: float = CLAIM_HOURS) -> DataFrame:
    """``events``(session_id, at) with ``fires``: the first of a session, then each at least ``hours`` after the last that fired.

    A fold over each session in order of time. Rows stream through sorted partitions, so a
    session with very many events needs no memory for them. Invalid ids never fire.
    """
    own = events.select("session_id", "at").filter(F.col("session_id").rlike(SESSION_ID))
    rows = own.repartition("session_id").sortWithinPartitions("session_id", "at")
    return rows.mapInPandas(_claims(hours), "session_id string, at timestamp, fires boolean")
