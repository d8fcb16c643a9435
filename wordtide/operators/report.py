"""Selection and rendering of a report's entries."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .thesaurus import trimmed

#: Words and phrases that a prompt shows, and the ages of the staleness rule.
HOOK_WORDS, HOOK_PHRASES = 5, 2
FRESH, STALE = timedelta(minutes=15), timedelta(days=6)
NOTE_STOP = re.compile(r"([.!?][\"')\]]*)\s+[\"'A-Z(]")


def renderable(kind: Column, words: Column, lemma: Column) -> Column:
    return (kind == "phrase") | (F.size(trimmed(words, lemma)) >= 2)


def hook_entries(entries: DataFrame, max_words: int = HOOK_WORDS, max_phrases: int = HOOK_PHRASES) -> DataFrame:
    """``entries``(entry_ord, kind, lemma, known, words) -> the ones shown, with ``shown_ord``.

    Half of the words (rounded up) go to chronic entries, curated first; the rest to risers;
    what risers leave goes back to chronic entries. A report has some tens of entries, so the
    windows are as small.
    """
    own = entries.filter(renderable(F.col("kind"), F.col("words"), F.col("lemma")))
    lane = F.when(F.col("kind") == "phrase", "phrase").when(F.col("kind") == "chronic", "chronic").otherwise("riser")
    own = own.withColumn("lane", lane)
    first = F.when((F.col("lane") == "chronic") & F.col("known"), 0).otherwise(1)
    own = own.withColumn("place", F.row_number().over(Window.partitionBy("lane").orderBy(first, "entry_ord")))
    total = entries.agg(F.count("*").cast("int").alias("everything"))
    lanes = own.agg(F.count_if(F.col("lane") == "chronic").alias("chronic"), F.count_if(F.col("lane") == "riser").alias("risers")).crossJoin(total)
    cap = lambda n: F.lit(n) if n > 0 else F.col("everything")
    lanes = lanes.select(cap(max_words).alias("words_cap"), cap(max_phrases).alias("phrases_cap"), "chronic", "risers")
    lanes = lanes.withColumn("share", F.floor((F.col("words_cap") + 1) / 2))
    lanes = lanes.withColumn("from_chronic", F.least("chronic", "share"))
    lanes = lanes.withColumn("from_risers", F.least(F.col("risers"), F.col("words_cap") - F.col("from_chronic")))
    lanes = lanes.withColumn("spill", F.least(F.col("chronic") - F.col("from_chronic"), F.col("words_cap") - F.col("from_chronic") - F.col("from_risers")))
    out = own.crossJoin(F.broadcast(lanes))
    lead = (F.col("lane") == "chronic") & (F.col("place") <= F.col("from_chronic"))
    rising = (F.col("lane") == "riser") & (F.col("place") <= F.col("from_risers"))
    spilled = (F.col("lane") == "chronic") & (F.col("place") > F.col("share")) & (F.col("place") <= F.col("share") + F.col("spill"))
    phrase = (F.col("lane") == "phrase") & (F.col("place") <= F.col("phrases_cap"))
    group = F.when(lead, 1).when(rising, 2).when(spilled, 3).when(phrase, 4)
    out = out.withColumn("group", group).filter("group is not null")
    out = out.withColumn("shown_ord", F.row_number().over(Window.orderBy("group", "place")))
    return out.select(*entries.columns, "shown_ord")


def first_sentence_of(note: str) -> str:
    m = NOTE_STOP.search(note)
    if not m or note[: m.start()].endswith(("e.g", "i.e")):
        return note
    return note[: m.start() + len(m[1])]


def render(entries: list[dict], hook: bool = False) -> str:
    """Lines "lemma (note): a < b < [lemma]"; the entries are a bounded selection."""
    lines = []
    for e in entries:
        note = first_sentence_of(e.get("judge_note") or "") if hook else (e.get("judge_note") or "")
        ladder = [f"[{w}]" if w == e["lemma"] else w for w in e.get("words") or []]
        what = e.get("reason") or e["kind"]
        spark = "" if hook or not e.get("spark") else f" {e['spark']}"
        body = f": {' < '.join(ladder)}" if ladder else ""
        lines.append(f"{e['lemma']} ({what}){spark}{body}" + (f" — {note}" if note else ""))
    return "\n".join(lines) + ("\n" if lines else "")


def staleness(report: dict | None, now: datetime, version: str, list_modified: datetime | None) -> str:
    """Why a report should be built again ("" if it need not be): none, old, version, list, in this order."""
    if report is None:
        return "none"
    age = now - report["generated_at"]
    if age >= STALE:
        return "old"
    if age < FRESH:
        return ""
    if report["version"] != version:
        return "version"
    if list_modified is not None and report.get("list_modified") != list_modified:
        return "list"
    return ""
