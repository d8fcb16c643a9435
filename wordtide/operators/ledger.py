"""The history of flagged words, folded from append-only logs in closed form.

report_log(refresh_at, lemma, kind, rate, known), refresh_log(refresh_at),
injections(at, lemma).
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import display as dp
from ..functions.console import aligned

#: Fixed value: the most suggestions for the curated list.
SHORTLIST = 5


#: What is kept of a word: a partial that merges with others in any order. A word that was shown and
#: never reported has no first_flagged.
PARTIAL = "lemma string, first_flagged timestamp, first_rate double, last_seen timestamp, last_rate double, kind string, known boolean, refreshes long, injected long"


def partial(report_log: DataFrame, injections: DataFrame | None = None) -> DataFrame:
    """Rows of some refreshes and some injections, summed up by word. A refresh belongs to one partial."""
    own = report_log.groupBy("lemma").agg(
        F.min("refresh_at").alias("first_flagged"),
        F.min_by("rate", "refresh_at").alias("first_rate"),
        F.max("refresh_at").alias("last_seen"),
        F.max_by("rate", "refresh_at").alias("last_rate"),
        F.max_by("kind", "refresh_at").alias("kind"),
        F.max_by("known", "refresh_at").alias("known"),
        F.count_distinct("refresh_at").alias("refreshes"),
    )
    if injections is None:
        return own.withColumn("injected", F.lit(0).cast("long"))
    shown = injections.groupBy("lemma").agg(F.count("*").alias("injected"))
    out = own.join(shown, "lemma", "full")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("refreshes", "injected")})


def merged(*partials: DataFrame) -> DataFrame:
    """Partials of disjoint refreshes and injections as one, whatever their order."""
    rows = partials[0]
    for p in partials[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("lemma").agg(
        F.min("first_flagged").alias("first_flagged"),
        F.min_by("first_rate", "first_flagged").alias("first_rate"),
        F.max("last_seen").alias("last_seen"),
        F.max_by("last_rate", "last_seen").alias("last_rate"),
        F.max_by("kind", "last_seen").alias("kind"),
        F.max_by("known", "last_seen").alias("known"),
        F.sum("refreshes").alias("refreshes"),
        F.sum("injected").alias("injected"),
    )


def of_partial(state: DataFrame, refresh_log: DataFrame) -> DataFrame:
    """The ledger of a merged partial and the times of all refreshes.

    A lemma has faded if a refresh came after its last report; an empty refresh fades all. Refreshes are
    a few a day, so one window orders their times; the time of fading is that of the refresh after the last report.
    """
    times = refresh_log.select("refresh_at").distinct()
    after = times.select(F.col("refresh_at").alias("last_seen"), F.lead("refresh_at").over(Window.orderBy("refresh_at")).alias("faded_at"))
    out = state.filter("first_flagged is not null").join(after, "last_seen", "left")
    return out.withColumn("faded", F.col("faded_at").isNotNull())


def fold(report_log: DataFrame, refresh_log: DataFrame, injections: DataFrame | None = None) -> DataFrame:
    """One row per lemma ever reported: first and last seen and rate, refreshes, faded, faded_at, injected."""
    return of_partial(partial(report_log, injections), refresh_log)


def curation_candidates(ledger: DataFrame) -> DataFrame:
    """Live chronic words that are not curated, were never shown and held on for two refreshes."""
    own = ledger.filter("NOT faded AND NOT known AND injected = 0 AND kind = 'chronic' AND refreshes >= 2")
    return own.orderBy(F.desc("last_rate"), "first_flagged", "lemma").limit(SHORTLIST)


def live(ledger: DataFrame) -> DataFrame:
    return ledger.filter("NOT faded").orderBy("first_flagged", "lemma")


def faded(ledger: DataFrame) -> DataFrame:
    return ledger.filter("faded").orderBy(F.desc("faded_at"), "lemma")


def render(ledger: DataFrame, now: datetime) -> str:
    """The ledger as text: words still flagged, the oldest first; how many were never shown; faded ones, the latest first.

    A ledger has a row for each word ever flagged, some hundreds.
    """
    pct = dp.change(F.col("first_rate"), F.col("last_rate"))
    own = ledger.withColumns(
        {
            "move": F.concat(dp.change_arrow(pct), F.format_string("%.0f%%", F.abs(pct))),
            "age": dp.human_age(F.unix_timestamp(F.lit(now)) - F.unix_timestamp("first_flagged")),
            "tally": dp.shown(F.col("known"), F.col("injected")),
            "since": F.date_format("first_flagged", "yyyy-MM-dd"),
            "gone": F.date_format("faded_at", "yyyy-MM-dd"),
        }
    )
    stay, went = live(own).collect(), faded(own).collect()
    if not stay and not went:
        return "nothing recorded yet\n"
    out = []
    if stay:
        out.append("still flagged:\n")
        out.append(aligned([[r.lemma, f"since {r.since} ({r.age}, {r.refreshes} refresh{'' if r.refreshes == 1 else 'es'})", f"{r.first_rate:.2f} → {r.last_rate:.2f}/1k", r.move, r.kind, r.tally] for r in stay]))
        unseen = sum(r.injected == 0 for r in stay)
        if unseen:
            out.append(f"{unseen} of {len(stay)} still flagged were never shown\n")
            steady = curation_candidates(ledger).collect()
            out.append("".join(f"  {r.lemma}: {r.last_rate:.2f}/1k over {r.refreshes} refreshes, not on the list\n" for r in steady))
    if went:
        out.append("faded:\n")
        out.append(aligned([[r.lemma, f"{r.since} → gone {r.gone}", f"{r.first_rate:.2f} → {r.last_rate:.2f}/1k", r.move, r.kind] for r in went]))
    return "".join(out)
