"""The judge's contract and the log of its verdicts: validity, cache, latest, churn."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.console import aligned

#: The roles of a verdict and the option of no demotion.
ROLES = ("tic", "mixed", "term_of_art")
NONE = "none"
KEY = ["word", "ladder_hash", "model", "schema_version"]


def schema(ladder: list[str]) -> dict:
    """The shape a judge must answer in."""
    return {
        "type": "object",
        "required": ["role", "demote_to"],
        "properties": {"role": {"enum": list(ROLES)}, "demote_to": {"enum": [NONE, *ladder]}, "note": {"type": "string"}},
    }


def parsed(answer: str, ladder: list[str]) -> dict | None:
    """A judge's raw answer, if it is well formed: demotion "none" becomes the empty string."""
    try:
        v = json.loads(answer)
    except ValueError:
        return None
    if not isinstance(v, dict) or v.get("role") not in ROLES or v.get("demote_to") not in (NONE, *ladder):
        return None
    return {"role": v["role"], "demote_to": "" if v["demote_to"] == NONE else v["demote_to"], "note": str(v.get("note") or "")}


def payload(word: str, ladder: list[str], samples: list[list[str]]) -> str:
    """What a judge is told about one word."""
    lines = [f"word: {word}", f"ladder: {' < '.join(ladder)}", *(f"- {' '.join(s)}" for s in samples)]
    return "\n".join(lines)


def well_formed(raw: Column, ladder: Column) -> Column:
    """Whether a JSON answer parses, has a known role and demotes to a rung or to none."""
    v = F.from_json(raw, "role string, demote_to string, note string")
    return F.coalesce(v["role"].isin(*ROLES) & ((v["demote_to"] == NONE) | F.array_contains(ladder, v["demote_to"])), F.lit(False))


def safe(role: Column, demote_to: Column) -> Column:
    """A term of art demotes to nothing; other roles to anything."""
    return (role != "term_of_art") | F.coalesce(demote_to, F.lit("")).isin("", NONE)


def record(verdicts: DataFrame, model: str, version: int) -> DataFrame:
    """Log rows with model, schema version and the time in UTC."""
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return verdicts.withColumns({"model": F.lit(model), "schema_version": F.lit(version), "at": now})


def cache(log: DataFrame) -> DataFrame:
    """The last row of each key (the version counts by its last digit); only accepted ones are served."""
    digit = log.withColumn("schema_version", F.col("schema_version") % 10)
    rest = [c for c in log.columns if c not in KEY]
    last = digit.groupBy(*KEY).agg(F.max_by(F.struct(*rest), "seq").alias("v"))
    return last.select(*KEY, "v.*").filter("well_formed AND safe")


def latest(log: DataFrame) -> DataFrame:
    """Each word's newest accepted verdict, whatever its ladder; of equal times the last logged."""
    own = cache(log)
    return own.groupBy("word").agg(F.max_by(F.struct("role", "demote_to", "note", "at", "seq"), F.struct("at", "seq")).alias("v")).select("word", "v.*")


def churn(log: DataFrame) -> DataFrame:
    """Per word: ladders, accepted, refused, roles and rungs in first-seen order, schemas, flips within a schema.

    A word's log is its judgments, few by nature; lists hold distinct values only.
    """
    ok = F.col("well_formed") & F.col("safe")
    rung = F.when(F.coalesce("demote_to", F.lit("")).isin("", NONE), "-").otherwise(F.col("demote_to"))
    rows = log.select("word", "ladder_hash", "schema_version", ok.alias("ok"), F.when(ok, F.col("role")).alias("role"), F.when(ok, rung).alias("rung"), "seq")

    def seen(column: str) -> DataFrame:
        first = rows.filter(F.col(column).isNotNull()).groupBy("word", column).agg(F.min("seq").alias("s"))
        ordered = F.array_sort(F.collect_list(F.struct("s", column)))
        return first.groupBy("word").agg(F.transform(ordered, lambda x: x[column]).alias(f"{column}s"))

    counts = rows.groupBy("word").agg(
        F.count_distinct("ladder_hash").alias("ladders"),
        F.count_if("ok").alias("accepted"),
        F.count_if(~F.col("ok")).alias("refused"),
        F.array_sort(F.collect_set("schema_version")).alias("schemas"),
    )
    within = rows.filter("ok").groupBy("word", "schema_version").agg(F.count_distinct("role").alias("r"), F.count_distinct("rung").alias("g"), F.max(F.col("role") == "term_of_art").alias("toa"))
    flips = within.groupBy("word").agg(F.max(F.col("r") > 1).alias("flips_within"), F.max(F.col("g") > 1).alias("rungs_within"), F.max((F.col("r") > 1) & F.col("toa")).alias("crosses_within"))
    out = counts.join(seen("role"), "word", "left").join(seen("rung"), "word", "left").join(flips, "word", "left")
    empty = F.array().cast("array<string>")
    out = out.withColumns({"roles": F.coalesce("roles", empty), "rungs": F.coalesce("rungs", empty)})
    no = F.lit(False)
    out = out.withColumns({c: F.coalesce(c, no) for c in ("flips_within", "rungs_within", "crosses_within")})
    crosses = (F.size("roles") > 1) & F.array_contains("roles", "term_of_art")
    unstable = (F.size("roles") > 1) | (F.size("rungs") > 1)
    return out.withColumns({"crosses_term_of_art": crosses, "unstable": unstable})


def churn_order(churned: DataFrame) -> DataFrame:
    """Words judged on two ladders or more, the most telling first."""
    several = churned.filter("ladders >= 2")
    return several.orderBy(
        F.desc("crosses_within"), F.desc("crosses_term_of_art"), F.desc("flips_within"), F.desc(F.size("rungs")), F.desc("ladders"), "word"
    )


def last_by(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    return log.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))).filter("__r = 1").drop("__r")


def render_churn(churned: DataFrame) -> str:
    """Words that were judged on two ladders or more and changed their answer: first under one schema, then across schemas."""
    rows = churn_order(churned).collect()
    judged = churned.count()
    if not rows:
        return f"{judged} judged, none on more than one ladder\n" if judged else "no verdicts yet\n"
    live = [r for r in rows if r.flips_within or r.rungs_within]
    across = [r for r in rows if r.unstable and r not in live]

    def lines(own: list, mark: bool) -> str:
        cells = [["!" if mark and r.crosses_within else " ", r.word, f"{r.ladders} ladders", f"role: {'/'.join(r.roles)}", f"rung: {'/'.join(r.rungs)}", f"({r.refused} refused)" if r.refused else "", f"schema {'/'.join(map(str, r.schemas))}" if len(r.schemas) > 1 else ""] for r in own]
        return aligned(cells)

    out = []
    if live:
        out.append("changed under one schema:\n" + lines(live, True))
    if across:
        out.append("changed only across schemas:\n" + lines(across, False))
    crossed = sum(r.crosses_within for r in live)
    out.append(f"{len(live)} of {len(rows)} words on two ladders or more changed" + (f", {crossed} of them into or out of term of art" if crossed else "") + "\n")
    return "".join(out)
