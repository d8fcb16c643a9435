"""What happens at a prompt and around it: refresh of a stale report, selection, claims, and the log of what was shown.

State lies in one folder that driver and executors share, as tables that grow by whole
batches: ``reports`` (entries with generated_at), ``refreshes`` (every attempt: at, outcome,
reason, note, version, list_modified) and ``injections`` (at, session_id, lemma). The
ledger is a compacted partial of the batches up to some time and those that came since. A lease keeps refreshes
single: who takes over an old one takes it from its owner, who then publishes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ledger, report, swaps
from ..sources import files, store
from ..work import cut, discard

#: Age from which a lock may be taken over, pause between automatic attempts, age of a report that is no longer shown.
LOCK_AGE, PAUSE, TOO_OLD = timedelta(hours=1), timedelta(minutes=15), timedelta(days=7)
REFRESHES = "at timestamp, outcome string, reason string, note string, version string, list_modified timestamp"
REPORTED = "generated_at timestamp, entry_ord int, kind string, lemma string, known boolean, rate double, reason string, words array<string>, judge_note string, demote_to string"
INJECTIONS = "at timestamp, session_id string, lemma string"


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


#: Batches that the ledger reads one by one before they are compacted.
MOST_PENDING = 8


def _batches(spark: SparkSession, state: str, name: str) -> list[str]:
    """Names of a table's whole batches, oldest first."""
    fs, place = _place(spark, f"{state}/{name}")
    if not fs.exists(place):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(place)]
    return sorted(n for n in names if n.startswith("batch-") and fs.exists(_place(spark, f"{state}/{name}/{n}/_SUCCESS")[1]))


def _table(spark: SparkSession, state: str, name: str, schema: str, batches: list[str] | None = None) -> DataFrame:
    """A table's batches, or some of them."""
    batches = _batches(spark, state, name) if batches is None else batches
    return spark.read.schema(schema).parquet(*[f"{state}/{name}/{b}" for b in batches]) if batches else spark.createDataFrame([], schema)


def _append(df: DataFrame, state: str, name: str, at: datetime) -> None:
    files.append_batch(df.coalesce(1), f"{state}/{name}", f"{int(at.timestamp() * 1e6):020d}-{uuid.uuid4().hex[:8]}", "parquet")


def last_report(spark: SparkSession, state: str) -> dict | None:
    """generated_at, version and list_modified of the newest report that was built."""
    built = _table(spark, state, "refreshes", REFRESHES).filter("outcome = 'ok'")
    row = built.agg(F.max_by(F.struct(F.col("at").alias("generated_at"), "version", "list_modified"), "at").alias("r")).first()["r"]
    return row.asDict() if row else None


def entries_of_last(spark: SparkSession, state: str, now: datetime, max_age: timedelta = TOO_OLD) -> DataFrame:
    """The entries of the newest report; none where there is none or it is older than ``max_age``. Only its own batch is read."""
    last = last_report(spark, state)
    if last is None or now - last["generated_at"] > max_age:
        return spark.createDataFrame([], REPORTED)
    own = f"batch-{int(last['generated_at'].timestamp() * 1e6):020d}-"
    batches = [b for b in _batches(spark, state, "reports") if b.startswith(own)]
    return _table(spark, state, "reports", REPORTED, batches).filter(F.col("generated_at") == F.lit(last["generated_at"]))


class Lease:
    """A folder that names its owner. Taking over an old one is a rename, which only one of several can do."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.token = spark, path, None

    def _age(self, fs, place, now: datetime) -> float:
        return now.timestamp() - fs.getFileStatus(place).getModificationTime() / 1000

    def take(self, now: datetime) -> bool:
        fs, lock = _place(self.spark, self.path)
        if fs.exists(lock):
            _, old = _place(self.spark, f"{self.path}.old-{uuid.uuid4().hex}")
            try:
                if self._age(fs, lock, now) < LOCK_AGE.total_seconds() or not fs.rename(lock, old):
                    return False
                if self._age(fs, old, now) < LOCK_AGE.total_seconds():  # another one had taken it over in between
                    fs.rename(old, lock)
                    return False
            except Exception:  # noqa: BLE001 - it is gone: another one has it
                return False
            fs.delete(old, True)
        self.token = store.claim(self.spark, self.path, {})
        return self.token is not None

    def held(self) -> bool:
        """Whether it is still ours."""
        return self.token is not None and store.owner(self.spark, self.path) == self.token

    def release(self) -> None:
        if self.held():
            fs, lock = _place(self.spark, self.path)
            fs.delete(lock, True)


def refresh(spark: SparkSession, state: str, build: Callable[[], DataFrame], now: datetime, version: str, list_modified: datetime | None = None, automatic: bool = False) -> str:
    """Builds a report if the last one is stale: "fresh", "paused", "busy", "lost", "ok" or "error".

    ``build`` is the report query. An attempt that fails is logged and raises nothing; the next
    automatic one waits.
    """
    reason = report.staleness(last_report(spark, state), now, version, list_modified)
    if not reason:
        return "fresh"
    tried = _table(spark, state, "refreshes", REFRESHES).agg(F.max("at")).first()[0]
    if automatic and tried is not None and now - tried < PAUSE:
        return "paused"
    lease = Lease(spark, f"{state}/refresh.lock")
    if not lease.take(now):
        return "busy"
    outcome, note = "ok", ""
    try:
        entries = build().withColumn("generated_at", F.lit(now))
        fields = [f.strip().split(" ") for f in REPORTED.split(", ")]
        own = lambda n: F.col(n) if n in entries.columns else F.lit(None)
        entries = cut(entries.select(*[own(n).cast(t).alias(n) for n, t in fields]), "refresh")
        if not lease.held():
            return "lost"
        _append(entries, state, "reports", now)
        discard(entries)
    except Exception as e:  # noqa: BLE001 - the flow must go on whatever a build does
        outcome, note = "error", str(e).splitlines()[0][:500] if str(e) else type(e).__name__
    finally:
        lease.release()
    _append(spark.createDataFrame([(now, outcome, reason, note, version, list_modified)], REFRESHES), state, "refreshes", now)
    if outcome == "ok" and len(_pending(spark, state, "reports", _base(spark, state)[1])) >= MOST_PENDING:
        compact(spark, state)
    return outcome


def shown(spark: SparkSession, state: str, now: datetime, words: int = report.HOOK_WORDS, phrases: int = report.HOOK_PHRASES) -> tuple[str, list[str]]:
    """The text for a prompt and the lemmas in it: none without a report, a remark where the report is too old."""
    last = last_report(spark, state)
    if last is None:
        return "", []
    if now - last["generated_at"] > TOO_OLD:
        errors = _table(spark, state, "refreshes", REFRESHES).filter("outcome = 'error'").agg(F.max_by("note", "at")).first()[0]
        text = f"word report is {(now - last['generated_at']).days}d old: it is not being refreshed."
        return text + (f" Last error: {errors}" if errors else "") + "\n", []
    entries = entries_of_last(spark, state, now)
    rows = [r.asDict() for r in report.hook_entries(entries, words, phrases).orderBy("shown_ord").collect()]
    return report.render(rows, hook=True), [r["lemma"] for r in rows]


def hook(prompts: DataFrame, state: str, now: datetime, words: int = report.HOOK_WORDS, phrases: int = report.HOOK_PHRASES) -> DataFrame:
    """``prompts``(session_id, at) that get a text: session_id, at, text; what they show is logged.

    A session's first prompt fires and then one four hours or more after the last that did.
    The text is one value for all prompts of the call, so nothing is joined.
    """
    spark = prompts.sparkSession
    text, lemmas = shown(spark, state, now, words, phrases)
    fired = swaps.claims(prompts).filter("fires").select("session_id", "at") if text else spark.createDataFrame([], "session_id string, at timestamp")
    if text:
        path = f"{state}/fired/at={int(now.timestamp())}"
        fired.write.mode("overwrite").parquet(path)
        fired = spark.read.schema("session_id string, at timestamp").parquet(path)
    if lemmas:
        said = F.explode(F.array(*[F.lit(x) for x in lemmas])).alias("lemma")
        _append(fired.select("at", "session_id", said), state, "injections", now)
    return fired.withColumn("text", F.lit(text))


# ---- the ledger


def _base(spark: SparkSession, state: str) -> tuple[str | None, dict[str, list[str]]]:
    """The newest compacted partial and the names of the batches in it."""
    fs, place = _place(spark, f"{state}/ledger")
    names = sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []
    whole = [n for n in names if n.startswith("batch-") and fs.exists(_place(spark, f"{state}/ledger/{n}/_SUCCESS")[1])]
    if not whole:
        return None, {}
    held = spark.read.text(f"{state}/ledger-batches/{whole[-1]}").first()[0]
    return whole[-1], json.loads(held)


def _pending(spark: SparkSession, state: str, name: str, inside: dict[str, list[str]]) -> list[str]:
    return sorted({*_batches(spark, state, name)} - {*inside.get(name, [])})


def _partial(spark: SparkSession, state: str) -> tuple[DataFrame, dict[str, list[str]]]:
    """The merged partial of everything, and the batches in it: the base and what came since."""
    base, inside = _base(spark, state)
    new = {name: _pending(spark, state, name, inside) for name in ("reports", "injections")}
    entries = _table(spark, state, "reports", REPORTED, new["reports"]).withColumnRenamed("generated_at", "refresh_at")
    parts = [ledger.partial(entries, _table(spark, state, "injections", INJECTIONS, new["injections"]))]
    if base is not None:
        parts.append(spark.read.schema(ledger.PARTIAL).parquet(f"{state}/ledger/{base}"))
    return ledger.merged(*parts), {name: inside.get(name, []) + new[name] for name in new}


def compact(spark: SparkSession, state: str) -> None:
    """Writes the partial of everything so far; the ledger then reads that and later batches only.

    The list of batches is there before the partial becomes visible, so an attempt that stops in between counts nothing twice.
    """
    whole, inside = _partial(spark, state)
    before = _base(spark, state)[0]
    name = f"{int(before.removeprefix('batch-')) + 1 if before else 0:08d}"
    spark.createDataFrame([(json.dumps(inside),)], "value string").coalesce(1).write.mode("overwrite").text(f"{state}/ledger-batches/batch-{name}")
    files.append_batch(whole, f"{state}/ledger", name, "parquet")


def history(spark: SparkSession, state: str) -> DataFrame:
    """The ledger of everything that was ever reported."""
    times = _table(spark, state, "refreshes", REFRESHES).filter("outcome = 'ok'").select(F.col("at").alias("refresh_at"))
    return ledger.of_partial(_partial(spark, state)[0], times)
