"""Streaming twins of the stateful operators, with transformWithStateInPandas.

They need the RocksDB state store and a checkpoint location:
``spark.sql.streaming.stateStore.providerClass`` =
``org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider``.

Neither depends on the order in which rows arrive. A delta waits in its session's state until all
before it have come (or have not come for a given time); with a delay for late rows, a prompt waits until the
watermark has passed it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.swaps import CLAIM_DAYS, CLAIM_HOURS, FENCE_LINE, SESSION_ID, apply_swaps

FENCED = "session_id string, message_id string, batch_seq long, delta string, in_fence boolean"
CLAIMS_OUT = "session_id string, at timestamp, fires boolean"
_FENCED_COLUMNS = [c.split()[0] for c in FENCED.split(", ")]


def fences_in(delta: str) -> int:
    return sum(bool(FENCE_LINE.match(line)) for line in delta.split("\n"))


class FenceProcessor(StatefulProcessor):
    """Deltas of a session in the order of ``batch_seq`` (from 1, without gaps), each with the fence state before it.

    The session has one slot (message, in_fence): another message begins outside a fence. A delta
    without a message is outside one and leaves the slot alone. Deltas that come early are held by number; a number that
    was handled already, or comes twice, is passed over. If the next number is not there after
    ``wait_ms``, the session goes on with the lowest one that is; without a ``wait_ms`` it waits for ever.
    """

    def __init__(self, wait_ms: int | None):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.slot = handle.getValueState("slot", "next long, message_id string, in_fence boolean, timer long")
        self.held = handle.getMapState("held", "batch_seq long", "session_id string, message_id string, delta string")

    def _state(self) -> list:
        return list(self.slot.get()) if self.slot.exists() else [1, None, False, None]

    def _in_order(self, state: list) -> list[tuple]:
        """Takes what follows without a gap out of the held deltas."""
        out = []
        while self.held.exists() and self.held.containsKey((state[0],)):
            session, message, delta = self.held.getValue((state[0],))
            self.held.removeKey((state[0],))
            if message:
                inside = bool(state[2]) if message == state[1] else False
                state[1], state[2] = message, inside ^ bool(fences_in(delta) % 2)
            out.append((session, message, state[0], delta, inside if message else False))
            state[0] += 1
        return out

    def _wait(self, state: list, now: int, again: bool) -> None:
        """A timer runs while deltas are held; it starts anew when one could be handled."""
        if self.wait_ms is None:
            return
        waits = self.held.exists() and next(iter(self.held.keys()), None) is not None
        if state[3] is not None and (again or not waits):
            self.handle.deleteTimer(state[3])
            state[3] = None
        if waits and state[3] is None:
            state[3] = now + self.wait_ms
            self.handle.registerTimer(state[3])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, loose = self._state(), []
        for batch in rows:
            for r in batch.itertuples(index=False):
                delta = r.delta or ""
                if r.batch_seq is None or pd.isna(r.batch_seq) or not r.valid:
                    loose.append((r.session_id, r.message_id, r.batch_seq, delta, False))
                elif r.batch_seq >= state[0] and not (self.held.exists() and self.held.containsKey((r.batch_seq,))):
                    self.held.updateValue((r.batch_seq,), (r.session_id, r.message_id, delta))
        done = self._in_order(state)
        if any_valid := bool(done) or self.held.exists():
            self._wait(state, timerValues.getCurrentProcessingTimeInMs() if self.wait_ms is not None else 0, bool(done))
        if any_valid or self.slot.exists():
            self.slot.update(tuple(state))
        yield pd.DataFrame(loose + done, columns=_FENCED_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self._state()
        state[3] = None
        left = [k[0] for k in self.held.keys()] if self.held.exists() else []
        done = []
        if left:
            state[0] = min(left)
            done = self._in_order(state)
            self._wait(state, timerValues.getCurrentProcessingTimeInMs(), True)
        self.slot.update(tuple(state))
        yield pd.DataFrame(done, columns=_FENCED_COLUMNS)

    def close(self) -> None:
        pass


class ClaimProcessor(StatefulProcessor):
    """Fires on a session's first event and when four hours have passed since the last that fired; forgets after 30 days.

    With ``ordered``, events wait for the watermark and are judged in order of time, whenever they came.
    """

    def __init__(self, ordered: bool):
        self.ordered = ordered

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # time to live runs on the wall clock, which event time has no part in
        self.fired = handle.getValueState("fired", "at timestamp") if self.ordered else handle.getValueState("fired", "at timestamp", ttlDurationMs=CLAIM_DAYS * 86_400_000)
        if self.ordered:
            self.held = handle.getMapState("held", "micros long", "n long")

    def _judged(self, session: str, times: list[pd.Timestamp]) -> pd.DataFrame:
        last = pd.Timestamp(self.fired.get()[0]) if self.fired.exists() else None
        out = []
        for at in sorted(times):
            fire = last is None or at - last >= pd.Timedelta(hours=CLAIM_HOURS) or self.ordered and at - last >= pd.Timedelta(days=CLAIM_DAYS)
            last = at if fire else last
            out.append((session, at, fire))
        if out:
            self.fired.update((last.to_pydatetime(),))
        return pd.DataFrame(out, columns=["session_id", "at", "fires"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = pd.concat(list(rows))["at"]
        if not self.ordered:
            yield self._judged(key[0], list(times))
            return
        for at, n in times.value_counts().items():
            micros = at.value // 1_000
            before = self.held.getValue((micros,))[0] if self.held.exists() and self.held.containsKey((micros,)) else 0
            self.held.updateValue((micros,), (before + int(n),))
            self.handle.registerTimer(micros // 1_000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs() * 1_000
        ripe = sorted(k[0] for k in self.held.keys() if k[0] < upto)
        times = []
        for micros in ripe:
            times += [pd.Timestamp(micros, unit="us")] * self.held.getValue((micros,))[0]
            self.held.removeKey((micros,))
        if times:
            yield self._judged(key[0], times)

    def close(self) -> None:
        pass


def stream_fences(deltas: DataFrame, wait_ms: int | None = 60_000) -> DataFrame:
    """Streaming ``deltas``(session_id, message_id, batch_seq, delta) -> FENCED, each session in order.

    Waiting runs on the wall clock, so such a query goes on without new data and never ends under a
    trigger that is to end; pass no ``wait_ms`` there.

    A delta without a valid session id has no state: it is outside a fence. Such rows are
    dealt by their content, so no group gathers them.
    """
    valid = F.coalesce(F.col("session_id").rlike(SESSION_ID), F.lit(False)) & F.col("batch_seq").isNotNull()
    slot = F.when(valid, F.col("session_id")).otherwise(F.concat(F.lit("\x00"), F.pmod(F.xxhash64("delta", "message_id"), F.lit(1_024)).cast("string")))
    rows = deltas.select("session_id", "message_id", "batch_seq", "delta", valid.alias("valid"), slot.alias("slot"))
    return rows.groupBy("slot").transformWithStateInPandas(FenceProcessor(wait_ms), FENCED, "Append", "None" if wait_ms is None else "ProcessingTime")


def stream_swaps(deltas: DataFrame, swaps: dict[str, str], wait_ms: int | None = 60_000) -> DataFrame:
    """Streaming ``deltas`` -> session_id, message_id, batch_seq, swapped, n_swaps."""
    done = apply_swaps(stream_fences(deltas, wait_ms), "delta", swaps, fence="in_fence")
    n = F.aggregate("swap_counts", F.lit(0).cast("long"), lambda a, s: a + s["n"])
    return done.select("session_id", "message_id", "batch_seq", "swapped", n.alias("n_swaps"))


def stream_claims(prompts: DataFrame, delay: str | None = None) -> DataFrame:
    """Streaming ``prompts``(session_id, at) -> whether each fires; invalid ids are dropped.

    Without a ``delay`` a prompt is judged when it comes. With one ("10 minutes") it is judged when no
    earlier one can come any more; prompts later than that are dropped.
    """
    own = prompts.filter(F.col("session_id").rlike(SESSION_ID)).select("session_id", "at")
    if delay is None:
        return own.groupBy("session_id").transformWithStateInPandas(ClaimProcessor(False), CLAIMS_OUT, "Append", "ProcessingTime")
    own = own.withWatermark("at", delay)
    return own.groupBy("session_id").transformWithStateInPandas(ClaimProcessor(True), CLAIMS_OUT, "Append", "EventTime")


