"""The ledger as partials that merge, its state over many refreshes, and the lease of a refresh."""

import random
import threading
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from wordtide.operators import ledger
from wordtide.plans import hook

NOW = datetime(2024, 3, 4)
ROWS = "refresh_at timestamp, lemma string, kind string, rate double, known boolean"
SHOWN = "at timestamp, session_id string, lemma string"


def log(rng, days):
    reports = [(NOW + timedelta(days=d), f"w{w}", rng.choice(["riser", "chronic"]), rng.random(), rng.random() < 0.5) for d in range(days) for w in range(9) if rng.random() < 0.4 and d % 5 != 4]
    shown = [(NOW + timedelta(days=rng.randint(0, days)), "s", rng.choice(["w1", "w2", "w3", "stray"])) for _ in range(40)]
    return reports, [NOW + timedelta(days=d) for d in range(days)], shown


def plain(reports, times, shown):
    out = {}
    for lemma in {r[1] for r in reports}:
        own = sorted(r for r in reports if r[1] == lemma)
        after = [t for t in times if t > own[-1][0]]
        out[lemma] = (own[0][0], own[0][3], own[-1][0], own[-1][3], own[-1][2], own[-1][4], len(own), sum(x[2] == lemma for x in shown), min(after, default=None), bool(after))
    return out


def held(df):
    return {r.lemma: (r.first_flagged, r.first_rate, r.last_seen, r.last_rate, r.kind, r.known, r.refreshes, r.injected, r.faded_at, r.faded) for r in df.collect()}


def test_partials_merge_in_any_order(spark):
    rng = random.Random(4)
    reports, times, shown = log(rng, 15)
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    when = frame([(t,) for t in times], "refresh_at timestamp")
    want = plain(reports, times, shown)
    assert held(ledger.fold(frame(reports, ROWS), when, frame(shown, SHOWN))) == want
    group = {t: rng.randint(0, 3) for t in times}
    parts = [ledger.partial(frame([r for r in reports if group[r[0]] == g], ROWS), frame(shown[g::4], SHOWN)) for g in range(4)]
    for _ in range(2):
        rng.shuffle(parts)
        nested = ledger.merged(ledger.merged(parts[0], parts[1]), parts[2], parts[3])
        assert held(ledger.of_partial(nested, when)) == want
    assert held(ledger.of_partial(ledger.partial(frame([], ROWS), frame(shown, SHOWN)), when)) == {}


def test_thirty_refreshes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(hook, "MOST_PENDING", 5)
    rng = random.Random(9)
    reports, times, shown = log(rng, 30)
    state = str(tmp_path / "state")
    read = []
    real = hook._table
    monkeypatch.setattr(hook, "_table", lambda s, st, name, schema, batches=None: read.append((name, batches)) or real(s, st, name, schema, batches))
    cols = "entry_ord int, kind string, reason string, lemma string, known boolean, rate double, words array<string>, judge_note string"
    for n, t in enumerate(times):
        rows = [(i, kind, "r", w, known, rate, [w], None) for i, (_, w, kind, rate, known) in enumerate(r for r in reports if r[0] == t)]
        assert hook.refresh(spark, state, lambda rows=rows: spark.createDataFrame(rows, cols), t, f"v{n}") == "ok"
        if said := [x for x in shown if t <= x[0] < t + timedelta(days=1)]:
            hook._append(spark.createDataFrame(said, SHOWN), state, "injections", t)
        if n % 8 == 7 or n == 29:
            read.clear()
            got = held(hook.history(spark, state))
            assert got == plain([r for r in reports if r[0] <= t], times[: n + 1], [x for x in shown if x[0] < t + timedelta(days=1)])
            # what is compacted is not read again
            assert all(len(b) <= 5 for name, b in read if name == "reports" and b is not None)
    assert hook._base(spark, state)[0] is not None
    # an attempt to compact that stopped before its partial was whole counts nothing twice
    before = held(hook.history(spark, state))
    base, inside = hook._base(spark, state)
    (tmp_path / "state" / "ledger" / "batch-00000099").mkdir()
    assert hook._base(spark, state) == (base, inside) and held(hook.history(spark, state)) == before


def test_only_the_last_report_is_read(spark, tmp_path):
    state = str(tmp_path / "state")
    cols = "entry_ord int, kind string, lemma string, demote_to string"
    for d, w in enumerate(["a", "b"]):
        assert hook.refresh(spark, state, lambda w=w: spark.createDataFrame([(0, "riser", w, "to")], cols), NOW + timedelta(days=7 * d), str(d)) == "ok"
    entries = hook.entries_of_last(spark, state, NOW + timedelta(days=8))
    assert [(r.lemma, r.demote_to, r.rate) for r in entries.collect()] == [("b", "to", None)]
    assert len(entries.inputFiles()) == 1
    assert hook.entries_of_last(spark, state, NOW + timedelta(days=30)).count() == 0


def test_lease(spark, tmp_path):
    path = str(tmp_path / "refresh.lock")
    now = datetime.now()
    first, second, third = (hook.Lease(spark, path) for _ in range(3))
    assert first.take(now) and first.held() and not second.take(now)
    fs, lock = hook._place(spark, path)
    fs.setTimes(lock, 0, 0)
    assert second.take(now) and second.held() and not first.held()
    first.release()  # what is no longer its own it does not release
    assert second.held() and not third.take(now)
    second.release()
    assert not second.held() and third.take(now)


def test_one_of_two_that_take_over_publishes(spark, tmp_path):
    state = str(tmp_path / "state")
    fs, lock = hook._place(spark, f"{state}/refresh.lock")
    fs.mkdirs(lock.getParent())
    fs.createNewFile(lock)
    fs.setTimes(lock, 0, 0)
    at, out, barrier = datetime.now(), [], threading.Barrier(2)
    build = lambda: spark.createDataFrame([(0, "riser", "w")], "entry_ord int, kind string, lemma string")

    def run():
        barrier.wait()
        out.append(hook.refresh(spark, state, build, at, "1"))

    threads = [threading.Thread(target=run) for _ in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    assert sorted(out) in (["busy", "ok"], ["fresh", "ok"], ["lost", "ok"])
    assert hook._table(spark, state, "reports", hook.REPORTED).filter(F.col("lemma") == "w").count() == out.count("ok")
    assert out.count("ok") == 1


def test_an_owner_that_lost_its_lease_publishes_nothing(spark, tmp_path):
    state = str(tmp_path / "state")

    def slow():
        fs, lock = hook._place(spark, f"{state}/refresh.lock")
        fs.setTimes(lock, 0, 0)
        assert hook.refresh(spark, state, quick, datetime.now(), "2") == "ok"
        return spark.createDataFrame([(0, "riser", "slow")], cols)

    cols = "entry_ord int, kind string, lemma string"
    quick = lambda: spark.createDataFrame([(0, "riser", "quick")], cols)
    assert hook.refresh(spark, state, slow, datetime.now(), "1") == "lost"
    assert [r.lemma for r in hook._table(spark, state, "reports", hook.REPORTED).collect()] == ["quick"]
