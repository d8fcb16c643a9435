"""Stateful streams against plain loops, whatever the order of arrival; the display flow and its log."""

import json
import os
import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wordtide.operators import swaps
from wordtide.plans import display, hook
from wordtide.sources import files
from wordtide.streaming import processors

DELTAS = "session_id string, message_id string, batch_seq long, delta string"
NOW = datetime(2024, 3, 4, 12)


def write(folder, number, rows, columns=("session_id", "message_id", "batch_seq", "delta")):
    folder.mkdir(exist_ok=True)
    path = folder / f"{number:03d}.json"
    path.write_text("".join(json.dumps(dict(zip(columns, r, strict=True)), default=str) + "\n" for r in rows))
    os.utime(path, (1_700_000_000 + number, 1_700_000_000 + number))  # files are read by age


def streamed(spark, folder, schema=DELTAS):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def run(writer):
    q = writer.trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(120)
    finally:
        q.stop()


def run_on(spark, writer, name, rows):
    """Runs without an end until so many rows are there."""
    q = writer.trigger(processingTime="0 seconds").start()
    try:
        for _ in range(120):
            if q.exception() is not None or spark.table(name).count() >= rows:
                break
            time.sleep(0.5)
        assert q.exception() is None
    finally:
        q.stop()


def in_memory(df, name, checkpoint):
    return df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(checkpoint))


def plain_fences(rows):
    """Each session's deltas one after the other, with one slot for the message and its fence."""
    out = {}
    for session in {r[0] for r in rows}:
        message, inside = None, False
        for _, m, seq, delta in sorted((r for r in rows if r[0] == session), key=lambda r: r[2]):
            if not m:
                out[session, seq] = False
                continue
            inside = inside if m == message else False
            out[session, seq], message = inside, m
            for line in delta.split("\n"):
                inside ^= bool(swaps.FENCE_LINE.match(line))
    return out


def deltas(rng, sessions=12, most=14):
    bits = ["arm", "```", "  ~~~ py", "    ```", "plain arm", "`arm`", "", "arms"]
    rows = []
    for s in range(sessions):
        messages = [rng.choice(["m1", "m1", "m2", "", None]) for _ in range(rng.randint(1, most))]
        rows += [(f"s{s}", m, i, "\n".join(rng.choices(bits, k=rng.randint(1, 4)))) for i, m in enumerate(messages, 1)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_fences_do_not_depend_on_arrival(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = deltas(rng)
    arrival = [*rows, *rng.sample(rows, 8)]  # some come twice
    rng.shuffle(arrival)
    for i in range(4):
        write(tmp_path / "in", i, arrival[i::4])
    run(in_memory(processors.stream_fences(streamed(spark, tmp_path / "in"), None), f"fences{seed}", tmp_path / "c"))
    got = [(r.session_id, r.batch_seq, r.in_fence) for r in spark.table(f"fences{seed}").collect()]
    assert sorted(got) == sorted((*k, v) for k, v in plain_fences(rows).items())
    assert len(got) == len(rows)


def test_fences_equal_the_batch_operator(spark, tmp_path):
    rng = random.Random(5)
    rows = [(f"s{s}", "m", i, rng.choice(["a", "```", "b\n~~~\nc", "```\n```"])) for s in range(6) for i in range(1, 12)]
    lines = [(s, m, q * 100 + n, bool(swaps.FENCE_LINE.match(x))) for s, m, q, d in rows for n, x in enumerate(d.split("\n"))]
    batch = swaps.fence_state(spark.createDataFrame(lines, "session_id string, message_id string, ord long, is_fence boolean")).filter("ord % 100 = 0")
    rng.shuffle(rows)
    for i in range(3):
        write(tmp_path / "in", i, rows[i::3])
    run(in_memory(processors.stream_fences(streamed(spark, tmp_path / "in"), None), "fences_b", tmp_path / "c"))
    got = sorted((r.session_id, r.batch_seq, r.in_fence) for r in spark.table("fences_b").collect())
    assert got == sorted((r.session_id, r.ord // 100, r.in_fence) for r in batch.collect())


def test_swaps_in_a_stream(spark, tmp_path):
    rows = [("s", "m", 1, "arm\n```\narm"), ("s", "m", 2, "arm\n```\narm"), ("t", "m", 1, "arm"), ("bad id", "m", 1, "```"), ("bad id", "m", 2, "arm"), (None, "m", 1, "arm"), ("u", "m", None, "arm")]
    write(tmp_path / "in", 0, [rows[1], *rows[3:]])
    write(tmp_path / "in", 1, [rows[0], rows[2]])
    run(in_memory(processors.stream_swaps(streamed(spark, tmp_path / "in"), {"arm": "branch"}, None), "swapped", tmp_path / "c"))
    got = sorted((r.session_id or "", r.batch_seq or 0, r.swapped, r.n_swaps) for r in spark.table("swapped").collect())
    assert got == [("", 1, "branch", 1), ("bad id", 1, "```", 0), ("bad id", 2, "branch", 1), ("s", 1, "branch\n```\narm", 1), ("s", 2, "arm\n```\nbranch", 1), ("t", 1, "branch", 1), ("u", 0, "branch", 1)]


def test_a_delta_that_never_comes_is_passed_over(spark, tmp_path):
    write(tmp_path / "in", 0, [("s", "m", 1, "```"), ("s", "m", 4, "c"), ("s", "m", 3, "```\nb")])
    write(tmp_path / "in", 1, [("t", "m", 1, "x")])
    write(tmp_path / "in", 2, [("s", "m", 2, "late"), ("s", "m", 5, "d"), ("t", "m", 2, "y")])
    run_on(spark, in_memory(processors.stream_fences(streamed(spark, tmp_path / "in"), 0), "gaps", tmp_path / "c"), "gaps", 6)
    got = sorted((r.session_id, r.batch_seq, r.in_fence) for r in spark.table("gaps").collect())
    assert got == [("s", 1, False), ("s", 3, True), ("s", 4, False), ("s", 5, False), ("t", 1, False), ("t", 2, False)]


def plain_claims(events):
    out = []
    for session in {s for s, _ in events}:
        last = None
        for at in sorted(a for s, a in events if s == session):
            fire = last is None or at - last >= timedelta(hours=4)
            last = at if fire else last
            out.append((session, at, fire))
    return sorted(out)


def test_claims_in_order_of_time(spark, tmp_path):
    rng = random.Random(2)
    events = [(f"s{rng.randint(0, 5)}", NOW + timedelta(minutes=rng.randint(0, 2_000))) for _ in range(90)]
    events += events[:3]
    arrival = [*events]
    rng.shuffle(arrival)
    for i in range(3):
        write(tmp_path / "in", i, arrival[i::3], ("session_id", "at"))
    write(tmp_path / "in", 8, [("end", NOW + timedelta(days=90))], ("session_id", "at"))
    write(tmp_path / "in", 9, [("end", NOW + timedelta(days=91)), ("../x", NOW)], ("session_id", "at"))
    stream = streamed(spark, tmp_path / "in", "session_id string, at timestamp")
    run(in_memory(processors.stream_claims(stream, "60 days"), "claims", tmp_path / "c"))
    got = sorted((r.session_id, r.at, r.fires) for r in spark.table("claims").collect() if r.session_id != "end")
    assert got == plain_claims(events)
    batch = swaps.claims(spark.createDataFrame(events, "session_id string, at timestamp"))
    assert got == sorted((r.session_id, r.at, r.fires) for r in batch.collect())


def test_claims_as_they_come(spark, tmp_path):
    for i, hours in enumerate([0, 1, 5, 6, 9]):
        write(tmp_path / "in", i, [("s", NOW + timedelta(hours=hours))], ("session_id", "at"))
    stream = streamed(spark, tmp_path / "in", "session_id string, at timestamp")
    run_on(spark, in_memory(processors.stream_claims(stream), "claims_now", tmp_path / "c"), "claims_now", 5)
    assert sorted(((r.at - NOW).total_seconds() / 3600, r.fires) for r in spark.table("claims_now").collect()) == [(0, True), (1, False), (5, True), (6, False), (9, True)]


# ---- the display flow


def reported(spark, state, at, *rows):
    cols = "entry_ord int, kind string, reason string, lemma string, known boolean, rate double, words array<string>, judge_note string, demote_to string"
    build = lambda: spark.createDataFrame([(i, "chronic", "known", w, known, 1.0, [to, w], None, to) for i, (w, to, known) in enumerate(rows)], cols)
    assert hook.refresh(spark, state, build, at, f"v{at}") == "ok"


def test_display(spark, tmp_path):
    state, out, log = str(tmp_path / "state"), str(tmp_path / "out"), str(tmp_path / "swaps")
    reported(spark, state, NOW, ("arm", "branch", True), ("leg", "limb", False))
    write(tmp_path / "in", 0, [("s", "m", 2, "Arms ` arm ` arm\n```"), ("s", "m", 1, "an ARM and a leg"), ("t", "m", 1, "eyes")])
    clock = [NOW + timedelta(hours=1)]
    start = lambda **k: run(display.display(streamed(spark, tmp_path / "in"), state, out, str(tmp_path / "c"), log, clock=lambda: clock[0], wait_ms=None, **k))
    start()
    said = lambda: {(r.session_id, r.batch_seq): r.shown for r in display.shown(spark, out).collect()}
    first = {("s", 1): "an BRANCH and a leg", ("s", 2): "Branches ` arm ` branch\n```", ("t", 1): "eyes"}
    assert said() == first
    # a newer report: the table is read again for each micro-batch, and the fence goes on
    reported(spark, state, NOW + timedelta(days=6, hours=1), ("arm", "twig", True), ("eye", "sight", True))
    clock[0] = NOW + timedelta(days=6, hours=2)
    write(tmp_path / "in", 1, [("s", "m", 3, "arm\n```\narm"), ("s", "n", 4, "eyes")])
    start()
    second = {("s", 3): "arm\n```\ntwig", ("s", 4): "sights"}
    assert said() == first | second
    # too old a report: only the pairs that are given
    clock[0] = NOW + timedelta(days=20)
    write(tmp_path / "in", 2, [("s", "n", 5, "arm and nose")])
    start(pairs={"nose": "snout"})
    assert said() == first | second | {("s", 5): "arm and snout"}
    rows = sorted((r.lemma, r.to, r.n) for r in files.swap_log(spark, log).collect())
    assert rows == [("arm", "branch", 1), ("arm", "branch", 2), ("arm", "twig", 1), ("eye", "sight", 1), ("nose", "snout", 1)]
    text = display.swap_report(spark, log, NOW + timedelta(days=20))
    assert [x.split()[0] for x in text.splitlines()[1:4]] == ["arm", "eye", "nose"] and "arm → twig (and others)  4×" in text
    assert text.splitlines()[-1] == "6 replacements in 20 days, 0.3 a day"
    assert display.swap_report(spark, str(tmp_path / "no log"), NOW) == "nothing replaced yet\n"


def test_a_replayed_micro_batch_adds_nothing(spark, tmp_path):
    out, log = str(tmp_path / "out"), str(tmp_path / "swaps")
    batch = spark.createDataFrame([("s", "m", 1, "arm arm", False), ("s", "m", 2, "arm", True)], processors.FENCED)
    assert display.show_batch(batch, 7, out, log, {"arm": "branch"}, NOW)
    assert not display.show_batch(batch, 7, out, log, {"arm": "other"}, NOW)
    assert [(r.shown, [(s.to, s.n) for s in r.swaps]) for r in display.shown(spark, out).orderBy("batch_seq").collect()] == [("branch branch", [("branch", 2)]), ("arm", [])]
    # stopped between the two writes: the log is made up from what was shown, not from the table of now
    batch = batch.withColumn("batch_seq", F.col("batch_seq") + 2)
    display.show_batch(batch, 8, out, None, {"arm": "branch"}, NOW)
    assert not display.show_batch(batch, 8, out, log, {"arm": "other"}, NOW)
    assert [(r.lemma, r.to, r.n) for r in files.swap_log(spark, log).collect()] == [("arm", "branch", 2)] * 2
    assert display.shown(spark, out).count() == 4


def test_without_swaps_everything_is_shown_as_it_is(spark, tmp_path):
    batch = spark.createDataFrame([("s", "m", 1, "arm", False)], processors.FENCED)
    display.show_batch(batch, 0, str(tmp_path / "o"), str(tmp_path / "l"), display.table_of(spark, str(tmp_path / "none"), NOW), NOW)
    assert [r.shown for r in display.shown(spark, str(tmp_path / "o")).collect()] == ["arm"]
    assert files.swap_log(spark, str(tmp_path / "l")).count() == 0
