"""Hourly partials of transcripts against scans and trends of the transcripts themselves."""

import json
import os
import random
from datetime import datetime, timedelta

from wordtide.functions import text as tx
from wordtide.options import SCAN
from wordtide.plans import commands, partials
from wordtide.sources import transcripts

NOW = datetime(2024, 3, 4, 12)
STOP = tx.stopword_set()
SINCE = datetime(2023, 12, 1)


def session(path, rng, words, n, age):
    path.parent.mkdir(parents=True, exist_ok=True)
    lines = []
    for _ in range(n):
        at = NOW - timedelta(hours=rng.randint(0, 24 * age), minutes=rng.choice([0, 0, rng.randint(0, 59)]))
        said = " ".join(rng.choices(words, k=rng.randint(3, 9))) + "."
        lines.append(json.dumps({"type": "assistant", "timestamp": at.strftime("%Y-%m-%dT%H:%M:%SZ"), "message": {"content": [{"type": "text", "text": said}]}}))
    path.write_text("\n".join(lines) + "\n")


def age(path, days):
    t = (NOW - timedelta(days=days)).timestamp()
    os.utime(path, (t, t))


def rows(df):
    return [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()]


def test_a_growing_tree(spark, tmp_path):
    rng = random.Random(6)
    root, state = tmp_path / "turns", str(tmp_path / "state")
    words = ["mountains", "river", "tower", "quietly", "honest", "signal", "layers"]
    o = SCAN.but(min_count=2, min_ratio=1.05)
    for i in range(4):
        session(root / f"p{i % 2}" / f"s{i}.jsonl", rng, words, 25, 60)
        age(root / f"p{i % 2}" / f"s{i}.jsonl", 50 - i)
    session(root / "p0" / "subagents" / "x.jsonl", rng, ["never"], 5, 3)

    def agree():
        turns = transcripts.read_turns(spark, str(root), SINCE)
        assert rows(partials.scan(spark, str(root), state, NOW, STOP, SINCE, o)) == rows(commands.scan(turns, NOW, STOP, o))
        asked = ["Mountains", "signal", "absent"]
        new = partials.trend(spark, str(root), state, asked, NOW, STOP, SINCE).orderBy("lemma", "bucket")
        assert rows(new) == rows(commands.trend(turns, asked, NOW, STOP).orderBy("lemma", "bucket"))

    assert partials.update(spark, str(root), state, SINCE, STOP) == 4
    assert partials.update(spark, str(root), state, SINCE, STOP) == 0
    agree()
    # a new file: known ones are not opened. One of them is overwritten by what has its length and time, and still counts as before
    old = root / "p0" / "s0.jsonl"
    kept, spoiled = old.read_text(), len(old.read_text()) * "x"
    old.write_text(spoiled)
    age(old, 50)
    session(root / "p2" / "new.jsonl", rng, [*words[:2] * 4, *words], 40, 5)
    age(root / "p2" / "new.jsonl", 1)
    assert partials.update(spark, str(root), state, SINCE, STOP) == 1
    old.write_text(kept)
    age(old, 50)
    agree()
    # a file that grows is counted anew, one that goes no longer counts
    session(root / "p1" / "s1.jsonl", rng, words, 60, 9)
    os.remove(root / "p0" / "s2.jsonl")
    assert partials.update(spark, str(root), state, SINCE, STOP) == 1
    agree()
    # an update that stopped before its files were written counts for nothing
    (tmp_path / "state" / "files" / "half").mkdir()
    agree()
    # files older than asked for are left alone
    session(root / "p3" / "ancient.jsonl", rng, words, 5, 5)
    age(root / "p3" / "ancient.jsonl", 400)
    assert partials.update(spark, str(root), state, SINCE, STOP) == 0


def test_history_is_cut_at_whole_hours(spark, tmp_path):
    root, state = tmp_path / "turns", str(tmp_path / "state")
    session(root / "p" / "s.jsonl", random.Random(1), ["mountains", "rivers"], 80, 30)
    partials.update(spark, str(root), state, SINCE, STOP)
    since = NOW - timedelta(days=10)
    counted = {r.lemma: r.n for r in partials.hourly(spark, str(root), state, since).groupBy("lemma").sum("n").withColumnRenamed("sum(n)", "n").collect()}
    turns = transcripts.read_turns(spark, str(root), since)
    from wordtide.operators import tokens

    assert counted == {r.lemma: r["count"] for r in tokens.tokens(turns, STOP).groupBy("lemma").count().collect()}
