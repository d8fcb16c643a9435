"""The judge's flow: what is served, what is asked, what is logged, and what a report makes of it."""

import json
import sys
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from wordtide.operators import gate, verdicts
from wordtide.sources import files

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def recording(folder, answer):
    """An ``Ask`` that notes each call in a file of its own and answers by word and call number."""
    folder.mkdir(exist_ok=True)
    where = str(folder)

    def ask(word, ladder, samples):
        import os
        import uuid

        n = sum(f.startswith(word + "~") for f in os.listdir(where))
        with open(f"{where}/{word}~{uuid.uuid4().hex}", "w") as f:
            f.write(repr((ladder, samples)))
        return answer(word, ladder, n)

    return ask


def calls(folder):
    return Counter(f.name.split("~")[0] for f in folder.iterdir())


def verdict(role, to="none", note="n"):
    return json.dumps({"role": role, "demote_to": to, "note": note})


def asks(spark, *rows):
    return spark.createDataFrame([(w, list(ladder), [["the", w, "holds"]]) for w, ladder in rows], "word string, ladder array<string>, samples array<array<string>>")


def said(df):
    return {r.word: (r.role, r.demote_to, r.origin) for r in df.collect()}


def test_an_answer_is_asked_for_once(spark, tmp_path):
    g = gate.Gate(recording(tmp_path / "calls", lambda w, ladder, n: verdict("tic", ladder[0], "loose")), str(tmp_path / "log"), "m", 3, batch=2, at_once=2)
    words = asks(spark, *((f"w{i}", ["layer", "surface"]) for i in range(9)))
    assert said(g(words)) == {f"w{i}": ("tic", "layer", "asked") for i in range(9)}
    # the order of rungs does not matter; another set of rungs, model or version does
    again = asks(spark, *((f"w{i}", ["surface", "layer"]) for i in range(9)))
    assert said(g(again)) == {f"w{i}": ("tic", "layer", "log") for i in range(9)}
    assert set(calls(tmp_path / "calls").values()) == {1}
    assert said(g(asks(spark, ("w1", ["surface"]), ("w2", ["layer", "surface"])))) == {"w1": ("tic", "surface", "asked"), "w2": ("tic", "layer", "log")}
    other = gate.Gate(g.ask, g.log, "other", 3)
    assert said(other(asks(spark, ("w2", ["layer", "surface"])))) == {"w2": ("tic", "layer", "asked")}
    assert said(gate.Gate(g.ask, g.log, "m", 13)(asks(spark, ("w2", ["layer", "surface"])))) == {"w2": ("tic", "layer", "log")}
    assert files.verdict_log(spark, g.log).count() == 11


def test_refused_answers_are_logged_and_not_served(spark, tmp_path):
    bad = {"off": verdict("tic", "bedrock"), "incoherent": verdict("term_of_art", "layer"), "torn": '{"role": "tic"', "role": verdict("great", "none")}

    def answer(word, ladder, n):
        if word == "busy" and n == 0:
            raise TimeoutError("overloaded")
        return bad[word] if word in bad and n == 0 else verdict("mixed", "none")

    g = gate.Gate(recording(tmp_path / "calls", answer), str(tmp_path / "log"), "m", 1)
    rows = asks(spark, *((w, ["layer", "surface"]) for w in [*bad, "busy", "fine"]))
    assert said(g(rows)) == {"fine": ("mixed", "", "asked")}
    log = files.verdict_log(spark, g.log)
    assert {(r.word, r.well_formed, r.safe) for r in log.collect()} == {("off", False, False), ("torn", False, False), ("role", False, False), ("incoherent", True, False), ("fine", True, True)}
    assert said(g(rows)) == {**{w: ("mixed", "", "asked") for w in [*bad, "busy"]}, "fine": ("mixed", "", "log")}
    assert calls(tmp_path / "calls") == Counter({**dict.fromkeys([*bad, "busy"], 2), "fine": 1})
    assert {r.word for r in verdicts.latest(files.verdict_log(spark, g.log)).collect()} == {*bad, "busy", "fine"}
    assert set(said(g(rows)).values()) == {("mixed", "", "log")}


def test_a_later_refusal_supersedes_and_is_asked_again(spark, tmp_path):
    g = gate.Gate(recording(tmp_path / "calls", lambda w, ladder, n: verdict("tic", "a")), str(tmp_path / "log"), "m", 1)
    assert said(g(asks(spark, ("x", ["a"]))))["x"] == ("tic", "a", "asked")
    h = gate.ladder_hash(F.array(F.lit("a")))
    row = spark.range(1).select(F.lit("x").alias("word"), h.alias("ladder_hash"), F.lit("tic").alias("role"), F.lit("b").alias("demote_to"), F.lit("").alias("note"), F.lit(False).alias("well_formed"), F.lit(False).alias("safe"))
    files.append_batch(verdicts.record(row, "m", 1), g.log, "99999999-later")
    assert said(g(asks(spark, ("x", ["a"]))))["x"] == ("tic", "a", "asked")
    assert calls(tmp_path / "calls") == {"x": 2}


def test_a_batch_is_logged_once(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1)], "word string, n int")
    log = str(tmp_path / "log")
    assert files.append_batch(rows, log, "7") and not files.append_batch(rows, log, "7")
    (tmp_path / "log" / "batch-8").mkdir()
    (tmp_path / "log" / "batch-8" / "part-half.json").write_text('{"word": "half"}\n')
    assert files.append_batch(rows, log, "8")
    assert [r.word for r in files.verdict_log(spark, log).collect()] == ["a", "a"]


def test_calls_of_a_task_are_bounded(spark, tmp_path):
    where = str(tmp_path)

    def ask(word, ladder, samples):
        import time
        import uuid

        begin = time.time()
        time.sleep(0.1)
        with open(f"{where}/{uuid.uuid4().hex}", "w") as f:
            f.write(f"{begin} {time.time()}")
        return json.dumps({"role": "tic", "demote_to": "none"})

    g = gate.Gate(ask, str(tmp_path / "log"), "m", 1, batch=40, at_once=3)
    g(asks(spark, *((f"w{i}", []) for i in range(20)))).collect()
    spans = [tuple(map(float, p.read_text().split())) for p in tmp_path.iterdir() if p.is_file()]
    assert len(spans) == 20
    assert 2 <= max(sum(a < e and s < b for s, e in spans) for a, b in ((t, t + 1e-6) for t, _ in spans)) <= 3


def one_by_one(candidates, roles, most):
    """A budget gone through candidate by candidate."""
    added, asked, kept = Counter(), [], []
    for budget, _, lemma in sorted(candidates):
        if added[budget] >= most[budget]:
            continue
        asked.append(lemma)
        if roles.get(lemma) != "term_of_art":
            added[budget] += 1
            kept.append(lemma)
    return sorted(asked), sorted(kept)


@pytest.mark.parametrize("seed", range(4))
def test_rounds_ask_what_going_one_by_one_asks(spark, seed):
    import random

    rng = random.Random(seed)
    cands = [(b, float(i), f"{b}{i}") for b in ("known", "spread", "riser") for i in range(12)]
    roles = {c[2]: rng.choice(["term_of_art", "tic", "mixed", None]) for c in cands}
    roles = {k: "term_of_art" if seed == 3 and k.startswith("known") else v for k, v in roles.items()}
    most = {"known": 3, "spread": 5, "riser": 99}
    asked = []

    def judge(new):
        words = [r.word for r in new.collect()]
        asked.extend(words)
        return spark.createDataFrame([(w, roles[w], "", "", "") for w in words if roles[w]], gate.JUDGED)

    df = spark.createDataFrame([(lemma, b, p, ["x"], [["s"]]) for b, p, lemma in cands], "lemma string, budget string, place double, options array<string>, samples array<array<string>>")
    limit = F.when(F.col("budget") == "known", 3).when(F.col("budget") == "spread", 5).otherwise(99)
    out, rounds = gate.within_budget(df, judge, limit)
    want_asked, want = one_by_one(cands, roles, most)
    assert sorted(asked) == want_asked and sorted(r.lemma for r in out.collect()) == want
    assert rounds >= 1


def test_http_judge(spark, tmp_path, monkeypatch):
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["content-length"])))
            seen.append((self.headers["x-key"], body))
            word = body["messages"][0]["content"].splitlines()[0].removeprefix("word: ")
            reply = {"error": {"message": "overloaded"}} if word == "busy" else {"answer": {"role": "tic", "demote_to": body["schema"]["properties"]["demote_to"]["enum"][1]}}
            out = json.dumps(reply).encode()
            self.send_response(200)
            self.send_header("content-length", str(len(out)))
            self.end_headers()
            self.wfile.write(out)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        # executors read the secret from their own environment; local ones were started before
        ask = gate.HttpJudge(f"http://127.0.0.1:{server.server_port}", "m", "Judge.", {"x-key": "${HOME}"}, timeout=20)
        g = gate.Gate(ask, str(tmp_path / "log"), "m", 1)
        assert said(g(asks(spark, ("busy", ["a"]), ("hook", ["snare", "bait"])))) == {"hook": ("tic", "snare", "asked")}
    finally:
        server.shutdown()
    assert len(seen) == 2 and all(k and k != "${HOME}" for k, _ in seen)
    assert {b["system"] for _, b in seen} == {"Judge."} and all(b["temperature"] == 0 for _, b in seen)
