"""Operators on tiny tables, each case in isolation."""

import json
import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wordtide.functions import text as tx
from wordtide.operators import drift, ledger, report, swaps, thesaurus, tokens, vectors, verdicts
from wordtide.options import REPORT
from wordtide.plans import commands
from wordtide.sources import files, transcripts
from wordtide.sources import thesaurus as thesaurus_files

NOW = datetime(2024, 3, 4)
STOP = tx.stopword_set()


def _turns(spark, rows):
    data = [(i, p, NOW - timedelta(days=d), t) for i, (p, d, t) in enumerate(rows)]
    return spark.createDataFrame(data, "turn_id long, project string, ts timestamp, text string")


def test_sentence_tokens_are_the_text_tokens(spark):
    turns = _turns(spark, [("a", 1, "Alpha beta! gamma's; delta\nflows `code` here"), ("b", 2, "...")])
    by_sentence = [t for r in tokens.sentences(turns, STOP).orderBy("turn_id", "sent_no").collect() for t in r.tokens]
    assert by_sentence == [r.lemma for r in tokens.tokens(turns, STOP).orderBy("turn_id").collect()]


def test_risers_leave_out_the_loudest_project(spark):
    counts = spark.createDataFrame([("spread", "x", 5, 1, 6), ("spread", "y", 5, 0, 5), ("topic", "x", 10, 0, 10), ("flat", "x", 40, 40, 80), ("flat", "y", 40, 40, 80)], "lemma string, project string, recent long, baseline long, full long")
    out = drift.risers(drift.lemma_counts(counts), REPORT.but(min_count=5)).collect()
    assert [r.lemma for r in out] == ["spread"]
    ratio = (10.5 / 100) / (1.5 / 81)
    assert math.isclose(out[0].ratio, ratio) and math.isclose(out[0].score, 5 * math.log(ratio)) and math.isclose(out[0].recent_rate, 100.0)
    assert drift.risers(drift.lemma_counts(counts.withColumn("baseline", F.lit(0)))).collect() == []


def test_week_buckets(spark):
    toks = _turns(spark, [("a", 0, ""), ("a", 6.9, ""), ("a", 7, ""), ("a", -3, ""), ("a", 60, "")]).withColumn("lemma", F.lit("w"))
    t = drift.trend(toks, ["w", "none"], NOW, 3).orderBy("lemma", "bucket").collect()
    assert [(r.lemma, r.n, r.rate) for r in t] == [("none", 0, None), ("none", 0, 0.0), ("none", 0, 0.0), ("w", 0, None), ("w", 1, 1000.0), ("w", 3, 1000.0)]
    assert drift.first_last(drift.trend(toks, ["w"], NOW, 3)).first()[1:] == (1000.0, 1000.0)


def test_store_keeps_the_first_and_samples_evenly(spark):
    same = "alpha beta gamma delta epsilon"
    turns = _turns(spark, [("a", 1, same), ("a", 1, f"{same}. one two"), *[("a", 1, f"{same} word{chr(97 + i)}x") for i in range(20)]])
    store = tokens.stored(tokens.sentences(turns, STOP))
    assert store.count() == 21 and store.filter(F.size("tokens") == 5).first().turn_id == 0
    used = tokens.uses(store, spark.createDataFrame([("alpha",)], "lemma string"), 4).orderBy("use_no").collect()
    ids = sorted(r.turn_id for r in store.collect())
    assert [r.turn_id for r in used] == [ids[i * 21 // 4] for i in range(4)]
    assert [r.turn_id for r in tokens.sample(store, 4).orderBy("turn_id").collect()] == [ids[i * 21 // 4] for i in range(4)]


def test_frames(spark):
    turns = _turns(spark, [("a", 1, "we saw the spine of design hold every heavy weight"), ("a", 1, "spine of paper holds many heavy books well")])
    out = tokens.frame_fraction(tokens.stored(tokens.sentences(turns, STOP)), spark.createDataFrame([("spine",)], "lemma string")).first()
    assert (out.uses, out.framed, out.frame_frac) == (2, 1, 0.5)


def test_phrases_count_all_at_a_place_then_skip_the_longest(spark):
    turns = _turns(spark, [("a", 1, "at the end of the day, at the end. At the"), ("b", 1, "x-at the-end")])
    found = tokens.audit_phrases(turns, ["at the end of the day", "at the end", "the end", "end of", "At  the", "day"])
    assert {r.phrase: r["count"] for r in found.groupBy("phrase").count().collect()} == {"at the end of the day": 1, "at the end": 2, "at the": 3}
    assert tokens.audit_phrases(turns, ["one"]).count() == 0


def test_names(spark):
    turns = _turns(spark, [("a", 1, "we met Robin near Robin. robin ROBIN")])
    assert tokens.name_counts(turns, STOP).filter("lemma = 'robin'").first()[1:] == (3, 2)


@pytest.fixture(scope="module")
def files_dir(tmp_path_factory):
    d = tmp_path_factory.mktemp("dict")
    head = "  1 licence line\n"
    noun = [
        "00000001 03 n 02 oak 0 great_oak 0 001 @ 00000002 n 0000 | a tree; with acorns",
        "00000002 03 n 01 tree 0 001 @ 00000003 n 0000 | a plant",
        "00000003 03 n 02 plant 0 Flora 0 000 | living",
        "00000004 03 n zz bad 0 000 | bad count",
        "00000005 03 n 05 short 0 000 | too few words",
        "00000006 03 n 01 cut 0 003 @ 00000002 n 0000 | too few pointers",
    ]
    adj = ["00000007 00 s 01 dry(a) 0 001 & 00000008 a 0000 | no water", "00000008 00 a 01 arid 0 000 | desert"]
    for name, lines in (("noun", noun), ("adj", adj), ("verb", []), ("adv", [])):
        (d / f"data.{name}").write_text(head + "".join(x + "\n" for x in lines))
    (d / "index.noun").write_text(head + "oak n 1 1 @ 1 0 00000001\ntree n 1 0 1 0 00000002\noak n 2 1 @ 2 0 00000001 00000099\n")
    (d / "index.adj").write_text("dry a 1 1 & 1 0 00000007\n")
    for name in ("verb", "adv"):
        (d / f"index.{name}").write_text(head)
    (d / "index.sense").write_text("oak%1:20:00:: 00000001 1 3\noak%2 00000001 1 2\ntree%1:20:00:: 00000002 1 40\nbad line\n")
    (d / "ic.dat").write_text("wnver::x\n1n 2\n2n 10\n3n 100 ROOT\n9n 0\n")
    return d


def test_thesaurus_files_and_ladders(spark, files_dir):
    t = thesaurus_files.read(spark, str(files_dir), str(files_dir / "ic.dat"))
    assert {r.key for r in t.synset.collect()} == {"00000001n", "00000002n", "00000003n", "00000007a", "00000008a"}
    assert {r.lemma: r.n for r in t.word_freq.collect()} == {"oak": 5, "tree": 40}
    assert math.isclose({r.key: r.ic for r in t.ic.collect()}["00000001n"], -math.log(2 / 100))
    asked = spark.createDataFrame([("oak",), ("dry",), ("none",)], "lemma string")
    rungs = thesaurus.ladders(t, asked).orderBy("lemma", "rung_ord").collect()
    assert [(r.word, r.source) for r in rungs if r.lemma == "oak"] == [("plant", "hypernym2"), ("flora", "hypernym2"), ("tree", "hypernym"), ("oak", "self"), ("great oak", "synonym")]
    assert {r.word for r in rungs if r.lemma == "dry"} == {"dry", "arid"}
    assert {r.word for r in thesaurus.candidates(thesaurus.ladders(t, asked)).filter("lemma = 'oak'").collect()} == {"plant", "flora", "tree"}
    assert {r.gloss for r in commands.ladder(t, asked).filter("lemma = 'oak'").collect()} == {"a tree"}


def test_trimmed(spark):
    df = spark.createDataFrame([(list("abcdefg"), "f"), (list("abcdefg"), "z"), ([], "a")], "w array<string>, l string")
    assert ["".join(r[0]) for r in df.select(thesaurus.trimmed(F.col("w"), F.col("l"))).collect()] == ["bcdef", "cdefg", ""]


def test_vectors(spark, tmp_path):
    (tmp_path / "v.txt").write_text("oak 2 0 0\ntree 0.9 0.1 0\nbad 1 x 0\nshort 1 1\nzero 0 0 0\nsea 0 0 3\noak 1 0 0\n")
    table = files.read_vectors(spark, str(tmp_path / "v.txt"))
    assert {r.word for r in table.collect()} == {"oak", "tree", "sea"}
    bags = spark.createDataFrame([(1, ["oak", "oak", "sea", "none"]), (2, ["none"]), (3, [])], "id int, words array<string>")
    got = {r.id: (r["mean"], r.known) for r in vectors.means(bags, ["id"], table).collect()}
    assert got[2] == (None, 0) and got[3] == (None, 0) and got[1][1] == 3 and math.isclose(got[1][0][0], 2 / math.sqrt(5), rel_tol=1e-6)
    uses = spark.createDataFrame([("oak", 1, ["oak", "sea"]), ("oak", 2, ["oak", "oak"])], "lemma string, use_no int, tokens array<string>")
    cands = spark.createDataFrame([("oak", "tree", 1.0, 1), ("oak", "sea", 1.0, 2), ("oak", "none", 1.0, 3)], "lemma string, word string, ic double, cand_ord int")
    subs = vectors.ranked(vectors.substitutes(uses, cands, table, 0.97)).orderBy("rank").collect()
    assert [(r.word, r.clean, r.total) for r in subs] == [("tree", 2, 2), ("sea", 0, 2)]
    assert vectors.spread(vectors.use_bags(uses), table, ["lemma"]).first().uses == 1
    assert math.isclose(vectors.incongruity(uses, table).first().incongruity, 1.0)


def test_hook_selection(spark):
    rows = [(i, "riser", f"r{i}", False, ["a", f"r{i}"]) for i in range(8)] + [(10 + i, "chronic", f"c{i}", i == 6, ["a", f"c{i}"]) for i in range(7)] + [(30, "phrase", "p q", True, [])]
    entries = spark.createDataFrame(rows, "entry_ord int, kind string, lemma string, known boolean, words array<string>")
    assert [r.lemma for r in report.hook_entries(entries, 5, 2).orderBy("shown_ord").collect()] == ["c6", "c0", "c1", "r0", "r1", "p q"]
    assert [r.lemma for r in report.hook_entries(entries.filter("kind <> 'riser'"), 5, 2).orderBy("shown_ord").collect()] == ["c6", "c0", "c1", "c2", "c3", "p q"]
    assert report.hook_entries(entries.withColumn("words", F.array("lemma")), 5, 0).count() == 1
    assert report.render([{"lemma": "b", "kind": "riser", "words": ["a", "b"], "judge_note": "Vague. More."}], hook=True) == "b (riser): a < [b] — Vague.\n"


def test_staleness():
    built = {"generated_at": NOW, "version": "1", "list_modified": NOW}
    at = lambda **k: NOW + timedelta(**k)
    assert [report.staleness(None, NOW, "1", None), report.staleness(built, at(days=6), "1", NOW), report.staleness(built, at(minutes=5), "2", None), report.staleness(built, at(hours=1), "2", None), report.staleness(built, at(hours=1), "1", at(hours=1)), report.staleness(built, at(hours=1), "1", None)] == ["none", "old", "", "version", "list", ""]


def test_ledger_lifecycle(spark):
    day = lambda n: NOW + timedelta(days=n)
    log = spark.createDataFrame([(day(0), "a", "chronic", 2.0, False), (day(1), "a", "chronic", 1.0, False), (day(0), "b", "riser", 1.0, False), (day(3), "b", "riser", 3.0, True)], "refresh_at timestamp, lemma string, kind string, rate double, known boolean")
    times = spark.createDataFrame([(day(i),) for i in range(4)], "refresh_at timestamp")
    shown = spark.createDataFrame([(day(1), "b"), (day(1), "stray")], "at timestamp, lemma string")
    rows = {r.lemma: r for r in ledger.fold(log, times, shown).collect()}
    assert (rows["a"].first_rate, rows["a"].last_rate, rows["a"].refreshes, rows["a"].faded, rows["a"].faded_at) == (2.0, 1.0, 2, True, day(2))
    assert (rows["b"].faded, rows["b"].injected, rows["b"].known, set(rows)) == (False, 1, True, {"a", "b"})
    live = ledger.fold(log, times.filter(F.col("refresh_at") <= F.lit(day(1))))
    assert [r.lemma for r in ledger.curation_candidates(live.filter("lemma = 'a'")).collect()] == ["a"]


def test_verdicts(spark):
    cols = "seq long, word string, ladder_hash string, model string, schema_version int, role string, demote_to string, note string, well_formed boolean, safe boolean, at string"
    log = spark.createDataFrame([(1, "w", "h1", "m", 1, "tic", "x", "", True, True, "t1"), (2, "w", "h1", "m", 1, "mixed", "y", "", False, True, "t2"), (3, "w", "h2", "m", 1, "term_of_art", "", "", True, True, "t3"), (4, "w", "h2", "m", 2, "tic", "x", "", True, True, "t2")], cols)
    assert {r.ladder_hash for r in verdicts.cache(log).collect()} == {"h2"}
    assert verdicts.latest(log).first().role == "term_of_art"
    c = verdicts.churn(log).first()
    assert (c.ladders, c.accepted, c.refused, c.roles, c.rungs, c.schemas, c.flips_within, c.crosses_within) == (2, 3, 1, ["tic", "term_of_art"], ["x", "-"], [1, 2], True, True)
    assert verdicts.parsed(json.dumps({"role": "tic", "demote_to": "none"}), ["a"]) == {"role": "tic", "demote_to": "", "note": ""}
    assert verdicts.parsed("{", ["a"]) is None and verdicts.parsed('{"role": "tic", "demote_to": "z"}', ["a"]) is None
    ok = spark.createDataFrame([('{"role":"tic","demote_to":"a"}',), ('{"role":"odd","demote_to":"a"}',), ("no",)], "x string")
    assert [r[0] for r in ok.select(verdicts.well_formed(F.col("x"), F.array(F.lit("a")))).collect()] == [True, False, False]


def test_swaps(spark):
    table = {"arm": "branch"}
    text, inside, counts = swaps.rewrite("Arms and arm's `arm` https://arm.io x/arm\n```\narm\n", False, table)
    assert text == "Branches and branch's `arm` https://arm.io x/arm\n```\narm\n" and inside and counts == {"arm": 2}
    assert swaps.rewrite("arm\n```\narm", True, table)[:2] == ("arm\n```\nbranch", False)
    entries = spark.createDataFrame([("riser", "Arm", "branch", True), ("riser", "leg", "LEG", True), ("phrase", "a b", "c", True), ("riser", "toe", "x", False)], "kind string, lemma string, demote_to string, known boolean")
    assert {r.lemma: r.replacement for r in swaps.swap_table(entries, {"arms": "limb"}).collect()} == {"arm": "limb"}


def test_claims_follow_the_last_fired(spark):
    hours = [0, 3, 4, 7.5, 8, 20]
    df = spark.createDataFrame([("s", NOW + timedelta(hours=h)) for h in hours] + [("bad id", NOW)], "session_id string, at timestamp")
    assert [r.fires for r in swaps.claims(df).orderBy("at").collect()] == [True, False, True, False, True, True]


def test_transcripts(spark, tmp_path):
    def line(ts="2024-03-01T10:00:00Z", kind="assistant", content=None, **more):
        return json.dumps({"type": kind, "timestamp": ts, "message": {"content": [{"type": "text", "text": "kept"}] if content is None else content}, **more})

    d = tmp_path / "p 1"
    (d / "subagents").mkdir(parents=True)
    two = [{"type": "text", "text": "a"}, {"type": "thinking", "text": "no"}, {"type": "text", "text": "b"}]
    lines = [line(content=two), line(isSidechain=True), line(kind="user"), line("2023-01-01T00:00:00Z"), "not json", line(content="plain"), line(content={"type": "text", "text": "x"}), line("2024-03-01"), line("2024-03-01T10:00:00+02:00")]
    (d / "s.jsonl").write_text("\n".join(lines) + "\n")
    (d / "subagents" / "t.jsonl").write_text(line() + "\n")
    (d / "notes.txt").write_text(line() + "\n")
    (tmp_path / "top.jsonl").write_text(line() + "\n")
    out = transcripts.read_turns(spark, str(tmp_path), datetime(2024, 2, 1)).orderBy("turn_id").collect()
    assert [(r.project, r.text) for r in out] == [("p 1", "a\nb"), ("p 1", "kept"), ("top.jsonl", "kept")]
    with pytest.raises(Exception):  # noqa: B017
        transcripts.read_turns(spark, str(tmp_path / "none"), NOW).count()


def test_lists_and_documents(spark, tmp_path):
    words, phrases = files.curated_list(spark, str(tmp_path / "own" / "list.txt"), ["# c", "Flies", "at the end", "at the end", ""])
    assert (words, phrases) == (["fly"], ["at the end"]) and (tmp_path / "own" / "list.txt").exists()
    files.write_document(spark, {"a": 1}, str(tmp_path / "r.json"))
    assert files.read_report(spark, str(tmp_path / "r.json")) == {"a": 1} and files.read_report(spark, str(tmp_path / "none")) is None
    (tmp_path / "swaps.jsonl").write_text('{"t":"2024-01-01T00:00:00Z","w":"a","to":"b","n":2}\n{"t":"2024-01-03T01:00:00Z","w":"a","to":"c","n":3}\n{"w":"torn\n{"w":"","n":1}\n')
    r = swaps.swap_totals(files.swap_log(spark, str(tmp_path / "swaps.jsonl"))).first()
    assert (r.lemma, r.total, r.last_to, r.replacements, r.per_day) == ("a", 5, "c", 2, 5 / 3)
    assert files.verdict_log(spark, str(tmp_path / "absent.jsonl")).count() == 0


def test_report_without_words_never_reads_vectors(spark, files_dir):
    t = thesaurus_files.read(spark, str(files_dir))

    def fail(_):
        raise AssertionError("vectors were read")

    turns = _turns(spark, [("a", 1, "in the end it works well enough today")] * 6)
    out = commands.report(turns, NOW, STOP, t, fail, phrases=["in the end"]).collect()
    assert [(r.kind, r.lemma, r["count"]) for r in out] == [("phrase", "in the end", 6)]


def test_report_admits_a_riser(spark, files_dir, tmp_path):
    t = thesaurus_files.read(spark, str(files_dir))
    (tmp_path / "v.txt").write_text("oak 1 0\ntree 1 0.01\nplant 1 0.02\nflora 0 1\nstrong 1 0.1\nroots 1 0\n")
    said = [(p, d, f"oak stood strong near roots {w} hill") for p, d, w in [("a", 1, "north"), ("b", 2, "south"), ("a", 3, "east"), ("b", 1, "west"), ("c", 2, "low")]]
    turns = _turns(spark, [*said, *[("a", 15, "plain words about other quiet matters entirely")] * 3])
    o = REPORT.but(min_count=3, min_ratio=1.5, min_uses=2, threshold=0.9)
    out = commands.report(turns, NOW, STOP, t, lambda v: files.read_vectors(spark, str(tmp_path / "v.txt"), v), o=o).collect()
    assert [(r.kind, r.lemma) for r in out] == [("riser", "oak")] and out[0].words == ["tree", "oak", "plant"] and len(out[0].spark) == 8


def test_refresh_hook_and_ledger(spark, tmp_path):
    from wordtide.plans import hook

    state, at = str(tmp_path / "state"), lambda **k: NOW + timedelta(**k)
    cols = "entry_ord int, kind string, reason string, lemma string, known boolean, rate double, words array<string>, judge_note string"
    entries = lambda *rows: (lambda: spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], cols))
    honor, spine = ("riser", "riser", "honor", False, 1.5, ["keep", "honor"], None), ("chronic", "frame", "spine", False, 2.0, ["core", "spine"], "Vague. More.")
    assert hook.shown(spark, state, NOW) == ("", []) and hook.last_report(spark, state) is None
    fails = lambda: 1 / 0
    assert hook.refresh(spark, state, fails, NOW, "1") == "error"
    assert hook.refresh(spark, state, fails, at(minutes=5), "1", automatic=True) == "paused"
    assert hook.refresh(spark, state, entries(honor, spine), at(minutes=20), "1", automatic=True) == "ok"
    assert hook.refresh(spark, state, fails, at(minutes=30), "2") == "fresh"
    fs, lock = hook._place(spark, f"{state}/refresh.lock")
    fs.createNewFile(lock)
    assert hook.refresh(spark, state, fails, datetime.now(), "2") == "busy"
    fs.setTimes(lock, 0, 0)
    assert hook.refresh(spark, state, entries(spine), at(days=6, minutes=20), "2") == "ok" and not fs.exists(lock)
    later = at(days=7)
    text, lemmas = hook.shown(spark, state, later)
    assert text == "spine (frame): core < [spine] — Vague.\n" and lemmas == ["spine"]
    prompts = spark.createDataFrame([("a", later), ("a", later + timedelta(hours=1)), ("a", later + timedelta(hours=5)), ("b", later), ("../x", later)], "session_id string, at timestamp")
    assert sorted((r.session_id, r.at - later) for r in hook.hook(prompts, state, later).collect()) == [("a", timedelta()), ("a", timedelta(hours=5)), ("b", timedelta())]
    rows = {r.lemma: r for r in hook.history(spark, state).collect()}
    assert (rows["spine"].refreshes, rows["spine"].injected, rows["spine"].faded) == (2, 3, False) and rows["honor"].faded_at == at(days=6, minutes=20)
    shown = ledger.render(hook.history(spark, state), at(days=20))
    assert shown.splitlines()[0] == "still flagged:" and "since 2024-03-04 (2w, 2 refreshes)" in shown and "shown 3×" in shown and "→ gone 2024-03-10" in shown
    old = hook.shown(spark, state, at(days=30))
    assert old[1] == [] and old[0].startswith("word report is 23d old") and "division by zero" in old[0]
    assert ledger.render(hook.history(spark, str(tmp_path / "none")), NOW) == "nothing recorded yet\n"


def test_console_and_churn_text(spark):
    from wordtide.functions import console

    out = spark.createDataFrame([("honor", 12, 3, 0.55555)], "term string, hits long, projects long, rate double").withColumn("status", F.lit("below cutoff"))
    assert console.table(out, console.AUDIT).splitlines() == ["TERM   HITS  PROJECTS  RATE/1K  STATUS", "honor  12    3         0.556    below cutoff"]
    toks = _turns(spark, [("a", 0, ""), ("a", 7, "")]).withColumn("lemma", F.lit("w"))
    assert console.trend_table(drift.trend(toks, ["w"], NOW, 3)).splitlines()[1:] == ["0     0k      -", "1     0k      1000.00", "2     0k      1000.00"]
    cols = "seq long, word string, ladder_hash string, model string, schema_version int, role string, demote_to string, note string, well_formed boolean, safe boolean, at string"
    row = lambda i, w, h, s, role, to: (i, w, h, "m", s, role, to, "", True, True, f"t{i}")
    log = spark.createDataFrame([row(1, "x", "a", 1, "tic", "p"), row(2, "x", "b", 1, "term_of_art", ""), row(3, "y", "a", 1, "tic", "p"), row(4, "y", "b", 2, "mixed", "p"), row(5, "z", "a", 1, "tic", "p"), row(6, "v", "a", 1, "tic", "p"), row(7, "v", "b", 1, "tic", "q")], cols)
    text = verdicts.render_churn(verdicts.churn(log))
    assert [x.split()[:2] for x in text.splitlines()[1:3]] == [["!", "x"], ["v", "2"]] and "changed only across schemas:\n  y" in text.replace("   ", "  ")
    assert text.endswith("2 of 3 words on two ladders or more changed, 1 of them into or out of term of art\n")
    assert verdicts.render_churn(verdicts.churn(log.filter("word = 'z'"))) == "1 judged, none on more than one ladder\n"
