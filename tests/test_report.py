"""The whole report against a plain Python version of it, on made-up prose in which every route admits words."""

import json
import math
import random
import sys
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from wordtide.functions import text as tx
from wordtide.operators import gate, thesaurus, tokens
from wordtide.operators.vectors import normalized
from wordtide.options import REPORT
from wordtide.plans import commands

cloudpickle.register_pickle_by_value(sys.modules[__name__])
NOW = datetime(2024, 3, 4)
STOP = tx.stopword_set()
O = REPORT.but(top=3, min_count=4, min_ratio=1.5, min_uses=3, max_uses=6, threshold=0.9, chronic_top=2, marked_top=2, min_chronic_rate=4.0, rarity_floor=5.0, incongruity_floor=0.3, phrase_min=2, phrase_top=2)
PHRASES = ["at the end", "the end of it", "never said"]


def _words(rng, n):
    out = []
    while len(out) < n:
        w = "".join(rng.choice("bdklmnrt") + rng.choice("aeio") for _ in range(rng.randint(2, 3)))
        if w not in out and w not in STOP and tx.lemma_of(w) == w:
            out.append(w)
    return out


def _corpus(rng, vocab):
    turns = []
    weights = [3 + (i % 7) for i in range(len(vocab))]
    for i in range(110):
        age = rng.choice([0.5, 2, 5, 9, 12, 18, 30, 50])
        pool = vocab[:4] * (6 if age < 7 else 0) + rng.choices(vocab[4:], weights[4:], k=40)
        parts = []
        for _ in range(rng.randint(2, 5)):
            said = rng.choices(pool, k=rng.randint(4, 8))
            if rng.random() < 0.5:
                said.insert(rng.randint(0, 2), f"the {rng.choice(vocab[8:12])} of")
            if rng.random() < 0.1:
                said.append(rng.choice(["at the end", "at the end of it"]))
            if rng.random() < 0.4:
                said.insert(1, vocab[20].capitalize())
            parts.append(" ".join(said))
        turns.append((i, f"p{rng.randint(0, 4)}", NOW - timedelta(days=age), ". ".join(parts)))
    return turns


def _unit(v):
    n = np.linalg.norm(v)
    return None if n == 0 else (v / n).astype(np.float32).astype(float)


class Plain:
    """The same definitions, one after the other over lists."""

    def __init__(self, turns, cands, freq, table, curated, judge=None):
        self.table, self.cands, self.freq, self.curated, self.judge = table, cands, freq, curated, judge
        self.sents = []
        for t, p, ts, text in turns:
            for no, s in enumerate(x for x in text.split(".") if x):
                toks = [w for w in map(tx.lemma_of, tx.words_of(s.lower())) if len(w.encode()) >= 3 and w not in STOP]
                if toks:
                    self.sents.append((t, no, p, ts, toks, tx.words_of(s.lower()), tx.words_of(s)))
        self.store, seen = [], set()
        for s in self.sents:
            if len(s[4]) >= 5 and tuple(s[4]) not in seen:
                seen.add(tuple(s[4]))
                self.store.append(s)

    def stride(self, xs):
        n, m = len(xs), O.max_uses
        return xs if n <= m else [xs[i * n // m] for i in range(m)]

    def hits(self, w):
        return [s for s in self.store if w in s[4]]

    def frame(self, w):
        opens, own = tokens.DETERMINERS.split(), self.hits(w)
        yes = sum(any(s[5][i - 1] in opens and tx.lemma_of(s[5][i]) == w and s[5][i + 1] == "of" for i in range(1, len(s[5]) - 1)) for s in own)
        return yes / len(own) if own else 0.0

    def mean(self, words):
        vs = [self.table[w] for w in words if w in self.table]
        return _unit(np.sum(vs, axis=0)) if vs else None

    def spread(self, bags):
        ms = [m for m in map(self.mean, bags) if m is not None]
        pairs = [a @ b for i, a in enumerate(ms) for b in ms[:i]]
        return len(ms), float(np.mean(pairs)) if pairs else 0.0

    def ranked(self, w, uses):
        out = []
        for n, (c, ic) in enumerate(self.cands[w][0]):
            if any(x not in self.table for x in c.split()):
                continue
            cos = []
            for u in uses:
                a, b = self.mean(u), self.mean([x for x in u if x != w] + c.split())
                if a is not None and b is not None:
                    cos.append(a @ b)
            if cos:
                out.append((-sum(x >= O.threshold for x in cos), -float(np.mean(cos)), n, c, ic, sum(x >= O.threshold for x in cos), len(cos)))
        return sorted(out)

    def word_ic(self, w):
        return -math.log((self.freq.get(w, 0) + 0.5) / sum(self.freq.values()))

    def report(self):
        full, recent, base, projects, by = Counter(), Counter(), Counter(), defaultdict(set), defaultdict(Counter)
        for _, _, p, ts, toks, *_ in self.sents:
            for w in toks:
                full[w] += 1
                projects[w].add(p)
                if ts >= NOW - timedelta(days=7):
                    recent[w] += 1
                    by[w][p] += 1
                elif ts >= NOW - timedelta(days=21):
                    base[w] += 1
        ft, rt, bt = full.total(), recent.total(), base.total()
        risers = []
        for w in recent:
            ratio = ((recent[w] + 0.5) / rt) / ((base[w] + 0.5) / bt)
            outside = recent[w] - max(by[w].values())
            if recent[w] >= O.min_count and ratio > 1 and ratio >= O.min_ratio and outside > 0:
                risers.append((-outside * math.log(ratio), w, ratio))
        uses = {w: [s[4] for s in self.stride(self.hits(w))] for w in full}
        ready = lambda w: bool(self.cands.get(w, ([],))[0]) and len(uses[w]) >= O.min_uses
        jobs, flagged = [], set()
        for _, w, ratio in sorted(risers)[: O.top]:
            if ready(w):
                flagged.add(w)
                jobs.append(("riser", "riser", w, recent[w] / rt * 1000, ratio))
        pool = sorted((-full[w] / ft * 1000, w) for w in full if full[w] / ft * 1000 >= O.min_chronic_rate and w not in flagged and len(projects[w]) >= 3)
        rare = lambda w: len(w.encode()) >= 4 and self.word_ic(w) >= O.rarity_floor
        used = Counter()
        for rate, w in pool:
            if not ready(w):
                continue
            route = next((r for r, ok in (("known", w in self.curated), ("frame", self.frame(w) >= O.frame_floor), ("rarity", rare(w))) if ok and used[r] < O.chronic_top), None)
            if route:
                used[route] += 1
                flagged.add(w)
                jobs.append(("chronic", route, w, -rate, None))
        marked = []
        for rate, w in pool:
            if w not in flagged and ready(w) and rare(w):
                around = self.mean([x for u in uses[w] for x in u if x != w])
                if w in self.table and around is not None and (odd := 1 - self.table[w] @ around) > O.incongruity_floor:
                    marked.append((-odd, rate, w))
        jobs += [("chronic", "marked", w, -rate, None) for _, rate, w in sorted(marked)]
        sample = [s[4] for s in self.stride(self.store)]
        base_spread = self.spread(sample)[1]
        mid, capped = Counter(), Counter()
        for *_, cased in self.sents:
            for x in cased[1:]:
                mid[tx.lemma_of(x.lower())] += 1
                capped[tx.lemma_of(x.lower())] += x[0].isupper() and x.upper() != x
        out, added = [], Counter()
        for kind, reason, w, rate, ratio in jobs:
            budget = {"riser": None, "known": "known", "marked": "marked"}.get(reason, "spread")
            if budget and added[budget] >= (O.marked_top if budget == "marked" else O.chronic_top):
                continue
            own = self.ranked(w, uses[w])
            floor = O.min_clean if kind == "riser" else max(O.min_clean, 0.5)
            rungs = [r for r in own if r[5] / r[6] >= floor]
            if not rungs and kind != "riser":
                for r in own[:2]:
                    if r[5] / r[6] < 0.3:
                        break
                    rungs.append(r)
            if not rungs or (mid[w] >= 20 and capped[w] / mid[w] >= 0.5):
                continue
            steps = sorted([(r[4], r[3]) for r in rungs] + [(self.cands[w][1], w)], key=lambda x: x[0])
            if self.judge and (said := self.judge(w, [x for _, x in steps], uses[w])) and said[0] == "term_of_art":
                continue
            n, clustered = self.spread([[x for x in u if x != w] for u in uses[w]])
            added[budget] += 1
            out.append((kind, reason, w, rate, ratio, self.frame(w), n, clustered - base_spread, [x for _, x in steps]))
        return out


def _world(spark, seed):
    rng = random.Random(seed)
    vocab = _words(rng, 40)
    turns = _corpus(rng, vocab)
    frame = spark.createDataFrame(turns, "turn_id long, project string, ts timestamp, text string").repartition(3)
    general = _words(rng, 12)
    index = [("n", w, 0, f"k{i}") for i, w in enumerate(vocab[:34])]
    synset = [(f"k{i}", "n", "") for i in range(34)] + [(f"g{j}", "n", "") for j in range(12)]
    words = [(f"k{i}", 0, w) for i, w in enumerate(vocab[:34])] + [(f"k{i}", 1, rng.choice(vocab)) for i in range(34)] + [(f"g{j}", 0, w) for j, w in enumerate(general)]
    ptrs = [(f"k{i}", n, "@", f"g{rng.randint(0, 11)}") for i in range(34) for n in range(2)]
    ic = [(f"g{j}", 0.5 + j / 7) for j in range(12)]
    freq = [(w, rng.choice([1, 1, 500, 3_000])) for w in vocab]
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    t = thesaurus.Thesaurus(
        make(index, "pos string, lemma string, sense_ord int, key string"), make(synset, "key string, pos string, gloss string"), make(words, "key string, ord int, word string"),
        make(ptrs, "key string, ord int, sym string, target string"), make(ic, "key string, ic double"), make(freq, "lemma string, n long"),
    )
    near = np.array([1.0, 1.0, 1.0])
    raw = [(w, (near + np.array([rng.gauss(0, 0.9 if i % 5 == 0 else 0.35) for _ in range(3)])).astype(np.float32).tolist()) for i, w in enumerate(dict.fromkeys([*vocab, *general]))]
    table = normalized(make(raw, "word string, v array<float>"))
    cands = defaultdict(lambda: ([], None))
    for r in thesaurus.candidates(thesaurus.ladders(t, make([(w,) for w in vocab], "lemma string"))).orderBy("lemma", "cand_ord").collect():
        cands[r.lemma] = ([*cands[r.lemma][0], (r.word, r.ic)], r.self_ic)
    return vocab, turns, frame, t, table, cands, dict(freq), {r.word: np.array(r.v, dtype=float) for r in table.collect()}


@pytest.mark.parametrize("seed", [3, 8])
def test_report_equals_the_plain_version(spark, seed):
    vocab, turns, frame, t, table, cands, freq, vectors = _world(spark, seed)
    curated = vocab[12:15]
    got = commands.report(frame, NOW, STOP, t, lambda v: table.join(v, "word", "left_semi"), curated, PHRASES, o=O).orderBy("entry_ord").collect()

    want = Plain(turns, cands, freq, vectors, curated).report()
    assert [(r.kind, r.reason, r.lemma, r.words) for r in got if r.kind != "phrase"] == [(k, why, w, ladder) for k, why, w, *_, ladder in want]
    for r, (*_, rate, ratio, frac, n, delta, _) in zip(got, want, strict=False):
        assert math.isclose(r.rate, rate) and (ratio is None or math.isclose(r.ratio, ratio)) and math.isclose(r.frame_frac, frac)
        assert r.uses == n and abs(r.cluster_delta - delta) < 1e-5 and len(r.spark) == 8
    assert {r.reason for r in got} >= {"riser", "known", "frame", "phrase"} and len({r.reason for r in got} & {"rarity", "marked"}) >= 1
    assert vocab[20] not in {r.lemma for r in got}
    said = [(r.lemma, r["count"]) for r in got if r.kind == "phrase"]
    found = Counter(r.phrase for r in tokens.report_phrases(frame, PHRASES, STOP).select(F.col("phrase")).collect())
    assert said == sorted(((p, n) for p, n in found.items() if n >= 2), key=lambda x: (-x[1], x[0]))[:2]


@pytest.mark.parametrize("seed", [3])
def test_report_asks_the_judge_what_the_plain_version_asks(spark, seed, tmp_path):
    vocab, turns, frame, t, table, cands, freq, vectors = _world(spark, seed)
    curated, asked = vocab[10:22], {}

    def role(word):
        return ["term_of_art", "tic", "none at all", "fails", "mixed", "term_of_art"][(len(word) + ord(word[0]) + seed) % 6]

    def plain(word, ladder, uses):
        at = ladder.index(word)
        asked[word] = (ladder[max(0, at - 4) : at], uses)
        return (role(word),)

    want = Plain(turns, cands, freq, vectors, curated, plain).report()
    where = tmp_path / "calls"
    where.mkdir()
    folder = str(where)

    def ask(word, ladder, samples):
        kind = ["term_of_art", "tic", "none at all", "fails", "mixed", "term_of_art"][(len(word) + ord(word[0]) + seed) % 6]
        with open(f"{folder}/{word}", "a") as f:
            f.write(json.dumps([ladder, samples]) + "\n")
        if kind == "fails":
            raise TimeoutError
        return json.dumps({"role": kind, "demote_to": ladder[-1] if ladder and kind == "tic" else "none", "note": f"about {word}"})

    g = gate.Gate(ask, str(tmp_path / "log"), "m", 1, batch=2)
    run = lambda: commands.report(frame, NOW, STOP, t, lambda v: table.join(v, "word", "left_semi"), curated, PHRASES, o=O, judge=g).orderBy("entry_ord").collect()
    got = run()
    assert [(r.kind, r.reason, r.lemma, r.words) for r in got if r.kind != "phrase"] == [(k, why, w, ladder) for k, why, w, *_, ladder in want]
    calls = {f.name: [json.loads(x) for x in f.read_text().splitlines()] for f in where.iterdir()}
    assert {w: (x[0][0], x[0][1]) for w, x in calls.items()} == {w: (o, [list(u) for u in uses]) for w, (o, uses) in asked.items()}
    assert any(role(w) == "term_of_art" for w in calls) and all(role(r.lemma) != "term_of_art" for r in got if r.kind != "phrase")
    for r in got:
        if r.kind != "phrase":
            offered = asked[r.lemma][0]
            judged = role(r.lemma) in ("tic", "mixed")
            assert r.judge_note == (f"about {r.lemma}" if judged else None)
            assert r.demote_to == (None if not judged else offered[-1] if role(r.lemma) == "tic" and offered else "")
    again = run()
    assert [r.asDict() for r in again] == [r.asDict() for r in got]
    # what was accepted is never asked again; what failed or was refused is
    for f in where.iterdir():
        assert len(f.read_text().splitlines()) == (1 if role(f.name) in ("term_of_art", "tic", "mixed") else 2)
