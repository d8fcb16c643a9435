"""Phrase matching: many phrases in one pass, against a plain scan."""

import random
from collections import Counter

import pytest

from wordtide.functions import text as tx
from wordtide.operators import tokens


def plain(words, phrases):
    """Left to right: at a place every phrase that begins there, then on after the longest."""
    out, i = [], 0
    while i < len(words):
        here = [p for p in phrases if tuple(words[i : i + len(p)]) == p]
        out += [" ".join(p) for p in here]
        i += max(map(len, here), default=1)
    return Counter(out)


@pytest.mark.parametrize("seed", range(3))
def test_scan_equals_the_plain_one(seed):
    rng = random.Random(seed)
    vocab = ["a", "b", "aa", "ab", "don't", "größe"]
    phrases = list({tuple(rng.choices(vocab, k=rng.randint(2, 4))) for _ in range(25)})
    found = tokens.automaton([" ".join(p) for p in phrases])
    for _ in range(300):
        words = rng.choices(vocab, k=rng.randint(0, 14))
        got = tokens.matches(found, f"|{'|'.join(words)}|")
        assert Counter(got) == plain(words, [p for p in phrases])


def test_ten_thousand_phrases(spark):
    rng = random.Random(7)
    vocab = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(400)]
    many = list({" ".join(rng.choices(vocab, k=rng.randint(2, 4))) for _ in range(10_500)})[:10_000]
    texts = [" ".join([*rng.choices(vocab, k=20), *rng.choice(many).split(), *rng.choice(many).upper().split(), *rng.choices(vocab, k=5)]) for _ in range(200)] + [None, "", "|", "wa - wb"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").repartition(3)
    out = tokens.phrase_matches(df, "t", many)
    got = Counter((r.i, r.phrase) for r in out.collect())
    index = {}
    for p in map(str.split, many):
        index.setdefault(p[0], []).append(p)
    want = Counter()
    for i, t in enumerate(texts):
        words = tx.words_of((t or "").lower())
        at = 0
        while at < len(words):
            here = [p for p in index.get(words[at], []) if words[at : at + len(p)] == p]
            want.update((i, " ".join(p)) for p in here)
            at += max(map(len, here), default=1)
    assert got == want and sum(want.values()) > 400
    plan = lambda n: len(tokens.phrase_matches(df, "t", many[:n])._jdf.queryExecution().toString())
    assert abs(plan(10) - plan(10_000)) < 200
    assert tokens.phrase_matches(df, "t", ["single", " "]).count() == 0
