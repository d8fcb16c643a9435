"""Phrase mining, best-fit packing and hard negatives against brute force on small tables."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import pairwise

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordtide.llm import bestfit, negatives, phrases, queries
from wordtide.llm.packing import default_tokenizer

RNG = random.Random(31)

# ---- phrases

DOCS = "doc_id long, text string, lang string, phrase string, a long, block long, segment int"


def _lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute_phrases(rows, least, longest, top, absorb=100):
    n, f = Counter(), defaultdict(Counter)
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", _lower(text or "")):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        good = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        best = defaultdict(int)
        for p, a in good.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if (i, j) != (0, len(p)):
                        best[p[i:j]] = max(best[p[i:j]], a)
        scored = []
        for p, a in good.items():
            if 100 * best[p] >= absorb * a:
                continue
            score, _, left, right = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


@pytest.fixture(scope="module")
def texts():
    words = ["The", "of", "Größe", "tower", "ring", "ça", "x'1", "AND", "ÄB"]
    rows = []
    for _ in range(120):
        text = ""
        for _ in range(RNG.randint(0, 60)):
            text += RNG.choice(words) + RNG.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", " ", "  "])
        rows.append((text, RNG.choice(["en", "en", "de", None, "und"])))
    passage = "one fixed passage of seven plain words"
    rows += [(passage, "en")] * 25 + [(f"before {passage} after", "en")] * 5
    rows += [(None, "en"), ("", "de"), (" .,;\n", "fr"), ("word " * 20_000, "es"), ("\x00a\x00 b " * 40, "de")]
    return rows


def _docs(spark, texts, parts=3):
    return spark.createDataFrame([(i, t, lang, "x", 1, 2, 3) for i, (t, lang) in enumerate(texts)], DOCS).repartition(parts)


def _found(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


@pytest.mark.parametrize(("least", "longest", "top", "absorb"), [(8, 5, 2000, 100), (20, 3, 7, 60), (5, 2, 30, 100), (10_000_000, 5, 5, 100)])
def test_phrases_equal_brute_force(spark, texts, least, longest, top, absorb):
    got = phrases.mine(_docs(spark, texts), least=least, longest=longest, top=top, absorb_percent=absorb)
    assert _found(got) == brute_phrases(texts, least, longest, top, absorb)


def test_phrases_do_not_depend_on_blocks_and_segments(spark, texts):
    want = brute_phrases(texts, 8, 5, 50)
    assert _found(phrases.mine(_docs(spark, texts, 7), least=8, top=50, block_bytes=300, segment_rows=40)) == want


def test_phrases_of_an_empty_table(spark):
    assert phrases.mine(spark.createDataFrame([], DOCS)).collect() == []
    assert phrases.mine(spark.createDataFrame([(1, None, None, "", 1, 1, 1)], DOCS), least=1).collect() == []


def test_scores_beyond_64_bits(spark):
    rows = spark.createDataFrame([(3 * 10**12, 4 * 10**12, [5 * 10**12], [6 * 10**12])], "a long, n long, heads array<long>, tails array<long>")
    assert rows.select(F.expr(phrases._CUT).alias("c")).first().c.score == 1000 * 3 * 4 // (5 * 6)


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 60_000])
def test_perfect_hash(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
    table = phrases.PerfectHash(keys)
    assert sorted(table.slots(keys).tolist()) == list(range(len(keys)))
    assert (table.stored[table.slots(keys)] == keys).all()
    strange = rng.integers(0, 2**64, 5_000, dtype=np.uint64)
    known = np.isin(strange, keys)
    assert (table.slots(strange)[~known] == -1).all()
    assert (phrases.unpacked(phrases.packed(keys)) == keys).all()


def test_candidates_lose_no_frequent_key():
    rng = np.random.default_rng(5)
    keys, counts = rng.zipf(1.3, 20_000).astype(np.uint64), rng.integers(1, 4, 20_000)
    total = np.bincount(np.minimum(keys, 50_000).astype(int), weights=counts)
    often = {int(k) for k in np.unique(keys) if k < 50_000 and total[int(k)] >= 60}
    found = {int(k) for k in phrases.candidates(keys, counts, 60)}
    assert often <= found and len(found) < len(np.unique(keys)) / 4


# ---- best-fit packing


def _brute_place(sizes, capacity):
    """Every choice of bin tried out: the one with the smallest sum of squared counts, then the tightest."""
    gaps, out = [], []
    for s in sizes:
        choices = []
        for i, g in enumerate([*gaps, capacity]):
            if g >= s:
                after = [*gaps]
                after[i : i + 1] = [g - s]
                choices.append((sum(c * c for g2, c in Counter(after).items() if g2), g, i, after))
        least = min(c[:2] for c in choices)
        _, g, i, gaps = max((c for c in choices if c[:2] == least), key=lambda c: c[2])
        out.append((least, g))
    return out, gaps


@pytest.mark.parametrize("capacity", [7, 16, 33])
def test_places_are_those_of_smallest_squares(capacity):
    rng = random.Random(capacity)
    sizes = [rng.randint(1, capacity) for _ in range(150)]
    rule, gaps = bestfit.SumOfSquares(capacity), {}
    want, _ = _brute_place(sizes, capacity)
    for s, (least, gap) in zip(sizes, want, strict=True):
        bin_, offset = rule.place(s)
        assert capacity - offset == gap and gaps.get(bin_, capacity) == gap
        gaps[bin_] = gap - s
        assert sum(c * c for g, c in Counter(gaps.values()).items() if g) == least[0]


def test_few_bins():
    rng = np.random.default_rng(3)
    sizes = np.clip(rng.lognormal(6, 1, 20_000).astype(int), 1, 4095)
    bins, offsets = bestfit.pack_sizes(sizes, 4096, 0.2)
    assert len(np.unique(bins)) <= 1.002 * math.ceil(sizes.sum() / 4096) + 1
    order = np.lexsort((offsets, bins))
    ends = offsets[order] + sizes[order]
    assert ends.max() <= 4096
    assert ((offsets[order][1:] == ends[:-1]) | (offsets[order][1:] == 0)).all()


def test_pieces(spark):
    from tokenizers import Tokenizer

    long_ = " ".join(RNG.choice(["alpha", "be", "12", "Größe", "—"]) for _ in range(3_000))
    texts = [None, "", "one", "one", long_, "a" * 9_000, *[" ".join(["word"] * RNG.randint(1, 90)) for _ in range(60)]]
    rows = [(i if i else None, t, 1, 2, 3) for i, t in enumerate(texts)]
    rows += [rows[2], rows[2]]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece int, length long, sequence_id long").repartition(3)
    out = bestfit.pack(df, capacity=128, group_pieces=20).collect()
    tok = Tokenizer.from_file(default_tokenizer())
    want = Counter()
    for d, t, *_ in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        for piece, start in enumerate(range(0, len(ids), 128)):
            part = ids[start : start + 128]
            want[d, piece, start, len(part), np.array(part, "<u4").tobytes(), len(ids)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, bytes(r.ids), r.doc_tokens) for r in out) == want
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.offset + r.length))
    for spans in bins.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= 128 and all(a[1] == b[0] for a, b in pairwise(spans))
    assert bestfit.pack(df.filter("false")).collect() == []


def test_op12_columns(spark, tmp_path):
    rows = [(i, "some words " * i, "en", "s", 1) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op12_sum_of_squares(spark, str(tmp_path)).collect()
    content = bestfit.pack(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in out) == sorted((r.doc_id, r.piece, zlib.crc32(r.ids)) for r in content)


# ---- hard negatives


def brute_negatives(rows, positives=5, negatives_=10, low=30, high=90):
    own = []
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            own.append((i, [math.floor(256 * x) for x in v], label))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = Counter()
    for i, v, label in own:
        if i % 100:
            continue
        scores = [(-dot(v, w), j, m) for j, w, m in own]
        near = sorted((s, j) for s, j, m in scores if m == label and j != i)[:positives]
        for p, j in near:
            hard = sorted((s, k) for s, k, m in scores if m != label and low * -p <= 100 * -s <= high * -p)[:negatives_]
            for rank, (s, k) in enumerate(hard, 1):
                out[i, j, rank, k, -p, -s] += 1
    return out


VECTORS = "vec_id long, embedding array<float>, label int, score long, rank int, w int"


def _mined(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], VECTORS).repartition(4)
    got = negatives.mine(df, F.col("vec_id") % 100 == 0, **options).collect()
    return Counter((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got)


def _vectors(n, dims=6, scale=1.0):
    rng = np.random.default_rng(n)
    return [(int(i), [float(x) for x in rng.normal(0, scale, dims).astype(np.float32)], int(rng.integers(0, 4))) for i in range(n)]


def test_negatives_with_ties_copies_and_nulls(spark):
    rows = _vectors(700)
    hot = [float(x) for x in np.float32([0.5, 0.25, -0.5, 0.75, 0.1, 0.2])]
    rows += [(10_000 + i, hot, i % 3) for i in range(400)]  # one vector many times: ties are broken by id
    rows += [(1_000_000_000_000, hot, 1), (-300, hot, 2), (20_000, None, 1), (20_001, hot, None), (20_002, [1.0, None], 1), (20_003, [float("nan")], 1), (20_004, [float("inf")], 2), (None, hot, 1)]
    rows += [rows[5], rows[5], rows[100], (30_000, [], 1), (30_001, [0.5], 2)]
    want = brute_negatives(rows)
    assert _mined(spark, rows) == want
    assert _mined(spark, rows, anchor_block=3, row_group=64) == want


def test_negatives_of_few_rows(spark):
    assert _mined(spark, _vectors(3)) == brute_negatives(_vectors(3))
    assert _mined(spark, []) == Counter()
    assert _mined(spark, [r for r in _vectors(50) if r[0]]) == Counter()


@pytest.mark.parametrize("scale", [1e5, 3e6])
def test_scores_beyond_doubles(spark, scale):
    rows = _vectors(250, scale=scale)
    assert negatives.number_kind(int(256 * 5 * scale), 6) is not np.float64
    assert _mined(spark, rows) == brute_negatives(rows)


def test_narrowing_ends_with_any_numbers():
    win = {"x": -(2**62), "y": 2**62, "above": 0, "by_id": False, "u": None, "v": None, "open": True}
    for _ in range(20):
        if not win["open"]:
            break
        win = negatives.narrowed(win, {"bucket": 1 if win["above"] == 0 else 0, "through": 10**9, "n": 10**9}, 10, 40, (-(2**63), 2**63 - 1))
    assert not win["open"] and win["u"] == win["v"]
