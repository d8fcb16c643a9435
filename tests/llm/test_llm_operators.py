"""Each operator on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordtide.llm import chat, exact, langid, merkle, minhash, mixing, packing, pii, sharding, suffix

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, key long, bucket int"
RNG = random.Random(7)
WORDS = ["the", "of", "and", "ring", "tower", "Größe", "niño", "ça", "x1", "don't", "42", "—"]


def _text(n):
    return " ".join(RNG.choice(WORDS) + str(RNG.randint(0, 50)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base = [_text(RNG.randint(0, 60)) for _ in range(40)]
    near = [" ".join(w if i != 3 else "changed" for i, w in enumerate(t.split())) for t in base[:10]]
    texts = [*base, *base[:8], *near, *[base[1]] * 6, None, None, "", "", "word", "word", " \n\t ", "a" * 30_000, _text(4_000)]
    out = [(i, t, RNG.choice(["en", "de", None]), RNG.choice(["s1", "s2", None]), None, 1, 2, 3, 4) for i, t in enumerate(texts)]
    return [*out, (None, base[2], "en", None, 0, 1, 2, 3, 4), (None, "alone with no id", "en", None, 0, 1, 2, 3, 4), out[5], out[5]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_empty_tables(spark, none):
    assert sharding.external_shuffle(none).collect() == []
    assert langid.identify(none).collect() == []
    assert suffix.remove_repeats(none).collect() == []
    assert exact.find_copies(none).collect() == []
    assert minhash.find_groups(none).collect() == []
    assert mixing.mixing_plan(none).collect() == []
    assert pii.find(none).collect() == []
    assert merkle.compare_with_next(none).collect() == []
    assert packing.pack(none).collect() == []
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(empty).collect() == []


# ---- sharding


def test_fisher_yates_is_a_uniform_permutation():
    seen = Counter(tuple(sharding.fisher_yates(3, np.random.default_rng(s))) for s in range(1_200))
    assert len(seen) == 6 and min(seen.values()) > 120


def test_shards(docs, rows):
    out = sharding.external_shuffle(docs, shards=4, bucket_bytes=2_000).collect()
    again = sharding.external_shuffle(docs.repartition(5), shards=4, bucket_bytes=2_000).collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter((r[0], r[1]) for r in rows)
    sizes = Counter(r.shard for r in out)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r.slot for r in out if r.shard == s) == list(range(n))
    place = lambda rs: sorted((r.shard, r.slot, str(r.doc_id), r.text or "") for r in rs)
    assert place(out) == place(again) and out[0].bucket == 4


def test_rows_that_repeat_very_often_are_spread(spark, monkeypatch):
    held = []
    monkeypatch.setattr(sharding, "_shuffle_buckets", lambda seed, real=sharding._shuffle_buckets: held.append(seed) or real(seed))
    data = [(1, "same", "a")] * 700 + [(1, "same", "b")] * 50 + [(i, f"t{i}", "c") for i in range(300)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(5)
    run = lambda: sharding.external_shuffle(df, shards=4, most_repeats=64).collect()
    out = run()
    assert Counter(r[:3] for r in out) == Counter(data) and sorted(map(str, out)) == sorted(map(str, run()))
    sizes = Counter(r.shard for r in out)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    numbered = sharding._numbered(df.withColumn("__hash", F.xxhash64("doc_id", "text")), 64).filter("doc_id = 1 and text = 'same'").collect()
    assert Counter((r.lang, r["__copy"]) for r in numbered) == Counter([*(("a", i) for i in range(700)), *(("b", i) for i in range(50))])


def test_rows_of_one_id_and_text_spread_by_their_other_columns(spark):
    data = [(None, "", f"u{i}", {"k": str(i)}) for i in range(3_000)] + [(i, f"t{i}", "u", None) for i in range(1_000)]
    df = spark.createDataFrame(data, "doc_id long, text string, url string, more map<string,string>").repartition(4)
    out = sharding.external_shuffle(df, shards=4, bucket_bytes=4_000)
    rows = out.collect()
    assert Counter((r.doc_id, r.text, r.url) for r in rows) == Counter((d, t, u) for d, t, u, _ in data)
    # an even spread of the rows without id and text over stretches of the permutation, and over the buckets before it
    per = sharding.external_shuffle(df, shards=20, bucket_bytes=4_000).groupBy("shard").agg(F.count_if(F.col("doc_id").isNull()).alias("n")).collect()
    assert 110 <= min(r.n for r in per) and max(r.n for r in per) <= 190


# ---- language


def test_language(spark):
    rng = random.Random(1)
    vocab = {"aa": ["kolo", "miro", "vesna", "brat"], "bb": ["chung", "wang", "ting", "hao"], "cc": ["évre", "çale", "rêve", "noël"]}
    data = [(i, " ".join(rng.choices(vocab[k], k=rng.randint(3, 40))), k) for i, k in enumerate(rng.choices(list(vocab), k=300))]
    data += [(900, None, "aa"), (901, "12 34 --", "bb"), (902, "", None), (903, "kolo miro brat vesna kolo", None)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in langid.identify(df).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(out[i].lang_pred == data[i][2] for i in held) >= 0.98 * len(held)
    assert [out[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "aa"]
    assert all(0 <= r.score <= 1 for r in out.values()) and out[901].rejected and not out[903].rejected
    # text next to a text, or its row's other columns, never change a prediction
    one = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(df.filter("doc_id < 5").drop("lang"), langid.fit(df.filter(~langid.held_out()))).collect()}
    assert all(out[i].lang_pred == p and abs(out[i].score - s) < 1e-6 for i, (p, s) in one.items())


def test_language_rejects_what_is_like_no_training_text(spark):
    rng = random.Random(2)
    vocab = {"aa": ["kolo", "miro", "vesna", "brat"], "bb": ["chung", "wang", "ting", "hao"]}
    data = [(i, " ".join(rng.choices(vocab[k], k=rng.randint(10, 40))), k) for i, k in enumerate(rng.choices(list(vocab), k=200))]
    strange = ["привет мир как дела сегодня хорошо " * 4, "ZXQJ9 xqzj qqzx jxq " * 6, "こんにちは世界これは文章です" * 5]
    df = spark.createDataFrame([*data, *[(1_000 + i, t, "aa") for i, t in enumerate(strange)]], "doc_id long, text string, lang string")
    model = langid.fit(df.filter("doc_id < 1000"))
    out = {r.doc_id: r for r in langid.predict(df.drop("lang"), model).collect()}
    assert all(out[1_000 + i].rejected for i in range(len(strange)))
    assert not any(out[i].rejected for i in range(200))


def test_the_sample_of_a_language_is_bounded_whatever_its_ids(spark):
    ids = [(None, "null"), (7, "one id")]
    df = spark.createDataFrame([(i, f"{what} text number {n}", "aa") for i, what in ids for n in range(4_000)] + [(9, "the same", "aa")] * 4_000, "doc_id long, text string, lang string")
    n = langid._drawn(df, {"aa": 12_000}, 300).count()
    assert 120 <= n <= 320
    repeated = df.filter("doc_id = 9").unionByName(df.filter("doc_id = 7").limit(50))
    assert len({(r.lang_pred, round(r.score, 6)) for r in langid.identify(repeated).filter("doc_id = 9").collect()}) == 1


def test_long_texts_are_counted_in_stretches():
    rng = random.Random(19)
    for _ in range(60):
        text = "".join(rng.choices("aB É3ß \n日", k=rng.randint(0, 400))).encode()
        buf = np.frombuffer(text, np.uint8)
        whole = langid.count_ngrams(buf, np.array([0, len(buf)]))
        assert (langid.count_long(buf, step=rng.randint(1, 50)) == whole).all()
        low = re.sub(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]+", b" ", text.decode().replace("É", "é").lower().encode())
        assert whole.sum() == sum(max(0, len(low) - n + 1) for n in (1, 2, 3))


def test_every_label_is_learned(spark):
    name = lambda i: "".join(chr(97 + int(x)) for x in f"{i * 7919 % 100000:05d}")
    data = [(i, f"{name(i % 270)} " * 8, f"l{i % 270:03d}") for i in range(1080)]
    model = langid.fit(spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(3))
    assert model.languages == sorted({x for _, _, x in data})


def test_language_without_labels(spark):
    df = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in langid.identify(df).collect()] == [("und", 0.0)]


# ---- repeated passages


def _kept(rows, length):
    first = {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            first.setdefault(b[p : p + length], d)
    out = {}
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < d:
                gone[p : p + length] = b"\1" * length
        out[d] = (bytes(x for x, g in zip(b, gone, strict=True) if not g), len(re.findall(rb"\x01+", bytes(gone))))
    return out


def test_two_stage_sort_orders_suffixes():
    rng = random.Random(3)
    for _ in range(40):
        texts = [bytes(rng.choice(b"ab\x00"[: rng.randint(1, 3)]) for _ in range(rng.randint(17, 60))) for _ in range(8)]
        size = np.array([len(t) for t in texts])
        begin = np.cumsum(size + 8) - size - 8
        buf = np.zeros(int((size + 8).sum()), np.uint8)
        for b, t in zip(begin, texts, strict=True):
            buf[b : b + len(t)] = np.frombuffer(t, np.uint8)
        order, words = suffix.two_stage_sort(buf, begin, begin + size, size - 16, 17)
        owner = np.searchsorted(begin, order, side="right") - 1
        order = order[order - begin[owner] < (size - 16)[owner]]
        found = [buf[i : i + 17].tobytes() for i in order]
        assert found == sorted(found) and len(found) == (size - 16).sum()
        assert suffix.reaches(words, order, 17).tolist() == [a == b for a, b in zip(found, found[1:], strict=False)]


@pytest.mark.parametrize("length", [20, 50])
def test_repeats(spark, length):
    rng = random.Random(length)
    block = ["".join(rng.choices("abc é", k=rng.randint(10, 90))) for _ in range(12)]
    data = [(i, "".join(rng.choices(block, k=rng.randint(0, 6)))) for i in range(60)] + [(60, None), (61, ""), (62, "a" * 3_000), (63, "a" * 500)]
    df = spark.createDataFrame([(*r, 1, "x") for r in data], "doc_id long, text string, found int, grams string").repartition(5)
    out = {r.doc_id: r for r in suffix.remove_repeats(df, length=length).collect()}
    for d, (kept, spans) in _kept(data, length).items():
        assert bytes(out[d].kept) == kept and out[d].n_spans == spans and out[d].kept_sha256 == hashlib.sha256(kept).hexdigest()


def test_strings_of_a_run_part_by_the_steps_they_cover():
    rng = np.random.default_rng(17)
    line = rng.integers(97, 123, 60).astype(np.uint8)
    seen = defaultdict(set)
    for _ in range(40):
        buf = np.concatenate([rng.integers(97, 123, 70).astype(np.uint8), line, rng.integers(97, 123, 70).astype(np.uint8)])
        first, last, h, place = suffix.anchor_runs(buf, np.array([0, len(buf)]), 50)
        assert all((f <= a) & (a + suffix.GRAM <= z + 50) for f, z, a in zip(first, last, place, strict=True))
        run, start, final, begin, end = suffix.by_steps(first, last, place, 50)
        assert (final - start + 1).sum() == (last - first + 1).sum() == len(buf) - 49
        assert (begin >= final - suffix.STEP).all() and (begin >= start).all() and (end <= start + 50).all() and (end - begin >= 50 - 2 * suffix.STEP).all()
        for s, f, b, e in zip(start, final, begin, end, strict=True):
            for w in range(s, f + 1):
                seen[buf[w : w + 50].tobytes()].add(buf[b:e].tobytes())
    assert all(len(keys) == 1 for keys in seen.values())


def test_repeats_long_and_hot(spark, monkeypatch):
    rng = random.Random(5)
    line = "".join(rng.choices("abcdefgh ", k=120))
    long = "".join(rng.choices("abcdefghij", k=1_900_000))
    data = [(i, f"{rng.random()}{line}{rng.choice('xy')}{rng.random()}") for i in range(80)] + [(90, long), (91, "q" + long[950_000:951_000])]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(8)
    monkeypatch.setattr(suffix, "HOT", 3)
    made = []
    monkeypatch.setattr(suffix, "written", lambda d, purpose, real=suffix.written: made.append(out := real(d, purpose)) or out)
    out = {r.doc_id: r for r in suffix.remove_repeats(df).collect()}
    assert made[0].filter("hot").count() > 0
    assert out[91].n_removed == 1_000 and out[90].n_removed == 0
    want = _kept(data[:80], 50)
    assert all(bytes(out[d].kept) == want[d][0] for d in range(80))


def test_repeats_without_ids(spark):
    rng = random.Random(18)
    block = ["".join(rng.choices("abc é", k=60)) for _ in range(3)]
    texts = [*["".join(rng.choices(block, k=2)) for _ in range(6)], None, "", "alone " * 3]
    data = [(None, t) for t in texts] + [(i, "".join(rng.choices(block, k=3)) + str(i)) for i in range(6)]
    out = suffix.remove_repeats(spark.createDataFrame(data, "doc_id long, text string").repartition(3), task_bytes=100).collect()
    assert len(out) == len(data)
    # rows without an id come first, in some order of their texts: of equal passages one keeps all
    nameless = [r for r in out if r.doc_id is None]
    assert sum(r.n_bytes - r.n_removed for r in nameless) >= len("".join(block).encode()) // 2 and any(r.n_removed for r in nameless)
    seen = {b[p : p + 50] for t in texts for b in [(t or "").encode()] for p in range(len(b) - 49)}
    for r in out:
        if r.doc_id == 0:
            b = data[len(texts)][1].encode()
            gone = {q for p in range(len(b) - 49) if b[p : p + 50] in seen for q in range(p, p + 50)}
            assert r.n_removed == len(gone)


# ---- copies


def test_exact(docs, rows):
    out = exact.find_copies(docs, capacity=4).collect()
    assert len(out) == len(rows)
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    want = {h: (max((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items() for h in [hashlib.sha256(t.encode()).hexdigest()]}
    for r in out:
        assert (r.keep_id, r.group_size) == want[r.text_sha256] and r.kept == (r.doc_id == r.keep_id)
    kept = exact.drop_copies(docs).collect()
    assert {r.text or "" for r in kept} == set(groups) and len({(r.doc_id, r.text) for r in kept}) == len(groups)


def test_copies_are_found_through_the_directory(docs, rows, monkeypatch):
    want = sorted(exact.find_copies(docs, capacity=4).collect(), key=str)

    def without_cells(keys, capacity, real=exact.directory):
        cells, depth = real(keys, capacity)
        return cells.filter("cell % 2 = 0"), depth

    monkeypatch.setattr(exact, "directory", without_cells)
    got = sorted(exact.find_copies(docs, capacity=4).collect(), key=str)
    lost = [r for r in got if r not in want]
    assert lost and all(r.group_size == 1 and r.keep_id == r.doc_id for r in lost)


def test_chains_lie_with_the_owner_of_their_bucket(docs, rows, monkeypatch):
    made = {}
    monkeypatch.setattr(exact, "written", lambda df, purpose, real=exact.written: made.setdefault(purpose, real(df, purpose)))
    monkeypatch.setattr(exact, "discard", lambda *tables: None)
    exact.find_copies(docs, capacity=4).collect()
    files = defaultdict(set)
    for r in made["exact-chains"].select("*", "_metadata.file_path").collect():
        files[r.local_depth, r.bucket].add(r.file_path)
        assert (r.key & (2**64 - 1)) >> (64 - r.local_depth) == r.bucket
    shared = [t for t, n in Counter(r[1] or "" for r in rows).items() if n > 1]
    assert len(files) > 1 and all(len(x) == 1 for x in files.values())
    assert made["exact-chains"].count() == len(shared)


def test_colliding_texts_are_links_of_one_chain(spark):
    data = [(1, 7, 0, 1, "a"), (2, 7, 0, 1, "b"), (3, 7, 0, 1, "a"), (None, 7, 0, 1, "b"), (4, 8, 0, 1, "c"), (None, 8, 0, 1, "d")]
    members = spark.createDataFrame(data, "doc_id long, key long, bucket long, local_depth int, text string").repartition(3)
    out = {r.key: [tuple(c) for c in r.chain] for r in exact._chains(members).collect()}
    assert out == {7: [("a", 3, 2), ("b", 2, 2)], 8: [("c", 4, 1), ("d", None, 1)]}


def test_directory_doubles_until_buckets_fit(spark):
    keys = spark.range(1_000).selectExpr("xxhash64(id) as key")
    cells, depth = exact.directory(keys, capacity=50)
    found = cells.collect()
    held = Counter((r.local_depth, (k & (2**64 - 1)) >> (64 - r.local_depth)) for k in [x.key for x in keys.collect()] for r in found if ((k & (2**64 - 1)) >> (64 - depth)) == r.cell)
    assert depth >= 5 and max(held.values()) <= 50 and sum(held.values()) == 1_000


# ---- near copies


def _components(rows, words):
    sets = {}
    for d, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))))
        sets[d] = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in ids}


@pytest.mark.parametrize("words", [2, 5])
def test_near(docs, rows, words):
    own = [(r[0], r[1]) for r in dict.fromkeys(rows) if r[0] is not None]
    out = [r for r in minhash.find_groups(docs, words=words).collect() if r.doc_id is not None]
    want = _components(own, words)
    assert {r.doc_id for r in out} == set(want)
    for r in out:
        assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id)
    kept = minhash.drop_near_copies(docs, words=words).collect()
    assert {r.doc_id for r in kept if r.doc_id is not None} == {d for d, (_, c) in want.items() if d == c}
    assert any(r.text == "alone with no id" for r in kept)


def test_near_copies_without_or_with_shared_ids(spark):
    def near(seed):
        w = [f"{seed}w{i}" for i in range(100)]
        return [" ".join(w), " ".join([*w[:99], "other"])]

    (a, a2), (b, b2), (c, _), (d, d2), (e, e2) = map(near, "abcde")
    data = [(None, a), (None, a2), (None, b), (7, b2), (None, c), (None, c), (5, d), (5, e), (8, d2), (9, e2), (None, None), (None, " ")]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    ids = {(r.doc_id, r.text_key): r for r in minhash.find_groups(df, words=2).collect()}
    assert sorted(r.component_id for r in ids.values() if r.doc_id in (5, 7, 8, 9)) == [5, 5, 5, 5, 7]
    kept = minhash.drop_near_copies(df, words=2).collect()
    texts = Counter(r.text for r in kept)
    assert texts[a] + texts[a2] == 1 and texts[b] == 0 and texts[b2] == 1 and texts[c] == 1
    assert (texts[d], texts[d2], texts[e], texts[e2]) == (1, 0, 1, 0) and texts[None] == texts[" "] == 1 and len(kept) == 7


def test_near_chains_and_hot_group(spark):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(150)]
    data = []
    for i in range(400):  # variants of one text, alike in pairs to about the threshold
        w = list(base)
        for p in rng.sample(range(150), rng.randint(2, 11)):
            w[p] = f"v{rng.randint(0, 10**9)}"
        data.append((i, " ".join(w)))
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(6)
    out = {r.doc_id: r.component_id for r in minhash.find_groups(df, words=2).collect()}
    assert out == {d: c for d, (_, c) in _components(data, 2).items()}


def test_near_copies_of_a_very_long_text(spark):
    rng = random.Random(20)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(120_000)]
    texts = [" ".join(words), " ".join([*words[:60_000], "other", *words[60_001:]]), " ".join(words[:50_000])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.find_groups(df, words=5).collect()}
    want = [len({tuple(w[i : i + 5]) for i in range(len(w) - 4)}) for w in map(str.split, texts)]
    assert out == {0: (want[0], 0), 1: (want[1], 0), 2: (want[2], 2)}


def test_bucket_of_documents_alike_below_the_threshold(spark, monkeypatch):
    rng = random.Random(16)
    base = [f"w{i}" for i in range(200)]
    data = []
    for i in range(160):  # each differs from the base in its own places: pairs are alike at about 0.7
        w = list(base)
        for p in rng.sample(range(0, 200, 4), 9):
            w[p] = f"v{i}x{p}"
        data.append((i, " ".join(w)))
    data += [(200 + i, data[i][1] + " end") for i in range(5)]
    made = defaultdict(list)

    def keep(df, purpose, real=minhash.written):
        out = real(df, purpose)
        made[purpose].append(out)
        return out

    monkeypatch.setattr(minhash, "written", keep)
    monkeypatch.setattr(minhash, "discard", lambda *tables: None)
    across = minhash._Links.across
    monkeypatch.setattr(minhash._Links, "across", lambda self, m, labels: across(self, m, labels, block=40))
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    out = {r.doc_id: r.component_id for r in minhash.find_groups(df, words=2).collect()}
    want = _components(data, 2)
    assert out == {d: c for d, (_, c) in want.items()} and len(set(out.values())) > 100
    # blocks name each document once a row or column of blocks, and only verified links come out of them
    involved, links = made["minhash-involved"][0], made["minhash-across"][0]
    assert {t for _, t in involved.dtypes} == {"bigint", "boolean", "binary", "array<bigint>"}
    assert 0 < involved.count() <= 32 * len(data) * 2 * 5 and links.count() <= len(data)


def test_signature_of_a_long_document_does_not_depend_on_its_turns():
    rng = np.random.default_rng(3)
    own, tail = rng.integers(0, 2**63, 150_000).astype(np.uint64), rng.integers(0, 2**63, 50).astype(np.uint64)
    both = minhash.superminhash(np.concatenate([own, tail]), np.array([0, 150_000, 150_050]), 160)
    assert (both[1] == minhash.superminhash(tail, np.array([0, 50]), 160)[0]).all()
    parts = [minhash.superminhash(own[i : i + 7_000], np.array([0, len(own[i : i + 7_000])]), 160)[0] for i in range(0, 150_000, 7_000)]
    assert (both[0] == np.min(parts, axis=0)).all()


def test_superminhash_estimates_jaccard():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(30):
        pool = rng.integers(0, 2**63, 300).astype(np.uint64)
        sig = minhash.superminhash(np.concatenate([pool[:200], pool[100:]]), np.array([0, 200, 400]), 160)
        errors.append((sig[0] == sig[1]).mean() - 1 / 3)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


# ---- mixing


def test_mixing(docs, rows):
    plan = mixing.mixing_plan(docs).collect()
    assert len(plan) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sums = Counter()
    for r in rows:
        sums[r[3]] += size(r[1])
    names = sorted(sums, key=lambda s: (s is None, s or ""))
    weights = dict(zip(names, [3, 1, 2], strict=False))
    target, open_, left = {}, set(names), 1.5 * sum(sums.values())
    while open_:  # share, cap, share the rest again
        level = left / sum(weights[s] for s in open_)
        over = {s for s in open_ if weights[s] * level > 2 * sums[s]}
        for s in over or open_:
            target[s] = 2 * sums[s] if over else weights[s] * level
        left -= sum(target[s] for s in over)
        open_ = open_ - over if over else set()
    for r in plan:
        assert r.size == size(r.text) and r.source_size == sums[r.source] and abs(r.target - target[r.source]) < 1e-6
        assert r.copies in (int(r.rate), min(2, int(r.rate) + 1))
    assert mixing.mix(docs).count() == sum(r.copies for r in plan)


def test_mixing_beyond_the_broadcast(docs):
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(mixing.mixing_plan(docs)) == rows(mixing.mixing_plan(docs, broadcast_bytes=0))


def test_mixing_draws(spark):
    none = spark.createDataFrame([(None, f"word{i}", "s") for i in range(400)], "doc_id long, text string, source string")
    copies = Counter(r.copies for r in mixing.mixing_plan(none, share=1.5, max_repeat=2.5).collect())
    assert 140 < copies[1] < 260 and copies[1] + copies[2] == 400
    copies = Counter(r.copies for r in mixing.mixing_plan(none, share=9.0, max_repeat=2.5).collect())
    assert 140 < copies[2] < 260 and copies[2] + copies[3] == 400


# ---- personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _base(t):
    out = []
    for rank, (k, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            odd = [int(c) * 2 - 9 * (int(c) > 4) if i % 2 else int(c) for i, c in enumerate(reversed(d))]
            good = {"email": True, "ip": all(int(x) < 256 for x in m[0].split(".")) if k == "ip" else False, "card": 12 <= len(d) <= 19 and sum(odd) % 10 == 0, "phone": 9 <= len(d) <= 15}[k]
            if good:
                out.append((m.start(), rank, k, m.end()))
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(out))


def test_personal_data(spark):
    rng = random.Random(9)
    parts = ["a", "é", "1", "22", "4111111111111111", "4111 1111-1111 1111", ".", "@", "b.c", " ", "-", "+", "(", ")", "%", "x@y.z", "1.2.3.4", "300.1.1.1", "+1 (555) 123-4567", "😀", "\n"]
    data = [(i, "".join(rng.choices(parts, k=rng.randint(0, 25)))) for i in range(400)]
    data += [(900, None), (901, ""), (902, "1" * 9_000 + " " + "1 " * 9_000), (903, "a" * 60_000), (904, 'call (555) 123-4567 or token = "abcdef0123456789abcd"')]
    out = {r.doc_id: r for r in pii.find(spark.createDataFrame(data, "doc_id long, text string")).select("doc_id", pii.spelled("base").alias("base"), pii.spelled("spans").alias("spans")).collect()}
    for d, t in data:
        assert out[d].base == _base(t or ""), t
        assert not set(filter(None, out[d].base.split(","))) - set(out[d].spans.split(","))
    assert "secret:23:53" in out[904].spans


def _spans(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = pii.find(df).select("doc_id", pii.spelled("base").alias("base"), pii.spelled("spans").alias("spans"), "base.kind").collect()
    return [r for r in sorted(found)]


def test_cards_grouped_in_ones_and_twos(spark):
    rng = random.Random(11)
    texts = ["card 41-11-11-11-11-11-11-11", "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "é 41 11 11-11 11 11 11 11.", "41 11 11 11 11 11 11 12", "41 11  11 11 11 11 11 11"]
    for _ in range(300):
        digits = "".join(rng.choices("0123456789", k=rng.randint(10, 21)))
        cut = sorted(rng.sample(range(1, len(digits)), len(digits) * 2 // 3))
        texts.append("x" + "".join(rng.choice(" -") * (i in cut) + c for i, c in enumerate(digits)))
    got = _spans(spark, texts)
    assert sum("card" in r.kind for r in got if not re.search("[0-9]{3}", texts[r.doc_id])) > 3
    for r in got:
        assert r.base == _base(texts[r.doc_id]), texts[r.doc_id]


def test_first_look_loses_no_candidate(spark):
    texts = ["account GB29 NWBK ABCD EF12 34GH 56", "account DE12ABCDEFGHIJKLMNOPQR", "account NO9386011117947", "ssn 123-45-6789"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.candidates(df).collect():
        whole = [m.span() for m in re.finditer(pii.WIDER["account"], texts[r.doc_id])]
        assert whole and [(c.start, c.end) for c in r.found if c.kind == "account"] == whole


def test_national_phones_with_dots_and_failing_cards(spark):
    texts = ["call (555) 123.4567", "tel 555.123.4567", "card 4111 1111 1111 1112", "card 4111 1111 1111 1111"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = pii.candidates(df)
    out = {r.doc_id: [(c.kind, c.start, c.end, c.base) for c in r.found] for r in found.collect()}
    assert out == {0: [("phone_national", 5, 19, False)], 1: [("phone_national", 4, 16, False)], 2: [("card_like", 5, 24, False)], 3: [("card", 5, 24, True)]}
    judged = lambda bias: {r.doc_id: (r.b, r.s) for r in pii.classify(found, pii.Labeling(bias=dict.fromkeys(pii.KINDS, bias))).select("doc_id", pii.spelled("base").alias("b"), pii.spelled("spans").alias("s")).collect()}
    assert judged(1.0)[2] == ("", "card_like:5:24") and judged(-1.0)[2] == ("", "") and judged(-1.0)[3] == ("card:5:24", "card:5:24")


def test_running_goes_on_over_blocks(spark):
    rows = [(list(range(n)),) for n in (0, 1, 2, 3, 9, 40)]
    own = pii._running(F.col("x"), pii._add, F.lit(0), block=3)
    for x, s in spark.createDataFrame(rows, "x array<int>").select("x", own).collect():
        assert s == [sum(x[:i]) for i in range(len(x))]


def test_long_values_and_many_matches(spark):
    secret = "a1" * 120
    texts = [f'api_key = "{secret}"', "write to " + "b" * 60 + " [at] " + "host" * 15 + " [dot] " + "org" * 9, "x 1.2.3.4 " * 20_000 + "é a@b.c"]
    t0 = time.monotonic()
    got = pii.candidates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert time.monotonic() - t0 < 60
    found = {r.doc_id: [(c.kind, c.start, c.end) for c in r.found] for r in got}
    assert found[0] == [("secret", 0, len(texts[0]))] and found[1] == [("email_spelled", 9, len(texts[1]))]
    ips = [c for c in found[2] if c[0] == "ip"]
    assert ips == [("ip", 10 * i + 2, 10 * i + 9) for i in range(20_000)] and found[2][0] == ("email", 200_002, 200_007)


def test_added_spans_overlap_nothing(spark):
    def span(start, end, kind, base):
        return (start, pii.KINDS.index(kind), kind, end, base, *[0] * (len(pii.LABELERS) + len(pii.FEATURES)))

    rng = random.Random(12)
    rows = []
    for i in range(200):
        spans = []
        for kind in ("email", "card", "account", "secret", "card_like"):
            at = 0
            for _ in range(rng.randint(0, 5)):
                at += rng.randint(0, 12)
                spans.append(span(at, at + (n := rng.randint(1, 9)), kind, kind in pii.BASE))
                at += n
        rows.append((i, spans))
    fields = ", ".join(["start: int, rank: int, kind: string, end: int, base: boolean", *[f"{k}: int" for k in (*pii.LABELERS, *pii.FEATURES)]])
    found = spark.createDataFrame(rows, f"doc_id long, found array<struct<{fields}>>")
    out = {r.doc_id: [(s.start, s.rank, s.end) for s in r.spans] for r in pii.classify(found, pii.Labeling(bias=dict.fromkeys(pii.KINDS, 1.0))).collect()}
    for i, spans in rows:
        base = [s for s in spans if s[4]]
        want, at = [(s[0], s[1], s[3]) for s in base], 0
        for s in sorted(s for s in spans if not s[4] and not any(b[0] < s[3] and s[0] < b[3] for b in base)):
            if s[0] >= at:
                want.append((s[0], s[1], s[3]))
                at = s[3]
        assert out[i] == sorted(want)


def _iban(rng, country):
    bban = "".join(rng.choice("0123456789") for _ in range(pii.IBAN_LENGTH[country] - 4))
    number = int("".join(str(int(c, 36)) for c in f"{bban}{country}00"))
    return f"{country}{98 - number % 97:02d}{bban}"


def test_account_numbers_by_country(spark):
    rng = random.Random(3)
    real = [_iban(rng, c) for c in pii.IBAN_LENGTH] + ["DE89370400440532013000", "GB29NWBK60161331926819", "FR1420041010050500013M02606", "NL91ABNA0417164300"]
    spaced = [" ".join(x[i : i + 4] for i in range(0, len(x), 4)) for x in real]
    wrong = [x[:6] + str((int(x[6]) + 1) % 10) + x[7:] for x in real if x[6].isdigit()]
    df = spark.createDataFrame(list(enumerate([f"to {x}, please" for x in [*real, *spaced, *wrong]])), "doc_id long, text string")
    found = {r.doc_id: [(c.start, c.end, c.valid) for c in r.found if c.kind == "account"] for r in pii.candidates(df).collect()}
    for i, x in enumerate([*real, *spaced, *wrong]):
        assert found[i] == [(3, 3 + len(x), 1 if i < 2 * len(real) else -1)], x


#: Sentences with a place for a value, by kind: with the value and with something like it that is not personal.
SAID = {
    "account": (["please transfer to {}", "my iban is {}", "bank account {} thanks", "{} is the account"], ["part {} shipped", "item {} of the order", "{} in total"]),
    "secret": (["export {}", "set {} in the config", "the config has {} there", "let {}"], ["the {} page", "section {} ends", "see {} here"]),
    "phone_national": (["call {} today", "my phone is {}", "tel {} please", "reach me at {} now"], ["order {} shipped", "version {} is out", "invoice {} paid", "item {} of ten"]),
    "email_spelled": (["write to {}", "contact {} please", "my email is {}", "reach {}"], []),
}


def _made(rng, kind):
    pick = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    digits, both = "0123456789", "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789"
    if kind == "account":
        x = _iban(rng, rng.choice(["DE", "FR", "GB", "NO", "NL", "IT", "CH", "ES", "BE"]))
        good = rng.choice([x, " ".join(x[i : i + 4] for i in range(0, len(x), 4))])
        return good, x[:5] + str((int(x[5]) + 3) % 10) + x[6:]
    if kind == "secret":
        value = pick(both, 18) + "7a"
        good = rng.choice([f'PASSWORD="{value}"', f"password='{value}'", f"api_key: {value}", f"Bearer {value}", "AKIA" + pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16), "token: ghp_" + pick(both, 36)])
        return good, rng.choice(["password: required", "token: optional", "secret: forgotten", "Bearer instruments-of-all-sorts"])
    if kind == "phone_national":
        good = rng.choice([f"({rng.randint(201, 999)}) {rng.randint(201, 999)}-{pick(digits, 4)}", f"{rng.randint(201, 999)} {rng.randint(201, 999)} {pick(digits, 4)}", f"030 {pick('123456789', 1)}{pick(digits, 6)}", f"01 {pick(digits, 2)} {pick(digits, 2)} {pick(digits, 2)} {pick(digits, 2)}", f"0171-{pick('123456789', 7)}"])
        return good, rng.choice([f"{rng.randint(100, 199)}.{rng.randint(100, 199)}.{pick(digits, 4)}", f"00 {pick(digits, 2)}", f"{rng.randint(100, 199)} {rng.randint(100, 199)} {pick(digits, 4)}"])
    name = f"{pick('abcdefgh', 5)} [at] {pick('mnopqr', 6)} [dot] {rng.choice(['com', 'org', 'net', 'de'])}"
    return name, None


@pytest.mark.parametrize("kind", list(SAID))
def test_precision_and_recall_of_added_kinds(spark, kind):
    rng = random.Random(41)
    texts, want = [], {}
    for i in range(300):
        good, bad = _made(rng, kind)
        frames = SAID[kind]
        value, frame = (bad, rng.choice(frames[1])) if i % 2 and bad else (good, rng.choice(frames[0]))
        texts.append(frame.format(value))
        if value is good:
            want[i] = (frame.index("{}"), frame.index("{}") + len(value))
    out = {r.doc_id: r for r in _spans(spark, texts)}
    got = {}
    for i, r in out.items():
        spans = [x.split(":") for x in (r.spans or "").split(",") if x]
        if own := [(int(a), int(b)) for k, a, b in spans if k == kind]:
            got[i] = own
    hit = sum(want.get(i) in own for i, own in got.items())
    assert hit >= 0.9 * len(want), (hit, len(want), [texts[i] for i in want if want[i] not in got.get(i, [])][:8])
    assert sum(map(len, got.values())) - hit <= 0.1 * hit, [texts[i] for i in got if i not in want][:8]


def test_many_added_spans_over_blocks(spark):
    rng = random.Random(8)
    spans, at = [], 0
    for _ in range(700):
        at += rng.randint(0, 6)
        spans.append((at, at + rng.randint(1, 9), rng.random() < 0.1))
    df = spark.createDataFrame([([*spans],)], "x array<struct<start:int,end:int,base:boolean>>")
    got = [(s.start, s.end, s.base) for s in df.select(pii._leftmost(F.col("x"), block=16).alias("y")).first().y]
    want, free = [], 0
    for s in spans:
        if s[2]:
            want.append(s)
        elif s[0] >= free:
            want.append(s)
            free = s[1]
    assert got == want


def test_em_finds_the_reliabilities_of_labelers():
    rng = random.Random(13)
    # (vote for, vote against) on true spans, then on false ones
    rates = {"email": [((0.9, 0.05), (0.2, 0.6)), ((0.8, 0.1), (0.1, 0.8)), ((0.6, 0.0), (0.1, 0.0)), ((0.0, 0.05), (0.0, 0.4)), ((0.95, 0.05), (0.5, 0.5)), ((0.5, 0.1), (0.2, 0.5))]}
    rates["account"] = [rates["email"][1], rates["email"][0], *rates["email"][2:]]
    share = {"email": 0.7, "account": 0.3}
    counts, truth = Counter(), Counter()
    for kind, table in rates.items():
        for _ in range(6_000):
            true = rng.random() < share[kind]
            votes = []
            for row in table:
                up, down = row[0] if true else row[1]
                x = rng.random()
                votes.append(1 if x < up else -1 if x < up + down else 0)
            counts[kind, tuple(votes)] += 1
            truth[kind, tuple(votes)] += true
    m = pii.aggregate_votes(sorted(counts.items()))
    for kind, table in rates.items():
        assert abs(m.prior[kind] - share[kind]) < 0.05
        for name, (yes, no) in zip(pii.LABELERS, table, strict=True):
            got = m.vote[kind][name]
            assert all(abs(got[v][side] - want) < 0.06 for side, (up, down) in enumerate((yes, no)) for v, want in ((1, up), (-1, down)))
    right = sum(truth[p] if m.posterior[p] > 0.5 else n - truth[p] for p, n in counts.items())
    assert right > 0.93 * sum(counts.values())


def test_classifier_precision_and_recall(spark):
    rng = random.Random(14)
    texts, personal = [], []
    for i in range(400):
        area, mid, end = rng.randint(200, 999), rng.randint(200, 999), rng.randint(0, 9_999)
        if i % 2:
            texts.append(rng.choice(["please call {} today", "my phone is {} at home", "tel {}.", "fax ({}) now"]).format(f"{area}-{mid}-{end:04d}"))
            personal.append(i)
        else:
            texts.append(rng.choice(["order {}a shipped", "version {}x is out", "item x{} of ten", "invoice #{}b paid"]).format(f"{area % 200:03d}-{mid % 200:03d}-{end:04d}"))
    out = {r.doc_id for r in _spans(spark, texts) if "phone_national" in r.spans}
    assert len(out & set(personal)) >= 0.95 * len(personal) and len(out - set(personal)) <= 0.05 * len(personal)


# ---- repeated rows


def test_rows_that_repeat_id_and_text_leave_one(spark):
    long_ = " ".join(f"w{i}" for i in range(60))
    other = long_.replace("w30", "changed")
    data = [(1, "x"), (1, "x"), (2, "y"), (3, long_), (3, long_), (4, other), (4, other), (5, None), (5, ""), (None, "z"), (None, "z"), (None, None), *[(6, "again and again")] * 300]
    df = spark.createDataFrame([(*r, "s", True, 1) for r in data], "doc_id long, text string, source string, kept boolean, __rows long").drop("__rows").repartition(5)
    kept = Counter((r.doc_id, r.text or "") for r in exact.drop_copies(df).collect())
    assert kept == Counter({(1, "x"): 1, (2, "y"): 1, (3, long_): 1, (4, other): 1, (5, ""): 1, (None, "z"): 1, (6, "again and again"): 1})
    near = Counter((r.doc_id, r.text or "") for r in minhash.drop_near_copies(df).collect())
    assert near == Counter({(1, "x"): 1, (2, "y"): 1, (3, long_): 1, (5, ""): 1, (None, "z"): 1, (None, ""): 1, (6, "again and again"): 1})
    assert minhash.drop_near_copies(df).columns == exact.drop_copies(df).columns == df.columns


# ---- chat


def test_chat_round_trip(spark):
    rng = random.Random(4)
    bits = ["<|im_end|>\n", "<|", "\\", "|", "</s>[INST]", "é😀", "\n", "assistant", " "]
    data = [(c, t, rng.choice(["user", "assistant", "system", None, "a\nb\\n"]), rng.choice([None, "".join(rng.choices(bits, k=6))])) for c in range(30) for t in range(rng.randint(1, 9))]
    data += [(99, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(150)] + [(None, 0, "user", "x"), (98, 0, "user", "same"), (98, 0, "user", "same")]
    rows = chat.format_conversations(spark.createDataFrame(data, "conv_id long, turn long, role string, text string")).collect()
    by = defaultdict(list)
    for c, t, role, text in data:
        by[c].append((t, role or "", text or ""))
    for r in rows:
        turns = [(role, text) for _, role, text in sorted(by[r.conv_id])]
        assert sorted(chat.read_back(r.formatted)) == sorted(turns) and r.rewritten_at is None
        assert [r.formatted[s:e] for s, e in r.spans] == [chat.marked_turns([x]) for x in chat.read_back(r.formatted)]
        assert [chat.unescape(r.formatted[s:e]) for s, e in r.loss] == [t for role, t in chat.read_back(r.formatted) if role == "assistant"]


def test_chat_detects_rewritten_history(spark):
    def hides(turns):
        return "".join(f"<{r}>{t if i == len(turns) - 1 else '...'}</{r}>" for i, (r, t) in enumerate(turns))

    def begins(turns):
        return "<s>" + chat.marked_turns(turns)

    seen = chat.Renderer(hides).render([("user", "hello"), ("assistant", "hi"), ("user", "bye")])
    assert seen.rewritten_at == 1
    def forgets(turns):  # beyond 70 turns the first one goes
        return chat.marked_turns(turns[1:] if len(turns) > 70 else turns)

    many = [("user", str(i)) for i in range(90)]
    assert chat.Renderer(forgets).render(many).rewritten_at == 70

    def once(turns):  # only at one length the template writes otherwise
        return chat.marked_turns([("user", "?"), *turns[1:]] if len(turns) == 71 else turns)

    assert chat.Renderer(once).render(many).rewritten_at == 70
    whole = chat.Renderer(begins).render([("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d")])
    assert whole.rewritten_at is None and [whole.text[s:e] for s, e in whole.contents] == ["a", "b", "c", "d"]


@pytest.mark.parametrize(("first", "last"), [(70, 100), (130, 131), (64, 65)])
def test_chat_detects_rewriting_at_some_lengths_only(spark, first, last):
    def sometimes(turns):
        return chat.marked_turns([("system", "short"), *turns[1:]] if first <= len(turns) < last else turns)

    rows = spark.createDataFrame([(c, t, "assistant" if t % 2 else "user", f"turn {t}") for c, n in ((1, 200), (2, first - 1)) for t in range(n)], "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in chat.format_conversations(rows, template=sometimes).collect()}
    assert out[1].rewritten_at == first - 1 and out[1].loss == []
    assert out[2].rewritten_at is None and len(out[2].loss) == (first - 1) // 2
    assert out[1].formatted == chat.marked_turns([("assistant" if t % 2 else "user", f"turn {t}") for t in range(200)])


def test_chat_long_conversation(spark):
    said = {t: f"turn {t} <|im_end|>" for t in range(3_000)} | {77: "é<|" * 300_000}
    data = [(1, t, "assistant" if t % 2 else "user", x) for t, x in said.items()]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").repartition(4)
    r = chat.digests(chat.format_conversations(df)).first()
    loss = "".join(x for t, x in said.items() if t % 2)
    assert (r.n_turns, r.loss_chars, r.rewritten_at) == (3_000, len(loss), None) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


# ---- fingerprints


def _tree(t):
    """Sections, paragraphs and pieces of a text, as the texts themselves."""
    lines = t.split("\n")
    pieces = [[m[0] for m in re.finditer(merkle.PIECE_PATTERN.replace(r"\z", r"\Z"), line)] for line in lines]
    assert all("".join(p) == line for p, line in zip(pieces, lines, strict=True))
    return [tuple(lines[i : i + 8]) for i in range(0, len(lines), 8)], lines, pieces


def _walk(a, b):
    (sa, pa_, la), (sb, pb, lb) = _tree(a), _tree(b)

    def front(x, y):
        return next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))  # noqa: B905

    head = front(sa, sb)
    tail = front(sa[head:][::-1], sb[head:][::-1])
    ea, eb = ((len(s) - tail) * 8 if tail else len(p) for s, p in ((sa, pa_), (sb, pb)))
    skip = min(head * 8, ea, eb)
    first = skip + front(pa_[skip:ea], pb[skip:eb])
    back = front(pa_[first:ea][::-1], pb[first:eb][::-1])
    flat = lambda ls: [x for leaf in ls for x in leaf]
    ma, mb = flat(la[first : ea - back]), flat(lb[first : eb - back])
    size = lambda xs: sum(map(len, xs))
    every, differ, both = size(flat(la)) + size(flat(lb)), size(ma) + size(mb), size(set(ma)) + size(set(mb))
    near = 1.0 if a == b else (every - differ + (2 * size(set(ma) & set(mb)) / both * differ if both else 0)) / every if every else 0.0
    return first, ea - back - first, eb - back - first, near


def test_fingerprints(spark):
    rng = random.Random(6)
    data = [(i * 3, "\n".join(_text(rng.randint(1, 30)) for _ in range(rng.randint(1, 20)))) for i in range(50)]
    data += [(200, None), (201, ""), (202, data[0][1]), (203, "x"), (204, "😀" * 501), (205, "a" * 30_000), (206, "." * 500), (207, data[1][1] + data[2][1])]
    df = spark.createDataFrame([(*r, "e") for r in data], "doc_id long, text string, edited string").repartition(4)
    out = {r.doc_id: r for r in merkle.compare_with_next(df).select("*", merkle.as_string("own_tree").alias("fp")).collect()}
    ids = sorted(d for d, _ in data)
    text = {d: t or "" for d, t in data}
    for i, d in enumerate(ids):
        following = text[ids[(i + 1) % len(ids)]]
        half = len(text[d]) // 2
        edited = text[d][: len(text[d]) - half] + following[:half]
        assert out[d].n_chars == len(text[d]) and out[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for got, other in ((out[d].to_edited, edited), (out[d].to_next, following)):
            *place, near = _walk(text[d], other)
            assert list(got)[:3] == place and abs(got.likeness - near) < 1e-9
        assert len(text[d]) < 600 or d > 203 or out[d].to_edited.likeness > out[d].to_next.likeness
    assert out[0].fp == out[202].fp and out[200].fp == out[201].fp and len({r.fp for r in out.values()}) == len({*text.values()})


@pytest.mark.parametrize("block_rows", [2, 7, 2_000])
def test_next_over_blocks(spark, block_rows):
    rng = random.Random(block_rows)
    ids = [*rng.sample(range(-50, 10**12), 60), *range(10**15, 10**15 + 60), 5, 5, 5]
    data = [(d, f"t{i}") for i, d in enumerate(ids)]
    nameless = [(None, f"n{i % 20}") for i in range(25)]
    for rows in (data, data + nameless, nameless, data[:1]):
        got = merkle.with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), block_rows=block_rows).collect()
        assert Counter(r[:2] for r in got) == Counter(rows) and Counter(r.next for r in got) == Counter(t for _, t in rows)
        ordered = sorted((r for r in rows if r[0] is not None))
        want = {a[0:2]: b[1] for a, b in zip(ordered, ordered[1:], strict=False)}
        assert all(r.next == want[r.doc_id, r.text] for r in got if (r.doc_id, r.text) in want)
        if not any(d is None for d, _ in rows):
            assert next(r.next for r in got if r[:2] == ordered[-1]) == ordered[0][1]


def test_differing_branches_locate_edits(spark):
    lines = [f"paragraph {i} says {i * i}." for i in range(40)]
    other = [*lines[:17], "an edit.", *lines[18:33], "another.", *lines[34:]]
    more = [*lines[:11], "put in.", "twice.", *lines[11:]]
    df = spark.createDataFrame([("\n".join(lines), "\n".join(other), "\n".join(more))], "a string, b string, c string")
    for text, tree in (("a", "x"), ("b", "y"), ("c", "z")):
        df = merkle.fingerprint(df, text, tree)
    assert df.select(merkle.edited_paragraphs("x", "y")).first()[0] == [17, 33]
    r = merkle.walk(merkle.walk(df, "x", "y", "xy"), "x", "z", "xz").select("xy", "xz").first()
    assert list(r.xy)[:3] == [17, 17, 17] and list(r.xz)[:3] == [11, 0, 2] and r.xz.likeness > 0.97


def test_pieces_are_the_same_again_after_a_shift(spark):
    rng = random.Random(15)
    words = " ".join("".join(rng.choices("abdelnorstuy", k=rng.randint(2, 9))) for _ in range(200))
    df = spark.createDataFrame([(words, "put in " + words)], "a string, b string")
    df = merkle.walk(merkle.fingerprint(merkle.fingerprint(df, "a", "x"), "b", "y"), "x", "y", "w")
    assert df.select("w.likeness").first()[0] > 0.9


# ---- packing


def test_packing(docs, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(packing.default_tokenizer())
    pieces = packing.pack(docs, capacity=256).collect()
    want = Counter()
    for r in rows:
        ids = [*library.encode(r[1] or "", add_special_tokens=False).ids, 2]
        want[r[0], len(ids)] += 1
    total, got = Counter(), defaultdict(list)
    for p in pieces:
        assert len(p.ids) == 4 * p.length
        total[p.doc_id, p.doc_tokens] += p.length
        got[p.sequence_id].append((p.offset, p.length))
    assert total == Counter({k: k[1] * n for k, n in want.items()})
    for held in got.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 256
    one = next(r for r in rows if r[1] and len(r[1]) > 20_000 and " " in r[1])
    own = sorted((p.start, bytes(p.ids)) for p in pieces if p.doc_id == one[0])
    assert np.frombuffer(b"".join(b for _, b in own), "<u4").tolist() == [*library.encode(one[1], add_special_tokens=False).ids, 2]


def test_bpe_equals_the_library():
    import pyarrow as pa
    from tokenizers import Tokenizer

    from wordtide.llm._bpe import load
    from wordtide.llm._bytes import utf8

    path = packing.default_tokenizer()
    rng = random.Random(8)
    letters = "aAbBeEthéÉßüÜñçÿŸ'<|>end12 .,!?-\n\t\x0b\x1c\x85日́ΣİÅ÷×"
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(600)] + ["", "it's WE'RE", "a<|endoftext|>b", "x" * 200]
    ids, first = load(path).encode(*utf8(pa.array(texts)))
    library = Tokenizer.from_file(path)
    for i, t in enumerate(texts):
        assert ids[first[i] : first[i + 1]].tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_harmonic_bins_are_nearly_full():
    rule = packing.Harmonic(4096)
    for n in (1, 31, 700, 1_500, 2_049, 3_000, 4_096, 10_000):
        assert sum(rule.pieces(n)) == n and max(rule.pieces(n)) <= 4_096
    waste = [1 - rule.klass[p] * p / 4096 for n in range(1, 4097) for p in rule.pieces(n) if p > 32]
    assert max(waste) <= 1 / 32 + 0.01
