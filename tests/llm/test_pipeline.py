"""The pipeline and the queries with SQL twins on a small table, held against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

import corpus_pipeline
from wordtide.llm import queries

RNG = random.Random(21)
VOCAB = {"en": ["the", "ring", "tower", "river", "green", "house", "stone", "light"], "de": ["der", "Größe", "Turm", "Fluss", "grün", "Haus", "Stein", "Licht"]}


@pytest.fixture(scope="module")
def rows():
    out = []
    for i in range(60):
        lang = RNG.choice(list(VOCAB))
        out.append((i, " ".join(RNG.choices(VOCAB[lang], k=RNG.randint(40, 90))), lang, f"s{i % 3}"))
    out += [(100 + i, out[i][1], out[i][2], "s1") for i in range(10)]
    out += [(200 + i, out[i][1] + " " + out[i][1].split()[0], out[i][2], "s2") for i in range(5, 15)]
    out += [(300, "12 34 --", "en", "s0"), (301, None, "de", "s1"), (302, "", None, "s2")]
    return [(*r, len(r[1] or "")) for r in out]


@pytest.fixture(scope="module")
def sf_dir(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


def _sql(rows, sql):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    cur = con.execute(sql)
    return [dict(zip([c[0] for c in cur.description], r, strict=True)) for r in cur.fetchall()]


def _near_kept(rows):
    sets = {}
    for d, t, *_ in rows:
        w = t.split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    name = {d: d for d in sets}
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((name[a], name[b]))
                name = {d: x if c == y else c for d, c in name.items()}
    return [r for r in rows if name[r[0]] == r[0]]


def test_pipeline(spark, rows, sf_dir, monkeypatch):
    made = {}
    monkeypatch.setattr(corpus_pipeline, "written", lambda df, purpose, real=corpus_pipeline.written: made.setdefault(purpose, real(df, purpose)))
    out = corpus_pipeline.run(spark, sf_dir).collect()
    ids = lambda purpose: Counter(r.doc_id for r in made[purpose].select("doc_id").collect())
    count = lambda kept: Counter(r[0] for r in kept)

    kept = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    assert ids("language") == count(kept)
    found = {r.doc_id: r.lang for r in made["language"].select("doc_id", "lang").collect()}
    assert all(found[r[0]] == r[2] for r in kept)
    last = {r[1]: max(x[0] for x in kept if x[1] == r[1]) for r in kept}
    kept = [r for r in kept if last[r[1]] == r[0]]
    assert ids("exact") == count(kept)
    kept = _near_kept(kept)
    assert ids("minhash") == count(kept)
    copies = Counter({r["doc_id"]: r["taken"] // r["size"] for r in _sql(kept, queries.OP6_SQL) if r["taken"]})
    assert ids("mixing") == copies

    pieces, bins = Counter(), defaultdict(list)
    size = {r.doc_id: r.doc_tokens for r in out}
    for r in out:
        pieces[r.doc_id] += r.length
        bins[r.sequence_id].append((r.offset, r.offset + r.length))
    assert pieces == Counter({d: n * size[d] for d, n in copies.items()})
    for spans in bins.values():
        spans.sort()
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))


@pytest.mark.parametrize(("name", "sql"), [("op3_suffix_array", queries.OP3_SQL), ("op4_extendible_hash", queries.OP4_SQL), ("op5_superminhash", queries.OP5_SQL), ("op6_mixing", queries.OP6_SQL)])
def test_queries_equal_their_sql(spark, rows, sf_dir, name, sql):
    key = lambda r: [round(v, 6) if isinstance(v, float) else v for _, v in sorted(r.items())]
    got = sorted((key(r.asDict()) for r in queries.llm_queries()[name](spark, sf_dir).collect()), key=str)
    assert got == sorted(map(key, _sql(rows, sql)), key=str)


def _held(spark, sf_dir, name):
    return [r.asDict() for r in queries.llm_queries()[name](spark, sf_dir).collect()]


def _text(rows):
    return {r[0]: r[1] or "" for r in rows}


def test_op1_columns(spark, rows, sf_dir):
    out, text = _held(spark, sf_dir, "op1_external_shuffle"), _text(rows)
    assert sorted(r["doc_id"] for r in out) == sorted(text)
    shards = Counter(r["shard"] for r in out)
    assert set(shards) == set(range(16)) and max(shards.values()) - min(shards.values()) <= 1
    for r in out:
        own = text[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(own) + 1, zlib.crc32(own), "rows", None)
    for shard, n in shards.items():
        assert sorted(r["slot"] for r in out if r["shard"] == shard) == list(range(n))


def test_op2_columns(spark, rows, sf_dir):
    out, text = {r["doc_id"]: r for r in _held(spark, sf_dir, "op2_nearest_centroid")}, _text(rows)
    assert set(out) == set(text)
    for d, r in out.items():
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in text[d]))
    assert all(out[r[0]]["lang_pred"] == r[2] for r in rows if r[2] and any(c.isalpha() for c in r[1] or ""))


def test_op3_columns(spark, rows, sf_dir):
    out, first = {r["doc_id"]: r for r in _held(spark, sf_dir, "op3_suffix_array")}, {}
    for d, t in sorted(_text(rows).items()):
        b = t.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first.setdefault(b[p : p + 50], d) < d:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        r = out[d]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())


def test_op5_columns(spark, rows, sf_dir):
    out = {r["doc_id"]: r for r in _held(spark, sf_dir, "op5_superminhash")}
    text = {d: t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for d, t in _text(rows).items()}
    sets = {d: {(*w[i : i + 2],) for i in range(max(1, len(w) - 1))} if (w := t.split()) else set() for d, t in text.items()}
    name = {d: d for d in sets}
    for a in sorted(sets):
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((name[a], name[b]))
                name = {d: x if c == y else c for d, c in name.items()}
    for d, r in out.items():
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[d]), name[d], name[d] == d)


def test_op7_columns(spark, tmp_path):
    said = [(1, "a@b.org 1.2.3.4 +1 555 123 4567, 4111111111111111"), (2, None), (3, "é x@y.z"), (4, "300.1.1.1")]
    spark.createDataFrame([(d, t, "en", "s", 0) for d, t in said], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r["doc_id"]: r for r in _held(spark, str(tmp_path), "op7_weak_supervision")}
    base = {1: "email:0:7,ip:8:15,phone:16:31,card:33:49", 2: "", 3: "email:2:7", 4: ""}
    counts = {1: (1, 1, 1, 1), 2: (0, 0, 0, 0), 3: (1, 0, 0, 0), 4: (0, 0, 0, 0)}
    for d, r in out.items():
        assert tuple(r[f"n_{k}"] for k in ("email", "ip", "card", "phone")) == counts[d]
        assert r["base_sha256"] == hashlib.sha256(base[d].encode()).hexdigest() and set(filter(None, base[d].split(","))) <= set(r["spans"].split(","))


def test_op9_columns(spark, rows, sf_dir):
    out, text = {r["doc_id"]: r for r in _held(spark, sf_dir, "op9_merkle_tree")}, _text(rows)
    ids = sorted(text)
    for i, d in enumerate(ids):
        half = len(text[d]) // 2
        edited = text[d][: len(text[d]) - half] + text[ids[(i + 1) % len(ids)]][:half]
        r = out[d]
        assert r["n_chars"] == len(text[d]) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (r["fingerprint"] == r["edited_fingerprint"]) == (text[d] == edited) == (r["near_edited"] == 1.0)
        assert 0 <= r["near_next"] <= 1
    assert len({r["fingerprint"] for r in out.values()}) == len(set(text.values()))


def test_op10_columns(spark, rows, sf_dir):
    from tokenizers import Tokenizer

    from wordtide.llm import packing

    library, text = Tokenizer.from_file(packing.default_tokenizer()), _text(rows)
    ids = {d: [*library.encode(t, add_special_tokens=False).ids, 2] for d, t in text.items()}
    covered, bins = defaultdict(list), defaultdict(list)
    for r in _held(spark, sf_dir, "op10_harmonic_packing"):
        own = ids[r["doc_id"]]
        piece = own[r["start"] : r["start"] + r["length"]]
        assert len(piece) == r["length"] > 0 and r["doc_tokens"] == len(own)
        assert r["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in piece))
        covered[r["doc_id"]].append((r["start"], r["length"]))
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for d, spans in covered.items():
        assert [s for s, _ in sorted(spans)] == [sum(n for _, n in sorted(spans)[:i]) for i in range(len(spans))] and sum(n for _, n in spans) == len(ids[d])
    assert set(covered) == set(ids)
    for spans in bins.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 4096
