"""What only shows on many files, at ties of rounding or in plans: cases that small tables pass over."""

import random
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from wordtide import queries
from wordtide.functions import text as tx
from wordtide.operators import postings, tokens, vectors
from wordtide.plans import commands
from wordtide.sources import files

STOP = tx.stopword_set()


def rows_of(spark, df, node):
    """Rows that a plan's nodes of a name put out, at most."""
    df.write.format("noop").mode("overwrite").save()
    execution = df._jdf.queryExecution()
    execution.toRdd().count()
    found = []

    def walk(plan):
        if node in plan.nodeName() and plan.metrics().contains("numOutputRows"):
            found.append(plan.metrics().apply("numOutputRows").value())
        if plan.nodeName() == "AdaptiveSparkPlan":
            return walk(plan.executedPlan())
        if hasattr(plan, "plan") and "QueryStage" in plan.nodeName():
            return walk(plan.plan())
        for i in range(plan.children().size()):
            walk(plan.children().apply(i))

    walk(execution.executedPlan())
    return max(found)


def test_lines_of_a_folder_follow_each_other_by_name(spark, tmp_path):
    (tmp_path / "part-0").write_text("first 3 4 0\ntwice 1 0 0\n")
    (tmp_path / "part-1").write_text("short 1 2\n" + "".join(f"w{i} 0 {i + 1} 0\n" for i in range(99)) + "twice 0 0 1\n")
    got = {r.word: r.v for r in files.read_vectors(spark, str(tmp_path)).collect()}
    assert len(got) == 101 and "short" not in got
    assert got["twice"] == [0.0, 0.0, 1.0]


def test_vectors_are_rounded_once(spark, tmp_path):
    rows = [(0, [22.0, 36.0]), (2, [3158.0, 3234.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r.word: r["first"] for r in queries.vector_file(spark, str(tmp_path)).collect()}
    assert got == {"v0": 0.5215, "v2": 0.6986}


def test_means_shuffle_no_vector_for_each_use(spark):
    words = [f"w{i}" for i in range(50)]
    table = spark.createDataFrame([(w, [float(i), 1.0, -2.0]) for i, w in enumerate(words)], "word string, v array<float>")
    rng = random.Random(5)
    bags = [(i, rng.choices([*words, "unknown"], k=rng.randint(0, 40))) for i in range(3_000)] + [(3_000, None), (3_001, ["w1"] * 40_000)]
    out = vectors.means(spark.createDataFrame(bags, "id long, words array<string>"), ["id"], table).cache()
    own = dict(zip(words, np.array([[i, 1, -2] for i in range(50)], float), strict=True))
    got = {r.id: r for r in out.collect()}
    assert len(got) == len(bags)
    for i, bag in bags:
        known = [own[w] for w in bag or [] if w in own]
        assert got[i].known == len(known)
        if known:
            want = sum(known) / np.linalg.norm(sum(known))
            assert np.allclose(got[i].mean, want, atol=1e-6)
        else:
            assert got[i].mean is None
    assert rows_of(spark, vectors.means(spark.createDataFrame(bags, "id long, words array<string>"), ["id"], table), "Join") <= 60 * len(words)


def test_ranks_are_those_of_one_sort(spark):
    counts = spark.createDataFrame([(f"w{i % 97}-{i}", i % 7) for i in range(2_000)], "lemma string, n int")
    want = {w: r for r, (w, n) in enumerate(sorted(((r.lemma, r.n) for r in counts.collect()), key=lambda x: (-x[1], x[0])), 1)}
    out = tokens.ranked(counts)
    assert {r.lemma: r.r for r in out.collect()} == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "row_number" in plan and "row_number() windowspecdefinition(part" in plan


def test_one_pass_counts_tokens_and_names(spark):
    said = ["So The Boss's dogs met Anna. Then Anna saw it: Ülle's cats; RUST and Rust", "anna\nTHE Anna's fences `Code` Fences. o'NEIL İstanbul and Iİs", "", "Only stop words are in the"]
    turns = spark.createDataFrame([(i, f"p{i % 2}", None, t) for i, t in enumerate(said * 3)], "turn_id long, project string, ts timestamp, text string")
    got = tokens.lemma_table(turns, STOP)
    n = {(r.lemma, r.project): r.n for r in got.collect() if r.n}
    assert n == {(r.lemma, r.project): r["count"] for r in tokens.tokens(turns, STOP).groupBy("lemma", "project").count().collect()}
    names = {r.lemma: (r.mid, r.capped) for r in got.groupBy("lemma").agg(F.sum("mid").alias("mid"), F.sum("capped").alias("capped")).collect() if r.mid}
    assert names == {r.lemma: (r.mid, r.capped) for r in tokens.name_counts(turns, STOP).collect()}
    assert names["anna"] == (9, 9)


def test_an_audit_keeps_no_copy_of_the_texts(spark):
    turns = spark.createDataFrame([(i, "p", None, f"alpha beta {chr(97 + i % 26) * 5} gamma") for i in range(500)], "turn_id long, project string, ts timestamp, text string")
    entries = spark.createDataFrame([], "lemma string, entry_ord int")
    made = set(Path(spark.conf.get("spark.checkpoint.dir")).iterdir())
    out = commands.audit(turns, ["alpha", "absent"], ["beta gamma"], entries, STOP)
    assert {r.term: r.hits for r in out.collect()} == {"alpha": 500, "absent": 0, "beta gamma": 0}
    new = set(Path(spark.conf.get("spark.checkpoint.dir")).iterdir()) - made
    assert sum(spark.read.parquet(str(p)).count() for p in new) == 29


def test_postings_are_made_where_a_block_is(spark):
    store = spark.createDataFrame([(1, 0, ["alpha", "beta"])], "turn_id long, sent_no int, tokens array<string>")
    plan = postings._lists(store)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Exchange hashpartitioning(block" in plan
