"""The stored index against the sample that is taken from the sentences."""

import random

from wordtide.operators import postings, tokens

WORDS = [f"word{chr(97 + i)}" for i in range(20)]


def store(spark):
    rng = random.Random(3)
    rows = []
    for turn in range(0, 3_000, 3):
        for no in range(rng.randint(0, 3)):
            own = rng.choices(WORDS, [40, *range(19, 0, -1)], k=6)
            rows.append((turn, no, "p", own, f"{turn}/{no}"))
    return spark.createDataFrame(rows, "turn_id long, sent_no int, project string, tokens array<string>, raw string").repartition(3)


def test_uses_equal_those_of_the_sentences(spark, tmp_path):
    own, path = store(spark).cache(), str(tmp_path / "index")
    postings.write(own, path, buckets=8)
    key = lambda df: sorted((r.lemma, r.turn_id, r.sent_no, r.use_no) for r in df.select("lemma", "turn_id", "sent_no", "use_no").collect())
    for asked, most in ((WORDS, 7), (["worda", "wordt", "absent"], 50), (["wordc"], 0), ([], 5)):
        got = postings.uses(postings.of_lemmas(spark, path, asked, buckets=8), most)
        want = tokens.uses(own, spark.createDataFrame([(x,) for x in asked], "lemma string"), most)
        assert key(got) == key(want)
    counted = {r.lemma: r.uses for r in postings.counts(postings.of_lemmas(spark, path, WORDS, buckets=8)).collect()}
    assert counted == {r.lemma: r["count"] for r in tokens.index(own).groupBy("lemma").count().collect()}
    with_text = postings.sentences_of(postings.uses(postings.of_lemmas(spark, path, ["wordb"], buckets=8), 5), own)
    assert sorted(r.raw for r in with_text.collect()) == sorted(f"{r.turn_id}/{r.sent_no}" for r in with_text.collect())


def test_only_asked_buckets_are_read(spark, tmp_path):
    path = str(tmp_path / "index")
    postings.write(store(spark), path, buckets=16)
    plan = postings.of_lemmas(spark, path, ["worda"], buckets=16)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "lemma" in plan.split("PushedFilters:")[1].split("]")[0]
    files = {r.f.rsplit("/", 2)[1] for r in postings.of_lemmas(spark, path, ["worda"], buckets=16).selectExpr("_metadata.file_path f").collect()}
    assert len(files) == 1
