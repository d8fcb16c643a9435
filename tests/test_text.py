"""Text expressions against their Python twins and on fixed cases."""

import random

from pyspark.sql import functions as F

from wordtide.functions import display as dp
from wordtide.functions import text as tx


def _one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "x string").select(*columns).first()


def test_clean_drops_code_urls_and_paths(spark):
    text = "run `ls -l` now\n```\ncode here\n``` see https://a.b/c?d or ~/x/y.txt and this/that, done."
    assert _one(spark, text, tx.clean(F.col("x")))[0].split() == ["run", "now", "see", "or", "~", "and", ",", "done."]
    assert _one(spark, "a/" * 20_000 + "b", F.trim(tx.clean(F.col("x"))))[0] == ""


def test_words_and_lemmas_equal_the_twins(spark):
    rng = random.Random(1)
    letters = "abSsxyieéÉ'-' .,3\n"
    texts = ["".join(rng.choices(letters, k=40)) for _ in range(200)] + ["Boss's classes' flies, pushes boxes; gas bus this is'"]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    rows = df.select("x", tx.words(F.col("x")).alias("w"), F.transform(tx.words(F.lower("x")), tx.lemma).alias("l")).collect()
    for r in rows:
        assert r.w == tx.words_of(r.x)
        assert r.l == [tx.lemma_of(w) for w in tx.words_of(r.x.lower())]


def test_lemma_cases():
    assert [tx.lemma_of(w) for w in ("cities", "boxes", "glass", "bus", "dogs", "dog's", "ties", "élés")] == ["city", "box", "glass", "bus", "dog", "dog", "tie", "élé"]


def test_stopwords_hold_lemmas():
    assert {"does", "doe", "always", "alway"} <= set(tx.stopword_set())
    assert tx.stopword_set(["Wolves"]) == ["Wolve", "Wolves"]


def test_keep_counts_bytes(spark):
    assert _one(spark, "éa ab abc the", tx.tokens(F.col("x"), tx.stopword_set()))[0] == ["éa", "abc"]


def test_notes_end_at_their_first_sentence(spark):
    for note, want in (("One. Two.", "One."), ('He said "no." Then', 'He said "no."'), ("as e.g. Rust does. Yes", "as e.g. Rust does. Yes"), ("no end", "no end")):
        assert _one(spark, note, dp.first_sentence(F.col("x")))[0] == want


def test_sparklines(spark):
    df = spark.createDataFrame([([0.0, 0.5, 1.0, None],), ([2.0, 2.0],), ([0.0, 0.0],), ([],)], "x array<double>")
    assert [r[0] for r in df.select(dp.sparkline(F.col("x"))).collect()] == ["▁▅█ ", "▄▄", "▁▁", ""]
    assert [r[0] for r in df.select(dp.trend_arrow(F.col("x"))).collect()] == ["↑", "→", "→", "→"]


def test_case_and_plurals(spark):
    pairs = [("Arm", "branch", "Branch"), ("ARM", "branch", "BRANCH"), ("arm", "branch", "branch"), ("É", "x", "X")]
    for a, b, want in pairs:
        got = spark.createDataFrame([(a, b)], "a string, b string").select(dp.match_case(F.col("a"), F.col("b"))).first()[0]
        assert got == want == dp.match_case_of(a, b)
    for w, want in (("box", "boxes"), ("city", "cities"), ("day", "days"), ("cat", "cats")):
        assert _one(spark, w, dp.pluralize(F.col("x")))[0] == want == dp.plural_of(w)
    assert dp.inflected("arm's", "arm", "branch") == "branch's" and dp.inflected("arms", "arm", "branch") == "branches"


def test_changes_and_ages(spark):
    r = spark.range(1).select(dp.change(F.lit(0.0), F.lit(3.0)), dp.change_arrow(F.lit(-1.0)), dp.change_arrow(F.lit(0.5)), dp.human_age(F.lit(15 * 86400)), dp.human_age(F.lit(5)), dp.human_age(F.lit(3 * 86400)), dp.shown(F.lit(True), F.lit(0)), dp.shortened(F.lit("abcdef"), 4)).first()
    assert list(r) == [0.0, "↓", "→", "2w", "today", "3d", "curated, never shown", "abc…"]


def test_function_words_are_whole():
    assert len(set(tx.FUNCTION_WORDS.split())) == 318 and len(tx.stopword_set()) == 322
    assert {"four", "seventh", "toward", "wouldn't", "out-of"} <= set(tx.stopword_set())
