"""Thesaurus joins: senses, information content, ladders of ever more general words.

Tables: sense_index(pos, lemma, sense_ord, key), synset(key, pos, gloss),
synset_word(key, ord, word), synset_ptr(key, ord, sym, target), ic(key, ic),
word_freq(lemma, n). They are dictionaries of a language; joins leave the choice of
broadcast to their measured size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

#: Order of the parts of speech, and the pointer symbols.
POS_ORDER = "nvar"
HYPERNYM, SIMILAR = "@", "&"
#: Fixed value: rungs shown, the lemma included.
RUNGS = 5


@dataclass
class Thesaurus:
    sense_index: DataFrame
    synset: DataFrame
    synset_word: DataFrame
    synset_ptr: DataFrame
    ic: DataFrame
    word_freq: DataFrame


def lookup(t: Thesaurus, lemmas: DataFrame) -> DataFrame:
    """lemma, pos, sense_ord, key: senses in order; keys without a synset are passed over."""
    asked = lemmas.select("lemma").distinct().withColumn("norm", tx.norm_lemma(F.col("lemma")))
    own = asked.join(t.sense_index.withColumnRenamed("lemma", "norm"), "norm")
    return own.join(t.synset.select("key"), "key").select("lemma", "pos", "sense_ord", "key")


def word_ic(words: DataFrame, t: Thesaurus, column: str = "word") -> DataFrame:
    """Adds ``word_ic``: -ln((n + 0.5) / total), n = 0 for words not counted."""
    total = t.word_freq.agg(F.sum("n").alias("freq_total"))
    freq = t.word_freq.select(F.col("lemma").alias("__w"), F.col("n").alias("__n"))
    out = words.withColumn("__k", tx.norm_lemma(F.col(column))).join(freq, F.col("__k") == F.col("__w"), "left").crossJoin(F.broadcast(total))
    return out.withColumn("word_ic", -F.ln((F.coalesce("__n", F.lit(0)) + 0.5) / F.col("freq_total"))).drop("__k", "__w", "__n", "freq_total")


def ladders(t: Thesaurus, lemmas: DataFrame) -> DataFrame:
    """lemma, pos, sense_ord, word, source, ic, word_ic, rung_ord (from 1): ladders of two rungs or more.

    Rungs come from the sense itself, its synonyms, its hypernyms and theirs, and similar
    senses, in this order; of a word's rungs the first stays; then a stable sort by
    information content. Depth is two by definition, so the joins are four, no recursion.
    """
    senses = lookup(t, lemmas)
    at = ["lemma", "pos", "sense_ord"]
    word = t.synset_word.select(F.col("key").alias("from"), F.col("ord").alias("w_ord"), tx.clean_word(F.col("word")).alias("word"))
    ptr = lambda sym: t.synset_ptr.filter(F.col("sym") == sym).select("key", F.col("ord").alias("p_ord"), F.col("target").alias("from"))
    zero = F.lit(0)

    def rung(df: DataFrame, source: str, group: int, *order: Column) -> DataFrame:
        keys = [*order, zero, zero, zero][:3]
        return df.select(*at, "word", "from", F.lit(source).alias("source"), F.struct(F.lit(group).alias("a"), *[k.cast("int").alias(n) for k, n in zip(keys, "bcd", strict=True)]).alias("ordinal"))

    own = senses.select(*at, F.lower("lemma").alias("word"), F.col("key").alias("from"))
    up = senses.join(ptr(HYPERNYM), "key")
    up2 = up.select(*at, F.col("p_ord").alias("p1"), F.col("from").alias("key")).join(ptr(HYPERNYM), "key")
    found = rung(own, "self", 0)
    found = found.unionByName(rung(senses.withColumnRenamed("key", "from").join(word, "from"), "synonym", 1, F.col("w_ord")))
    found = found.unionByName(rung(up.join(word, "from"), "hypernym", 2, F.col("p_ord"), zero, F.col("w_ord")))
    found = found.unionByName(rung(up2.join(word, "from"), "hypernym2", 2, F.col("p1"), F.col("p_ord") + 1, F.col("w_ord")))
    found = found.unionByName(rung(senses.join(ptr(SIMILAR), "key").join(word, "from"), "similar", 3, F.col("p_ord"), F.col("w_ord")))
    first = found.groupBy(*at, "word").agg(F.min(F.struct("ordinal", "source", "from")).alias("r")).select(*at, "word", "r.*")
    out = word_ic(first, t).join(t.ic.select(F.col("key").alias("from"), F.col("ic").alias("own_ic")), "from", "left")
    out = out.withColumn("ic", F.coalesce("own_ic", "word_ic"))
    sense = Window.partitionBy(*at)
    out = out.withColumn("rung_ord", F.row_number().over(sense.orderBy("ic", "word_ic", "ordinal"))).withColumn("rungs", F.count("*").over(sense))
    return out.filter("rungs > 1").select(*at, "word", "source", "ic", "word_ic", "rung_ord")


def candidates(ladder: DataFrame) -> DataFrame:
    """lemma, word, ic, self_ic, cand_ord: words of all senses, each with its first information content;
    neither the lemma nor words that contain it."""
    order = F.struct(F.expr(f"instr('{POS_ORDER}', pos)").alias("p"), "sense_ord", "rung_ord")
    selves = ladder.filter(F.col("source") == "self").groupBy("lemma").agg(F.min_by("ic", order).alias("self_ic"))
    others = ladder.filter((F.col("source") != "self") & ~tx.contains_word(F.col("word"), F.lower("lemma")))
    first = others.groupBy("lemma", "word").agg(F.min(F.struct(order.alias("o"), "ic")).alias("f"))
    out = first.select("lemma", "word", "f.ic", "f.o").join(selves, "lemma")
    return out.withColumn("cand_ord", F.row_number().over(Window.partitionBy("lemma").orderBy("o", "word"))).drop("o")


def trimmed(words: Column, lemma: Column, rungs: int = RUNGS) -> Column:
    """The rungs just below the lemma and the lemma; without it, the last ones."""
    at = F.array_position(words, lemma).cast("int")
    last = F.when(at > 0, at).otherwise(F.size(words))
    start = F.greatest(last - rungs + 1, F.lit(1))
    return F.when(F.size(words) == 0, words).otherwise(F.slice(words, start, last - start + 1))


def demote_options(words: Column, lemma: Column) -> Column:
    return F.filter(trimmed(words, lemma), lambda w: w != lemma)
