"""Sentences, tokens, samples, frames and phrases of turns(turn_id, project, ts, text)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import ahocorasick
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..work import cut

#: The words that open a frame "<word> X of".
DETERMINERS = "the a an this that these those its their your my our his her each every"
#: Fixed value: fewest tokens of a stored sentence.
MIN_TOKENS = 5


def sentences(turns: DataFrame, stopwords: list[str]) -> DataFrame:
    """turn_id, project, ts, sent_no, tokens, raw (lower-cased, trimmed), cased: sentences with a kept token."""
    # tokens are made before rows are, as the filter would make them a second time
    each = F.transform(tx.sentences(tx.clean(F.col("text"))), lambda s: F.struct(s.alias("cased"), tx.tokens(s, stopwords).alias("tokens")))
    cut = turns.select("turn_id", "project", "ts", F.posexplode(each).alias("sent_no", "s")).filter(F.size("s.tokens") > 0)
    return cut.select("turn_id", "project", "ts", "sent_no", "s.cased", "s.tokens", F.trim(F.lower("s.cased")).alias("raw"))


def tokens(turns: DataFrame, stopwords: list[str]) -> DataFrame:
    """turn_id, project, ts, lemma: every kept token. Sentence ends separate words, so whole texts give the same stream."""
    kept = tx.tokens(tx.clean(F.col("text")), stopwords)
    return turns.select("turn_id", "project", "ts", F.explode(kept).alias("lemma"))


def of_sentences(sents: DataFrame) -> DataFrame:
    """The tokens of sentences that are cut already: the same stream as that of their turns."""
    return sents.select("turn_id", "project", "ts", F.explode("tokens").alias("lemma"))


def ranked(counts: DataFrame) -> DataFrame:
    """``counts``(lemma, n) with r, the place by n and then lemma, from 1.

    Ranges of that order are written with their number; their sizes (one row each) say where each begins, and rows are numbered inside.
    """
    order = [F.desc("n"), F.asc("lemma")]
    held = cut(counts.select("lemma", "n").repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.groupBy("part").agg(F.count("*").alias("c")).select("part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return held.join(starts, "part").select("lemma", "n", (F.col("start") + inside).alias("r"))


def name_counts(turns: DataFrame, stopwords: list[str]) -> DataFrame:
    """lemma, mid, capped: uses after a sentence's first word, and how many of them have a capital."""
    return names_of(turns.select(F.explode(tx.sentences(tx.clean(F.col("text")))).alias("cased")), stopwords)


def names_of(sents: DataFrame, stopwords: list[str]) -> DataFrame:
    """``name_counts`` of sentences that are cut already; those without a kept token would add nothing."""
    words = sents.select(F.explode(_after_first(F.col("cased"))).alias("word")).groupBy("word").agg(F.count("*").alias("c"))
    own = words.select(tx.lemma(F.lower("word")).alias("lemma"), _capped(F.col("word")).alias("capped"), "c").filter(tx.keep(F.col("lemma"), stopwords))
    return own.groupBy("lemma").agg(F.sum("c").alias("mid"), F.sum(F.when(F.col("capped"), F.col("c")).otherwise(0)).alias("capped"))


def _after_first(sentence: Column) -> Column:
    return tx.let(tx.words(sentence), lambda w: F.slice(w, F.lit(2), F.size(w)))


def _capped(word: Column) -> Column:
    first = F.substring(word, 1, 1)
    return (F.upper(first) == first) & (F.lower(first) != first) & (F.upper(word) != word)


def lemma_table(turns: DataFrame, stopwords: list[str]) -> DataFrame:
    """lemma, project, n, mid, capped: its tokens, and what ``name_counts`` counts, in one pass over the texts.

    A word of a sentence gives one row unless lower case would cut the sentence into other words.
    """
    row = lambda lemma, n, mark: F.struct(lemma.alias("lemma"), n.alias("n"), mark.alias("mark"))
    mark = lambda w: F.when(_capped(w), 2).otherwise(1)

    def told(s: Column) -> Column:
        inner = lambda low, cased: F.when(low == cased, 1).otherwise(mark(cased))
        one = F.transform(s["low"], lambda w, i: row(tx.stem(w), F.lit(1), F.when(i == 0, 0).otherwise(inner(w, F.get(s["cased"], i)))))
        rest = F.transform(F.slice(s["cased"], F.lit(2), F.size(s["cased"])), lambda w: row(tx.lemma(F.lower(w)), F.lit(0), mark(w)))
        two = F.concat(F.transform(s["low"], lambda w: row(tx.stem(w), F.lit(1), F.lit(0))), rest)
        return F.when(F.transform(s["cased"], F.lower) == s["low"], one).otherwise(two)

    def spoken(sentence: Column) -> Column:
        rows = tx.let(F.struct(tx.words(sentence).alias("cased"), tx.words(F.lower(sentence)).alias("low")), told)
        return F.filter(rows, lambda w: tx.keep(w["lemma"], stopwords))

    said = turns.select("project", F.explode(tx.sentences(tx.clean(F.col("text")))).alias("sentence")).select("project", F.explode(spoken(F.col("sentence"))).alias("w"))
    return said.groupBy("w.lemma", "project").agg(F.sum("w.n").alias("n"), F.count_if(F.col("w.mark") > 0).alias("mid"), F.count_if(F.col("w.mark") == 2).alias("capped"))


def stored(sents: DataFrame) -> DataFrame:
    """Sentences of at least five tokens; of equal token streams the first in corpus order.

    The first is found by a minimum over (turn_id, sent_no) with partial aggregation, so a
    sentence that very many turns repeat is no hot group. Project and text travel only where ``sents`` has them.
    """
    long = sents.filter(F.size("tokens") >= MIN_TOKENS)
    more = [c for c in ("project", "raw") if c in sents.columns]
    # tokens have no blanks; a text is half as long as an array where it is sorted and shuffled
    first = long.groupBy(F.array_join("tokens", " ").alias("key")).agg(F.min(F.struct("turn_id", "sent_no", *more)).alias("s"))
    return first.select("s.turn_id", "s.sent_no", *[f"s.{c}" for c in more if c != "raw"], F.split("key", " ").alias("tokens"), *[f"s.{c}" for c in more if c == "raw"])


#: Turns of a block of corpus order.
BLOCK = 65_536


def index(store: DataFrame, *more: str) -> DataFrame:
    """lemma, turn_id, sent_no and ``more`` columns: each stored sentence once for each of its lemmas."""
    return store.select(F.explode(F.array_distinct("tokens")).alias("lemma"), "turn_id", "sent_no", *more)


def _block(rows: DataFrame) -> Column:
    """Stretches of corpus order. A turn_id is a number, or a struct (path, place) of a line of a file."""
    kind = rows.schema["turn_id"].dataType
    if not isinstance(kind, T.StructType):
        return F.expr(f"turn_id div {BLOCK}")
    *keys, place = kind.names
    return F.struct(*[F.col(f"turn_id.{k}").alias(k) for k in keys], F.expr(f"turn_id.{place} div {BLOCK}").alias(place))


def strided(rank: Column, n: Column, most: int) -> Column:
    """Whether the 0-based rank of n is in the systematic sample floor(i * n / most)."""
    i = F.ceil(rank * most / n)
    return (n <= most) | ((i < most) & (F.floor(i * n / most) == rank)) if most > 0 else F.lit(True)


def _sampled(rows: DataFrame, by: list[str], most: int) -> DataFrame:
    """``rows``(by..., turn_id, sent_no) of the systematic sample of each group, with ``use_rank``.

    Ranks come without one task for a group: blocks of corpus order are counted, the counts
    of a group are summed up (one row for each block), and only blocks that hold a row of the
    sample are numbered, each in a window of its own.
    """
    own = rows.withColumn("block", _block(rows))
    counts = own.groupBy(*by, "block").agg(F.count("*").alias("c"))
    group = Window.partitionBy(*by)
    before = group.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("start", F.coalesce(F.sum("c").over(before), F.lit(0))).withColumn("n", F.sum("c").over(group))
    if most > 0:
        i = F.ceil(F.col("start") * most / F.col("n"))
        first = F.floor(i * F.col("n") / most)
        counts = counts.filter((F.col("n") <= most) | ((i < most) & (first < F.col("start") + F.col("c"))))
    inside = F.row_number().over(Window.partitionBy(*by, "block").orderBy("turn_id", "sent_no")) - 1
    ranked = own.join(counts.drop("c"), [*by, "block"]).withColumn("use_rank", F.col("start") + inside)
    return ranked.filter(strided(F.col("use_rank"), F.col("n"), most)).drop("block", "start", "n")


def uses(store: DataFrame, lemmas: DataFrame, most: int) -> DataFrame:
    """A systematic sample of at most ``most`` stored sentences for each of ``lemmas``(lemma), with ``use_no``.

    Only ids are ranked; texts join what was sampled.
    """
    own = index(store).join(lemmas.select("lemma").distinct(), "lemma")
    out = _sampled(own, ["lemma"], most)
    out = out.withColumn("use_no", F.row_number().over(Window.partitionBy("lemma").orderBy("use_rank"))).drop("use_rank")
    return out.join(store.select("turn_id", "sent_no", "tokens", "raw"), ["turn_id", "sent_no"]).select("lemma", "turn_id", "sent_no", "tokens", "raw", "use_no")


def sample(store: DataFrame, most: int) -> DataFrame:
    """A systematic sample over all stored sentences in corpus order."""
    out = _sampled(store.select("turn_id", "sent_no"), [], most).drop("use_rank")
    return store.join(out, ["turn_id", "sent_no"], "left_semi")


def frame_fraction(store: DataFrame, lemmas: DataFrame | None = None) -> DataFrame:
    """lemma, uses, framed, frame_frac: share of a lemma's stored sentences with "<determiner> lemma of" (each once).

    The framed lemmas of a sentence are found once; what is exploded is a lemma and whether it is one of them.
    """
    opens = DETERMINERS.split()

    def inside(words: Column) -> Column:
        at = F.when(F.size(words) > 2, F.sequence(F.lit(1), F.size(words) - 2)).otherwise(F.array().cast("array<int>"))
        hit = F.filter(at, lambda i: (F.get(words, i + 1) == "of") & F.get(words, i - 1).isin(opens))
        return F.transform(hit, lambda i: tx.lemma(F.get(words, i)))

    framed = tx.let(F.when(F.col("raw").contains("of"), tx.words(F.col("raw"))).otherwise(F.array().cast("array<string>")), inside)
    each = lambda found: F.transform(F.array_distinct("tokens"), lambda t: F.struct(t.alias("lemma"), F.array_contains(found, t).alias("framed")))
    hits = store.select(F.explode(tx.let(framed, each)).alias("h")).select("h.lemma", "h.framed")
    out = hits.groupBy("lemma").agg(F.count("*").alias("uses"), F.count_if("framed").alias("framed"))
    if lemmas is not None:
        out = out.join(lemmas.select("lemma").distinct(), "lemma")
    return out.withColumn("frame_frac", F.col("framed") / F.col("uses"))


# ---- phrases


def normal_phrases(phrases: list[str]) -> list[str]:
    """Phrases as streams of words, those of fewer than two words left out, each once."""
    streams = (" ".join(tx.words_of(p.lower())) for p in phrases)
    return list(dict.fromkeys(s for s in streams if " " in s))


_BUILT: dict[tuple[str, ...], ahocorasick.Automaton] = {}


def automaton(phrases: Sequence[str]) -> ahocorasick.Automaton:
    """Finds phrases in words between bars ("|a|b|c|"); it grows with the phrases' letters, a text's cost does not."""
    out = ahocorasick.Automaton()
    for p in phrases:
        words = f"|{p.replace(' ', '|')}|"
        out.add_word(words, (p, len(words)))
    out.make_automaton()
    return out


def matches(found: ahocorasick.Automaton, words: str) -> list[str]:
    """Phrases in order of place and length. Left to right: at a place all that begin there count, then it goes on after the longest."""
    hits = sorted((end - n + 1, n, p) for end, (p, n) in found.iter(words))
    out, free, at, longest = [], 0, -1, 0
    for start, n, p in hits:
        if start != at:
            free = max(free, at + longest - 1)  # the bar that ends a phrase opens the next one
            if start < free:
                continue
            at = start
        out.append(p)
        longest = n
    return out


def _found(shared: Broadcast) -> Callable:
    @F.pandas_udf("array<string>")
    def udf(words: pd.Series) -> pd.Series:
        key = tuple(shared.value)
        if key not in _BUILT:  # a worker keeps the last one that it built
            _BUILT.clear()
            _BUILT[key] = automaton(key)
        return pd.Series([matches(_BUILT[key], w) if w else [] for w in words])

    return udf


def phrase_matches(texts: DataFrame, column: str, phrases: list[str]) -> DataFrame:
    """Explodes ``texts`` into a row for each phrase found in ``column``: ``phrase``.

    The scan goes left to right; at a place every phrase that begins there counts, then it goes on after the
    longest. One automaton finds all phrases in one pass over a text's words, so neither the plan nor a text's cost
    grows with their number. The list is the caller's own and sent to each worker once.
    """
    own = normal_phrases(phrases)
    if not own:
        return texts.withColumn("phrase", F.lit(None).cast("string")).filter(F.lit(False))
    shared = texts.sparkSession.sparkContext.broadcast(own)
    return texts.withColumn("phrase", F.explode(_found(shared)(tx.encoded_words(F.col(column)))))


def report_phrases(turns: DataFrame, phrases: list[str], stopwords: list[str]) -> DataFrame:
    """Phrase uses as a report counts them: in cleaned text, within sentences that keep a token."""
    return phrase_matches(sentences(turns, stopwords).select("turn_id", "project", "ts", "raw"), "raw", phrases)


def audit_phrases(turns: DataFrame, phrases: list[str]) -> DataFrame:
    """Phrase uses as an audit counts them: in the raw text, across sentence ends."""
    return phrase_matches(turns.select("turn_id", "project", "ts", "text"), "text", phrases)
