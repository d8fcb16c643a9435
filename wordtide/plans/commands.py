"""The commands: scan, trend, ladder, vet, report, audit, each a composition of operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import audit as au
from ..operators import drift, gate, thesaurus, tokens, vectors, verdicts
from ..options import REPORT, SCAN, VET, Options
from ..work import cut, discard

VectorLoader = Callable[[DataFrame], DataFrame]


def scan(turns: DataFrame, now: datetime, stopwords: list[str], o: Options = SCAN) -> DataFrame:
    """Lemmas that rose, outside their loudest project."""
    by_project = drift.lemma_project_counts(tokens.tokens(turns, stopwords), now, o)
    return drift.risers(drift.lemma_counts(by_project), o)


def trend(turns: DataFrame, lemmas: Sequence[str], now: datetime, stopwords: list[str], weeks: int = 8) -> DataFrame:
    asked = [tx.lemma_of(x.lower()) for x in lemmas]
    return drift.trend(tokens.tokens(turns, stopwords), asked, now, weeks)


def ladder(t: thesaurus.Thesaurus, words: DataFrame) -> DataFrame:
    """Ladders with their gloss up to the first semicolon and a mark on the word itself."""
    own = thesaurus.ladders(t, words)
    gloss = thesaurus.lookup(t, words).join(t.synset.select("key", "gloss"), "key")
    gloss = gloss.select("lemma", "pos", "sense_ord", F.trim(F.substring_index("gloss", ";", 1)).alias("gloss"))
    return own.join(gloss, ["lemma", "pos", "sense_ord"], "left").withColumn("is_self", F.col("source") == "self")


def vet(turns: DataFrame, words: DataFrame, t: thesaurus.Thesaurus, table: DataFrame, stopwords: list[str], o: Options = VET) -> dict[str, DataFrame]:
    """Of words that are used often enough: spread of their uses, frame share, and ranked substitutes."""
    store = tokens.stored(tokens.sentences(turns, stopwords))
    uses = tokens.uses(store, words, o.max_uses)
    uses = uses.withColumn("n", F.count("*").over(Window.partitionBy("lemma"))).filter(F.col("n") >= o.min_uses).drop("n")
    cands = thesaurus.candidates(thesaurus.ladders(t, words))
    subs = vectors.ranked(vectors.substitutes(uses, cands, table, o.threshold)).filter(F.col("rank") <= o.top)
    return {"spread": vectors.spread(vectors.use_bags(uses), table, ["lemma"]), "frames": tokens.frame_fraction(store, words), "substitutes": subs}


def _gate(subs: DataFrame, kinds: DataFrame, o: Options) -> DataFrame:
    """Rungs that stand in cleanly; for a chronic word that keeps none, at most its first two of some worth."""
    own = subs.join(kinds.select("lemma", "kind"), "lemma").withColumn("frac", F.col("clean") / F.col("total"))
    need = F.when(F.col("kind") == "riser", o.min_clean).otherwise(max(o.min_clean, o.min_clean_chronic))
    own = own.withColumn("clean_enough", F.col("frac") >= need)
    by = Window.partitionBy("lemma")
    own = own.withColumn("any_clean", F.max("clean_enough").over(by))
    worst = F.min("frac").over(by.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    own = own.withColumn("worst", worst)
    spare = (F.col("kind") != "riser") & ~F.col("any_clean") & (F.col("rank") <= o.fallback_rungs) & (F.col("worst") >= o.fallback_clean)
    return own.filter(F.col("clean_enough") | spare)


def report(
    turns: DataFrame,
    now: datetime,
    stopwords: list[str],
    t: thesaurus.Thesaurus,
    load_vectors: VectorLoader,
    curated_words: Sequence[str] = (),
    phrases: Sequence[str] = (),
    proper_nouns: Sequence[str] = (),
    judgments: DataFrame | None = None,
    o: Options = REPORT,
    judge: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """The report's entries in order: risers, chronic words by route, figurative ones, phrases.

    ``load_vectors`` gets the vocabulary that is asked for and returns its vectors; it is not
    called if no word needs them. ``judgments``(word, role, demote_to, note) drop terms of art
    before budgets are spent; a ``judge`` (operators.gate) is asked about the words that the budgets
    admit, with the rungs that a reader would see below the word and its uses. What several branches need is written to the shared folder once.
    """
    spark = turns.sparkSession
    made: list[DataFrame] = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        made.append(cut(df, name))
        return made[-1]

    # the corpus is cleaned and cut into sentences once; every branch reads what is written here
    sents = kept(tokens.sentences(turns, stopwords).drop("raw"), "report-sentences").withColumn("raw", F.trim(F.lower("cased")))
    toks = tokens.of_sentences(sents)
    store = kept(tokens.stored(sents), "sentences")
    lemmas = kept(drift.lemma_counts(drift.lemma_project_counts(toks, now, o)), "lemmas")
    full_total = drift.totals(lemmas).select("full_total")
    rising = kept(drift.risers(lemmas, o).select("lemma", "recent", "projects", "recent_rate", "ratio", "score"), "risers")
    pool = kept(drift.chronic_pool(lemmas, None, o), "pool")
    asked = kept(rising.select("lemma").union(pool.select("lemma")).distinct(), "asked")
    cands_all = kept(thesaurus.candidates(kept(thesaurus.ladders(t, asked), "ladders")), "candidates")
    uses_all = kept(tokens.uses(store, asked, o.max_uses), "uses")
    often = uses_all.groupBy("lemma").count().filter(F.col("count") >= o.min_uses)
    enough = kept(often.join(cands_all.select("lemma").distinct(), "lemma").select("lemma"), "enough")
    frames = kept(tokens.frame_fraction(store, enough).select("lemma", "frame_frac"), "frames")
    rising = kept(rising.join(enough, "lemma").join(frames, "lemma", "left"), "prepared")
    pool = pool.join(rising, "lemma", "left_anti").join(enough, "lemma")
    pool = thesaurus.word_ic(pool, t, "lemma").join(frames, "lemma", "left")
    known = F.col("lemma").isin([tx.lemma_of(w.lower()) for w in curated_words])
    pool = kept(pool.withColumn("known", known).withColumn("frame_frac", F.coalesce("frame_frac", F.lit(0.0))), "chronic")

    names = tokens.names_of(sents, stopwords).filter(tx.is_name(F.col("mid"), F.col("capped"))).select("lemma")
    listed = spark.createDataFrame([(tx.lemma_of(w.lower()),) for w in proper_nouns], "lemma string")
    barred = kept(names.union(listed).distinct(), "names")
    found = tokens.phrase_matches(sents.select("project", "raw"), "raw", list(phrases))
    said = kept(drift.phrase_entries(found, full_total, o), "phrases")
    shape = (
        "kind string, reason string, lemma string, count long, projects long, rate double, ratio double, frame_frac double, rarity double, "
        "incongruity double, cluster_delta double, uses long, known boolean, ladder array<struct<word:string,ic:double,clean:long,total:long>>, "
        "demote_to string, judge_note string, lane int, place double"
    )
    empty = spark.createDataFrame([], shape)
    blank = lambda **c: [c.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in empty.schema]
    phrase_rows = said.select(*blank(kind=F.lit("phrase"), reason=F.lit("phrase"), lemma=F.col("phrase"), count=F.col("count"), projects=F.col("projects"), rate=F.col("rate"), known=F.lit(True), ladder=F.array(), lane=F.lit(4), place=-F.col("count")))

    routes = kept(drift.cascade(pool, o), "routes")
    # the marked route looks at what no route took; its gate is a score that needs vectors
    rare = pool.join(routes, "lemma", "left_anti").filter((F.octet_length("lemma") >= o.rarity_bytes) & (F.col("word_ic") >= o.rarity_floor))
    rare = kept(rare if o.marked_top > 0 else rare.limit(0), "rare")
    if rising.isEmpty() and routes.isEmpty() and rare.isEmpty():  # phrases only, and the vector table is not read
        body = phrase_rows
    else:
        sampled = kept(tokens.sample(store, o.max_uses).select("turn_id", "sent_no", "tokens"), "sample")
        drawn = sampled.select(F.lit("").alias("lemma"), F.row_number().over(Window.orderBy("turn_id", "sent_no")).alias("use_no"), "tokens")
        mine = lambda df: df.join(jobs, "lemma", "left_semi")
        jobs = kept(rising.select("lemma").union(routes.select("lemma")).union(rare.select("lemma")), "jobs")
        uses, cands = kept(mine(uses_all), "job-uses"), mine(cands_all)
        vocabulary = vectors.vocabulary(uses, cands).union(drawn.select(F.explode("tokens"))).distinct()
        table = kept(load_vectors(vocabulary), "vectors")
        odd = vectors.incongruity(mine(uses).join(rare.select("lemma"), "lemma", "left_semi"), table)
        odd = kept(odd.filter(F.col("incongruity") > o.incongruity_floor), "marked")
        subs = kept(vectors.ranked(vectors.substitutes(uses, cands, table, o.threshold)), "substitutes")
        over_all = vectors.spread(vectors.use_bags(drawn), table, []).select(F.col("clustered").alias("base"))
        spread = vectors.spread(vectors.use_bags(uses), table, ["lemma"]).crossJoin(F.broadcast(over_all))
        spread = kept(spread.select("lemma", (F.col("clustered") - F.coalesce("base", F.lit(0.0))).alias("cluster_delta"), "uses"), "spread")
        chosen = rising.select(*blank(kind=F.lit("riser"), reason=F.lit("riser"), lemma=F.col("lemma"), count=F.col("recent"), projects=F.col("projects"), rate=F.col("recent_rate"), ratio=F.col("ratio"), frame_frac=F.col("frame_frac"), known=F.lit(False), lane=F.lit(1), place=-F.col("score")))
        steady = lambda df, reason, lane, place, incong: df.select(*blank(kind=F.lit("chronic"), reason=reason, lemma=F.col("lemma"), count=F.col("full"), projects=F.col("projects"), rate=F.col("rate"), frame_frac=F.col("frame_frac"), rarity=F.when(reason.isin("rarity", "marked"), F.col("word_ic")), incongruity=incong, known=F.col("known"), lane=F.lit(lane), place=-place))
        chosen = chosen.unionByName(steady(routes, F.col("route"), 2, F.col("rate"), F.lit(None)))
        chosen = chosen.unionByName(steady(odd.join(rare, "lemma"), F.lit("marked"), 3, F.col("incongruity"), F.col("incongruity")))
        # a curated word is marked as known only by the known route
        chosen = chosen.withColumn("known", F.col("reason") == "known").drop("ladder", "cluster_delta", "uses", "demote_to", "judge_note")
        chosen = kept(chosen, "chosen")
        rungs = kept(_gate(subs, chosen, o), "rungs")
        selves = cands_all.groupBy("lemma").agg(F.first("self_ic").alias("self_ic"))
        rung = lambda ic, own, rank, word, clean, total: F.struct(ic.alias("ic"), F.lit(own).alias("is_self"), rank.alias("rank"), word.alias("word"), clean.alias("clean"), total.alias("total")).alias("s")
        steps = rungs.select("lemma", rung(F.col("ic"), 0, F.col("rank"), F.col("word"), F.col("clean"), F.col("total")))
        no = F.lit(None).cast("long")
        own = rungs.select("lemma").distinct().join(selves, "lemma").select("lemma", rung(F.col("self_ic"), 1, F.lit(0), F.col("lemma"), no, no))
        ordered = F.transform(F.array_sort(F.collect_list("s")), lambda s: F.struct(s["word"].alias("word"), s["ic"].alias("ic"), s["clean"].alias("clean"), s["total"].alias("total")))
        assembled = steps.unionByName(own).groupBy("lemma").agg(ordered.alias("ladder"))
        live = chosen.join(assembled, "lemma").join(spread, "lemma", "left").join(barred, "lemma", "left_anti")
        if judgments is None:
            live = live.withColumns({"demote_to": F.lit(None).cast("string"), "judge_note": F.lit(None).cast("string")})
        else:
            said_of = judgments.select(F.col("word").alias("lemma"), "role", "demote_to", F.col("note").alias("judge_note"))
            live = live.join(said_of, "lemma", "left").filter(F.coalesce("role", F.lit("")) != "term_of_art").drop("role")
        budget = F.when(F.col("reason").isin("frame", "rarity"), "spread").otherwise(F.col("reason"))
        live = live.withColumn("budget", budget)
        most = F.when(F.col("budget") == "riser", 1 << 30).when(F.col("budget") == "marked", o.marked_top).otherwise(o.chronic_top)
        if judge is not None:
            told = uses.groupBy("lemma").agg(F.array_sort(F.collect_list(F.struct("use_no", "tokens"))).alias("told"))
            offered = thesaurus.demote_options(F.transform("ladder", lambda s: s["word"]), F.col("lemma"))
            asking = live.drop("demote_to", "judge_note").join(told, "lemma", "left").withColumns({"options": offered, "samples": F.transform("told", lambda x: x["tokens"])})
            live, _ = gate.within_budget(kept(asking.drop("told"), "candidates-of-budgets"), judge, most)
            live = live.withColumnRenamed("note", "judge_note")
        used = F.row_number().over(Window.partitionBy("budget").orderBy("place", "lemma"))
        live = live.withColumn("used", used).filter(F.col("used") <= most)
        body = live.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in empty.schema]).unionByName(phrase_rows)
    body = cut(body, "body")
    line = drift.series(drift.trend(toks, body.filter("kind <> 'phrase'").select("lemma"), now, o.spark_weeks))
    line = cut(line.select("lemma", F.transform("rates", lambda r: F.coalesce(r, F.lit(-1.0))).alias("spark")), "lines")
    discard(*made)  # the entries and their series are all that is read from here on
    out = body.join(line, "lemma", "left").withColumn("spark", F.coalesce("spark", F.array().cast("array<double>")))
    out = out.withColumn("words", F.transform("ladder", lambda s: s["word"]))
    return out.withColumn("entry_ord", F.row_number().over(Window.orderBy("lane", "place", "lemma"))).drop("lane", "place")


def audit(turns: DataFrame, curated_words: Sequence[str], phrases: Sequence[str], entries: DataFrame, stopwords: list[str], log: DataFrame | None = None, proper_nouns: Sequence[str] = (), counts: DataFrame | None = None) -> DataFrame:
    """Every curated entry with its uses, its place in the report and why it is not in it. ``counts`` are the turns'
    ``tokens.lemma_table`` where that is written already."""
    spark = turns.sparkSession
    words = list(dict.fromkeys(tx.lemma_of(w.lower()) for w in curated_words))
    curated = spark.createDataFrame([(w, False) for w in words] + [(p, True) for p in dict.fromkeys(phrases)], "term string, is_phrase boolean")
    if counts is None:
        counts = cut(tokens.lemma_table(turns, stopwords), "audit-words")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("full_total"))
    own = counts.filter(F.col("lemma").isin(words))
    said = tokens.audit_phrases(turns, list(phrases)).groupBy(F.col("phrase").alias("term"), "project").agg(F.count("*").alias("n"))
    uses = own.filter("n > 0").select(F.col("lemma").alias("term"), "project", "n").unionByName(said)
    names = own.groupBy("lemma").agg(F.sum("mid").alias("mid"), F.sum("capped").alias("capped")).filter(tx.is_name(F.col("mid"), F.col("capped")))
    names = names.select("lemma").union(spark.createDataFrame([(tx.lemma_of(w.lower()),) for w in proper_nouns], "lemma string")).distinct()
    terms = spark.createDataFrame([], "word string") if log is None else verdicts.latest(log).filter("role = 'term_of_art'").select("word")
    ranks = entries.select(F.lower("lemma").alias("term"), F.col("entry_ord").alias("rank"))
    return au.run(curated, uses, total, ranks, names, terms)
