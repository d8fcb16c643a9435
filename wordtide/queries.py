"""One query per operator over the driver's tables, each over whole tables, with its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import display as dp
from .functions import text as tx
from .operators import audit as au
from .operators import drift, ledger, report, swaps, thesaurus, tokens, vectors, verdicts
from .options import REPORT, SCAN
from .plans import commands
from .sources import adapters as ad
from .sources import files, transcripts
from .sources import thesaurus as thesaurus_files
from .sources.adapters import NOW, table, turns
from .work import cut, discard, place, rename_files

Query = Callable[[SparkSession, str], DataFrame]
STOP = tx.stopword_set()
PHRASES = ["of the", "in the", "of the and", "by the", "is the", "that the"]
CURATED = ["onea", "thtion", "heeds", "andst", "zzyx"]
SWAPS = {"the": "that", "des": "les", "die": "jene"}
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


# ---- SQL fragments

_QUOTED = ", ".join("'" + w.replace("'", "''") + "'" for w in STOP)


def _clean(x: str) -> str:
    for p in (r"(?s)```.*?```", r"`[^`\n]*`", r"https?://\S+", r"[~./]?(?:[\w.-]+/)+[\w.-]*"):
        x = f"regexp_replace({x}, '{p}', ' ', 'g')"
    return x


def _words(x: str) -> str:
    return rf"list_filter(list_transform(regexp_extract_all({x}, '[\p{{L}}''-]+'), lambda w: trim(w, '-''')), lambda w: w <> '')"


def _lemma(x: str) -> str:
    b = f"regexp_replace(regexp_replace({x}, '''s$', ''), '''$', '')"
    return (
        f"CASE WHEN strlen({b}) > 4 AND {b} LIKE '%ies' THEN left({b}, length({b}) - 3) || 'y' "
        f"WHEN strlen({b}) > 4 AND regexp_matches({b}, '(sses|shes|ches|xes)$') THEN left({b}, length({b}) - 2) "
        f"WHEN strlen({b}) > 3 AND {b} LIKE '%s' AND NOT regexp_matches({b}, '(ss|us|is)$') THEN left({b}, length({b}) - 1) ELSE {b} END"
    )


def _tokens(x: str) -> str:
    return f"list_filter(list_transform({_words(f'lower({x})')}, lambda w: {_lemma('w')}), lambda w: strlen(w) >= 3 AND w NOT IN ({_QUOTED}))"


_TURNS = """turns AS (
  SELECT doc_id AS turn_id, source AS project, coalesce(text, '') AS text,
         TIMESTAMP '2024-03-04 00:00:00' - to_days(CAST(doc_id % 63 AS INT)) - to_hours(CAST(doc_id % 24 AS INT)) AS ts
  FROM documents)"""
_SENTS = f"""cleaned AS (SELECT *, list_filter(string_split_regex({_clean("text")}, '[.!?;\\n]'), lambda s: s <> '') AS parts FROM turns),
cut AS (SELECT turn_id, project, ts, unnest(parts) AS cased, unnest(range(len(parts))) AS sent_no FROM cleaned),
sents AS (SELECT *, trim(lower(cased), ' ') AS raw FROM (SELECT *, {_tokens("cased")} AS tokens FROM cut) WHERE len(tokens) > 0)"""
_BASE = f"WITH {_TURNS}, {_SENTS}"
_TOK = f"{_BASE}, tok AS (SELECT turn_id, project, ts, unnest(tokens) AS lemma FROM sents)"
_RECENT = "ts >= TIMESTAMP '2024-02-26 00:00:00'"
_BASELINE = f"(ts >= TIMESTAMP '2024-02-12 00:00:00' AND NOT {_RECENT})"
_COUNTS = f"""{_TOK}, lp AS (
  SELECT lemma, project, count(*) FILTER (WHERE {_RECENT}) AS recent, count(*) FILTER (WHERE {_BASELINE}) AS baseline, count(*) AS "full" FROM tok GROUP BY ALL
), lc AS (
  SELECT lemma, sum(recent)::BIGINT AS recent, sum(baseline)::BIGINT AS baseline, sum("full")::BIGINT AS "full", max(recent) AS top_recent,
         count(*) FILTER (WHERE recent > 0) AS recent_projects, count(*) AS projects FROM lp GROUP BY lemma
), tt AS (SELECT sum(recent)::BIGINT AS rt, sum(baseline)::BIGINT AS bt, sum("full")::BIGINT AS ft FROM lc)"""
_RISE = f"""{_COUNTS}, sc AS (
  SELECT *, ((recent + 0.5::DOUBLE) / rt * 1000) / ((baseline + 0.5::DOUBLE) / bt * 1000) AS ratio, recent - top_recent AS outside FROM lc, tt WHERE rt > 0 AND bt > 0
)"""
_STORE = f"""{_BASE}, store AS (
  SELECT turn_id, sent_no, tokens, raw FROM (SELECT *, row_number() OVER (PARTITION BY tokens ORDER BY turn_id, sent_no) AS r FROM sents WHERE len(tokens) >= 5) WHERE r = 1
), idx AS (SELECT unnest(list_distinct(tokens)) AS lemma, turn_id, sent_no, tokens, raw FROM store)"""


def _common(spark: SparkSession, d: str) -> DataFrame:
    return tokens.tokens(turns(spark, d), STOP)


def _lemmas(toks: DataFrame) -> DataFrame:
    return drift.lemma_counts(drift.lemma_project_counts(toks, NOW, REPORT))


def _sents(spark: SparkSession, d: str) -> DataFrame:
    """Sentences, written once for the branches of a query."""
    return cut(tokens.sentences(turns(spark, d), STOP).drop("cased"), "query-sentences")


def _top(toks: DataFrame, n: int) -> DataFrame:
    """The n most used lemmas, with their rank r."""
    counted = toks.groupBy("lemma").agg(F.count("*").alias("n"))
    best = counted.orderBy(F.desc("n"), "lemma").limit(n)
    return best.withColumn("r", F.row_number().over(Window.orderBy(F.desc("n"), "lemma")))


def _rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


# ---- text


@_query(f"""SELECT page_id, {_clean("concat('see ', url, ' or ', substr(url, 8), ' uses `', url, '` end. ', html)")} AS cleaned FROM pages""")
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    prose = F.concat(F.lit("see "), "url", F.lit(" or "), F.expr("substr(url, 8)"), F.lit(" uses `"), "url", F.lit("` end. "), "html")
    return table(spark, d, "pages").select("page_id", tx.clean(prose).alias("cleaned"))


@_query(f"SELECT doc_id, array_to_string({_words('text')}, ' ') AS words FROM documents")
def words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.array_join(tx.words(F.col("text")), " ").alias("words"))


@_query(f"{_BASE} SELECT turn_id, sent_no::INT AS sent_no, array_to_string(tokens, ' ') AS tokens, raw FROM sents")
def sentences(spark: SparkSession, d: str) -> DataFrame:
    s = tokens.sentences(turns(spark, d), STOP)
    return s.select("turn_id", "sent_no", F.array_join("tokens", " ").alias("tokens"), "raw")


@_query(f"{_TOK} SELECT lemma, project, count(*) AS n FROM tok GROUP BY ALL")
def token_counts(spark: SparkSession, d: str) -> DataFrame:
    return _common(spark, d).groupBy("lemma", "project").agg(F.count("*").alias("n"))


@_query(
    f"""{_BASE}, wl AS (SELECT unnest(list_slice(w, 2, len(w))) AS word FROM (SELECT {_words("cased")} AS w FROM cut)),
w2 AS (SELECT {_lemma("lower(word)")} AS lemma, upper(left(word, 1)) = left(word, 1) AND lower(left(word, 1)) <> left(word, 1) AND upper(word) <> word AS capped FROM wl),
c AS (SELECT lemma, count(*) AS mid, count(*) FILTER (WHERE capped) AS capped FROM w2 WHERE strlen(lemma) >= 3 AND lemma NOT IN ({_QUOTED}) GROUP BY lemma)
SELECT lemma, mid, capped, mid >= 20 AND capped / mid >= 0.5 AS is_name FROM c"""
)
def name_counts(spark: SparkSession, d: str) -> DataFrame:
    c = tokens.name_counts(turns(spark, d), STOP)
    return c.withColumn("is_name", tx.is_name(F.col("mid"), F.col("capped")))


@_query(
    r"""WITH w AS (SELECT DISTINCT lower(n_name) AS w FROM nation UNION SELECT lower(r_name) FROM region)
SELECT w AS word, CASE WHEN regexp_matches(w, '(s|x|z|sh|ch)$') THEN w || 'es' WHEN regexp_matches(w, '[^aeiou]y$') THEN left(w, length(w) - 1) || 'ies' ELSE w || 's' END AS plural,
       left(sha256(array_to_string(list_sort([w, 'zz', 'aa']), chr(0))), 16) AS hash FROM w"""
)
def inflections(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "nation").select(F.lower("n_name").alias("word")).union(table(spark, d, "region").select(F.lower("r_name"))).distinct()
    rungs = F.array("word", F.lit("zz"), F.lit("aa"))
    return w.select("word", dp.pluralize(F.col("word")).alias("plural"), dp.ladder_hash(rungs).alias("hash"))


# ---- windows and drift


@_query(
    f"""{_COUNTS} SELECT rt AS recent_total, bt AS baseline_total, ft AS full_total, (SELECT count(*) FROM turns WHERE {_RECENT}) AS recent_turns,
(SELECT count(*) FROM turns WHERE {_BASELINE}) AS baseline_turns, (SELECT count(*) FROM turns) AS full_turns FROM tt"""
)
def window_totals(spark: SparkSession, d: str) -> DataFrame:
    return drift.totals(_lemmas(_common(spark, d))).crossJoin(drift.turn_totals(turns(spark, d), NOW))


@_query(
    f"""{_RISE} SELECT lemma, recent, outside, recent_projects AS projects, round(recent / rt * 1000, 6) AS recent_rate, round(baseline / bt * 1000, 6) AS baseline_rate,
round(ratio, 6) AS ratio, round(outside * ln(ratio), 6) AS score FROM sc WHERE recent >= 5 AND ratio > 1 AND ratio >= 2 AND outside > 0 ORDER BY outside * ln(ratio) DESC, lemma LIMIT 25"""
)
def rising_lemmas(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(commands.scan(turns(spark, d), NOW, STOP, SCAN), "recent_rate", "baseline_rate", "ratio", "score")


_TREND = f"""{_TOK}, asked AS (SELECT lemma FROM tok GROUP BY lemma ORDER BY count(*) DESC, lemma LIMIT 20),
wk AS (SELECT lemma, CAST(7 - trunc((epoch_us(TIMESTAMP '2024-03-04') - epoch_us(ts)) / 604800000000.0) AS INT) AS bucket FROM tok),
cn AS (SELECT lemma, bucket, count(*) AS n FROM wk WHERE bucket BETWEEN 0 AND 7 GROUP BY ALL), ev AS (SELECT bucket, sum(n)::BIGINT AS tokens FROM cn GROUP BY bucket),
tr AS (SELECT a.lemma, b.bucket::INT AS bucket, coalesce(ev.tokens, 0) AS tokens, coalesce(cn.n, 0) AS n, CASE WHEN ev.tokens > 0 THEN coalesce(cn.n, 0) / ev.tokens * 1000 END AS rate
  FROM asked a CROSS JOIN (SELECT unnest(range(8)) AS bucket) b LEFT JOIN ev USING (bucket) LEFT JOIN cn ON cn.lemma = a.lemma AND cn.bucket = b.bucket)"""


@_query(f"{_TREND} SELECT lemma, bucket, tokens, n, round(rate, 6) AS rate FROM tr")
def weekly_trend(spark: SparkSession, d: str) -> DataFrame:
    toks = tokens.of_sentences(_sents(spark, d))
    return _rounded(drift.trend(toks, _top(toks, 20), NOW), "rate")


@_query(
    f"""{_TREND}, s AS (SELECT lemma, list(rate ORDER BY bucket) AS r, min(rate) AS lo, max(rate) AS hi, arg_min(rate, bucket) AS f, arg_max(rate, bucket) AS l FROM tr GROUP BY lemma)
SELECT lemma, array_to_string(list_transform(r, lambda v: CASE WHEN v IS NULL THEN ' ' WHEN hi = lo THEN CASE WHEN hi = 0 THEN '▁' ELSE '▄' END
  ELSE ('▁▂▃▄▅▆▇█')[CAST(floor((v - lo) / (hi - lo) * 7 + 0.5) AS INT) + 1] END), '') AS line,
  CASE WHEN l > f THEN '↑' WHEN l < f THEN '↓' ELSE '→' END AS arrow, round(f, 6) AS first_rate, round(l, 6) AS last_rate FROM s"""
)
def sparkline(spark: SparkSession, d: str) -> DataFrame:
    toks = tokens.of_sentences(_sents(spark, d))
    t = cut(drift.trend(toks, _top(toks, 20), NOW), "trend")
    out = drift.series(t).join(drift.first_last(t), "lemma")
    return _rounded(out.select("lemma", dp.sparkline(F.col("rates")).alias("line"), dp.trend_arrow(F.col("rates")).alias("arrow"), "first_rate", "last_rate"), "first_rate", "last_rate")


# ---- sentence store


@_query(f"{_STORE} SELECT turn_id, sent_no::INT AS sent_no, array_to_string(tokens, ' ') AS tokens FROM store")
def sentence_dedup(spark: SparkSession, d: str) -> DataFrame:
    return tokens.stored(tokens.sentences(turns(spark, d), STOP)).select("turn_id", "sent_no", F.array_join("tokens", " ").alias("tokens"))


_USES = f"""{_STORE}, asked AS (SELECT lemma FROM (SELECT unnest(tokens) AS lemma FROM sents) GROUP BY lemma ORDER BY count(*) DESC, lemma LIMIT 40),
ranked AS (SELECT i.*, row_number() OVER (PARTITION BY lemma ORDER BY turn_id, sent_no) - 1 AS r, count(*) OVER (PARTITION BY lemma) AS n FROM idx i SEMI JOIN asked USING (lemma)),
uses AS (SELECT lemma, turn_id, sent_no, tokens, row_number() OVER (PARTITION BY lemma ORDER BY r) AS use_no FROM ranked
  WHERE n <= 50 OR (ceil(r * 50 / n) < 50 AND floor(ceil(r * 50 / n) * n / 50) = r))"""


@_query(f"{_USES} SELECT lemma, turn_id, sent_no::INT AS sent_no, use_no::INT AS use_no FROM uses")
def uses_sample(spark: SparkSession, d: str) -> DataFrame:
    return _uses(_sents(spark, d)).select("lemma", "turn_id", "sent_no", "use_no")


def _uses(sents: DataFrame) -> DataFrame:
    return tokens.uses(tokens.stored(sents), _top(tokens.of_sentences(sents), 40), 50)


@_query(
    f"""{_STORE}, g AS (SELECT turn_id, sent_no, row_number() OVER (ORDER BY turn_id, sent_no) - 1 AS r, count(*) OVER () AS n FROM store)
SELECT turn_id, sent_no::INT AS sent_no FROM g WHERE n <= 50 OR (ceil(r * 50 / n) < 50 AND floor(ceil(r * 50 / n) * n / 50) = r)"""
)
def corpus_sample(spark: SparkSession, d: str) -> DataFrame:
    return tokens.sample(tokens.stored(tokens.sentences(turns(spark, d), STOP)), 50).select("turn_id", "sent_no")


_FRAMES = f"""{_STORE}, ww AS (SELECT lemma, turn_id, sent_no, {_words("raw")} AS w FROM idx),
fr AS (SELECT lemma, len(list_filter(range(2, len(w)), lambda i: w[i + 1] = 'of' AND w[i - 1] IN ({", ".join(f"'{x}'" for x in tokens.DETERMINERS.split())}) AND {_lemma("w[i]")} = lemma)) > 0 AS framed FROM ww),
ff AS (SELECT lemma, count(*) AS uses, count(*) FILTER (WHERE framed) AS framed FROM fr GROUP BY lemma)"""


@_query(f"{_FRAMES} SELECT lemma, uses, framed, round(framed / uses, 6) AS frame_frac FROM ff")
def frame_fraction(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(tokens.frame_fraction(tokens.stored(tokens.sentences(turns(spark, d), STOP))), "frame_frac")


def _sql_phrases(source: str, text: str) -> str:
    own = sorted(tokens.normal_phrases(PHRASES), key=lambda p: (-p.count(" "), p))
    # words carry a bar on both sides, so that a match always ends at a word's end
    spread = rf"regexp_extract_all('|' || array_to_string({_words(f'lower({text})')}, '||') || '|', '({'|'.join(chr(92) + '|' + p.replace(' ', chr(92) + '|' + chr(92) + '|') + chr(92) + '|' for p in own)})')"
    rows = ", ".join(f"('{p}', '|{p.replace(' ', '||')}|')" for p in own)
    return f"""found AS (SELECT project, unnest({spread}) AS m FROM {source}), ph(phrase, enc) AS (VALUES {rows}),
hits AS (SELECT phrase, project FROM found JOIN ph ON starts_with(m, enc))"""


@_query(f"""{_BASE}, {_sql_phrases("sents", "raw")} SELECT phrase, count(*) AS "count", count(DISTINCT project) AS projects FROM hits GROUP BY phrase""")
def phrase_counts(spark: SparkSession, d: str) -> DataFrame:
    found = tokens.report_phrases(turns(spark, d), PHRASES, STOP)
    return found.groupBy("phrase").agg(F.count("*").alias("count"), F.count_distinct("project").alias("projects"))


@_query(
    f"""{_TOK}, {_sql_phrases("sents", "raw")}, t AS (SELECT count(*) AS n FROM tok)
SELECT phrase, count(*) AS "count", count(DISTINCT project) AS projects, round(count(*) / max(n) * 1000, 6) AS rate FROM hits, t GROUP BY phrase HAVING count(*) >= 5 ORDER BY count(*) DESC, phrase LIMIT 4"""
)
def phrase_entries(spark: SparkSession, d: str) -> DataFrame:
    sents = _sents(spark, d)
    found = tokens.phrase_matches(sents.select("project", "raw"), "raw", PHRASES)
    total = tokens.of_sentences(sents).agg(F.count("*").alias("full_total"))
    return _rounded(drift.phrase_entries(found, total), "rate")


# ---- routes


_POOL = f"""{_COUNTS}, pool AS (SELECT lemma, "full", projects, "full" / ft * 1000 AS rate FROM lc, tt WHERE "full" / ft * 1000 >= 0.2 AND projects >= 3)"""


@_query(f"""{_POOL} SELECT lemma, "full", projects, round(rate, 6) AS rate FROM pool""")
def chronic_pool(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(drift.chronic_pool(_lemmas(_common(spark, d)), None), "rate")


_WORDIC = f"""{_TOK}, fq AS (SELECT lemma, count(*) AS n FROM tok GROUP BY lemma), al AS (SELECT count(*) AS t FROM tok)"""


@_query(f"{_WORDIC} SELECT lemma, n, round(-ln((n + 0.5::DOUBLE) / t), 6) AS word_ic FROM fq, al")
def wordic(spark: SparkSession, d: str) -> DataFrame:
    counts = _common(spark, d).groupBy("lemma").agg(F.count("*").alias("n"))
    t = thesaurus.Thesaurus(*[None] * 5, counts)
    return _rounded(thesaurus.word_ic(counts, t, "lemma").select("lemma", "n", "word_ic"), "word_ic")


_CASCADE = f"""{_FRAMES}, tok AS (SELECT turn_id, project, ts, unnest(tokens) AS lemma FROM sents),
lc AS (SELECT lemma, count(*) AS "full", count(DISTINCT project) AS projects FROM tok GROUP BY lemma), tt AS (SELECT count(*) AS ft FROM tok),
pl AS (SELECT lemma, "full" / ft * 1000 AS rate, lemma LIKE 'th%' AS known, -ln(("full" + 0.5::DOUBLE) / ft) AS ic, coalesce(framed / uses, 0) AS frame_frac
  FROM lc CROSS JOIN tt LEFT JOIN ff USING (lemma) WHERE "full" / ft * 1000 >= 0.2 AND projects >= 3),
c1 AS (SELECT *, CASE WHEN known AND row_number() OVER (PARTITION BY known ORDER BY rate DESC, lemma) <= 4 THEN 'known' END AS route FROM pl),
c2 AS (SELECT * REPLACE (coalesce(route, CASE WHEN frame_frac >= 0.25 AND row_number() OVER (PARTITION BY route IS NULL AND frame_frac >= 0.25 ORDER BY rate DESC, lemma) <= 4 THEN 'frame' END) AS route) FROM c1),
c3 AS (SELECT * REPLACE (coalesce(route, CASE WHEN strlen(lemma) >= 4 AND ic >= 6 AND row_number() OVER (PARTITION BY route IS NULL AND strlen(lemma) >= 4 AND ic >= 6 ORDER BY rate DESC, lemma) <= 4 THEN 'rarity' END) AS route) FROM c2)"""


def _cascade(spark: SparkSession, d: str) -> DataFrame:
    sents = _sents(spark, d)
    lemmas = cut(_lemmas(tokens.of_sentences(sents)), "lemmas")
    pool = cut(drift.chronic_pool(lemmas, None), "pool")
    freq = lemmas.select("lemma", F.col("full").alias("n"))
    frames = tokens.frame_fraction(tokens.stored(sents), pool).select("lemma", "frame_frac")
    pool = thesaurus.word_ic(pool, thesaurus.Thesaurus(*[None] * 5, freq), "lemma").join(frames, "lemma", "left")
    pool = pool.withColumn("known", F.col("lemma").startswith("th")).withColumn("frame_frac", F.coalesce("frame_frac", F.lit(0.0)))
    return drift.cascade(pool, REPORT.but(rarity_floor=6.0))


@_query(f"{_CASCADE} SELECT lemma, route, round(rate, 6) AS rate FROM c3 WHERE route IS NOT NULL")
def route_cascade(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_cascade(spark, d).select("lemma", "route", "rate"), "rate")


@_query(
    f"""{_CASCADE}, e AS (SELECT lemma, known, row_number() OVER (ORDER BY rate DESC, lemma) AS entry_ord, CASE WHEN route = 'rarity' THEN 'riser' ELSE 'chronic' END AS kind FROM c3 WHERE route IS NOT NULL),
l AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY CASE WHEN kind = 'chronic' AND known THEN 0 ELSE 1 END, entry_ord) AS place FROM e),
n AS (SELECT count(*) FILTER (WHERE kind = 'chronic') AS c, count(*) FILTER (WHERE kind = 'riser') AS r FROM l), m AS (SELECT *, least(c, 3) AS fc, least(r, 5 - least(c, 3)) AS fr FROM n),
g AS (SELECT *, CASE WHEN kind = 'chronic' AND place <= fc THEN 1 WHEN kind = 'riser' AND place <= fr THEN 2 WHEN kind = 'chronic' AND place > 3 AND place <= 3 + least(c - fc, 5 - fc - fr) THEN 3 END AS grp FROM l, m)
SELECT lemma, kind, row_number() OVER (ORDER BY grp, place)::INT AS shown_ord FROM g WHERE grp IS NOT NULL"""
)
def report_selection(spark: SparkSession, d: str) -> DataFrame:
    own = _cascade(spark, d).withColumn("entry_ord", F.row_number().over(Window.orderBy(F.desc("rate"), "lemma")))
    kind = F.when(F.col("route") == "rarity", "riser").otherwise("chronic")
    entries = own.select("entry_ord", kind.alias("kind"), "lemma", "known", F.array(F.lit("below"), "lemma").alias("words"))
    return report.hook_entries(entries).select("lemma", "kind", "shown_ord")


# ---- thesaurus

_LADDER = """WITH c AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1), al AS (SELECT count(*) AS a FROM customer),
nat AS (SELECT n_nationkey AS k, replace(lower(n_name), '_', ' ') AS w, n_regionkey AS rk, c.n FROM nation LEFT JOIN c ON c.k = n_nationkey),
reg AS (SELECT r_regionkey AS rk, replace(lower(r_name), '_', ' ') AS w, (SELECT sum(n) FROM nat WHERE nat.rk = r_regionkey) AS n FROM region),
fq AS (SELECT translate(lower(s_name), ' ', '_') AS w, coalesce(n, 0) AS n FROM supplier LEFT JOIN c ON c.k = s_nationkey),
ft AS (SELECT sum(n) AS t FROM fq),
sup AS (SELECT translate(lower(s_name), ' ', '_') AS lemma, replace(translate(lower(s_name), ' ', '_'), '_', ' ') AS w, s_nationkey AS k FROM supplier),
rungs AS (
  SELECT lemma, w AS from_w, lemma AS word, 'self' AS source, 0 AS o, NULL::DOUBLE AS ic0 FROM sup
  UNION ALL SELECT lemma, w, w, 'synonym', 1, NULL FROM sup WHERE w <> lemma
  UNION ALL SELECT lemma, w, w || ' co', 'synonym', 2, NULL FROM sup
  UNION ALL SELECT lemma, sup.w, nat.w, 'hypernym', 3, -ln(nat.n / a) FROM sup JOIN nat USING (k), al
  UNION ALL SELECT lemma, sup.w, reg.w, 'hypernym2', 4, -ln(reg.n / a) FROM sup JOIN nat USING (k) JOIN reg USING (rk), al),
wi AS (SELECT rungs.*, -ln((coalesce(fq.n, 0) + 0.5::DOUBLE) / t) AS word_ic FROM rungs LEFT JOIN fq ON fq.w = translate(lower(word), ' ', '_'), ft),
lad AS (SELECT *, coalesce(ic0, word_ic) AS ic, row_number() OVER (PARTITION BY lemma ORDER BY coalesce(ic0, word_ic), word_ic, o) AS rung_ord FROM wi)"""


def _ladders(spark: SparkSession, d: str) -> DataFrame:
    t = ad.taxonomy(spark, d)
    asked = t.sense_index.join(t.synset.filter("key LIKE 's%'").select("key"), "key").select("lemma")
    return thesaurus.ladders(t, asked)


@_query(f"{_LADDER} SELECT lemma, word, source, round(ic, 6) AS ic, round(word_ic, 6) AS word_ic, rung_ord::INT AS rung_ord FROM lad")
def ladder(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_ladders(spark, d).select("lemma", "word", "source", "ic", "word_ic", "rung_ord"), "ic", "word_ic")


@_query(
    f"""{_LADDER}, s AS (SELECT lemma, ic AS self_ic FROM lad WHERE source = 'self')
SELECT lemma, word, round(ic, 6) AS ic, round(self_ic, 6) AS self_ic FROM lad JOIN s USING (lemma) WHERE source <> 'self' AND NOT list_contains(string_split_regex(word, '\\s+'), lemma)"""
)
def ladder_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(thesaurus.candidates(_ladders(spark, d)).select("lemma", "word", "ic", "self_ic"), "ic", "self_ic")


@_query(
    f"""{_LADDER}, w AS (SELECT lemma, list(word ORDER BY rung_ord) AS ws FROM lad GROUP BY lemma),
t AS (SELECT lemma, list_slice(ws, greatest(list_position(ws, lemma) - 4, 1), list_position(ws, lemma)) AS ws FROM w)
SELECT lemma, array_to_string(ws, ' < ') AS shown, array_to_string(list_filter(ws, lambda x: x <> lemma), ' < ') AS options FROM t"""
)
def demote_window(spark: SparkSession, d: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("rung_ord", "word")))
    w = _ladders(spark, d).groupBy("lemma").agg(F.transform(ordered, lambda x: x["word"]).alias("ws"))
    show = lambda c: F.array_join(c, " < ")
    return w.select("lemma", show(thesaurus.trimmed(F.col("ws"), F.col("lemma"))).alias("shown"), show(thesaurus.demote_options(F.col("ws"), F.col("lemma"))).alias("options"))


_PARTS = """WITH pt AS (SELECT p_partkey, translate(lower(p_name), ' ', '_') AS lemma, lower(p_brand) AS brand, CASE p_partkey % 3 WHEN 0 THEN 'a' ELSE 'n' END AS pos FROM part),
se AS (SELECT *, row_number() OVER (PARTITION BY lemma, pos ORDER BY p_partkey) - 1 AS sense_ord FROM pt),
fq AS (SELECT brand AS w, count(*) AS n FROM pt GROUP BY brand), ft AS (SELECT sum(n) AS t FROM fq),
rungs AS (SELECT lemma, pos, sense_ord, lemma AS word, 'self' AS source, 0 AS o FROM se
  UNION ALL SELECT lemma, pos, sense_ord, replace(lemma, '_', ' '), 'synonym', 1 FROM se
  UNION ALL SELECT lemma, pos, sense_ord, brand, CASE pos WHEN 'a' THEN 'similar' ELSE 'hypernym' END, 2 FROM se),
fi AS (SELECT * FROM rungs QUALIFY row_number() OVER (PARTITION BY lemma, pos, sense_ord, word ORDER BY o) = 1),
wi AS (SELECT fi.*, -ln((coalesce(fq.n, 0) + 0.5::DOUBLE) / t) AS word_ic FROM fi LEFT JOIN fq ON fq.w = translate(lower(word), ' ', '_'), ft),
lad AS (SELECT *, row_number() OVER (PARTITION BY lemma, pos, sense_ord ORDER BY word_ic, o)::INT AS rung_ord, count(*) OVER (PARTITION BY lemma, pos, sense_ord) AS rungs FROM wi)"""


def _part_ladders(spark: SparkSession, d: str) -> DataFrame:
    """Parts as senses of their name, every third an adjective; brands are hypernyms of nouns and similar to adjectives."""
    part = table(spark, d, "part")
    pos = F.when(F.col("p_partkey") % 3 == 0, "a").otherwise("n")
    own = part.select("p_partkey", F.translate(F.lower("p_name"), " ", "_").alias("w"), F.lower("p_brand").alias("brand"), pos.alias("pos"))
    own = own.withColumn("key", F.concat(F.lit("p"), "p_partkey", "pos")).withColumn("up", F.concat(F.lit("b"), "brand"))
    by = Window.partitionBy("w", "pos").orderBy("p_partkey")
    index = own.select("pos", F.col("w").alias("lemma"), (F.row_number().over(by) - 1).alias("sense_ord"), "key")
    brands = own.select(F.col("up").alias("key"), "brand").distinct()
    synset = own.select("key", "pos", F.lit("").alias("gloss")).unionByName(brands.select("key", F.lit("n").alias("pos"), F.lit("").alias("gloss")))
    words_ = own.select("key", F.lit(0).alias("ord"), F.col("w").alias("word")).unionByName(brands.select("key", F.lit(0).alias("ord"), F.col("brand").alias("word")))
    up = own.select("key", F.lit(0).alias("ord"), F.when(F.col("pos") == "a", "&").otherwise("@").alias("sym"), F.col("up").alias("target"))
    freq = own.groupBy(F.col("brand").alias("lemma")).agg(F.count("*").alias("n"))
    t = thesaurus.Thesaurus(index, synset, words_, up, spark.createDataFrame([], "key string, ic double"), freq)
    return thesaurus.ladders(t, index.select("lemma"))


@_query(f"{_PARTS} SELECT lemma, pos, sense_ord::INT AS sense_ord, word, source, round(word_ic, 6) AS word_ic, rung_ord FROM lad WHERE rungs > 1")
def sense_ladders(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_part_ladders(spark, d).select("lemma", "pos", "sense_ord", "word", "source", "word_ic", "rung_ord"), "word_ic")


@_query(
    f"""{_PARTS}, c AS (SELECT lemma, word, word_ic, row_number() OVER (PARTITION BY lemma, word ORDER BY CASE pos WHEN 'n' THEN 1 ELSE 3 END, sense_ord, rung_ord) AS r FROM lad
  WHERE rungs > 1 AND word <> lemma AND NOT list_contains(string_split_regex(word, '\\s+'), lemma))
SELECT lemma, word, round(word_ic, 6) AS ic FROM c WHERE r = 1"""
)
def sense_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(thesaurus.candidates(_part_ladders(spark, d)).select("lemma", "word", "ic"), "ic")


# ---- vectors

_VECS = """rk AS (SELECT lemma, row_number() OVER (ORDER BY count(*) DESC, lemma) AS r FROM (SELECT unnest(tokens) AS lemma FROM sents) GROUP BY lemma),
vec AS (SELECT lemma AS word, list_transform(embedding, lambda x: (x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])))::FLOAT) AS v FROM rk JOIN embeddings ON vec_id = r - 1)"""


def _unit_sum(keys: str, source: str) -> str:
    """SQL: unit mean as floats of vectors ``v`` by ``keys``."""
    k = f"{keys}, " if keys else ""
    g = f"GROUP BY {keys}" if keys else ""
    return f"""(SELECT {k}list_transform(s, lambda x: (x / sqrt(list_dot_product(s, s)))::FLOAT) AS mean FROM (
  SELECT {k}list(x ORDER BY i) AS s FROM (SELECT {k}i, sum(x) AS x FROM (SELECT {k}unnest(v)::DOUBLE AS x, unnest(range(len(v))) AS i FROM {source}) GROUP BY {k}i) {g}) WHERE list_dot_product(s, s) > 0)"""


def _table(spark: SparkSession, d: str, toks: DataFrame) -> DataFrame:
    return _vectors(spark, d, toks.groupBy("lemma").agg(F.count("*").alias("n")))


def _vectors(spark: SparkSession, d: str, counts: DataFrame) -> DataFrame:
    """The embeddings by rank of the lemmas of ``counts``(lemma, n)."""
    return cut(ad.vectors(spark, d, tokens.ranked(counts)), "query-vectors")


@_query(
    f"""{_STORE}, {_VECS}, b AS (SELECT turn_id, sent_no, unnest(tokens) AS word FROM store), kn AS (SELECT turn_id, sent_no, count(*) AS known FROM b JOIN vec USING (word) GROUP BY ALL),
m AS {_unit_sum("turn_id, sent_no", "(SELECT turn_id, sent_no, v FROM b JOIN vec USING (word))")}
SELECT turn_id, sent_no::INT AS sent_no, coalesce(known, 0)::INT AS known, round(mean[1]::DOUBLE, 4) AS x, round(mean[2]::DOUBLE, 4) AS y FROM store LEFT JOIN kn USING (turn_id, sent_no) LEFT JOIN m USING (turn_id, sent_no)"""
)
def vec_mean(spark: SparkSession, d: str) -> DataFrame:
    sents = cut(tokens.sentences(turns(spark, d), STOP).select("turn_id", "sent_no", "tokens"), "query-sentences")
    table_ = _table(spark, d, sents.select(F.explode("tokens").alias("lemma")))
    store = cut(tokens.stored(sents).select("turn_id", "sent_no", F.col("tokens").alias("words")), "query-store")
    discard(sents)
    m = vectors.means(store, ["turn_id", "sent_no"], table_)
    at = lambda i: F.round(F.get("mean", F.lit(i)).cast("double"), 4)
    return m.select("turn_id", "sent_no", "known", at(0).alias("x"), at(1).alias("y"))


@_query(
    f"""{_USES}, {_VECS}, b AS (SELECT lemma, use_no, unnest(list_filter(tokens, lambda t: t <> lemma)) AS word FROM uses),
m AS {_unit_sum("lemma, use_no", "(SELECT lemma, use_no, v FROM b JOIN vec USING (word))")},
p AS (SELECT a.lemma, avg(list_dot_product(a.mean::DOUBLE[], c.mean::DOUBLE[])) AS clustered FROM m a JOIN m c ON a.lemma = c.lemma AND a.use_no < c.use_no GROUP BY a.lemma)
SELECT lemma, count(*)::INT AS uses, round(coalesce(max(clustered), 0), 4) AS clustered FROM m LEFT JOIN p USING (lemma) GROUP BY lemma"""
)
def use_clustering(spark: SparkSession, d: str) -> DataFrame:
    sents = _sents(spark, d)
    return _rounded(vectors.spread(vectors.use_bags(_uses(sents)), _table(spark, d, tokens.of_sentences(sents)), ["lemma"]), "clustered", places=4)


_SUBS = f"""{_USES}, {_VECS}, cand AS (SELECT a.lemma, c.lemma AS word, c.r AS cand_ord FROM rk a JOIN rk c ON c.r BETWEEN a.r + 1 AND a.r + 5 WHERE a.r <= 40),
b AS (SELECT lemma, use_no, unnest(tokens) AS word FROM uses), bv AS (SELECT b.*, v FROM b JOIN vec USING (word)),
own AS {_unit_sum("lemma, use_no", "(SELECT lemma, use_no, v FROM bv)")},
sw AS {_unit_sum("lemma, use_no, cand", "(SELECT bv.lemma, use_no, cand.word AS cand, v FROM bv JOIN cand ON cand.lemma = bv.lemma WHERE bv.word <> bv.lemma UNION ALL SELECT uses.lemma, use_no, cand.word, vec.v FROM uses JOIN cand USING (lemma) JOIN vec ON vec.word = cand.word)")},
cs AS (SELECT sw.lemma, cand AS word, list_dot_product(own.mean::DOUBLE[], sw.mean::DOUBLE[]) AS cos FROM sw JOIN own USING (lemma, use_no) WHERE cand IN (SELECT word FROM vec))"""


def _cands(toks: DataFrame) -> DataFrame:
    top = cut(_top(toks, 45), "top")
    a, c = top.filter("r <= 40").select("lemma", F.col("r").alias("ra")), top.select(F.col("lemma").alias("word"), F.col("r").alias("cand_ord"))
    near = a.withColumn("cand_ord", F.explode(F.sequence(F.col("ra") + 1, F.col("ra") + 5)))
    return near.join(c, "cand_ord").select("lemma", "word", F.lit(1.0).alias("ic"), "cand_ord")


@_query(f"""{_SUBS} SELECT lemma, word, count(*) FILTER (WHERE cos >= 0.8) AS clean, count(*) AS total, round(avg(cos), 4) AS mean_cos FROM cs GROUP BY lemma, word""")
def substitutes(spark: SparkSession, d: str) -> DataFrame:
    sents = _sents(spark, d)
    toks = tokens.of_sentences(sents)
    s = vectors.substitutes(cut(_uses(sents), "uses"), cut(_cands(toks), "candidates"), _table(spark, d, toks), 0.8)
    return _rounded(s.select("lemma", "word", "clean", "total", "mean_cos"), "mean_cos", places=4)


@_query(
    f"""{_USES}, {_VECS}, b AS (SELECT lemma, unnest(list_filter(tokens, lambda t: t <> lemma)) AS word FROM uses),
m AS {_unit_sum("lemma", "(SELECT lemma, v FROM b JOIN vec USING (word))")}
SELECT m.lemma, round(1 - list_dot_product(v::DOUBLE[], mean::DOUBLE[]), 4) AS incongruity FROM m JOIN vec ON vec.word = m.lemma"""
)
def incongruity(spark: SparkSession, d: str) -> DataFrame:
    sents = _sents(spark, d)
    return _rounded(vectors.incongruity(cut(_uses(sents), "uses"), _table(spark, d, tokens.of_sentences(sents))), "incongruity", places=4)


# ---- logs


_LEDGER = """WITH r AS (SELECT date_trunc('day', ts) AS refresh_at, 'w' || user_id AS lemma, avg(value) AS rate, CASE WHEN user_id % 3 = 0 THEN 'riser' ELSE 'chronic' END AS kind, count(*) % 2 = 0 AS known FROM events GROUP BY ALL),
f AS (SELECT DISTINCT refresh_at FROM r), l AS (SELECT lemma, min(refresh_at) AS first_flagged, arg_min(rate, refresh_at) AS first_rate, max(refresh_at) AS last_seen, arg_max(rate, refresh_at) AS last_rate,
arg_max(kind, refresh_at) AS kind, arg_max(known, refresh_at) AS known, count(DISTINCT refresh_at) AS refreshes FROM r GROUP BY lemma),
i AS (SELECT CASE event_id % 5 WHEN 0 THEN 'stray' ELSE 'w' || user_id END AS lemma, count(*) AS injected FROM events WHERE event_id % 3 = 0 AND user_id % 4 <> 1 GROUP BY ALL),
g AS (SELECT lemma, first_flagged, first_rate, last_seen, last_rate, kind, known, refreshes, (SELECT min(refresh_at) FROM f WHERE refresh_at > last_seen) AS faded_at,
coalesce(injected, 0) AS injected, last_seen < (SELECT max(refresh_at) FROM f) AS faded FROM l LEFT JOIN i USING (lemma))"""


def _ledger(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    keys = [F.date_trunc("day", "ts").cast("timestamp_ntz").alias("refresh_at"), F.concat(F.lit("w"), "user_id").alias("lemma"), F.when(F.col("user_id") % 3 == 0, "riser").otherwise("chronic").alias("kind")]
    rows = e.groupBy(*keys).agg(F.avg("value").alias("rate"), (F.count("*") % 2 == 0).alias("known"))
    lemma = F.when(F.col("event_id") % 5 == 0, "stray").otherwise(F.concat(F.lit("w"), "user_id"))
    shown = e.filter("event_id % 3 = 0 AND user_id % 4 <> 1").select(F.col("ts").alias("at"), lemma.alias("lemma"))
    return ledger.fold(rows, rows.select("refresh_at"), shown)


@_query(f"{_LEDGER} SELECT * REPLACE (round(first_rate, 6) AS first_rate, round(last_rate, 6) AS last_rate) FROM g")
def ledger_fold(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_ledger(spark, d), "first_rate", "last_rate")


@_query(f"{_LEDGER} SELECT lemma, round(last_rate, 6) AS last_rate, refreshes FROM g WHERE NOT faded AND NOT known AND injected = 0 AND kind = 'chronic' AND refreshes >= 2 ORDER BY last_rate DESC, first_flagged, lemma LIMIT 5")
def curation_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(ledger.curation_candidates(_ledger(spark, d)).select("lemma", "last_rate", "refreshes"), "last_rate")


_LOG = """WITH e AS (SELECT event_id AS seq, 'w' || user_id % 50 AS word, 'h' || CAST(json_extract_string(props, '$.k') AS INT) % 3 AS ladder_hash, 'm' AS model, 1 + event_id // 5000 AS schema_version,
CASE event_id % 3 WHEN 0 THEN 'tic' WHEN 1 THEN 'mixed' ELSE 'term_of_art' END AS role, CASE event_id % 4 WHEN 0 THEN '' ELSE 'r' || event_id % 4 END AS demote_to, event_id % 7 <> 0 AS wf,
NOT (event_id % 3 = 2 AND event_id % 4 <> 0) AS sf, ts AS judged FROM events)"""


def _verdict_log(spark: SparkSession, d: str) -> DataFrame:
    e, i = table(spark, d, "events"), F.col("event_id")
    role = F.when(i % 3 == 0, "tic").when(i % 3 == 1, "mixed").otherwise("term_of_art")
    demote = F.when(i % 4 == 0, "").otherwise(F.concat(F.lit("r"), i % 4))
    k = F.get_json_object("props", "$.k").cast("int") % 3
    return e.select(
        i.alias("seq"), F.concat(F.lit("w"), F.col("user_id") % 50).alias("word"), F.concat(F.lit("h"), k).alias("ladder_hash"), F.lit("m").alias("model"),
        (1 + F.expr("event_id div 5000")).alias("schema_version"), role.alias("role"), demote.alias("demote_to"), F.lit("").alias("note"),
        (i % 7 != 0).alias("well_formed"), verdicts.safe(role, demote).alias("safe"), F.col("ts").alias("at"),
    )


@_query(
    f"""{_LOG}, k AS (SELECT *, row_number() OVER (PARTITION BY word, ladder_hash, model, schema_version % 10 ORDER BY seq DESC) AS r FROM e),
l AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY judged DESC, seq DESC) AS q FROM k WHERE r = 1 AND wf AND sf) SELECT word, role, demote_to, seq FROM l WHERE q = 1"""
)
def verdict_latest(spark: SparkSession, d: str) -> DataFrame:
    return verdicts.latest(_verdict_log(spark, d)).select("word", "role", "demote_to", "seq")


@_query(
    f"""{_LOG}, g AS (SELECT *, wf AND sf AS ok, CASE WHEN demote_to = '' THEN '-' ELSE demote_to END AS rung FROM e),
ro AS (SELECT word, string_agg(role, ',' ORDER BY s) AS roles FROM (SELECT word, role, min(seq) AS s FROM g WHERE ok GROUP BY ALL) GROUP BY word),
ru AS (SELECT word, string_agg(rung, ',' ORDER BY s) AS rungs FROM (SELECT word, rung, min(seq) AS s FROM g WHERE ok GROUP BY ALL) GROUP BY word),
wi AS (SELECT word, max(r > 1) AS flips, max(g > 1) AS rungf, max(r > 1 AND toa) AS crosses FROM (SELECT word, schema_version, count(DISTINCT role) AS r, count(DISTINCT rung) AS g, max(role = 'term_of_art') AS toa FROM g WHERE ok GROUP BY ALL) GROUP BY word)
SELECT g.word, count(DISTINCT ladder_hash) AS ladders, count(*) FILTER (WHERE ok) AS accepted, count(*) FILTER (WHERE NOT ok) AS refused, array_to_string(list_sort(list(DISTINCT schema_version)), ',') AS schemas,
coalesce(max(roles), '') AS roles, coalesce(max(rungs), '') AS rungs, coalesce(max(flips), false) AS flips_within, coalesce(max(rungf), false) AS rungs_within, coalesce(max(crosses), false) AS crosses_within,
coalesce(max(roles) LIKE '%,%' AND max(roles) LIKE '%term_of_art%', false) AS crosses_term_of_art, coalesce(max(roles) LIKE '%,%' OR max(rungs) LIKE '%,%', false) AS unstable
FROM g LEFT JOIN ro USING (word) LEFT JOIN ru USING (word) LEFT JOIN wi USING (word) GROUP BY g.word"""
)
def verdict_churn(spark: SparkSession, d: str) -> DataFrame:
    c = verdicts.churn(_verdict_log(spark, d))
    text = lambda x: F.array_join(F.transform(x, lambda v: v.cast("string")), ",").alias(x)
    return c.select("word", "ladders", "accepted", "refused", text("schemas"), text("roles"), text("rungs"), "flips_within", "rungs_within", "crosses_within", "crosses_term_of_art", "unstable")


_CUR = [tx.lemma_of(w) for w in CURATED]
#: Curated besides: the three most used lemmas and the two that are most often names. The report has the second
#: most used lemma and one phrase, and the log of verdicts calls the most used one a term of art.
_AUDIT = f"""{_TOK}, {_sql_phrases("turns", "text")}, wl AS (SELECT unnest(list_slice(w, 2, len(w))) AS word FROM (SELECT {_words("cased")} AS w FROM cut)),
w2 AS (SELECT {_lemma("lower(word)")} AS lemma, upper(left(word, 1)) = left(word, 1) AND lower(left(word, 1)) <> left(word, 1) AND upper(word) <> word AS capped FROM wl),
nm AS (SELECT lemma, count(*) AS mid FROM w2 WHERE strlen(lemma) >= 3 AND lemma NOT IN ({_QUOTED}) GROUP BY lemma HAVING count(*) >= 20 AND count(*) FILTER (WHERE capped) / count(*) >= 0.5),
top AS (SELECT lemma, row_number() OVER (ORDER BY count(*) DESC, lemma) AS r FROM tok GROUP BY lemma),
cur AS (SELECT term, bool_or(is_phrase) AS is_phrase FROM (VALUES {", ".join([f"('{w}', false)" for w in _CUR] + [f"('{p}', true)" for p in PHRASES])}) v(term, is_phrase) GROUP BY term
  UNION SELECT lemma, false FROM top WHERE r <= 3 UNION SELECT lemma, false FROM (SELECT lemma FROM nm ORDER BY mid DESC, lemma LIMIT 2)),
us AS (SELECT lemma AS term, project FROM tok UNION ALL SELECT phrase, project FROM hits), n AS (SELECT count(*) AS ft FROM tok),
rk AS (SELECT 'of the' AS term, 1 AS rank UNION ALL SELECT lemma, 2 FROM top WHERE r = 2),
a AS (SELECT term, is_phrase, count(us.project) AS hits, count(DISTINCT us.project) AS projects FROM cur LEFT JOIN us USING (term) GROUP BY ALL),
au AS (SELECT term, is_phrase, hits, projects, hits / ft * 1000 AS rate, CASE WHEN rank > 0 THEN 'reported' WHEN hits = 0 THEN 'never fires' WHEN NOT is_phrase AND term IN (SELECT lemma FROM nm) THEN 'read as name'
  WHEN term IN (SELECT lemma FROM top WHERE r = 1) THEN 'term of art' ELSE 'below cutoff' END AS status FROM a LEFT JOIN rk USING (term), n)"""


def _audited(spark: SparkSession, d: str) -> DataFrame:
    counts = cut(tokens.lemma_table(turns(spark, d), STOP), "query-words")
    own = counts.groupBy("lemma").agg(F.sum("n").alias("n"), F.sum("mid").alias("mid"), F.sum("capped").alias("capped"))
    first, second, third = (r.lemma for r in own.filter("n > 0").orderBy(F.desc("n"), "lemma").limit(3).collect())
    named = [r.lemma for r in own.filter(tx.is_name(F.col("mid"), F.col("capped"))).orderBy(F.desc("mid"), "lemma").limit(2).collect()]
    entries = spark.createDataFrame([("of the", 1), (second, 2)], "lemma string, entry_ord int")
    log = spark.createDataFrame([(1, first, "h", "m", 1, "term_of_art", "", "", True, True, "2024-03-01T00:00:00Z")], f"seq long, {files.VERDICTS}")
    return commands.audit(turns(spark, d), [*CURATED, first, second, third, *named], PHRASES, entries, STOP, log, counts=counts)


@_query(f"{_AUDIT} SELECT term, is_phrase, hits, projects, round(rate, 6) AS rate, status FROM au")
def curated_audit(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_audited(spark, d).drop("rank"), "rate")


@_query(f"{_AUDIT} SELECT term, is_phrase FROM au WHERE status = 'never fires'")
def audit_never(spark: SparkSession, d: str) -> DataFrame:
    return au.never(_audited(spark, d)).select("term", "is_phrase")


@_query(
    f"""{_AUDIT} SELECT count(*) FILTER (WHERE status = 'reported') AS reported, count(*) FILTER (WHERE status = 'never fires') AS never_fires, count(*) FILTER (WHERE status = 'read as name') AS read_as_name,
count(*) FILTER (WHERE status = 'term of art') AS term_of_art, count(*) FILTER (WHERE status = 'below cutoff') AS below_cutoff, count(*) FILTER (WHERE projects = 1 AND hits <= 2) AS self_cited FROM au"""
)
def audit_tallies(spark: SparkSession, d: str) -> DataFrame:
    return au.tallies(_audited(spark, d))


@_query(
    rf"""WITH w AS (SELECT conv_id, turn, regexp_extract_all(text, '[\p{{L}}][\p{{L}}''-]*') AS w FROM conversations),
u AS (SELECT conv_id, turn, lower(unnest(w)) AS x FROM w), l AS (SELECT conv_id, CASE WHEN x IN ('the', 'des', 'die') THEN x ELSE {_lemma("x")} END AS lemma FROM u)
SELECT lemma, count(*) AS total, count(DISTINCT conv_id) AS conversations FROM l WHERE lemma IN ('the', 'des', 'die') GROUP BY lemma"""
)
def swap_counts(spark: SparkSession, d: str) -> DataFrame:
    done = swaps.apply_swaps(table(spark, d, "conversations").select("conv_id", "text"), "text", SWAPS)
    one = done.select("conv_id", F.explode("swap_counts").alias("s")).select("conv_id", "s.lemma", "s.n")
    return one.groupBy("lemma").agg(F.sum("n").alias("total"), F.count_distinct("conv_id").alias("conversations"))


@_query(
    """WITH l AS (SELECT event_id AS seq, ts AS t, event_type AS lemma, 'r' || user_id % 4 AS "to", 1 + event_id % 3 AS n FROM events)
SELECT lemma, sum(n)::BIGINT AS total, arg_max("to", seq) AS last_to, count(DISTINCT "to") AS replacements, min(t) AS first_at, max(t) AS last_at,
round(sum(n) / (floor((epoch_us(max(t)) - epoch_us(min(t))) / 86400000000.0) + 1), 6) AS per_day FROM l GROUP BY lemma"""
)
def swap_totals(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    log = e.select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("t"), F.col("event_type").alias("lemma"), F.concat(F.lit("r"), F.col("user_id") % 4).alias("to"), (1 + F.col("event_id") % 3).alias("n"))
    out = _rounded(swaps.swap_totals(log), "per_day")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_at", "last_at")})


@_query(
    """WITH RECURSIVE e AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS r FROM events),
f AS (SELECT user_id, r, ts, ts AS fired, true AS fires FROM e WHERE r = 1 UNION ALL
  SELECT e.user_id, e.r, e.ts, CASE WHEN e.ts - f.fired >= INTERVAL 4 HOUR THEN e.ts ELSE f.fired END, e.ts - f.fired >= INTERVAL 4 HOUR FROM f JOIN e ON e.user_id = f.user_id AND e.r = f.r + 1)
SELECT 'u' || user_id AS session_id, count(*) AS events, count(*) FILTER (WHERE fires) AS fired, max(ts) FILTER (WHERE fires) AS last_fired FROM f GROUP BY user_id"""
)
def injection_claims(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.concat(F.lit("u"), "user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("at"))
    c = swaps.claims(e)
    return c.groupBy("session_id").agg(F.count("*").alias("events"), F.count_if("fires").alias("fired"), F.max(F.when(F.col("fires"), F.col("at"))).cast("timestamp_ntz").alias("last_fired"))


#: Some lines are made to open or close a fence: three or four signs after up to four blanks (four are too many).
_FENCED = r"""l AS (SELECT conv_id, turn, unnest(p) AS said, unnest(range(len(p))) AS ord FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS p FROM conversations)),
m AS (SELECT conv_id, turn, ord, CASE length(said) % 7 WHEN 0 THEN repeat(' ', length(said) % 5) || '```' || said WHEN 3 THEN '~~~~' ELSE said END AS line FROM l),
f AS (SELECT *, regexp_matches(line, '^\s{0,3}(```+|~~~+)') AS is_fence FROM m),
g AS (SELECT *, coalesce(sum(is_fence::INT) OVER (PARTITION BY conv_id, turn ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS in_fence FROM f)"""


def _fenced(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n", -1)).alias("ord", "said"))
    kind = F.length("said") % 7
    opened = F.concat(F.repeat(F.lit(" "), F.length("said") % 5), F.lit("```"), "said")
    return c.withColumn("line", F.when(kind == 0, opened).when(kind == 3, "~~~~").otherwise(F.col("said")))


@_query(f"WITH {_FENCED} SELECT conv_id, turn, ord::INT AS ord, is_fence, in_fence FROM g")
def fence_state(spark: SparkSession, d: str) -> DataFrame:
    c = _fenced(spark, d).select(F.col("conv_id").alias("session_id"), F.col("turn").alias("message_id"), "ord", swaps.is_fence(F.col("line")).alias("is_fence"))
    return swaps.fence_state(c).select(F.col("session_id").alias("conv_id"), F.col("message_id").alias("turn"), "ord", "is_fence", "in_fence")


def _sql_case(word: str, to: str) -> str:
    return f"""CASE WHEN length({word}) > 1 AND upper({word}) = {word} AND lower({word}) <> {word} THEN upper({to})
  WHEN upper(left({word}, 1)) = left({word}, 1) AND lower(left({word}, 1)) <> left({word}, 1) THEN upper(left({to}, 1)) || substr({to}, 2) ELSE {to} END"""


def _sql_swapped(word: str) -> str:
    """SQL: a word exchanged by SWAPS, exactly or by its lemma (then with its possessive ending or as a plural)."""
    exact = " ".join(f"WHEN '{w}' THEN {_sql_case(word, repr(r))}" for w, r in SWAPS.items())
    rest = lambda w: f"substr(lower({word}), {len(w) + 1})"
    owned = lambda w, r: f"('{r}' || {rest(w)})"
    by_lemma = " ".join(
        f"WHEN '{w}' THEN CASE WHEN {rest(w)} IN (chr(39), chr(39) || 's') THEN {_sql_case(word, owned(w, r))} ELSE {_sql_case(word, repr(dp.plural_of(r)))} END" for w, r in SWAPS.items()
    )
    return f"CASE lower({word}) {exact} ELSE CASE {_lemma(f'lower({word})')} {by_lemma} ELSE {word} END END"


@_query(
    rf"""WITH {_FENCED}, w AS (SELECT conv_id, turn, ord, is_fence OR in_fence AS stays, line, regexp_extract_all(line, '[\p{{L}}][\p{{L}}''-]*|[^\p{{L}}]+') AS parts FROM g),
r AS (SELECT conv_id, turn, ord, CASE WHEN stays THEN line ELSE array_to_string(list_transform(parts, lambda x: {_sql_swapped("x")}), '') END AS line FROM w)
SELECT conv_id, turn, string_agg(line, chr(10) ORDER BY ord) AS swapped FROM r GROUP BY conv_id, turn"""
)
def swapped_text(spark: SparkSession, d: str) -> DataFrame:
    lines = F.array_sort(F.collect_list(F.struct("ord", "line")))
    text = F.array_join(F.transform(lines, lambda x: x["line"]), "\n")
    said = _fenced(spark, d).groupBy("conv_id", "turn").agg(text.alias("text"))
    return swaps.apply_swaps(said, "text", SWAPS).select("conv_id", "turn", "swapped")


# ---- sources: what the driver's tables hold, written in each source's format and read back


def _lines(df: DataFrame, name: str) -> str:
    """``df``(value) as lines of text files; returns their folder."""
    path = place(df.sparkSession, name)
    df.select("value").write.text(path)
    return path


_SINCE = "TIMESTAMP '2024-02-10 00:00:00'"


@_query(
    rf"""WITH c AS (SELECT *, TIMESTAMP '2024-03-04 00:00:00' - to_days(CAST(conv_id % 40 AS INT)) AS ts FROM conversations)
SELECT 'p' || conv_id % 3 AS project, conv_id, turn, ts, text || chr(10) || 'turn ' || turn AS text FROM c WHERE role = 'assistant' AND text <> '' AND conv_id % 5 <> 0 AND conv_id % 7 <> 0 AND conv_id % 11 <> 0 AND ts >= {_SINCE}"""
)
def transcript_turns(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as transcripts: other roles, side chains, plain strings and torn lines are no turns."""
    c, i = table(spark, d, "conversations"), F.col("conv_id")
    ts = F.date_format(F.lit(NOW) - F.make_dt_interval(i % 40), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    block = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    blocks = F.array(block("text", F.col("text")), block("thinking", F.lit("no")), block("text", F.lit("")), block("text", F.concat(F.lit("turn "), "turn")))
    line = lambda content: F.to_json(F.struct(F.col("role").alias("type"), (i % 5 == 0).alias("isSidechain"), ts.alias("timestamp"), F.struct(content.alias("content")).alias("message"), i.alias("conv"), F.col("turn")))
    value = F.when(i % 7 == 0, line(F.col("text"))).when(i % 11 == 0, F.left(line(blocks), F.lit(40))).otherwise(line(blocks))
    root = place(spark, "transcripts")
    for p in range(3):  # a session's file must end in .jsonl
        c.filter(i % 3 == p).select(F.concat(F.lit("conv"), i % 2).alias("session"), value.alias("value")).write.partitionBy("session").text(f"{root}/p{p}")
    rename_files(spark, root, ".txt", ".jsonl")
    turns_ = transcripts.read_turns(spark, root, datetime(2024, 2, 10))
    said = c.select("conv_id", "turn", F.concat_ws("\n", "text", F.concat(F.lit("turn "), "turn")).alias("text"))
    # the lines carry no ids of conversations: they come back by the text
    return turns_.join(said.distinct(), "text").select("project", "conv_id", "turn", F.col("ts").cast("timestamp_ntz").alias("ts"), "text")


@_query(
    """SELECT 'v' || vec_id AS word, round((embedding[1]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 4) AS first,
round((embedding[-1]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 4) AS last FROM embeddings WHERE vec_id % 11 <> 5 AND vec_id % 13 <> 6 AND vec_id % 2 = 0"""
)
def vector_file(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as a text table: lines that are too short or hold no numbers are dropped, and words not asked for."""
    e, i = table(spark, d, "embeddings"), F.col("vec_id")
    numbers = F.transform("embedding", lambda x: x.cast("string"))
    numbers = F.when(i % 11 == 5, F.slice(numbers, 2, 5)).when(i % 13 == 6, F.concat(F.slice(numbers, 1, 3), F.array(F.lit("x")))).otherwise(numbers)
    path = _lines(e.select(F.concat(F.lit("v"), i, F.lit(" "), F.array_join(numbers, " ")).alias("value")).orderBy(i), "vectors")
    asked = e.filter(i % 2 == 0).select(F.concat(F.lit("v"), i).alias("word"))
    v = files.read_vectors(spark, path, asked, "double")
    at = lambda n: F.round(F.element_at("v", n), 4)
    return v.select("word", at(1).alias("first"), at(-1).alias("last"))


@_query(
    """WITH p AS (SELECT p_partkey, printf('%08d', p_partkey) AS o, replace(p_name, ' ', '_') AS w, lower(p_brand) AS brand, CASE p_partkey % 3 WHEN 0 THEN 'adj' ELSE 'noun' END AS f FROM part),
roots AS (SELECT f, sum(p_partkey) AS t FROM p WHERE p_partkey % 10 = 1 GROUP BY f), tag AS (SELECT brand, sum(p_partkey % 4)::BIGINT AS n FROM p WHERE p_partkey % 6 <> 0 GROUP BY brand)
SELECT o || f[1] AS key, f[1] AS pos, w AS word, brand AS second, 'about ' || brand AS gloss, printf('%08d', p_partkey // 2) || f[1] AS target, round(-ln(p_partkey / t), 6) AS ic, tag.n AS tags
FROM p JOIN roots USING (f) JOIN tag USING (brand) WHERE p_partkey % 8 <> 3 AND p_partkey > 0"""
)
def thesaurus_text(spark: SparkSession, d: str) -> DataFrame:
    """Parts as thesaurus files; lines with a wrong count of words are passed over."""
    i = F.col("p_partkey")
    p = table(spark, d, "part").select(i, F.format_string("%08d", i).alias("o"), F.translate("p_name", " ", "_").alias("w"), F.lower("p_brand").alias("brand"), F.when(i % 3 == 0, "adj").otherwise("noun").alias("f"))
    root = place(spark, "dict")
    pos = F.left("f", F.lit(1))
    count = F.when(i % 8 == 3, "zz").otherwise("02")
    data = F.concat_ws(" ", "o", F.lit("03"), pos, count, "w", F.lit("0"), "brand", F.lit("0"), F.lit("001"), F.lit("@"), F.format_string("%08d", F.expr("p_partkey div 2")), pos, F.lit("0000"), F.lit("|"), F.lit("about"), "brand")
    index = F.concat_ws(" ", F.lower("w"), pos, F.lit("1 1 @ 1 0"), "o")
    for name in thesaurus_files.FILES:
        own = p.filter(F.col("f") == name)
        own.select(data.alias("value")).write.text(f"{root}/data.{name}")
        own.select(index.alias("value")).write.text(f"{root}/index.{name}")
    tags = F.concat_ws(" ", F.concat("brand", F.lit("%1:00")), "o", F.lit("1"), (i % 4).cast("string"))
    p.select(F.when(i % 6 == 0, F.concat(tags, F.lit(" odd"))).otherwise(tags).alias("value")).write.text(f"{root}/index.sense")
    ic = F.concat_ws(" ", F.concat(i.cast("string"), pos), i.cast("string"), F.when(i % 10 == 1, "ROOT"))
    p.select(ic.alias("value")).write.text(f"{root}/ic")
    t = thesaurus_files.read(spark, root, f"{root}/ic")
    word = lambda n, name: t.synset_word.filter(F.col("ord") == n).select("key", F.col("word").alias(name))
    out = t.synset.join(word(0, "word"), "key").join(word(1, "second"), "key").join(t.synset_ptr.select("key", "target"), "key").join(t.ic, "key")
    out = out.join(t.word_freq.select(F.col("lemma").alias("second"), F.col("n").alias("tags")), "second")
    return _rounded(out.select("key", "pos", "word", "second", "gloss", "target", "ic", "tags"), "ic")


@_query(
    """WITH l AS (SELECT event_id, ts, event_type AS w, 'r' || user_id % 4 AS "to", 1 + event_id % 3 AS n FROM events WHERE event_id % 9 <> 0 AND event_id % 10 <> 0)
SELECT w AS lemma, count(*) AS rows, sum(n)::BIGINT AS total, count(DISTINCT "to") AS replacements, date_trunc('second', min(ts)) AS first_at FROM l GROUP BY w"""
)
def swap_log(spark: SparkSession, d: str) -> DataFrame:
    """Events as a log of swaps in JSON lines; torn lines and rows without a word are passed over."""
    i = F.col("event_id")
    row = F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("t"), F.when(i % 10 == 0, "").otherwise(F.col("event_type")).alias("w"), F.concat(F.lit("r"), F.col("user_id") % 4).alias("to"), (1 + i % 3).alias("n")))
    path = _lines(table(spark, d, "events").select(F.when(i % 9 == 0, F.left(row, F.lit(20))).otherwise(row).alias("value")), "swap-log")
    out = files.swap_log(spark, path).groupBy("lemma").agg(F.count("*").alias("rows"), F.sum("n").alias("total"), F.count_distinct("to").alias("replacements"), F.min("t").cast("timestamp_ntz").alias("first_at"))
    return out


@_query(
    """SELECT 'w' || user_id AS word, role, count(*) AS n, count(*) FILTER (WHERE event_id % 7 <> 0) AS well_formed FROM (SELECT *, CASE event_id % 3 WHEN 0 THEN 'tic' WHEN 1 THEN 'mixed' ELSE 'term_of_art' END AS role FROM events WHERE event_id % 9 <> 0) GROUP BY ALL"""
)
def verdict_file(spark: SparkSession, d: str) -> DataFrame:
    """Events as a log of verdicts in JSON lines, appended in two writes."""
    i = F.col("event_id")
    role = F.when(i % 3 == 0, "tic").when(i % 3 == 1, "mixed").otherwise("term_of_art")
    row = F.to_json(F.struct(F.concat(F.lit("w"), "user_id").alias("word"), F.lit("h").alias("ladder_hash"), F.lit("m").alias("model"), F.lit(1).alias("schema_version"), role.alias("role"), F.lit("").alias("demote_to"), F.lit("").alias("note"), (i % 7 != 0).alias("well_formed"), F.lit(True).alias("safe"), F.lit("t").alias("at")))
    e = table(spark, d, "events").select(F.when(i % 9 == 0, F.left(row, F.lit(30))).otherwise(row).alias("value"), i)
    path = _lines(e.filter(i % 2 == 0), "verdict-log")
    e.filter(i % 2 == 1).select("value").write.mode("append").text(path)
    return files.verdict_log(spark, path).groupBy("word", "role").agg(F.count("*").alias("n"), F.count_if("well_formed").alias("well_formed"))


# ---- what is shown


@_query(
    r"""WITH c AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'See e.g. ' || text WHEN 1 THEN replace(text, '.', '.")') ELSE text END AS note FROM conversations),
m AS (SELECT *, regexp_extract(note, '^((?:.|\n)*?)[.!?]["'')\]]*\s+["''A-Z(]', 1) AS head, regexp_extract(note, '^(?:.|\n)*?([.!?]["'')\]]*)\s+["''A-Z(]', 1) AS mark FROM c)
SELECT conv_id, turn, CASE WHEN mark = '' OR head LIKE '%e.g' OR head LIKE '%i.e' THEN note ELSE head || mark END AS first FROM m"""
)
def first_sentences(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    note = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("See e.g. "), text)).when(F.col("turn") % 3 == 1, F.replace(text, F.lit("."), F.lit('.")'))).otherwise(text)
    return table(spark, d, "conversations").select("conv_id", "turn", dp.first_sentence(note).alias("first"))


@_query(
    """WITH c AS (SELECT event_id, value, event_type, coalesce(round((value - 50) / 50 * 100, 6), 0) AS pct, event_id % 3 AS injected, event_id % 40 AS days FROM events)
SELECT event_id, pct AS change, CASE WHEN pct <= -1 THEN '↓' WHEN pct >= 1 THEN '↑' ELSE '→' END AS arrow, CASE WHEN days >= 14 THEN days // 7 || 'w' WHEN days <= 0 THEN 'today' ELSE days || 'd' END AS age,
CASE WHEN event_id % 2 = 0 THEN 'curated, ' ELSE '' END || CASE injected WHEN 0 THEN 'never shown' ELSE 'shown ' || injected || '×' END AS tally,
CASE WHEN length(event_type) > 5 THEN left(event_type, 4) || '…' ELSE event_type END AS short,
CASE event_id % 3 WHEN 0 THEN 'BRANCH' WHEN 1 THEN 'Branch' ELSE 'branch' END AS cased FROM c"""
)
def display_cells(spark: SparkSession, d: str) -> DataFrame:
    i, kind = F.col("event_id"), F.col("event_type")
    pct = F.round(dp.change(F.lit(50.0), F.col("value")), 6)
    word = F.when(i % 3 == 0, F.upper(kind)).when(i % 3 == 1, F.initcap(kind)).otherwise(F.lower(kind))
    return table(spark, d, "events").select(
        "event_id", pct.alias("change"), dp.change_arrow(pct).alias("arrow"), dp.human_age((i % 40) * 86_400 + 3_600).alias("age"), dp.shown(i % 2 == 0, i % 3).alias("tally"),
        dp.shortened(kind, 5).alias("short"), dp.match_case(word, F.lit("branch")).alias("cased"),
    )


@_query(
    """WITH e AS (SELECT event_type || user_id % 5 AS lemma, 'riser' AS kind, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN event_type || user_id % 5 ELSE 'to' || user_id % 5 END AS demote_to, event_id % 2 = 0 AS known, event_id FROM events)
SELECT lemma, max(replacement) AS replacement FROM (SELECT lemma, demote_to AS replacement FROM e WHERE known AND demote_to <> '' AND lower(lemma) <> lower(demote_to) AND lemma <> 'extra' UNION ALL SELECT 'extra', 'given') GROUP BY lemma"""
)
def swap_table(spark: SparkSession, d: str) -> DataFrame:
    """Curated entries with a demotion, and pairs that are given."""
    i, lemma = F.col("event_id"), F.concat("event_type", F.col("user_id") % 5)
    to = F.when(i % 4 == 0, "").when(i % 4 == 1, F.upper(lemma)).otherwise(F.concat(F.lit("to"), F.col("user_id") % 5))
    entries = table(spark, d, "events").select(F.lit("riser").alias("kind"), lemma.alias("lemma"), to.alias("demote_to"), (i % 2 == 0).alias("known"))
    return swaps.swap_table(entries, {"extra": "given"})


@_query(None)
def report_document(spark: SparkSession, d: str) -> DataFrame:
    """The whole report; words of a made-up thesaurus, in which a lemma's hypernyms are the ones ranked around it."""
    counts = cut(_common(spark, d).groupBy("lemma").agg(F.count("*").alias("n")), "query-counts")
    best = counts.orderBy(F.desc("n"), "lemma").limit(1_000)
    top = cut(best.withColumn("r", F.row_number().over(Window.orderBy(F.desc("n"), "lemma"))), "top")
    key = F.concat(F.lit("k"), "r")
    synset = top.select(key.alias("key"), F.lit("n").alias("pos"), F.lit("").alias("gloss"))
    words_ = top.select(key.alias("key"), F.lit(0).alias("ord"), F.col("lemma").alias("word"))
    up = top.filter("r > 2").select(key.alias("key"), F.lit(0).alias("ord"), F.lit("@").alias("sym"), F.concat(F.lit("k"), F.expr("r div 2")).alias("target"))
    index = top.select(F.lit("n").alias("pos"), "lemma", F.lit(0).alias("sense_ord"), key.alias("key"))
    none = spark.createDataFrame([], "key string, ic double")
    t = thesaurus.Thesaurus(index, synset, words_, up, none, top.select("lemma", "n"))
    out = commands.report(turns(spark, d), NOW, STOP, t, lambda v: _vectors(spark, d, counts).join(v, "word", "left_semi"), CURATED, PHRASES, (), None, REPORT.but(threshold=0.6, rarity_floor=6.0, incongruity_floor=0.5))
    return _rounded(out.withColumn("words", F.array_join("words", " < ")).withColumn("spark", F.transform("spark", lambda x: F.round(x, 6))), "rate", "ratio")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
