"""Text expressions: cleaning, sentences, words, lemmas, tokens. No UDF; Python twins build literals and test."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

FENCE = r"(?s)```.*?```"
INLINE_CODE = r"`[^`\n]*`"
URL = r"https?://\S+"
#: A path is runs of word characters that end in slashes. Possessive, and begun at the border of a
#: run, so that neither long runs nor many segments backtrack.
PATH = r"(?:[~/]|(?<![\w.-]))[\w.-]++/(?:[\w.-]++/)*+[\w.-]*"
SENTENCE_END = r"[.!?;\n]"
#: From a run's first letter to its last one: what is left of a run of letters, hyphens and apostrophes when the latter two are trimmed.
WORD = r"\p{L}(?:[\p{L}'-]*\p{L})?"
TRIMMED = "-'"

#: The default function words. The list is a parameter of everything that keeps tokens.
FUNCTION_WORDS = """
a about above across actually after again against all along already also always am among an and
another any are aren aren't around as at back bad be because been before behind being below beneath
beside between beyond big bit both but by came can can't cannot come comes coming could couldn
couldn't dare did didn didn't do does doesn doesn't doing don don't down during each eight eighth
either eleven else even ever every except few fifth fifty first five for forty four fourth from get
gets getting go goes going gone good got had has have having he her here here's hers high him his
how hundred i i'll i'm i've if in inside into is isn isn't it it's its just kind knew know knowing
known knows last let let's lets like long lot lots low made make makes making many may me might
million mine more most much must my near need neither never new next nine ninth no none nor not
nothing now of off often okay old on once one only onto or other ought our ours out out-of outside
over own part pretty quite rarely rather really right same saw second see seeing seen sees seven
seventh shall she short should shouldn shouldn't since six sixth small so some sometimes sort still
stuff such take taken takes taking ten tenth than that that's the their theirs them then there
there's these they they're thing things think thinking thinks third thirty this those thought
thousand three through throughout till to too took toward towards twelve twenty two under until up
upon us use used uses using usually very via want wanted wants was wasn wasn't way ways we we're
we've well went were weren weren't what what's when where which while who whom whose why will with
within without won won't would wouldn wouldn't yeah yes yet you you're you've your yours
"""


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once: lambdas would evaluate a captured expression per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lemma_of(word: str) -> str:
    """Python twin of :func:`lemma`; lengths are in bytes."""
    w = word.removesuffix("'s").removesuffix("'")
    n = len(w.encode())
    if n > 4 and w.endswith("ies"):
        return w[:-3] + "y"
    if n > 4 and w.endswith(("sses", "shes", "ches", "xes")):
        return w[:-2]
    if n > 3 and w.endswith("s") and not w.endswith(("ss", "us", "is")):
        return w[:-1]
    return w


def words_of(text: str) -> list[str]:
    """Python twin of :func:`words`."""
    return [w for w in (m.strip(TRIMMED) for m in re.findall(r"(?:[^\W\d_]|['-])+", text)) if w]


def stopword_set(listed: str | Iterable[str] | None = None) -> list[str]:
    """Each listed word as it stands and as its lemma, sorted."""
    own = FUNCTION_WORDS if listed is None else listed
    own = own.split() if isinstance(own, str) else list(own)
    return sorted({*own, *map(lemma_of, own)})


def clean(text: Column) -> Column:
    """Fenced code, inline code, URLs and paths become one blank each, in this order; a pattern runs on texts that hold its signs."""

    def without(pattern: str, sign: str) -> Callable[[Column], Column]:
        return lambda t: F.when(t.contains(sign), F.regexp_replace(t, pattern, " ")).otherwise(t)

    for pattern, sign in ((FENCE, "```"), (INLINE_CODE, "`"), (URL, "://"), (PATH, "/")):
        text = let(text, without(pattern, sign))
    return text


def sentences(cleaned: Column) -> Column:
    return F.filter(F.split(cleaned, SENTENCE_END), lambda s: s != "")


def words(text: Column) -> Column:
    """Runs of letters, hyphens and apostrophes, without hyphens and apostrophes at the ends."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def lemma(word: Column) -> Column:
    return let(word, stem)


def stem(word: Column) -> Column:
    """The lemma of a word that costs nothing to read again (a lambda's variable). Only words that end in s or an apostrophe change."""
    owned = lambda w: F.when(w.endswith("'s"), F.left(w, F.length(w) - 2)).otherwise(w)
    bare = lambda w: F.when(w.endswith("'"), F.left(w, F.length(w) - 1)).otherwise(w)

    def singular(w: Column) -> Column:
        n = F.octet_length(w)
        cut = lambda k: F.left(w, F.length(w) - k)
        return (
            F.when(~w.endswith("s"), w)
            .when((n > 4) & w.endswith("ies"), F.concat(cut(3), F.lit("y")))
            .when((n > 4) & (w.endswith("sses") | w.endswith("shes") | w.endswith("ches") | w.endswith("xes")), cut(2))
            .when((n > 3) & ~(w.endswith("ss") | w.endswith("us") | w.endswith("is")), cut(1))
            .otherwise(w)
        )

    return F.when(word.endswith("s") | word.endswith("'"), let(let(let(word, owned), bare), singular)).otherwise(word)


def keep(word: Column, stopwords: list[str]) -> Column:
    """At least three bytes and no stopword."""
    return (F.octet_length(word) >= 3) & ~word.isin(stopwords)


def tokens(text: Column, stopwords: list[str]) -> Column:
    return F.filter(F.transform(words(F.lower(text)), stem), lambda w: keep(w, stopwords))


def contains_word(phrase: Column, word: Column) -> Column:
    """Whether a word is among the white-space separated parts of a phrase."""
    return F.array_contains(F.split(phrase, r"\s+"), word)


def mark_parts(word: Column) -> Column:
    return F.filter(F.split(word, "[-_]"), lambda p: p != "")


def norm_lemma(word: Column) -> Column:
    return F.translate(F.lower(word), " ", "_")


def clean_word(word: Column) -> Column:
    """A thesaurus word as text: without its syntactic marker, lower case, blanks for underscores."""
    return F.translate(F.lower(F.substring_index(word, "(", 1)), "_", " ")


def norm_pos(pos: Column) -> Column:
    return F.when(pos == "s", "a").otherwise(pos)


def is_name(mid: Column, capped: Column, least: int = 20, share: float = 0.5) -> Column:
    return (mid >= least) & (capped / mid >= share)


def encoded_words(text: Column) -> Column:
    """All words of a text as |a|b|c| for matching phrases with one pattern."""
    return F.concat(F.lit("|"), F.array_join(words(F.lower(text)), "|"), F.lit("|"))
