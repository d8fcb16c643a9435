"""Expressions for what is printed: first sentences, sparklines, arrows, ages, case and inflection."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The block heights of a sparkline, lowest first.
GLYPHS = "▁▂▃▄▅▆▇█"
NOTE_END = r"[.!?][\"')\]]*\s+[\"'A-Z(]"


def first_sentence(note: Column) -> Column:
    """A note up to its first sentence end, closing quotes kept; whole if that end is an abbreviation's."""
    at = F.regexp_instr(note, F.lit(NOTE_END))
    ending = F.regexp_extract(note, r"([.!?][\"')\]]*)\s+[\"'A-Z(]", 1)
    head = F.substring(note, F.lit(1), at - 1 + F.length(ending))
    bare = F.substring(note, F.lit(1), at - 1)
    return F.when((at == 0) | bare.endswith("e.g") | bare.endswith("i.e"), note).otherwise(head)


def sparkline(series: Column) -> Column:
    """One block per value, scaled to the series' own range; null (a gap) is a blank."""
    low, high = F.array_min(series), F.array_max(series)
    n = len(GLYPHS)
    glyphs = F.array(*[F.lit(g) for g in GLYPHS])

    def glyph(v: Column) -> Column:
        flat = F.when(high == 0, F.lit(GLYPHS[0])).otherwise(F.lit(GLYPHS[(n - 1) // 2]))
        scaled = F.get(glyphs, F.floor((v - low) / (high - low) * (n - 1) + 0.5).cast("int"))
        return F.when(v.isNull(), F.lit(" ")).when(high == low, flat).otherwise(scaled)

    return F.array_join(F.transform(series, glyph), "")


def trend_arrow(series: Column) -> Column:
    """Direction from the first to the last value that is no gap."""
    present = F.filter(series, lambda v: v.isNotNull())
    first, last = F.get(present, F.lit(0)), F.get(present, F.size(present) - 1)
    return F.when(last > first, "↑").when(last < first, "↓").otherwise("→")


def change(first: Column, last: Column) -> Column:
    """Percent from first to last; 0 without a first."""
    return F.when(first == 0, 0.0).otherwise((last - first) / first * 100)


def change_arrow(percent: Column) -> Column:
    return F.when(percent <= -1, "↓").when(percent >= 1, "↑").otherwise("→")


def human_age(seconds: Column) -> Column:
    days = F.floor(seconds / 86400)
    return (
        F.when(days >= 14, F.concat(F.floor(days / 7).cast("string"), F.lit("w")))
        .when(days <= 0, F.lit("today"))
        .otherwise(F.concat(days.cast("string"), F.lit("d")))
    )


def shown(known: Column, injected: Column) -> Column:
    times = F.concat(F.lit("shown "), injected.cast("string"), F.lit("×"))
    often = F.when(injected == 0, "never shown").otherwise(times)
    return F.when(known, F.concat(F.lit("curated, "), often)).otherwise(often)


def shortened(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - 1)), F.lit("…"))).otherwise(text)


def match_case(original: Column, replacement: Column) -> Column:
    """All capitals and a leading capital carry over."""
    caps = (F.upper(original) == original) & (F.lower(original) != original) & (F.length(original) > 1)
    first = F.substring(original, 1, 1)
    lead = (F.upper(first) == first) & (F.lower(first) != first)
    capped = F.concat(F.upper(F.substring(replacement, 1, 1)), F.substring(replacement, F.lit(2), F.length(replacement)))
    return F.when(caps, F.upper(replacement)).when(lead, capped).otherwise(replacement)


def pluralize(word: Column) -> Column:
    return (
        F.when(word.rlike("(?:s|x|z|sh|ch)$"), F.concat(word, F.lit("es")))
        .when(word.rlike("[^aeiou]y$"), F.concat(F.left(word, F.length(word) - 1), F.lit("ies")))
        .otherwise(F.concat(word, F.lit("s")))
    )


def ladder_hash(rungs: Column) -> Column:
    """The first 16 hex digits of SHA-256 over the sorted rungs, joined by NUL."""
    return F.left(F.sha2(F.array_join(F.array_sort(rungs), "\x00"), 256), F.lit(16))


# ---- Python twins for the driver and for the streaming rewriter


def match_case_of(original: str, replacement: str) -> str:
    if len(original) > 1 and original.upper() == original and original.lower() != original:
        return replacement.upper()
    if original[:1].upper() == original[:1] and original[:1].lower() != original[:1]:
        return replacement[:1].upper() + replacement[1:]
    return replacement


def plural_of(word: str) -> str:
    if re.search("(?:s|x|z|sh|ch)$", word):
        return word + "es"
    if re.search("[^aeiou]y$", word):
        return word[:-1] + "ies"
    return word + "s"


def inflected(surface: str, lemma: str, replacement: str) -> str:
    """For a word that is not its lemma: a possessive ending carries over, anything else is a plural."""
    rest = surface[len(lemma) :] if surface.startswith(lemma) else ""
    return replacement + rest if rest in ("'s", "'") else plural_of(replacement)
