"""Console tables of small results. Numbers are rounded here and nowhere before."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

#: Headings, columns and formats of what the commands print.
SCAN = (("lemma", "lemma", "{}"), ("recent", "recent", "{}"), ("outside", "outside", "{}"), ("projects", "projects", "{}"), ("r/1k", "recent_rate", "{:.2f}"), ("base/1k", "baseline_rate", "{:.2f}"), ("ratio", "ratio", "{:.1f}x"), ("score", "score", "{:.1f}"))
AUDIT = (("term", "term", "{}"), ("hits", "hits", "{}"), ("projects", "projects", "{}"), ("rate/1k", "rate", "{:.3f}"), ("status", "status", "{}"))


def aligned(rows: Sequence[Sequence[str]]) -> str:
    """Rows of cells in columns as wide as their widest cell, two blanks apart."""
    if not rows:
        return ""
    widths = [max(len(r[i]) for r in rows) for i in range(len(rows[0]))]
    return "".join("  ".join(c.ljust(w) for c, w in zip(r, widths, strict=True)).rstrip() + "\n" for r in rows)


def table(df: DataFrame, columns: Sequence[tuple[str, str, str]]) -> str:
    """A table of ``df`` in its order; for results that are bounded by their operator (a top-k, a curated list)."""
    shown = [["-" if r[c] is None else f.format(r[c]) for _, c, f in columns] for r in df.select(*[c for _, c, _ in columns]).collect()]
    return aligned([[h.upper() for h, _, _ in columns], *shown])


def trend_table(trended: DataFrame) -> str:
    """Of drift.trend: a line a week with the rate of each lemma, a dash for weeks without a token."""
    rows = trended.select("bucket", "tokens", "lemma", "rate").orderBy("bucket", "lemma").collect()
    lemmas = sorted({r.lemma for r in rows})
    rate = {(r.bucket, r.lemma): "-" if r.rate is None else f"{r.rate:.2f}" for r in rows}
    tokens = {r.bucket: r.tokens for r in rows}
    return aligned([["WEEK", "TOKENS", *(f"{x}/1k" for x in lemmas)], *([str(b), f"{tokens[b] // 1000}k", *(rate[b, x] for x in lemmas)] for b in sorted(tokens))])
