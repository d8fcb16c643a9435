"""Language identification by the nearest of several centroids per language.

A text becomes a vector of hashed byte 1-, 2- and 3-grams (letters lower-cased,
everything that is no letter one blank), weighted by sublinear term frequency and
inverse document frequency and brought to length one. Each language has a few
centroids found by spherical k-means; the prediction is the language of the
centroid with the largest cosine. A text farther from every centroid than training
texts of its length ever are, by a factor of three in cosine, is rejected.

Document frequencies and label counts cover all training rows. The centroids are
fitted on a bounded sample: ``per_language`` rows of each language in expectation,
chosen by a hash of id and text (default 1,000), so that a language with a third of all
rows is no larger a group than any other; rows that repeat both are drawn together, once. Prediction reads whole texts.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and
rejected; null labels are not learned from; repeated rows get the same prediction;
with no labelled training row everything is ``und``; extra columns are ignored.
Every label is learned; the model grows by 256 KiB for each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import ship, text_of, tidy

DIMS = 1 << 14
LENGTH_CLASSES = 24


@dataclass
class Model:
    languages: list[str]
    centroids: np.ndarray  # one row each
    language_of: np.ndarray
    idf: np.ndarray
    floor: np.ndarray  # least cosine that is not rejected, by length class


def _letters() -> np.ndarray:
    t = np.full(256, 0x20, dtype=np.uint8)
    t[0x80:] = np.arange(0x80, 0x100)
    t[ord("a") : ord("z") + 1] = t[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
    return t


_LETTERS = _letters()


def count_long(buf: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """Counts of one text, as ``count_ngrams`` gives them, read in stretches of ``step`` bytes."""
    total = np.zeros(DIMS, dtype=np.int64)
    at, carry = 0, np.zeros(0, dtype=np.uint8)
    while at < len(buf):
        end = min(len(buf), at + step)
        while end < len(buf) and buf[end] & 0xC0 == 0x80:  # no character is split
            end += 1
        x = _normal(buf[at:end], np.zeros(1, np.int64), carry[-1:])
        held, x = len(carry), np.concatenate([carry, x])
        for order in (1, 2, 3):
            if len(x) >= order:
                total += np.bincount(_gram_hashes(x.astype(np.uint32), order)[max(0, held - order + 1) :], minlength=DIMS)
        carry, at = x[-2:], end
    return total[None, :]


def _normal(buf: np.ndarray, starts: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Letters in lower case, runs of others as one blank; ``before`` is what the first text goes on from."""
    b = _lowered(buf)
    keep = _kept(b, starts)
    if len(b) and len(before) and b[0] == before[-1] == 0x20:
        keep[0] = False
    return b[keep]


def _lowered(buf: np.ndarray) -> np.ndarray:
    b = _LETTERS[buf]
    lead = np.flatnonzero(buf[:-1] == 0xC3) if len(buf) else np.zeros(0, np.int64)
    second = b[lead + 1]
    b[lead[(second >= 0x80) & (second <= 0x9E)] + 1] += 0x20
    return b


def _kept(b: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """All but blanks after a blank of the same text."""
    keep = np.ones(len(b), dtype=bool)
    if len(b) > 1:
        keep[1:] = (b[1:] != 0x20) | (b[:-1] != 0x20)
    keep[starts[starts < len(b)]] = True
    return keep


def _gram_hashes(x: np.ndarray, order: int) -> np.ndarray:
    m = len(x) - order + 1
    h = x[:m] + np.uint32(order << 24)
    for i in range(1, order):
        h = h * np.uint32(0x01000193) + x[i : i + m]
    return (h * np.uint32(0x9E3779B1)) >> np.uint32(18)


def count_ngrams(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of hashed n-grams, a row of DIMS for each text. No n-gram crosses texts."""
    n = len(offsets) - 1
    b = _lowered(buf)
    keep = _kept(b, offsets[:-1])
    doc = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets))[keep]
    x = b[keep].astype(np.uint32)
    total = np.zeros(n * DIMS, dtype=np.int64)
    for order in (1, 2, 3):
        if len(x) >= order:
            inside = doc[: len(x) - order + 1] == doc[order - 1 :]
            at = _gram_hashes(x, order)[inside].astype(np.int64) + doc[: len(inside)][inside].astype(np.int64) * DIMS
            total += np.bincount(at, minlength=n * DIMS)
    return total.reshape(n, DIMS)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts.astype(np.float32)) * idf
    size = np.sqrt(np.einsum("ij,ij->i", v, v))
    return v / np.maximum(size, 1e-12)[:, None]


def length_class(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(counts.sum(axis=1), 1)).astype(np.int64), LENGTH_CLASSES - 1)


def _blocks(column: pa.Array, rows: int = 1_024) -> Iterator[np.ndarray]:
    """Counts of the texts of a column, some hundred texts at a time."""
    from ._bytes import AT_ONCE, chunks, utf8

    for at in range(0, len(column), rows):
        buf, offsets = utf8(column.slice(at, rows))
        for i, j in chunks(offsets):
            if j - i == 1 and offsets[j] - offsets[i] > AT_ONCE:
                yield count_long(buf[offsets[i] : offsets[j]], AT_ONCE)
                continue
            for k in range(i, j, 32):
                e = min(j, k + 32)
                yield count_ngrams(buf[offsets[k] : offsets[e]], offsets[k : e + 1] - offsets[k])


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(DIMS, dtype=np.int64)
    for batch in batches:
        for counts in _blocks(batch.column(0)):
            total += (counts > 0).sum(axis=0)
    found = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["gram", "n"])


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Unit centroids and each row's cosine to its own; starts from rows far from each other."""
    rng = np.random.default_rng(seed)
    c = x[[int(rng.integers(len(x)))]]
    while len(c) < min(k, len(x)):
        far = 1 - (x @ c.T).max(axis=1)
        far = np.maximum(far, 0) ** 2
        if far.sum() <= 1e-9:
            break
        c = np.vstack([c, x[[int(np.searchsorted(np.cumsum(far) / far.sum(), rng.random()).clip(0, len(x) - 1))]]])
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        sums = np.vstack([_sum_of(x, own == j) if (own == j).any() else c[j] for j in range(len(c))])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1), 1e-12)[:, None]
    return c.astype(np.float32), (x @ c.T).max(axis=1)


def _sum_of(x: np.ndarray, rows: np.ndarray, columns: int = 1_024) -> np.ndarray:
    """The sum of some rows, without a copy of all of them."""
    return np.concatenate([x[rows, i : i + columns].sum(axis=0) for i in range(0, x.shape[1], columns)])


def _fit_language(idf: np.ndarray, k: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        x, sizes, at = np.empty((len(table), DIMS), dtype=np.float32), np.empty(len(table), dtype=np.int64), 0
        for counts in _blocks(table.column("text")):  # counts are let go block by block
            x[at : at + len(counts)], sizes[at : at + len(counts)] = vectors(counts, idf), length_class(counts)
            at += len(counts)
        c, cos = spherical_kmeans(x, k)
        low = [float(cos[sizes == s].min()) if (sizes == s).any() else None for s in range(LENGTH_CLASSES)]
        lang = table.column("lang")[0].as_py()
        return pa.table({"lang": [lang] * len(c), "centroid": [row.tobytes() for row in c], "low": [low] * len(c)}, schema=_FITTED)

    return run


_FITTED = pa.schema([("lang", pa.string()), ("centroid", pa.binary()), ("low", pa.list_(pa.float64()))])


def _drawn(train: DataFrame, counts: dict[str, int], per_language: int) -> DataFrame:
    """About ``per_language`` rows of each language, by a hash of id and text."""
    share = train.sparkSession.createDataFrame([(k, min(1.0, per_language / n)) for k, n in counts.items()], "lang string, share double")
    draw = F.pmod(F.xxhash64(F.lit(3), "doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return train.join(F.broadcast(share), "lang").filter(draw < F.col("share")).select("doc_id", "text", "lang").distinct()


def fit(train: DataFrame, per_language: int = 1_000, centroids: int = 4) -> Model | None:
    """Learn from ``train``(doc_id, text, lang); None if nothing is labelled.

    To the driver come: label counts, DIMS document frequencies, and the centroids
    (``centroids`` rows of 64 KiB a label at most).
    """
    ship(train.sparkSession)
    train = train.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & has_letter("text"))
    labels = train.groupBy("lang").count().collect()
    if not labels:
        return None
    pairs = train.select("text").mapInArrow(tidy(_document_frequencies), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    n = sum(r["count"] for r in labels)
    df = np.zeros(DIMS)
    df[[r["gram"] for r in pairs]] = [r["n"] for r in pairs]
    idf = (np.log((1 + n) / (1 + df)) + 0.1).astype(np.float32)
    sample = _drawn(train, {r["lang"]: r["count"] for r in labels}, per_language)
    fitted = sample.groupBy("lang").applyInArrow(_fit_language(idf, centroids), "lang string, centroid binary, low array<double>").collect()
    fitted.sort(key=lambda r: (r["lang"], r["centroid"]))
    languages = sorted({r["lang"] for r in fitted})
    low = np.array([[np.nan if v is None else v for v in r["low"]] for r in fitted], dtype=float)
    floor = np.full(LENGTH_CLASSES, np.nan)
    seen = ~np.isnan(low).all(axis=0)
    floor[seen] = np.nanmin(low[:, seen], axis=0) / 3
    for i in range(LENGTH_CLASSES):  # lengths not seen in training: the most lenient of the seen
        if np.isnan(floor[i]):
            floor[i] = np.nanmin(floor[seen])
    return Model(languages, np.vstack([np.frombuffer(r["centroid"], dtype=np.float32) for r in fitted]), np.array([languages.index(r["lang"]) for r in fitted]), idf, floor)


def has_letter(text: str | Column) -> Column:
    return text_of(text).rlike(r"\p{L}")


def _predict(shared, text_col: str, rows: int = 1_024):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = pa.array(m.languages)
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                best, score, far = [], [], []
                for counts in _blocks(batch.column(text_col)):
                    cos = vectors(counts, m.idf) @ m.centroids.T
                    own = cos.argmax(axis=1)
                    top = cos[np.arange(len(own)), own]
                    best.append(m.language_of[own])
                    score.append(np.clip(top.astype(float), 0, 1))
                    far.append(top < m.floor[length_class(counts)])
                cols = [np.concatenate(c) if c else np.zeros(0, kind) for c, kind in ((best, np.int64), (score, float), (far, bool))]
                yield pa.RecordBatch.from_arrays([*batch.columns, names.take(pa.array(cols[0])), pa.array(cols[1]), pa.array(cols[2])], names=[*batch.schema.names, "__lang", "__score", "__far"])

    return run


def predict(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with ``lang_pred``, ``score`` and ``rejected`` (in place of columns of these names)."""
    docs = docs.drop(*[c for c in ("lang_pred", "score", "rejected") if c in docs.columns])
    if model is None:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0), "rejected": F.lit(True)})
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = (("__letter", "boolean"), ("__lang", "string"), ("__score", "double"), ("__far", "boolean"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), *(f"{n} {t}" for n, t in added)])
    out = docs.withColumn("__letter", has_letter(text_col)).mapInArrow(tidy(_predict(shared, text_col)), schema)
    return out.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.when(F.col("__letter"), F.col("__lang")).otherwise("und").alias("lang_pred"),
        F.when(F.col("__letter"), F.col("__score")).otherwise(0.0).alias("score"),
        (~F.col("__letter") | F.col("__far")).alias("rejected"),
    )


def held_out(id_col: str = "doc_id") -> Column:
    """The third of the ids that is never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, **options) -> DataFrame:
    """Learn from the labelled rows that are not held out and predict all rows of ``docs``(doc_id, text, lang)."""
    train = docs.filter(~held_out() & F.col("doc_id").isNotNull())
    return predict(docs, fit(train, **options))
