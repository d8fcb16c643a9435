"""Word vectors: means, cosines, spread of uses, substitution and incongruity.

vectors(word, v) holds unit vectors as ARRAY<FLOAT>. Sums and products are doubles, a
mean is stored as floats again.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..functions.text import let


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") + y.cast("double"))


def total(vs: Column) -> Column:
    """Sum of an array of vectors; null if there is none."""

    def fold(own: Column) -> Column:
        first = F.transform(F.get(own, F.lit(0)), lambda x: x.cast("double"))
        return F.when(F.size(own) > 0, F.aggregate(F.slice(own, F.lit(2), F.greatest(F.size(own) - 1, F.lit(0))), first, add))

    return let(vs, fold)


def unit(v: Column, kind: str = "float") -> Column:
    """Unit length, as floats or another ``kind``; null for null or a zero vector."""
    scaled = lambda s: F.when(s["n"] > 0, F.transform(s["v"], lambda x: (x.cast("double") / s["n"]).cast(kind)))
    return let(v, lambda w: let(F.struct(w.alias("v"), F.sqrt(dot(w, w)).alias("n")), scaled))


def normalized(raw: DataFrame, kind: str = "float") -> DataFrame:
    """``raw``(word, v) with unit vectors; zero vectors are dropped."""
    return raw.select("word", unit(F.col("v"), kind).alias("v")).filter("v is not null")


#: Most words and bags of a cell of ``means``, and fewest words for which it is worth a cell of its own.
CELL_WORDS, CELL_BAGS, LEAST_WORDS = 3 << 20, 1 << 18, 1 << 20
#: Bags and words that are summed at once.
ROWS, STEP = 1_024, 1 << 14


def means(bags: DataFrame, keys: list[str], vectors: DataFrame) -> DataFrame:
    """``bags``(keys..., words array) -> keys..., mean, known: mean of the words in the table, with multiplicity.

    Bags are dealt into cells of bounded size, and a word's vector goes once to each cell that has the word: neither a
    vector for each use nor a sum is shuffled. ``keys`` tell bags apart; words have no line breaks.
    """
    bags = bags.select(*keys, "words")
    n = bags.agg(F.coalesce(F.sum(F.size("words")), F.lit(0)).alias("words"), F.count("*").alias("bags")).first()
    most = max(-(-n.words // CELL_WORDS), -(-n.bags // CELL_BAGS), 1)
    cells = max(most, min(bags.sparkSession.sparkContext.defaultParallelism, -(-n.words // LEAST_WORDS)))
    cell = F.pmod(F.xxhash64(*keys), F.lit(cells))
    # which words a cell has is told by short hashes: a vector too many does no harm
    needed = bags.select(cell.alias("of"), F.explode(F.array_distinct("words")).alias("word")).select("of", F.hash("word").alias("h")).distinct()
    table = needed.join(vectors.select("word", "v", F.hash("word").alias("h")), "h").select("of", "word", "v")
    own = bags.select(cell.alias("cell"), *keys, F.array_join("words", "\n").alias("words"))
    schema = T.StructType([*bags.drop("words").schema, T.StructField("mean", T.ArrayType(T.FloatType())), T.StructField("known", T.IntegerType())])
    return own.groupBy("cell").cogroup(table.groupBy("of")).applyInArrow(_mean_of(keys), schema)


def _mean_of(keys: list[str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def mean(left: pa.Table, right: pa.Table) -> pa.Table:
        words, n = pc.split_pattern(left["words"].combine_chunks(), "\n"), left.num_rows
        size = pc.fill_null(pc.list_value_length(words), 0).to_numpy()
        at = pc.fill_null(pc.index_in(pc.list_flatten(words), value_set=right["word"].combine_chunks()), -1).to_numpy()
        del words
        of, v = np.repeat(np.arange(n, dtype=np.int32), size)[at >= 0], _matrix(right["v"].combine_chunks())
        at = at[at >= 0]
        known, dim = np.bincount(of, minlength=n), v.shape[1]
        first = np.concatenate([[0], np.cumsum(known)])
        out, there = np.zeros((n, dim), np.float32), np.zeros(n, bool)
        for r in range(0, n, ROWS):
            end = min(r + ROWS, n)
            sums = np.zeros((end - r, dim))
            for a in range(first[r], first[end], STEP):
                b = min(a + STEP, first[end])
                row = of[a:b] - r
                starts = np.flatnonzero(np.diff(row, prepend=-1))
                sums[row[starts]] += np.add.reduceat(v[at[a:b]].astype(np.float64), starts, axis=0)
            length = np.sqrt((sums * sums).sum(axis=1))
            there[r:end] = (known[r:end] > 0) & ~(length == 0)
            out[r:end] = sums / np.where(length == 0, 1, length)[:, None]
        offsets = np.concatenate([[0], np.cumsum(there * dim)]).astype(np.int32)
        mean = pa.ListArray.from_arrays(pa.array(offsets), pa.array(out[there].ravel()), mask=pa.array(~there))
        pa.default_memory_pool().release_unused()
        return pa.table([*(left[k] for k in keys), mean, pa.array(known.astype(np.int32))], names=[*keys, "mean", "known"])

    return mean


def _matrix(v: pa.ListArray) -> np.ndarray:
    """Vectors as rows; where some are shorter, what they lack is 0."""
    size = pc.list_value_length(v).to_numpy()
    flat = pc.list_flatten(v).to_numpy(zero_copy_only=False)
    if len(size) == 0 or (size == size[0]).all():
        return flat.reshape(len(size), -1 if len(flat) else 0)
    out = np.zeros((len(size), size.max()), flat.dtype)
    out[np.arange(size.max()) < size[:, None]] = flat
    return out


def vocabulary(uses: DataFrame, candidates: DataFrame) -> DataFrame:
    """word: all that substitution can ask for. Pruning only, results never depend on it."""
    used = uses.select(F.explode("tokens").alias("word"))
    parts = candidates.select(F.explode(F.split("word", r"\s+")).alias("word"))
    marks = candidates.select(F.explode(F.concat(F.array("lemma"), tx.mark_parts(F.col("lemma")))).alias("word"))
    return used.unionByName(parts).unionByName(marks).distinct()


def spread(bags: DataFrame, vectors: DataFrame, by: list[str]) -> DataFrame:
    """``bags``(by..., use_no, words) -> by..., uses, clustered: mean pairwise cosine of the uses' vectors.

    (|sum|^2 - sum of |v|^2) / (n (n - 1)) is that mean without listing pairs.
    """
    m = means(bags, [*by, "use_no"], vectors).filter("mean is not null")
    agg = m.groupBy(*by).agg(F.collect_list("mean").alias("vs")) if by else m.agg(F.collect_list("mean").alias("vs"))
    n = F.size("vs")
    square = let(total(F.col("vs")), lambda s: dot(s, s))
    own = F.aggregate(F.transform("vs", lambda v: dot(v, v)), F.lit(0.0), lambda a, x: a + x)
    return agg.select(*by, n.alias("uses"), F.when(n > 1, (square - own) / (n * (n - 1))).otherwise(0.0).alias("clustered"))


def use_bags(uses: DataFrame) -> DataFrame:
    """Uses without their target: lemma, use_no, words."""
    return uses.select("lemma", "use_no", F.filter("tokens", lambda t: t != F.col("lemma")).alias("words"))


def substitutes(uses: DataFrame, candidates: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """lemma, word, ic, cand_ord, clean, total, mean_cos: how well each candidate stands in for its lemma.

    A use's vector is compared with the one where the target gives way to the candidate's
    parts. Uses per lemma are sampled, so lemma x uses x candidates is bounded; the join is
    by lemma, against the vectors of the vocabulary only.
    """
    words = vectors.join(vocabulary(uses, candidates), "word", "left_semi")
    bags = uses.select("lemma", "use_no", F.col("tokens").alias("words"))
    whole = means(bags, ["lemma", "use_no"], words).select("lemma", "use_no", F.col("mean").alias("own"))
    rest = use_bags(uses).select("lemma", "use_no", F.explode_outer("words").alias("word")).join(words, "word", "left")
    rest = rest.groupBy("lemma", "use_no").agg(total(F.collect_list("v")).alias("rest"))
    parts = candidates.select("lemma", F.col("word").alias("cand"), "ic", "cand_ord", F.posexplode(F.split("word", r"\s+")).alias("at", "word"))
    parts = parts.filter("cand <> lemma").join(words, "word", "left").groupBy("lemma", "cand", "ic", "cand_ord").agg(total(F.collect_list("v")).alias("parts"), F.count("v").alias("known"), F.count("*").alias("n"))
    parts = parts.filter("known = n").drop("known", "n")
    both = rest.join(parts, "lemma").select("lemma", "use_no", "cand", "ic", "cand_ord", unit(F.when(F.col("rest").isNull(), F.col("parts")).otherwise(add(F.col("rest"), F.col("parts")))).alias("swapped"))
    cos = both.join(whole, ["lemma", "use_no"]).select("*", dot(F.col("own"), F.col("swapped")).alias("cos")).filter("cos is not null")
    out = cos.groupBy("lemma", F.col("cand").alias("word"), "ic", "cand_ord").agg(
        F.count_if(F.col("cos") >= threshold).alias("clean"), F.count("*").alias("total"), F.avg("cos").alias("mean_cos")
    )
    return out


def ranked(subs: DataFrame) -> DataFrame:
    """Adds ``rank``: clean, then mean cosine, then the candidates' order."""
    return subs.withColumn("rank", F.row_number().over(Window.partitionBy("lemma").orderBy(F.desc("clean"), F.desc("mean_cos"), "cand_ord")))


def incongruity(uses: DataFrame, vectors: DataFrame) -> DataFrame:
    """lemma, incongruity: 1 - cosine of the word (or the mean of its parts) and the mean of all its contexts' tokens."""
    context = uses.select("lemma", F.explode("tokens").alias("word")).filter("word <> lemma")
    mean = context.join(vectors, "word").groupBy("lemma").agg(unit(total(F.collect_list("v"))).alias("context"))
    asked = uses.select("lemma").distinct()
    own = asked.join(vectors.select(F.col("word").alias("lemma"), "v"), "lemma", "left")
    parts = asked.select("lemma", F.explode(tx.mark_parts(F.col("lemma"))).alias("word")).join(vectors, "word").groupBy("lemma")
    parts = parts.agg(unit(total(F.collect_list("v"))).alias("parts"))
    out = own.join(parts, "lemma", "left").join(mean, "lemma", "left")
    return out.select("lemma", (1 - dot(F.coalesce("v", "parts"), F.col("context"))).alias("incongruity")).filter("incongruity is not null")
