"""Near-duplicate detection: SuperMinHash signatures, banding, verification, union-find.

A document's set are the distinct shingles of ``words`` words (A-Z lower-cased); a
shorter text is one shingle. SuperMinHash gives every element one random permutation
of all signature places and a random fraction; a place keeps the least of (rank,
fraction) over the elements. The ranks are drawn round by round for all documents of
a block at once, and a document stops when no later rank can lower any place.

Documents with equal sets form a class, which one member represents. The signature
is cut into bands; representatives that agree on a band share a bucket. Every member
of a bucket is compared with the bucket's leader; pairs that the signatures put far
below the threshold are dropped and the rest is verified on full sets. Components of
the verified links are found. What matters then are pairs of a bucket that no component
joins yet: signatures are compared in blocks of at most 2,048 by 2,048, a pair in the
first band it shares only; the full sets of those that are alike enough to some other
come to their block, and pairs are verified there until a document is linked to the
other's component. A block returns verified links and nothing else: no partner is
capped, no bucket left out, and no pairs are listed. Blocks are smaller where sets are
large, so that the sets of a block stay under about 64 MB each way, or are one set.

A pair at the threshold of 0.8 shares none of 32 bands of 5 with probability 3e-6,
and less above it.

Defined cases: null and empty texts, and texts without words, have an empty set and
are linked with nothing; ties do not occur, since components are named by their
smallest doc_id, or null where no member has one; every different text is compared,
also those that share a doc_id or have none. Of a component the row with the smallest
doc_id stays (null last, then the smaller hash of the text); rows that repeat both
doc_id and text get one verdict, but of rows with no doc_id ``drop_near_copies`` keeps
one of each text. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import byte_table, chunks, mix, span_hashes, utf8, word_spans
from ._common import discard, ship, text_of, tidy, written
from .graph import components

_WORDS = byte_table(29, lower=True)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_TOP = np.iinfo(np.int64).max


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit hashes, one text after the other, and n + 1 offsets."""
    starts, ends, first = word_spans(buf, offsets)
    h = span_hashes(buf, starts, ends, _WORDS)
    count = np.diff(first)
    per = np.where(count >= words, count - words + 1, (count > 0).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(per)])
    rolled = np.zeros(max(0, len(h) - words + 1), dtype=np.uint64)
    for i in range(words):
        rolled = mix(rolled * _STEP + h[i : len(h) - words + 1 + i] + np.uint64(i + 1))
    doc = np.repeat(np.arange(len(per)), per)
    at = np.arange(begin[-1]) - begin[doc] + first[doc]
    out = np.zeros(begin[-1], dtype=np.uint64)
    long = count[doc] >= words
    out[long] = rolled[at[long]]
    for d in np.flatnonzero((count > 0) & (count < words)).tolist():
        whole = np.uint64(count[d])
        with np.errstate(over="ignore"):
            for x in h[first[d] : first[d + 1]]:
                whole = mix(np.array([whole * _STEP + x]))[0]
        out[begin[d]] = whole
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        if b - a > 1:
            out[a:b].sort()
    fresh = np.ones(len(out), dtype=bool)
    fresh[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    sizes = np.bincount(doc[fresh], minlength=len(per)) if len(doc) else np.zeros(len(per), np.int64)
    return out[fresh], np.concatenate([[0], np.cumsum(sizes)])


def superminhash(elements: np.ndarray, offsets: np.ndarray, places: int) -> np.ndarray:
    """Signatures (one row per set): rank << 32 | fraction of the least element at each place; empty sets are all _TOP."""
    n = len(offsets) - 1
    # elements are taken in turns of bounded size, also those of one long document: a place keeps the least over all turns
    sig = np.full((n, places), _TOP, dtype=np.int64)
    flat = sig.reshape(-1)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    kind = np.uint8 if places <= 256 else np.uint16
    for at in range(0, len(elements), 60_000):
        own, d = elements[at : at + 60_000], doc[at : at + 60_000]
        order = np.tile(np.arange(places, dtype=kind), (len(own), 1))
        rows = np.arange(len(own))
        for j in range(places):
            if not len(own):
                break
            u = mix(own + np.uint64((j + 1) * int(_STEP) & 0xFFFFFFFFFFFFFFFF))
            pick = j + (((u & np.uint64(0xFFFFFFFF)) * np.uint64(places - j)) >> np.uint64(32)).astype(np.int64)
            place = order[rows, pick].astype(np.int64)
            order[rows, pick] = order[rows, j]
            value = (u >> np.uint64(32)).astype(np.int64) | (j << 32)
            np.minimum.at(flat, d * places + place, value)
            docs = np.unique(d)
            open_ = docs[sig[docs].max(axis=1) >= (j + 1) << 32]
            if len(open_) < len(docs):
                stay = np.isin(d, open_)
                own, d, order = own[stay], d[stay], order[stay]
                rows = np.arange(len(own))
    return sig


def band_hashes(sig: np.ndarray, bands: int) -> np.ndarray:
    rows = sig.shape[1] // bands
    parts = sig[:, : bands * rows].reshape(len(sig), bands, rows).astype(np.uint64)
    h = np.arange(1, bands + 1, dtype=np.uint64)[None, :] * _STEP
    for i in range(rows):
        h = mix(h + parts[:, :, i])
    return h.view(np.int64)


def _features(words: int, places: int, bands: int):
    names = ["doc_id", "text_key", "n_shingles", "c1", "c2", "bands", "sig"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = utf8(batch.column(1))
            for i, j in chunks(offsets):
                sets, at = shingle_sets(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)
                size = np.diff(at)
                sig = superminhash(sets, at, places)
                c1, c2 = (np.zeros(j - i, dtype=np.uint64) for _ in range(2))
                some = np.flatnonzero(size)
                if len(some):
                    c1[some] = np.add.reduceat(mix(sets), at[some])
                    c2[some] = np.bitwise_xor.reduceat(mix(sets ^ _STEP), at[some])
                keys = band_hashes(sig, bands)
                short = mix(sig.astype(np.uint64)).astype("<u2")
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        batch.column(2).slice(i, j - i),
                        pa.array(size.astype(np.int64)),
                        pa.array(c1.view(np.int64)),
                        pa.array(c2.view(np.int64)),
                        pa.ListArray.from_arrays(np.arange(0, keys.size + 1, bands, dtype=np.int32), pa.array(keys.reshape(-1))),
                        pa.array([r.tobytes() for r in short], pa.binary()),
                    ],
                    names=names,
                )

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = utf8(batch.column(1))
            for i, j in chunks(offsets):
                sets, at = shingle_sets(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)
                data, edges = sets.tobytes(), (at * 8).tolist()
                blobs = pa.array([data[a:b] for a, b in zip(edges, edges[1:], strict=False)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), blobs], names=["node", "items"])

    return run


def _alike(least: float):
    """Keeps pairs whose signatures agree on a share of ``least`` of the places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(utf8(b.column(c))[0].tobytes(), dtype="<u2").reshape(b.num_rows, -1) for c in ("sig_a", "sig_b"))
                yield b.select(["a", "b"]).filter(pa.array((x == y).mean(axis=1) >= least))

    return run


def _verify(percent: int):
    """Keeps pairs with 100 * intersection >= percent * union of their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = zip(b.column("items_a"), b.column("items_b"), strict=True)
            keep = [_alike_sets(*(np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in p), percent) for p in pairs]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


_BLOCK = "bucket long, row long, column long, asks boolean, node long, label long, sig binary, bands array<long>"


def _plausible(table: pa.Table, least: float) -> Iterator[tuple[int, np.ndarray]]:
    """Of one block of a bucket: places of the asking documents with the places of those that their signatures
    allow, in other components, the most alike first. A pair belongs to the first band it shares."""
    asks, bucket = table.column("asks").to_numpy(), table.column("bucket")[0].as_py()
    node, label = table.column("node").to_numpy(), table.column("label").to_numpy()
    sig = utf8(table.column("sig"))[0].copy().view("<u2").reshape(len(node), -1)
    bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(node), -1)
    members = np.flatnonzero(~asks)
    if not len(members):
        return
    for i in np.flatnonzero(asks).tolist():
        alike = (sig[members] == sig[i]).mean(axis=1)
        c = np.flatnonzero((alike >= least) & (label[members] != label[i]))
        shared = (bands[members[c]] == bands[i]).argmax(axis=1)
        c = c[bands[i][shared] == bucket]
        if len(c):
            yield i, members[c][np.lexsort((node[members[c]], -alike[c]))]


def _involved(least: float):
    """Of one block: the rows that some pair needs."""

    def run(table: pa.Table) -> pa.Table:
        needed = np.zeros(len(table), dtype=bool)
        for i, partners in _plausible(table, least):
            needed[i] = True
            needed[partners] = True
        return table.select(_BLOCK_NAMES).filter(pa.array(needed))

    return run


_BLOCK_NAMES = [c.split()[0] for c in _BLOCK.split(", ")]


def _alike_sets(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    if min(len(s), len(t)) * 100 < percent * max(len(s), len(t)):
        return False
    shared = len(np.intersect1d(s, t, assume_unique=True))
    return 100 * shared >= percent * (len(s) + len(t) - shared)


def _verify_blocks(percent: int, least: float):
    """Of one block: one verified link of each asking document to each other component that has one."""

    def run(table: pa.Table) -> pa.Table:
        node, label, items = table.column("node").to_pylist(), table.column("label").to_pylist(), table.column("items")
        one = lambda i: np.frombuffer(items[i].as_buffer(), dtype=np.uint64)
        out = []
        for i, partners in _plausible(table, least):
            linked, own = set(), one(i)
            for j in partners.tolist():
                if label[j] not in linked and _alike_sets(own, one(j), percent):
                    linked.add(label[j])
                    out.append((min(node[i], node[j]), max(node[i], node[j])))
        return pa.table([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return run


class _Links:
    """Compares pairs of representatives: by signature, then on full sets."""

    def __init__(self, texts: DataFrame, reps: DataFrame, words: int, percent: int):
        self.texts, self.reps, self.words, self.percent = texts, reps, words, percent
        self.least = percent / 100 - 0.15

    def alike(self, pairs: DataFrame) -> DataFrame:
        sig = self.reps.select("node", "sig")
        own = pairs.join(sig.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")).hint("merge"), "a")
        own = own.join(sig.select(F.col("node").alias("b"), F.col("sig").alias("sig_b")).hint("merge"), "b")
        return written(own.mapInArrow(tidy(_alike(self.least)), "a long, b long"), "minhash-near")

    def sets(self, nodes: DataFrame) -> DataFrame:
        """node, items: the full sets of ``nodes``(node)."""
        asked = self.reps.select("node", F.col("doc_id").alias("own"), "text_key").join(nodes.distinct().hint("merge"), "node")
        same = self.texts["doc_id"].eqNullSafe(asked["own"]) & (F.xxhash64(self.texts["text"]) == asked["text_key"])
        texts = self.texts.join(asked.hint("merge"), same).select("node", "text").dropDuplicates(["node"])
        return written(texts.mapInArrow(tidy(_sets(self.words)), "node long, items binary"), "minhash-sets")

    def verified(self, near: DataFrame) -> DataFrame:
        sets = self.sets(near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))))
        both = near.join(sets.select(F.col("node").alias("b"), F.col("items").alias("items_b")).hint("merge"), "b")
        both = both.join(sets.select(F.col("node").alias("a"), F.col("items").alias("items_a")).hint("merge"), "a")
        links = written(both.mapInArrow(tidy(_verify(self.percent)), "a long, b long"), "minhash-links")
        discard(near, sets)
        return links

    def across(self, member: DataFrame, labels: DataFrame, block: int = 2_048, block_bytes: int = 64 << 20) -> DataFrame:
        """Verified links (a, b) between components that share buckets: all that matter for components."""
        own = member.filter("n > 2").join(labels.withColumnRenamed("component", "label").hint("merge"), "node", "left")
        own = own.select("bucket", "node", F.coalesce("label", "node").alias("label"), (F.col("n_shingles") * 8).alias("bytes"))
        own = written(own, "minhash-labels")
        sizes = own.groupBy("bucket", "label").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
        # rows of blocks hold all members of a bucket, columns those outside its largest component
        main = sizes.groupBy("bucket").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("most"), F.sum("bytes").alias("bytes"))
        parts = lambda n: F.greatest(F.ceil(n / block), F.ceil(n / F.col("n") * F.col("bytes") / block_bytes))
        main = main.filter("most < n").withColumn("rows", parts(F.col("n"))).withColumn("columns", parts(F.col("n") - F.col("most")))
        main = written(main.select("bucket", "main", "rows", "columns"), "minhash-main")
        mixed = own.drop("bytes").join(main.hint("merge"), "bucket").join(self.reps.select("node", "sig", "bands").hint("merge"), "node")
        mixed = written(mixed, "minhash-mixed")
        place = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        members = mixed.withColumn("row", place("rows")).withColumn("column", every("columns")).withColumn("asks", F.lit(False))
        asking = mixed.filter("label <> main").withColumn("row", every("rows")).withColumn("column", place("columns")).withColumn("asks", F.lit(True))
        keys = ["bucket", "row", "column"]
        blocks = members.unionByName(asking).select(*_BLOCK_NAMES)
        met = written(blocks.groupBy(*keys).applyInArrow(_involved(self.least), _BLOCK), "minhash-involved")
        sets = self.sets(met.select("node"))
        found = met.join(sets.hint("merge"), "node").groupBy(*keys).applyInArrow(_verify_blocks(self.percent, self.least), "a long, b long")
        links = written(found.distinct(), "minhash-across")
        discard(own, main, mixed, met, sets)
        return links


def _pairs(rows: DataFrame) -> DataFrame:
    return rows.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def find_groups(
    docs: DataFrame, words: int = 5, percent: int = 80, bands: int = 32, rows: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, text_key, n_shingles, class_id, component_id, kept: one row per document."""
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    features = written(
        texts.withColumn("text_key", F.xxhash64("text")).mapInArrow(tidy(_features(words, bands * rows, bands)), "doc_id long, text_key long, n_shingles long, c1 long, c2 long, bands array<long>, sig binary"), "minhash-features"
    )
    some = features.filter("n_shingles > 0")
    # a class is a node of its own number; its member with the smallest doc_id, null last, stands for it
    member = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", "bands", "sig")
    named = some.groupBy("c1", "c2", "n_shingles").agg(F.min(member).alias("r"))
    reps = named.select("c1", "c2", "n_shingles", F.monotonically_increasing_id().alias("node"), "r.doc_id", "r.text_key", "r.bands", "r.sig")
    reps = written(reps, "minhash-classes")

    buckets = reps.select("node", "n_shingles", F.explode("bands").alias("bucket"))
    # one order of the nodes for all bands: a group's buckets agree on few leaders
    first = F.min(F.struct(F.xxhash64("node").alias("d"), "node"))["node"]
    counted = buckets.groupBy("bucket").agg(F.count("*").alias("n"), first.alias("leader"))
    full = written(counted.filter("n > 1"), "minhash-buckets")
    member = written(buckets.join(full.hint("merge"), "bucket"), "minhash-members")
    compare = _Links(texts, reps, words, percent)
    near = compare.alike(_pairs(member.select(F.col("node").alias("x"), F.col("leader").alias("y"))))
    links = compare.verified(near)
    more = compare.across(member, components(links))
    labels = components(links.unionByName(more))
    named = reps.select("c1", "c2", "n_shingles", "node", "doc_id", "text_key").join(labels.hint("merge"), "node", "left")
    named = written(named.withColumn("component", F.coalesce("component", "node")).drop("node"), "minhash-named")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("first")
    stays = written(named.groupBy("component").agg(first), "minhash-stays")
    discard(reps, full, member, links, more)
    named = named.withColumnRenamed("doc_id", "class_id").drop("text_key").join(stays.hint("merge"), "component")
    named = named.select("c1", "c2", "n_shingles", "class_id", "first")
    linked = some.select("doc_id", "text_key", "n_shingles", "c1", "c2").join(named.hint("merge"), ["c1", "c2", "n_shingles"])
    stay = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
    linked = linked.select("doc_id", "text_key", "n_shingles", "class_id", F.col("first.doc_id").alias("component_id"), stay.alias("kept"))
    own = [F.col("doc_id").alias(c) for c in ("class_id", "component_id")]
    alone = features.filter("n_shingles = 0").select("doc_id", "text_key", "n_shingles", *own, F.lit(True).alias("kept"))
    return linked.unionByName(alone)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay: of each group the one with the smallest doc_id.

    Of rows that repeat both doc_id and text one stays, and so of rows without an id that repeat their text.
    """
    found = find_groups(docs, id_col=id_col, text_col=text_col, **options)
    marks = found.groupBy(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).agg(F.max("kept").alias("__kept"), F.count("*").alias("__rows"))
    marks = written(marks.filter("not __kept or __rows > 1"), "minhash-marks")
    same = docs[id_col].cast("long").eqNullSafe(marks["__id"]) & (F.xxhash64(text_of(docs[text_col])) == marks["__key"])
    rows = docs.join(marks.hint("merge"), same, "left")
    once = rows.filter("__kept is null").select(*[docs[c] for c in docs.columns])
    again = rows.filter("__kept").withColumn("__text", text_of(docs[text_col])).dropDuplicates(["__id", "__text"]).select(*[docs[c] for c in docs.columns])
    return once.unionByName(again)
