"""Document fingerprints: a Merkle tree over pieces, paragraphs and sections.

A text is cut into paragraphs (lines) and a paragraph into pieces: sentences, and within
a sentence after a word whose last letter says so. Cuts depend on what stands there and
not on where it stands, so pieces after an edit are the old ones again; only stretches
without such a word are cut by length. A paragraph's node is an MD5 digest of its text, a
section's (eight paragraphs) one of its paragraphs' nodes, the root one of its sections':
128 bits each, so equal roots mean equal texts. A piece's node is a short hash of its text with its length;
pieces only measure likeness where paragraphs differ.

Two trees are compared from the root down. Equal sections at both ends are passed
over, then equal paragraphs at both ends of what is left: what remains are the
branches that differ, which locate the edit. Only there pieces are compared. The
likeness is the share of text under equal branches and equal pieces. Everything is
built-in column functions.

The next document (ascending id, the first after the last) is found within blocks of
the id order: approximate quantiles make stretches, even division of a stretch makes
blocks of some thousand rows. The first row of each block is also dealt to the block
before it, and a window within the block looks one row ahead. Texts are shuffled once.
The driver receives ``CUTS`` quantiles; the table of first rows, one for each block, is
broadcast and has at most ``MOST_BLOCKS`` rows of three numbers.

Defined cases: null is the empty text; equal ids are ordered by text; null ids come
first, ordered by a hash of their text; an only row is its own next; an empty table gives
an empty result; columns that are named like a result column are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import partitions, text_of

#: Paragraphs of a section.
SECTION = 8
#: A piece: at least 12 characters and the end of a word on one of five letters, or the end of a sentence.
PIECE_PATTERN = r"(?:[^.!?]{12,47}?(?:(?<=[dlnry])\x20|(?=[.!?])|\z)|[^.!?]{1,48})[.!?]{0,14}|[.!?]{1,62}"
_LENGTH_BITS = 0x3F
CUTS, MOST_BLOCKS = 256, 1_000_000


# ---- trees


def _piece(text: Column) -> Column:
    """A piece's node, 48 bits: 42 of hash and 6 of length."""
    return F.shiftrightunsigned(F.xxhash64(text), 16).bitwiseAND(F.lit(~_LENGTH_BITS).cast("long")).bitwiseOR(F.length(text).cast("long"))


def _node(content: Column) -> Column:
    """128 bits over a paragraph's text or over the nodes below."""
    return F.unhex(F.md5(content))


def _joined(nodes: Column) -> Column:
    return F.array_join(F.transform(nodes, F.hex), "")


def _pieces(paragraph: Column) -> Column:
    return F.transform(F.regexp_extract_all(paragraph, F.lit(PIECE_PATTERN), F.lit(0)), _piece)


def fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the tree of column ``text`` as struct ``name``(root, sections, paragraphs, leaves: the pieces of each paragraph)."""
    df = df.withColumn("__lines", F.split(text_of(text), "\n", -1)).withColumn("__pieces", F.transform("__lines", _pieces))
    df = df.withColumn("__paragraphs", F.transform("__lines", _node))
    starts = F.sequence(F.lit(1), F.size("__paragraphs"), F.lit(SECTION))
    df = df.withColumn("__sections", F.transform(starts, lambda i: _node(_joined(F.slice("__paragraphs", i, SECTION)))))
    root = F.lower(F.hex(_node(_joined(F.col("__sections")))))
    tree = F.struct(root.alias("root"), F.col("__sections").alias("sections"), F.col("__paragraphs").alias("paragraphs"), F.col("__pieces").alias("leaves"))
    return df.withColumn(name, tree).drop("__lines", "__pieces", "__paragraphs", "__sections")


def as_string(tree_: str) -> Column:
    """root|sections|paragraphs|leaves, nodes in hexadecimal joined by commas."""
    level = lambda c: F.array_join(F.transform(c, lambda h: F.lower(F.hex(h))), ",")
    return F.concat_ws("|", F.col(f"{tree_}.root"), level(f"{tree_}.sections"), level(f"{tree_}.paragraphs"), level(F.flatten(f"{tree_}.leaves")))


# ---- comparing from the root down


def _weight(leaves: Column) -> Column:
    return F.aggregate(leaves, F.lit(0).cast("long"), lambda a, h: a + h.bitwiseAND(F.lit(_LENGTH_BITS).cast("long")))


def _alike(x: Column, y: Column) -> Column:
    """How many nodes two lists begin with alike."""
    differs = F.array_position(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), F.lit(False))
    return F.when(differs == 0, F.size(x)).otherwise(differs - 1).cast("int")


def _rest(x: Column, first: Column, stop: Column) -> Column:
    return F.slice(x, first + 1, F.greatest(stop - first, F.lit(0)))


def walk(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Adds struct ``name``(first, in_a, in_b, likeness): from paragraph ``first`` (from 0) on, ``in_a`` paragraphs of
    ``a`` stand where ``b`` has ``in_b``; what is before and after them is under equal branches.

    ``likeness`` is the share of text of both, 0 to 1, under equal branches or, between the branches that
    differ, in equal pieces.
    """
    own = [f"__w_{c}" for c in ("head", "tail", "enda", "endb", "skip", "first", "back", "stopa", "stopb", "la", "lb", "wa", "wb")]
    head, tail, enda, endb, skip, first, back, stopa, stopb, la, lb, wa, wb = own
    col, sections, paragraphs = F.col, "sections", "paragraphs"
    part = lambda tree, level: F.col(f"{tree}.{level}")
    # sections alike from the front; of the others, alike from the back
    df = df.withColumn(head, _alike(part(a, sections), part(b, sections)))
    ends = [F.reverse(_rest(part(t, sections), col(head), F.size(part(t, sections)))) for t in (a, b)]
    df = df.withColumn(tail, _alike(*ends))
    # the paragraphs of the sections between them
    for end, tree in ((enda, a), (endb, b)):
        inside = (F.size(part(tree, sections)) - col(tail)) * SECTION
        df = df.withColumn(end, F.when(col(tail) > 0, inside).otherwise(F.size(part(tree, paragraphs))))
    df = df.withColumn(skip, F.least(col(head) * SECTION, col(enda), col(endb)))
    middle = [_rest(part(t, paragraphs), col(skip), col(e)) for t, e in ((a, enda), (b, endb))]
    df = df.withColumn(first, col(skip) + _alike(*middle))
    ends = [F.reverse(_rest(part(t, paragraphs), col(first), col(e))) for t, e in ((a, enda), (b, endb))]
    df = df.withColumn(back, _alike(*ends))
    df = df.withColumn(stopa, col(enda) - col(back)).withColumn(stopb, col(endb) - col(back))
    # the pieces of the paragraphs that differ
    for leaves, tree, stop in ((la, a, stopa), (lb, b, stopb)):
        df = df.withColumn(leaves, F.flatten(_rest(part(tree, "leaves"), col(first), col(stop))))
    for w, tree in ((wa, a), (wb, b)):
        df = df.withColumn(w, _weight(F.flatten(part(tree, "leaves"))))
    differ = _weight(col(la)) + _weight(col(lb))
    shared = F.lit(2.0) * _weight(F.array_intersect(la, lb)) / F.nullif(_weight(F.array_distinct(la)) + _weight(F.array_distinct(lb)), F.lit(0))
    under = col(wa) + col(wb) - differ + F.coalesce(shared, F.lit(0.0)) * differ
    likeness = F.when(part(a, "root") == part(b, "root"), 1.0).otherwise(F.coalesce(under / F.nullif(col(wa) + col(wb), F.lit(0)), F.lit(0.0)))
    found = F.struct(
        col(first).alias("first"),
        (col(stopa) - col(first)).alias("in_a"),
        (col(stopb) - col(first)).alias("in_b"),
        F.least(F.greatest(likeness, F.lit(0.0)), F.lit(1.0)).alias("likeness"),
    )
    return df.withColumn(name, found).drop(*own)


def edited_paragraphs(a: str, b: str) -> Column:
    """Numbers (from 0) of the paragraphs of ``a`` whose branch differs from that of ``b`` at the same
    place; whole sections with equal nodes are passed over."""
    sections = F.sequence(F.lit(0), F.size(f"{a}.sections") - 1)
    changed = F.filter(sections, lambda i: ~F.get(f"{a}.sections", i).eqNullSafe(F.get(f"{b}.sections", i)))
    inside = F.flatten(
        F.transform(changed, lambda i: F.sequence(i * SECTION, F.least(i * SECTION + SECTION, F.size(f"{a}.paragraphs")) - 1))
    )
    return F.filter(inside, lambda i: ~F.get(f"{a}.paragraphs", i).eqNullSafe(F.get(f"{b}.paragraphs", i)))


# ---- the next document


def _block(cuts: list[int], low: int, high: int, each: int) -> Column:
    """The number of a row's block, which never falls as the id grows: ``each`` even ones between neighbouring cuts."""
    at = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("doc_id"))) if cuts else F.lit(0)
    edges = F.array(*[F.lit(float(x)) for x in (low, *cuts, high)])
    lo, hi = F.get(edges, at), F.get(edges, at + 1)
    part = F.floor((F.col("doc_id").cast("double") - lo) / (hi - lo + 1) * each)
    return at.cast("long") * each + F.least(F.greatest(part, F.lit(0)), F.lit(each - 1))


def with_next(docs: DataFrame, block_rows: int = 2_000) -> DataFrame:
    """``docs``(doc_id, text) with ``next``: the text of the next document in order of doc_id."""
    n, low, high, nameless = docs.agg(F.count("*"), F.min("doc_id"), F.max("doc_id"), F.count_if(F.col("doc_id").isNull())).first()
    blocks = min(MOST_BLOCKS // 2, max(partitions(docs.sparkSession), math.ceil(n / block_rows), 1))
    stretches = min(CUTS, blocks)
    points = [i / stretches for i in range(1, stretches)]
    cuts = docs.agg(F.percentile_approx("doc_id", points, 20 * stretches)).first()[0] if low is not None and points else []
    named = _block(sorted(set(cuts)), low or 0, high or 0, math.ceil(blocks / stretches))
    if nameless:  # rows without an id: as many blocks as they fill, in an order of their own
        hashed = F.xxhash64("text")
        of_none = math.ceil(nameless / n * blocks)
        dealt = docs.withColumn("__hash", F.when(F.col("doc_id").isNull(), hashed).otherwise(0))
        dealt = dealt.withColumn("__block", F.when(F.col("doc_id").isNull(), -1 - F.pmod("__hash", F.lit(of_none))).otherwise(named))
    else:
        dealt = docs.withColumn("__hash", F.lit(0).cast("long")).withColumn("__block", named)
    # one row for each block: its first row, and the block before it that also gets that row
    firsts = dealt.groupBy("__block").agg(F.min(F.struct("doc_id", "__hash")).alias("f"))
    by, every = Window.orderBy("__block"), Window.partitionBy()
    before = F.coalesce(F.lag("__block").over(by), F.max("__block").over(every))
    firsts = firsts.select(F.col("f.doc_id").alias("__id"), F.col("f.__hash").alias("__h"), before.alias("__to"))
    same = dealt["doc_id"].eqNullSafe(firsts["__id"]) & (dealt["__hash"] == firsts["__h"])
    ghosts = dealt.join(F.broadcast(firsts), same).select("doc_id", "text", "__hash", F.col("__to").alias("__block"), F.lit(1).alias("__ghost"))
    rows = dealt.withColumn("__ghost", F.lit(0)).unionByName(ghosts, allowMissingColumns=True)
    # beyond what the session's number of partitions is made for, a task for every two blocks
    tasks = blocks // 2
    rows = rows.repartition(tasks, "__block") if tasks > partitions(docs.sparkSession) else rows
    order = Window.partitionBy("__block").orderBy("__ghost", F.col("doc_id").asc_nulls_first(), "__hash", "text")
    return rows.withColumn("next", F.lead("text").over(order)).filter("__ghost = 0").drop("__block", "__ghost", "__hash")


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Each document's tree, that of its edited text (the last half of the code points replaced by the first
    ones of the next document), and the walks from the document's tree to the edited and to the next one's."""
    own = docs.select("doc_id", text_of("text").alias("text"))
    rows = with_next(own)
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    rows = rows.withColumn("edited", F.concat(F.expr("left(text, cast(n_chars - n_chars div 2 as int))"), F.substring("next", F.lit(1), half)))
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256))
    for text, name in (("text", "own_tree"), ("edited", "edited_tree"), ("next", "next_tree")):
        rows = fingerprint(rows, text, name)
    rows = walk(walk(rows.drop("next", "edited"), "own_tree", "edited_tree", "to_edited"), "own_tree", "next_tree", "to_next")
    return rows
