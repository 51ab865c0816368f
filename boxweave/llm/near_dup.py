"""Near-duplicate documents by b-bit MinHash.

Words are runs of other than ASCII blanks, with A-Z lower-cased; a document's set
is its distinct shingles of some words (of fewer words, the whole sequence as
one).  HASHES minima are taken over the whole set; groups of BAND of them are the
bands which make candidates, and of each only the low BITS are kept, packed in bit
planes.  Their agreement, corrected for chance collisions, estimates the
similarity of a candidate pair; what may pass is confirmed on full sets.

A parity sketch (of each set, which of PARITY cells hold an odd number of
shingles) bounds a pair from the other side without error: two sets differ in at
least as many shingles as their sketches do in bits.

Equal word sequences are one node.  In a bucket (documents of one band value)
nobody makes all pairs: first each member is compared with the bucket's first one.
After components are found, only members of a bucket that are in another component
than most of it are compared with the others there, by signatures and sketches
within the join's condition; a pair is made only where both leave a link possible,
which few pairs that are not linked pass.  So every pair of a common bucket is
either confirmed, refuted, or within a component, but for those whose estimate is
over five standard deviations too low.  At similarity 0.8 a pair shares no bucket
with a chance of (1 - 0.8 ** BAND) ** BANDS, 5e-8.

A large bucket is dealt into blocks of some BLOCK members, and each two blocks meet
under a key of their own: the work of a key is bounded, whatever a bucket holds.
Many documents that share a bucket and are all just too far apart still are
compared one by one, BLOCK by BLOCK; only their number of keys grows.

Each row is a document; rows that share a doc_id are told apart.  A null or empty
text, or one of blanks, has no shingles, is linked with nothing and stays.  A null
doc_id counts as larger than all others.  doc_id is a whole number: another one is
an error.  An empty table gives no rows.  Columns of the input with the names of
the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import connected
from . import common

SHINGLE, PERCENT = 5, 80
BAND, BANDS, BITS = 4, 32, 2
HASHES = BAND * BANDS
#: Standard deviations by which an estimate may be too low.
SLACK = 5.2
#: Cells of a parity sketch.
PARITY = 2048
#: Members of a bucket's block, about.
BLOCK = 4096

_WORDS = HASHES // 64
PLANES = [f"s{i}" for i in range(BITS * _WORDS)]
CELLS = [f"p{i}" for i in range(PARITY // 64)]
SKETCH = [*PLANES, *CELLS]
FIELDS = [
    T.StructField("n_shingles", T.LongType()),
    T.StructField("d0", T.LongType()),
    T.StructField("d1", T.LongType()),
    *[T.StructField(p, T.LongType()) for p in SKETCH],
    T.StructField("bands", T.ArrayType(T.LongType())),
]
_RANDOM = np.random.Generator(np.random.PCG64(20240501))
_A = _RANDOM.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RANDOM.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_C = _RANDOM.integers(0, 1 << 63, BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sequence_digests(rows: np.ndarray, hashes: np.ndarray, salt: int) -> np.ndarray:
    """A hash of each row's whole word sequence."""
    h = common.mix(hashes ^ np.uint64(salt))
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * common.powers(common._Q, len(h) + 1)[: len(h)], out=sums[1:])
    back = common.powers(pow(common._Q, -1, 1 << 64), len(h) + 1)
    return common.mix((sums[rows[1:]] - sums[rows[:-1]]) * back[rows[:-1]] + np.diff(rows).astype(np.uint64))


def sign(col: pa.Array, shingle: int) -> list[pa.Array]:
    """FIELDS of each text; bands are null where there is no shingle."""
    words = common.Words(col, common.BLANKS)
    hashes = words.hashes()
    grams, bounds = common.row_grams(words.rows, hashes, shingle)
    n = len(col)
    full = np.flatnonzero(np.diff(bounds))
    sizes = np.zeros(n, np.int64)
    parity = np.zeros((n, PARITY), np.uint8)
    for i in full:
        own = np.unique(grams[bounds[i] : bounds[i + 1]])
        sizes[i] = len(own)
        parity[i] = np.bincount((own >> np.uint64(7) & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1
    cells = np.packbits(parity, axis=1, bitorder="little").view("<i8")
    minima = np.zeros((HASHES, len(full)), np.uint32)
    if len(full):
        begins = bounds[:-1][full]
        for k in range(HASHES):
            minima[k] = np.minimum.reduceat(((grams * _A[k] + _B[k]) >> np.uint64(32)).astype(np.uint32), begins)
    planes = np.zeros((BITS * _WORDS, n), np.int64)
    for bit in range(BITS):
        packed = np.packbits((minima >> np.uint32(bit) & np.uint32(1)).astype(np.uint8), axis=0, bitorder="little")
        planes[bit * _WORDS : (bit + 1) * _WORDS, full] = np.ascontiguousarray(packed.T).view("<i8").T
    keys = np.zeros((BANDS, len(full)), np.uint64)
    for b in range(BANDS):
        for j in range(BAND):
            keys[b] += minima[b * BAND + j].astype(np.uint64) * _C[j]
        keys[b] = common.mix(keys[b] + np.uint64(b * common._P & (1 << 64) - 1))
    flat = pa.array(np.ascontiguousarray(keys.T).view(np.int64).reshape(-1))
    lengths = np.zeros(n + 1, np.int32)
    lengths[full + 1] = BANDS
    bands = pa.ListArray.from_arrays(pa.array(np.cumsum(lengths, dtype=np.int32)), flat)
    digests = [sequence_digests(words.rows, hashes, s).view(np.int64) for s in (1, 2)]
    return [pa.array(sizes), *map(pa.array, digests), *map(pa.array, planes), *map(pa.array, np.ascontiguousarray(cells.T)), bands]


def estimate(left: str, right: str) -> Column:
    """Similarity by agreeing bits, corrected for codes that agree by chance."""
    differ = None
    for w in range(_WORDS):
        planes = [F.col(f"{left}.s{b * _WORDS + w}").bitwiseXOR(F.col(f"{right}.s{b * _WORDS + w}")) for b in range(BITS)]
        any_bit = planes[0]
        for p in planes[1:]:
            any_bit = any_bit.bitwiseOR(p)
        differ = F.bit_count(any_bit) if differ is None else differ + F.bit_count(any_bit)
    chance = 0.5**BITS
    return (F.lit(1.0) - differ / F.lit(float(HASHES)) - F.lit(chance)) / F.lit(1 - chance)


def may_pass(left: str, right: str, percent: int) -> Column:
    """False only where sizes or sketches rule a link out, or the estimate is far
    too low.  Sets of a and b shingles that differ in d of them are linked if
    d * (100 + percent) <= (a + b) * (100 - percent)."""
    j, chance = percent / 100, 0.5**BITS
    agree = chance + (1 - chance) * j
    cut = j - SLACK * (agree * (1 - agree) / HASHES) ** 0.5 / (1 - chance)
    a, b = F.col(f"{left}.n_shingles"), F.col(f"{right}.n_shingles")
    sizes = (a * 100 >= b * percent) & (b * 100 >= a * percent)
    differ = sum((F.bit_count(F.col(f"{left}.{c}").bitwiseXOR(F.col(f"{right}.{c}"))) for c in CELLS[1:]), F.bit_count(F.col(f"{left}.{CELLS[0]}").bitwiseXOR(F.col(f"{right}.{CELLS[0]}"))))
    return sizes & (estimate(left, right) >= F.lit(cut)) & (differ * (100 + percent) <= (a + b) * (100 - percent))


def shingles(text: str, n: int) -> set:
    """The full set, of the words themselves."""
    words = text.encode().lower().split()
    if len(words) < n:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(n)), strict=False))


def confirm(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(a, b, linked) of distinct (a, b), on full sets of texts (uid, text).  Texts
    are joined to b first, so that the text of an a with many partners is met in
    one place only."""
    ta = texts.select(F.col("uid").alias("a"), F.col("text").alias("ta"))
    tb = texts.select(F.col("uid").alias("b"), F.col("text").alias("tb"))
    both = pairs.select("a", "b").join(tb, "b").join(ta, "a").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, own = None, set()
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                if (x := x.as_py()) != text:
                    text, own = x, shingles(x, shingle)
                other = shingles(y.as_py(), shingle)
                common_size = len(own & other)
                linked.append(bool(other) and 100 * common_size >= percent * (len(own) + len(other) - common_size))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    return both.mapInArrow(run, "a long, b long, linked boolean")


def _cross_pairs(members: DataFrame, labels: DataFrame, nodes: DataFrame, done: DataFrame, percent: int, block: int) -> DataFrame:
    """Pairs of different components that share a bucket and may pass, less those
    that are done.  One of a pair is outside the component that holds most of the
    bucket."""
    now = members.join(labels, "id", "left").withColumn("component_id", F.coalesce("component_id", "id"))
    per = now.groupBy("band", "component_id").agg(F.count("*").alias("n"))
    mixed = per.groupBy("band").agg(
        F.max_by("component_id", F.struct("n", "component_id")).alias("main"), F.count("*").alias("k"), F.sum("n").alias("all"), F.max("n").alias("most")
    ).where("k > 1")
    blocks = lambda n: F.ceil(n / F.lit(block)).cast("int")
    mixed = mixed.select("band", "main", blocks(F.col("all") - F.col("most")).alias("x_blocks"), blocks(F.col("all")).alias("y_blocks"))
    inside = now.join(mixed, "band").join(nodes, "id")
    slot = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    body = F.struct("id", "component_id", "n_shingles", *SKETCH)
    stray = inside.where("component_id <> main").select("band", slot("x_blocks").alias("xs"), every("y_blocks").alias("ys"), body.alias("x"))
    other = inside.select("band", "main", every("x_blocks").alias("xs"), slot("y_blocks").alias("ys"), body.alias("y"))
    pairs = stray.join(other, ["band", "xs", "ys"]).where(
        (F.col("x.component_id") != F.col("y.component_id"))
        & ((F.col("y.component_id") == F.col("main")) | (F.col("x.id") < F.col("y.id")))
        & may_pass("x", "y", percent)
    )
    pairs = pairs.select(F.col("y.id").alias("a"), F.col("x.id").alias("b")).distinct()
    known = done.select("a", "b").unionAll(done.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return pairs.join(known, ["a", "b"], "left_anti")


def _joined_up(labels: DataFrame, found: DataFrame) -> DataFrame:
    """``labels`` with the links ``found`` too: whole components are nodes here, so
    that only those which a new link touches go through rounds again."""
    ends = found.select("a", "b")
    for end in ("a", "b"):
        own = labels.select(F.col("id").alias(end), F.col("component_id").alias("_of"))
        ends = ends.join(own, end, "left").withColumn(end, F.coalesce("_of", end)).drop("_of")
    new = common.stored(connected(ends.distinct()), "joined")
    known = labels.join(new.select(F.col("id").alias("component_id"), F.col("component_id").alias("_new")), "component_id", "left")
    single = new.join(labels.select("id"), "id", "left_anti").select("id", "component_id")
    return known.select("id", F.coalesce("_new", "component_id").alias("component_id")).unionAll(single)


def _signed(rows: DataFrame, shingle: int, leave: list[str]) -> DataFrame:
    return common.stored(common.annotate(rows, "text", lambda col, _: sign(col, shingle), FIELDS).drop(*leave), "signatures")


def _labelled(docs: DataFrame, shingle: int, percent: int, text_col: str, block: int, rows: DataFrame | None = None) -> DataFrame:
    """uid, doc_id, n_shingles, component_id (the least doc_id of a row's component),
    first (its row that stays: the least doc_id's, then the least uid) of each row."""
    if rows is None:  # numbered as they are signed, so that they are written once
        narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        signed = rows = _signed(narrow.withColumn("uid", F.monotonically_increasing_id()), shingle, [])
    else:
        signed = _signed(rows, shingle, ["text"])

    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")
    usable = signed.where("n_shingles > 0")
    classes = usable.groupBy("d0", "d1").agg(F.min(F.struct(order.alias("o"), "n_shingles", *SKETCH, "bands")).alias("r"))
    reps = classes.select("d0", "d1", F.col("r.o.uid").alias("id"), F.col("r.o").alias("o"), "r.n_shingles", *[f"r.{p}" for p in SKETCH], "r.bands")
    reps = common.stored(reps, "classes")
    nodes = reps.select("id", "n_shingles", *SKETCH)

    buckets = reps.select("id", F.explode("bands").alias("band"))
    pivots = buckets.groupBy("band").agg(F.min("id").alias("pivot"), F.count("*").alias("n")).where("n > 1").drop("n")
    members = common.stored(buckets.join(pivots, "band"), "buckets")

    star = members.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    side = lambda name, key: nodes.select(F.col("id").alias(key), F.struct("n_shingles", *SKETCH).alias(name))
    star = star.join(side("x", "a"), "a").join(side("y", "b"), "b").where(may_pass("x", "y", percent)).select("a", "b").distinct()
    texts = rows.select("uid", "text").join(members.select(F.col("id").alias("uid")).distinct(), "uid", "left_semi")
    texts = common.stored(texts, "texts")

    done = common.stored(confirm(star, texts, shingle, percent), "links")
    labels = common.stored(connected(done.where("linked")), "labels")
    pairs = common.stored(_cross_pairs(members.drop("pivot"), labels, nodes, done, percent, block), "pairs")
    common.discard(members)
    found = common.stored(confirm(pairs, texts, shingle, percent).where("linked"), "links")
    common.discard(texts, pairs, done)
    if not found.isEmpty():
        labels = common.stored(_joined_up(labels, found), "labels")

    tied = reps.select("d0", "d1", "id", "o").join(labels, "id", "left").withColumn("node", F.coalesce("component_id", "id"))
    least = tied.groupBy("node").agg(F.min("o").alias("first"))
    of_class = common.stored(tied.join(least, "node").select("d0", "d1", "first"), "components")
    common.discard(reps)
    out = signed.select("uid", "doc_id", "n_shingles", "d0", "d1").join(of_class, ["d0", "d1"], "left")
    alone = F.col("n_shingles") == 0
    return out.select(
        "uid", "doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"),
        F.when(alone, F.col("uid")).otherwise(F.col("first.uid")).alias("first"),
    )


def groups(docs: DataFrame, *, shingle: int = SHINGLE, percent: int = PERCENT, text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of ``docs``."""
    out = _labelled(docs, shingle, percent, text_col, block)
    return out.select("doc_id", "n_shingles", "component_id").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicate(docs: DataFrame, *, shingle: int = SHINGLE, percent: int = PERCENT, text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row of each group, with its own columns: that of the least doc_id, of
    several with it the first in the table."""
    own = {c: f"_own_{i}" for i, c in enumerate(docs.columns)}
    rows = common.numbered(docs.withColumnsRenamed(own), "rows")
    narrow = rows.select(F.col(own["doc_id"]).cast("long").alias("doc_id"), F.coalesce(F.col(own[text_col]), F.lit("")).alias("text"), "uid")
    kept = _labelled(docs, shingle, percent, text_col, block, narrow).where("uid = first").select("uid")
    return rows.join(kept, "uid", "left_semi").select(*[F.col(own[c]).alias(c) for c in docs.columns])
