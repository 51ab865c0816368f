"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

Words are runs of ASCII letters and digits and of all other than ASCII, with A-Z
lower-cased.  A window is N_GRAM consecutive words of a benchmark item; an item
of fewer words, but not none, is one window.  Document windows are hashed with
numpy, looked up in the set, and each hit is verified word by word before its
words count as hit.

The benchmark is broadcast in blocks of at most BLOCK_BYTES, as the set takes them in
memory (``SET_BYTES`` for each byte of text), one after the other, so that no broadcast
grows with it; the usual benchmark is one block.  A longer item is cut where its text
may be, each part with the words that a window needs from the next one, so that every
window is in a block.

A null text has no words.  Items without words match nothing; a null item_id
counts as the id "".  Repeated items count once, and rows that share an item_id are one
item.  Empty tables give no hits or no rows.  Columns of the input with the names of
the results are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

N_GRAM = 13
BLOCK_BYTES = 64 << 20
#: Bytes of the set for a byte of text, at most: a word is two bytes or more, and has
#: two places of 8 bytes, a hash of 8, a place of 8 and the 2 bytes themselves.
SET_BYTES = 18
#: A document is contaminated if one word of this many is hit.
MAX_CLEAN = 20
_SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("hit_spans", _SPAN),
]
_BITS = 20


class GramSet:
    """Windows by length: a bit table of their low hash bits, their hashes in order,
    and for each the place of its first word among the words of all items.  Windows
    are spelt out only where a hash is met."""

    def __init__(self, items: list[tuple[str, str | None]], n: int) -> None:
        self.ids = [i for i, _ in items]
        words = common.Words(pa.array([t for _, t in items], pa.string()), common.NOT_ALNUM)
        hashes, self.data = words.hashes(), words.data.tobytes()
        self.starts, self.ends, self.rows = words.starts, words.ends, words.rows
        counts = words.counts()
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in np.unique(np.minimum(counts[counts > 0], n)).tolist():
            mine = counts >= n if size == n else counts == size
            at = [np.arange(a, b - size + 1) for a, b in zip(self.rows[:-1][mine].tolist(), self.rows[1:][mine].tolist(), strict=True)]
            place = np.concatenate(at)
            found = common.grams(hashes, size)[place]
            order = np.argsort(found, kind="stable")
            found, place = found[order], place[order]
            bits = np.zeros(1 << _BITS, bool)
            bits[found & np.uint64((1 << _BITS) - 1)] = True
            self.by_length[size] = bits, found, place

    def n_bytes(self) -> int:
        return len(self.data) + sum(x.nbytes for x in (self.starts, self.ends, self.rows)) + sum(h.nbytes + p.nbytes for _, h, p in self.by_length.values())

    def spelt(self, place: int, size: int) -> list[bytes]:
        return [self.data[s:e] for s, e in zip(self.starts[place : place + size].tolist(), self.ends[place : place + size].tolist(), strict=True)]

    def item(self, place: int) -> str:
        return self.ids[int(np.searchsorted(self.rows, place, "right")) - 1]


def scan(col: pa.Array, grams: GramSet, earlier: pa.RecordBatch | None = None) -> list[pa.Array]:
    """FIELDS of each text.  earlier: has items and hit_spans of other blocks."""
    words = common.Words(col, common.NOT_ALNUM)
    hashes, data = words.hashes(), words.data.tobytes()
    counts, total = words.counts(), len(hashes)
    row_of = np.repeat(np.arange(len(counts)), counts)
    row_end = words.rows[1:][row_of]
    change = np.zeros(total + 1, np.int64)
    items: list[set[str]] = [set() for _ in counts]
    for size, (bits, known, place) in grams.by_length.items():
        h = common.grams(hashes, size)
        at = np.flatnonzero(bits[h & np.uint64((1 << _BITS) - 1)])
        at = at[at + size <= row_end[at]]
        first, last = np.searchsorted(known, h[at], "left"), np.searchsorted(known, h[at], "right")
        met = np.flatnonzero(first < last)
        known_items: dict[tuple[int, bytes], set[str]] = {}  # a window that many items have is looked up once
        for i, a, b in zip(at[met].tolist(), first[met].tolist(), last[met].tolist(), strict=True):
            spelt = [data[s:e] for s, e in zip(words.starts[i : i + size].tolist(), words.ends[i : i + size].tolist(), strict=True)]
            key = a, b" ".join(spelt)
            if key not in known_items:
                known_items[key] = {grams.item(p) for p in place[a:b].tolist() if grams.spelt(p, size) == spelt}
            if who := known_items[key]:
                items[row_of[i]] |= who
                change[i] += 1
                change[i + size] -= 1
    if earlier is not None:
        for r, (who, spans) in enumerate(zip(earlier.column("items").to_pylist(), earlier.column("hit_spans").to_pylist(), strict=True)):
            items[r].update(who)
            for s in spans:
                change[words.rows[r] + s["start"]] += 1
                change[words.rows[r] + s["end"]] -= 1
    hit = np.cumsum(change)[:total] > 0
    sums = np.concatenate([[0], np.cumsum(hit)])
    n_hit = sums[words.rows[1:]] - sums[words.rows[:-1]]
    spans: list[list[dict[str, int]]] = [[] for _ in counts]
    for r in np.flatnonzero(n_hit):
        a, b = words.rows[r], words.rows[r + 1]
        edge = np.flatnonzero(np.diff(np.concatenate([[0], hit[a:b].astype(np.int8), [0]])))
        spans[r] = [{"start": int(s), "end": int(e)} for s, e in zip(edge[::2], edge[1::2], strict=True)]
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    return [
        pa.array(counts, pa.int64()),
        pa.array(n_hit, pa.int64()),
        pa.array([sorted(x) for x in items], pa.list_(pa.string())),
        pa.array(spans, kind),
    ]


_ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def item_parts(text: str, n: int, most: int) -> Iterator[str]:
    """Parts of a text of about ``most`` characters, which together have all of its
    windows: each but the last ends with the n - 1 words that the next begins with."""
    if len(text) <= most:
        yield text
        return
    begin, starts = 0, []  # places of the last n - 1 words
    for m in _ITEM_WORD.finditer(text):
        if n > 1 and m.end() - begin > most and len(starts) == n - 1 and starts[0] > begin:
            yield text[begin : m.start()]
            begin = starts[0]
        starts = [*starts, m.start()][-(n - 1) :] if n > 1 else []
        if n == 1 and m.end() - begin > most:
            yield text[begin : m.end()]
            begin = m.end()
    yield text[begin:]


def contamination(
    docs: DataFrame, benchmark: DataFrame, *, n: int = N_GRAM, text_col: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``docs`` with n_words, n_hit, items (sorted ids) and hit_spans (words)."""
    common.bounded_batches(docs.sparkSession)
    most = max(64, block_bytes // SET_BYTES // 4)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, p) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for p in item_parts(t or "", n, most)]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.string()), pa.array([t for _, t in rows], pa.string())], names=["item_id", "text"])

    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").distinct()
    if (items.agg(F.max(F.octet_length("text"))).first()[0] or 0) > most:
        items = common.stored(items.mapInArrow(cut, "item_id string, text string"), "items")
    size = items.agg(F.sum(F.octet_length("text") + 64).alias("b")).first()["b"] or 0
    # parts are a quarter of a block at most, so that blocks of equal shares stay near their bound
    blocks = max(1, ceil(size * 1.5 * SET_BYTES / block_bytes))
    out = docs
    for k in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else items
        grams = docs.sparkSession.sparkContext.broadcast(GramSet([(r[0], r[1]) for r in mine.collect()], n))
        out = common.annotate(out, text_col, lambda col, batch, g=grams, k=k: scan(col, g.value, batch if k else None), FIELDS)
        if k < blocks - 1:  # a worker holds the set of one block at a time
            out = common.stored(out, "decontaminate")
    return out


def is_contaminated() -> F.Column:
    return (F.col("n_hit") > 0) & (F.col("n_hit") * MAX_CLEAN >= F.col("n_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    marked = contamination(docs, benchmark, text_col=text_col)
    return marked.where(~is_contaminated()).select(*[f"`{c}`" for c in docs.columns])


def _cut(texts, spans):
    out = []
    for text, found in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
        if not found:
            out.append(text)
            continue
        words = common.Words(pa.array([text], pa.string()), common.NOT_ALNUM)
        raw, kept, at = text.encode(), [], 0
        for s in found:
            kept.append(raw[at : words.starts[s["start"]]])
            at = int(words.ends[s["end"] - 1])
        out.append(b"".join([*kept, raw[at:]]).decode())
    return pa.array(out, pa.string())


def remove_spans(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text") -> DataFrame:
    """All documents, with the hit words (from the first to the last of each
    run, and what stands between them) cut out of their texts."""
    marked = contamination(docs, benchmark, text_col=text_col)
    field = T.StructField(text_col, T.StringType())
    cut = common.annotate(marked, text_col, lambda col, batch: [_cut(col, batch.column("hit_spans"))], [field])
    return cut.select(*[f"`{c}`" for c in docs.columns])
