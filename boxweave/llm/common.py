"""What the operators share: shared storage, bounded Arrow batches, numpy words.

Words and n-grams are hashed with numpy over the concatenated UTF-8 bytes of a
batch, so that no Python object is made per word.  All hashes are fixed
functions of the bytes: the same in every process and at every run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import discard, file_system, own_path, remove, shared_dir, shares, stored  # noqa: F401

#: Bytes of text that a numpy kernel sees at once, unless one text is longer.
PIECE_BYTES = 1 << 20
#: Rows and bytes of an Arrow batch; long texts make batches of few rows.
BATCH_ROWS, BATCH_BYTES = 1024, 4 << 20

_MASK = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_Q = 0xD6E8FEB86659FD93


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches which this session hands to Python workers.

    Spark reads these two settings of the session when a plan runs, so they are
    left at the bound; smaller values that are set already stay."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        now = str(spark.conf.get(name)).lower().removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df``, stored, with a number ``uid`` of each row: fixed once it is written,
    so that rows which share an id, or have none, are told apart."""
    return stored(df.withColumn("uid", F.monotonically_increasing_id()), name)


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """``df`` less the columns of these names, in any case of letters."""
    drop = {n.lower() for n in names}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in drop])


def pieces(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that column ``at`` holds about PIECE_BYTES in each piece."""
    if not batch.num_rows:
        return
    col = batch.column(at)
    ends = np.frombuffer(col.buffers()[1], np.int32)[col.offset + 1 : col.offset + len(col) + 1].astype(np.int64)
    first = int(np.frombuffer(col.buffers()[1], np.int32)[col.offset])
    begin = 0
    while begin < len(ends):
        stop = int(np.searchsorted(ends, first + PIECE_BYTES, "right"))
        stop = min(max(stop, begin + 1), len(ends))
        yield batch.slice(begin, stop - begin)
        first, begin = int(ends[stop - 1]), stop


def annotate(
    df: DataFrame, text_col: str, kernel: Callable[[pa.Array, pa.RecordBatch], list[pa.Array]], fields: list[T.StructField]
) -> DataFrame:
    """Append (or replace) the columns ``fields``, computed from ``text_col``.

    ``kernel`` gets that column and the batch it is from, and returns an Arrow
    array for each field.
    Columns of ``df`` whose names clash with ``fields`` are replaced.
    """
    bounded_batches(df.sparkSession)
    new = {f.name.lower() for f in fields}
    kept = [i for i, f in enumerate(df.schema.fields) if f.name.lower() not in new]
    schema = T.StructType([df.schema.fields[i] for i in kept] + fields)
    at = next(i for i, f in enumerate(df.schema.fields) if f.name.lower() == text_col.lower())
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, at):
                cols = kernel(part.column(at), part)
                yield pa.RecordBatch.from_arrays([part.column(i) for i in kept] + cols, names=names)

    return df.mapInArrow(run, schema)


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string (or binary) array and its row offsets; null is empty."""
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) else "")
    offsets = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of a well-known 64-bit hash, over an array of uint64."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1), modulo 2 ** 64."""
    if len(_POWERS.get(base, ())) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        p = np.full(size, base & _MASK, np.uint64)
        p[0] = 1
        _POWERS[base] = np.cumprod(p, dtype=np.uint64)
    return _POWERS[base][:n]


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The separators of `[^\x20\x09-\x0D]+` and of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, by byte.
BLANKS = np.zeros(256, bool)
BLANKS[[32, 9, 10, 11, 12, 13]] = True
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[48:58] = NOT_ALNUM[97:123] = NOT_ALNUM[128:] = False


class Words:
    """The words of a batch: places in ``data``, row bounds and 64-bit hashes."""

    def __init__(self, col: pa.Array, separators: np.ndarray) -> None:
        raw, self.offsets = utf8(col)
        self.data = LOWER[raw]
        n = len(raw)
        word = ~separators[self.data]
        before = np.zeros(n, bool)
        before[1:] = word[:-1]
        after = np.zeros(n, bool)
        after[:-1] = word[1:]
        inner = self.offsets[(self.offsets > 0) & (self.offsets < n)]
        before[inner] = False
        after[inner - 1] = False
        self.starts = np.flatnonzero(word & ~before)
        self.ends = np.flatnonzero(word & ~after) + 1
        #: Words before each row, and at the end their number.
        self.rows = np.searchsorted(self.starts, self.offsets)

    def hashes(self) -> np.ndarray:
        n = len(self.data)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * powers(_P, n + 1)[:n], out=sums[1:])
        h = (sums[self.ends] - sums[self.starts]) * powers(_PINV, n + 1)[self.starts]
        return mix(h + (self.ends - self.starts).astype(np.uint64) * np.uint64(_Q))

    def counts(self) -> np.ndarray:
        return np.diff(self.rows)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n words from each place; the last n - 1 places are left out."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    if n <= 6:
        h = np.zeros(m, np.uint64)
        for j, q in enumerate(powers(_Q, n)):
            h += hashes[j : j + m] * q
    else:
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * powers(_Q, len(hashes)), out=sums[1:])
        h = (sums[n:] - sums[:m]) * powers(pow(_Q, -1, 1 << 64), m)
    return mix(h + np.uint64(n * 0x2545F4914F6CDD1D & _MASK))


def row_grams(rows: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams inside rows, and their row bounds.  A row of fewer words, but
    not none, has its whole sequence as its only gram."""
    counts = np.diff(rows)
    sizes = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(bounds[-1], np.uint64)
    full = counts >= n
    if full.any():
        every = grams(hashes, n)
        place = np.arange(bounds[-1]) - np.repeat(bounds[:-1], sizes) + np.repeat(rows[:-1], sizes)
        keep = np.repeat(full, sizes)
        out[keep] = every[place[keep]]
    for i in np.flatnonzero(~full & (counts > 0)):
        out[bounds[i]] = grams(hashes[rows[i] : rows[i + 1]], int(counts[i]))[0]
    return out, bounds
