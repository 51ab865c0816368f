"""Language identification by error-correcting output codes.

Each language has a codeword; each bit of it is predicted by a binary logistic
classifier over hashed byte n-grams of the whole text.  Loss-weighted decoding
takes the codeword with the least logistic loss of the bits' margins, each bit
weighted by its accuracy on that language in training; a text whose two nearest
codewords are about as near is flagged as ambiguous.

Classifiers are fitted on the driver on a bounded sample: of the LANGUAGES most
frequent labels (of equally frequent ones the first by name) SAMPLE_PER_LANGUAGE rows
each, SAMPLE in all, chosen by a digest of doc_id and text; rows equal in both and in
label are one.  Their n-gram counts are made on the executors, over whole texts.

A null text and one without a letter are ``und``, with score 0 and not ambiguous;
without any labelled row all texts are.  A null lang is never learned from, a null
doc_id may be.  Of codewords that are equally near the first language by name is taken;
repeated rows have equal results; empty tables give no rows.  Columns of the input with
the names of the results are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SAMPLE, SAMPLE_PER_LANGUAGE, LANGUAGES = 4000, 500, 500
#: Buckets of byte pairs and of byte triples.
PAIRS, TRIPLES = 1024, 4096
DIM = PAIRS + TRIPLES
STEPS, DECAY = 200, 1e-6
#: A text is ambiguous if the best of all has no more than this share.
AMBIGUOUS = 0.5
UNKNOWN = "und"
FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())]
_ROWS = 256

# ASCII other than letters counts as a blank
_FOLD = common.LOWER.copy()
_FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 32


def features(col: pa.Array) -> np.ndarray:
    """Square roots of n-gram counts, of unit length; zero without any n-gram."""
    data, offsets = common.utf8(col)
    out = np.zeros((len(col), DIM), np.float32)
    for first in range(0, len(col), _ROWS):
        last = min(first + _ROWS, len(col))
        text = _FOLD[data[offsets[first] : offsets[last]]].astype(np.uint32)
        if len(text) < 2:
            continue
        row = np.repeat(np.arange(last - first, dtype=np.int32), np.diff(offsets[first : last + 1]))
        two = text[:-1] * np.uint32(0x9E3779B1) + text[1:] * np.uint32(0x85EBCA77)
        total = np.zeros((last - first) * DIM, np.int64)
        for codes, size, begin, n in ((two, PAIRS, 0, 2), (None, TRIPLES, PAIRS, 3)):
            if codes is None:
                if len(text) < 3:
                    continue
                codes = two[:-1] * np.uint32(0xC2B2AE3D) + text[2:] * np.uint32(0x27D4EB2F)
            codes = (codes ^ (codes >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - int(log2(size)))
            same = row[n - 1 :] == row[: len(row) - n + 1]
            at = row[: len(codes)].astype(np.int64) * DIM + begin + codes
            total += np.bincount(at[same], minlength=len(total))
        x = np.sqrt(total.reshape(-1, DIM).astype(np.float32))
        out[first:last] = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    return out


def codewords(n: int, tries: int = 64) -> np.ndarray:
    """(n, bits) of -1 and 1.  Few languages: every split of them into two; more:
    the random code, of several, whose closest two words are farthest apart."""
    if n <= 1:
        return np.zeros((n, 0), np.float32)
    if n <= 7:
        splits = [s for s in product((-1, 1), repeat=n) if s[0] == 1 and -1 in s]
        return np.array(splits, np.float32).T
    rng = np.random.default_rng(7)
    best, found = -1, None
    for _ in range(tries):
        code = rng.choice(np.array([-1, 1], np.float32), (n, 10 * ceil(log2(n))))
        if (np.abs(code.sum(0)) == n).any():
            continue
        near = code @ code.T - 2 * code.shape[1] * np.eye(n)
        if (apart := code.shape[1] - near.max()) > best:
            best, found = apart, code
    return found


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # (DIM + 1, bits)
    trust: np.ndarray  # (languages, bits); a row sums to the number of bits


def fit(x: np.ndarray, labels: list[str]) -> Model:
    """Logistic classifiers for all bits at once, by accelerated gradient descent."""
    languages = sorted(set(labels))
    code = codewords(len(languages))
    y = code[[languages.index(v) for v in labels]] if labels else np.zeros((0, 0), np.float32)
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w = np.zeros((DIM + 1, code.shape[1]), np.float32)
    # each language weighs the same, however many rows it has
    share = np.array([1 / labels.count(v) / len(languages) for v in labels], np.float32)[:, None]
    look, t = w.copy(), 1.0
    for _ in range(STEPS if code.shape[1] else 0):
        margin = y * (x @ look)
        slope = -y * share / (1 + np.exp(np.clip(margin, -30, 30)))
        new = look - 2.0 * (x.T @ slope + DECAY * look)
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        look, w, t = new + np.float32((t - 1) / t2) * (new - w), new, t2
    right = (y * (x @ w)) > 0
    trust = np.array([[right[[v == lang for v in labels], b].mean() for b in range(code.shape[1])] for lang in languages], np.float32)
    trust = trust.reshape(code.shape)
    return Model(languages, code, w, trust / np.maximum(trust.sum(1, keepdims=True), 1e-9) * code.shape[1])


def decode(model: Model, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest codeword of each row, and its share among all."""
    distance = np.einsum("kb,nkb->nk", model.trust, np.logaddexp(0, -model.code[None] * margins[:, None, :]))
    near = distance.argmin(1)
    share = 1 / np.exp(distance[np.arange(len(near)), near, None] - distance).sum(1)
    return near, share


def has_letter(texts: pa.Array) -> np.ndarray:
    return np.array([any(c.isalpha() for c in t) if t else False for t in texts.to_pylist()], bool)


def predict(col: pa.Array, model: Model) -> list[pa.Array]:
    n = len(col)
    known = has_letter(col) if model.languages else np.zeros(n, bool)
    near, share = np.zeros(n, int), np.zeros(n)
    if known.any():
        x = features(col)
        near, share = decode(model, x @ model.weights[:-1] + model.weights[-1])
    names = [model.languages[k] if ok else UNKNOWN for k, ok in zip(near, known, strict=True)]
    score = np.where(known, np.clip(share, 0, 1), 0.0).astype(np.float64)
    return [pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(known & (share <= AMBIGUOUS))]


def learnable() -> Column:
    """Rows whose labels may be learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4, F.lit(0)) != 2


def train(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", where: Column | None = None) -> Model:
    """A model of the labelled rows ``where`` holds (all, if that is None)."""
    rows = docs.where(where) if where is not None else docs
    name = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    rows = rows.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), (F.pmod(F.xxhash64(name), F.lit(1 << 52)) / float(1 << 52)).alias("rank"))
    rows = rows.where(F.col("lang").isNotNull() & F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    top = rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("rank").alias("distinct"))
    counts = {r["lang"]: r["distinct"] for r in top.orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    if not counts:
        return fit(np.zeros((0, DIM), np.float32), [])
    each = max(1, min(SAMPLE_PER_LANGUAGE, SAMPLE // len(counts)))
    # somewhat more than is taken, so that few languages are short of it by chance
    limits = docs.sparkSession.createDataFrame([(k, min(1.0, 1.2 * (each + 5 * each**0.5) / n)) for k, n in counts.items()], "lang string, most double")
    chosen = rows.join(F.broadcast(limits), "lang").where("rank <= most").groupBy("lang", "rank").agg(F.first("text").alias("text"))
    field = T.StructField("x", T.BinaryType())
    made = common.annotate(chosen, "text", lambda col, _: [pa.array([r.astype(np.float16).tobytes() for r in features(col)], pa.binary())], [field])
    found: dict[str, list[bytes]] = {}
    for r in sorted(made.select("lang", "rank", "x").collect(), key=lambda r: (r["lang"], r["rank"], bytes(r["x"]))):
        found.setdefault(r["lang"], []).append(r["x"])
    labels = [k for k, v in found.items() for _ in v[:each]]
    x = np.array([np.frombuffer(v, np.float16) for vs in found.values() for v in vs[:each]], np.float32).reshape(-1, DIM)
    return fit(x, labels)


def identify(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and ambiguous."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # DIM rows of a few bits
    return common.annotate(docs, text_col, lambda col, _: predict(col, sent.value), FIELDS)


def is_rejected() -> Column:
    return (F.col("lang_pred") == UNKNOWN) | F.col("ambiguous")


def keep_identified(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """The documents whose language is told, with their own columns."""
    clash = {f.name for f in FIELDS}
    renamed = {c: f"_own_{i}" for i, c in enumerate(docs.columns) if c.lower() in clash}
    out = identify(docs.withColumnsRenamed(renamed), model, text_col=renamed.get(text_col, text_col)).where(~is_rejected())
    return out.select(*[out[f"`{renamed.get(c, c)}`"].alias(c) for c in docs.columns])
