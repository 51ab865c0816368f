"""Token counts with a digest cache.

The cache is a folder of Parquet files (content, n_tokens) for each tokenizer: the
SHA-256 of the normalised UTF-8 text and its count; a tokenizer's version is the
SHA-256 of its model file.  A run joins the digests of its documents to it, encodes
only distinct misses, appends them in one commit and answers from the cache's rows
of these digests.  A run that is lost midway leaves the cache as it was; two runs
that append the same digest agree, and readers take one of them.

Texts are normalised by what the model itself doesn't tell apart, so that no count
can change (``normalised``): null and the empty text; the mark by which it writes a
blank, and a blank; repeated and outer blanks where it drops them.  A model that has
a table of replacements of its own gets the text as it stands.

Nulls count as the empty text (0 tokens), repeated rows each get their count, an
empty table gives an empty result, and the input's other columns are returned as
they are, but for those named as the results are, which are replaced.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CACHE_SCHEMA = "content binary, n_tokens long"
#: What a model of this kind writes for a blank.
BLANK_MARK = "\u2581"


@functools.lru_cache(maxsize=2)
def _processor(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def normalised(text: Column, model: bytes) -> Column:
    from sentencepiece import sentencepiece_model_pb2 as pb

    spec = pb.ModelProto.FromString(model).normalizer_spec
    out = F.coalesce(text, F.lit(""))
    if spec.precompiled_charsmap or not spec.escape_whitespaces:
        return out
    out = F.translate(out, BLANK_MARK, " ")
    return F.trim(F.regexp_replace(out, " {2,}", " ")) if spec.remove_extra_whitespaces else out


def open_cache(spark: SparkSession, path: str, tokenizer: str) -> DataFrame:
    """One row for each content digest that this tokenizer version has counted."""
    place = f"{path}/{tokenizer}"
    fs, p = common.file_system(spark, place)
    fs.mkdirs(p)
    return spark.read.schema(CACHE_SCHEMA).parquet(place).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def encode(misses: DataFrame, model: bytes) -> DataFrame:
    """(content, text) to the rows of the cache."""
    common.bounded_batches(misses.sparkSession)
    sent = misses.sparkSession.sparkContext.broadcast(model)  # a model file: under a MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _processor(sent.value)
        for batch in batches:
            for part in common.pieces(batch, 1):
                counts = [len(ids) for ids in encoder.encode(part.column(1).to_pylist(), num_threads=1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64())], names=["content", "n_tokens"])

    return misses.select("content", "text").mapInArrow(run, CACHE_SCHEMA)


def count_tokens(docs: DataFrame, cache_path: str, model_path: str, *, text_col: str = "text") -> DataFrame:
    """``docs`` with n_bytes and n_tokens; what the cache lacked is appended to it.

    Texts travel once, to the task of their digest, and only where the cache
    lacks it; all other joins are of digests.
    """
    spark = docs.sparkSession
    model = Path(model_path).read_bytes()
    tokenizer = hashlib.sha256(model).hexdigest()
    text = F.coalesce(F.col(text_col), F.lit(""))
    content = normalised(F.col(text_col), model)
    digest = F.unhex(F.sha2(content.cast("binary"), 256))
    texts = docs.select(digest.alias("content"), content.alias("text"))
    lacking = texts.join(open_cache(spark, cache_path, tokenizer), "content", "left_anti")
    # first() of equal texts; one text of a digest is enough
    misses = lacking.groupBy("content").agg(F.first("text").alias("text"))
    encode(misses, model).write.mode("append").parquet(f"{cache_path}/{tokenizer}")
    rest = common.without(docs, ["n_bytes", "n_tokens", "content"])
    out = rest.withColumns({"n_bytes": F.octet_length(text).cast("long"), "content": digest})
    # of the cache only the rows of these documents; stored, so that the join has an
    # exchange on either side and a hot digest can be split
    asked = docs.select(digest.alias("content")).distinct()
    counts = common.stored(open_cache(spark, cache_path, tokenizer).join(asked, "content", "left_semi"), "counts")
    return out.join(counts, "content", "left").drop("content")
