"""The queries opN_<name>: each applies its operator to its whole table."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, decontaminate, lang_id, licenses, mixture, near_dup, passages, pii, telephony, token_cache, warc


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = lang_id.train(docs, where=lang_id.learnable())
    named = lang_id.identify(docs.select("doc_id", "text"), model)
    return named.select("doc_id", (~lang_id.learnable()).alias("held_out"), "lang_pred", "score", "ambiguous")


def op2_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    packed = common.stored(telephony.pack(docs).select("doc_id", "n_bytes", "codec", "media"), "media")
    described = []
    for part in common.shares(packed, telephony.PARTS):
        sound = common.stored(telephony.read_back(part, out_rate=telephony.STORED_RATE).drop("media"), "pcm")
        described.append(common.stored(telephony.features(sound).drop("pcm"), "features"))
        common.discard(sound)
    common.discard(packed)
    return functools.reduce(DataFrame.unionAll, described)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(common.table(spark, sf_dir, "documents"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.groups(common.table(spark, sf_dir, "documents"), shingle=2)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontaminate.contamination(docs, common.table(spark, sf_dir, "benchmark"))
    return marked.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        decontaminate.is_contaminated().alias("contaminated"),
    )


def op6_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mixture.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "position")
    return mixture.sorted_documents(mixed)


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *[f"n_{k}" for k in pii.KINDS], base, "spans")


def op8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeats(common.table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalogue = warc.write_packages(common.table(spark, sf_dir, "pages"), common.own_path(spark, "packages"))
    read = warc.read_packages(catalogue, payloads=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


MAX_TOKENS = 4096


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    # one cache for all runs that share the folder: the next one finds these counts
    cache = f"{common.shared_dir(spark)}/token-cache"
    counted = token_cache.count_tokens(docs, cache, str(public_tokenizers.path("piece_bpe_32k.model")))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > MAX_TOKENS).alias("over_limit"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_telephony, op3_license_scan, op4_near_duplicates, op5_decontaminate, op6_mixture, op7_personal_data, op8_passages, op9_warc, op10_token_counts)}
