"""Registered queries of the training-data operators: one for each, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import bpe, dedup, language_id, lm_score, mixing, quality_classifier, quality_rules, sharding, topk, warc
from pagemill.llm.common import crc_fold, cut
from pagemill.llm.oracles import ORACLES
from pagemill.session import table

__all__ = ["ORACLES", "QUERIES"]


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def piece_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of all documents."""
    return bpe.digests(table(spark, sf_dir, "documents"), word_vocabulary())


#: Ids of a file's records.
PAGES_A_FILE = 2048


def op2_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records, and what an audit finds of a replica in which some were altered or lost."""
    pages = table(spark, sf_dir, "pages")
    file = F.floor(F.col("page_id") / PAGES_A_FILE).alias("file")
    record = warc.record(F.col("url"), F.col("html"), F.col("page_id"))
    # The replica has the same places, but for some records that are lost; its bytes are hashed anew.
    altered = F.when(F.col("page_id") % 97 == 5, F.overlay(record, F.lit("X").cast("binary"), F.lit(1))).otherwise(record)
    lost = F.coalesce(F.col("page_id") % 211 == 7, F.lit(False))
    records = pages.select("page_id", file, record.alias("record"), F.sha2(altered, 256).alias("held"), lost.alias("lost"))
    primary = cut(warc.index(records, "file", "page_id", "record", carry=("held", "lost")))
    replica = primary.where("not lost").select("file", "key", "offset", "length", F.col("held").alias("digest"))
    found = warc.audit(primary.drop("held", "lost"), replica).select(F.col("file").alias("_file"), F.col("offset").alias("_offset"), "status")
    same = F.col("file").eqNullSafe(F.col("_file")) & (F.col("offset") == F.col("_offset"))
    out = primary.join(found, same, "left")
    return out.select(F.col("key").alias("page_id"), "file", "offset", "length", "digest", F.coalesce("status", F.lit("intact")).alias("status"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence, site posteriors and quality of all documents."""
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.judge(docs, table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"), carry=["doc_id"])


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of equal numbers of rows, each with the mixture of sources."""
    placed = sharding.interleave(table(spark, sf_dir, "documents"), n_shards=40)
    law, grown = F.lit("rows").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return placed.select("doc_id", "size", "text_crc32", law, "shard", "slot", grown, "stratum", "position")


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of all documents, learned from six sevenths of them."""
    return lm_score.score(table(spark, sf_dir, "documents"), crc_fold("doc_id", 7) != 2, piece_vocabulary())


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return dedup.near_duplicates(table(spark, sf_dir, "documents"), percent=85).drop("text_mark")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from three quarters of them; a narrow margin is told, not acted on."""
    docs = table(spark, sf_dir, "documents")
    held_out = crc_fold("doc_id", 4) == 2
    learned = language_id.learn(docs, ~held_out)
    plain = docs.select("doc_id", held_out.alias("held_out"), "text")
    return language_id.classify(plain, learned, reject=False).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to weights 1, 2, 3 by source, at most 3 epochs."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "times")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures and verdict of line-first cleaning on all documents."""
    return quality_rules.assess(table(spark, sf_dir, "documents"), carry=["doc_id"]).drop("clean")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best inner products of every 20th vector with all others."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_warc_audit": op2_warc_audit,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_sharding": op4_sharding,
    "op5_lm_score": op5_lm_score,
    "op6_near_dedup": op6_near_dedup,
    "op7_language_id": op7_language_id,
    "op8_mixing": op8_mixing,
    "op9_quality_rules": op9_quality_rules,
    "op10_topk": op10_topk,
}
