"""A training-corpus pipeline: rules, classifier, near-duplicates, mixture, tokens; each stage on all that the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import bpe, dedup, mixing, quality_classifier, quality_rules
from pagemill.llm.common import cut, drop, scratch
from pagemill.llm.queries import word_vocabulary
from pagemill.session import table


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, with their passing lines; n_chars is that of the text that stays."""
    clean = quality_rules.clean(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality isn't too low, by source and by language within it."""
    return quality_classifier.keep(docs, table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five words, a similarity of 0.8 or more."""
    return dedup.deduplicate(docs, percent=80).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it."""
    return mixing.repeat(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the ids and the decoded text of each document of the mixture."""
    return bpe.digests(docs, word_vocabulary())


STAGES = [("quality_rules", rules), ("quality_classifier", classifier), ("near_dedup", near_dedup), ("mixing", mixture), ("bpe", tokens)]
#: Classifier, sketches and tokens aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other. What a stage wrote for itself goes when it is done, and so does what it read."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        with scratch() as kept:
            out = cut(stage(spark, docs, sf_dir))
            kept.append(out)
        drop(docs)
        docs = out
    return docs
