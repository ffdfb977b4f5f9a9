"""From raw documents to a training mix: five stages, each a written table for the next one.

Stages take (spark, docs, sf_dir); all but the last return the columns of documents, whatever others
the table has. SQL cannot express the toxicity model, so the whole has no oracle; each stage is tested
by itself.

Null and empty texts are never toxic, hold no repeated line and no benchmark passage, are near copies
of nothing, and are left out by the mix, which takes documents with a token only. Rows without an id
stay until the mix. Rows that repeat an id stay or go together as near copies. Very long texts are read
whole. An empty table goes through all stages empty."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from encore.llm import decontaminate, jaccard, lines, mix, queries, toxicity
from encore.llm.common import own_name, table
from encore.staging import stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model calls toxic go. It is fitted on the labels beside the documents."""
    return toxicity.drop_toxic(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; a document keeps its row, its n_chars follow its text."""
    own = own_name("lines")
    found, kept = lines.dedup_lines(docs, out=own), F.col(f"{own}.kept")
    return found.withColumns({"text": F.when(F.col("text").isNotNull(), kept), "n_chars": F.when(F.col("text").isNotNull(), F.length(kept).cast("long")).otherwise(F.col("n_chars"))}).drop(own)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return jaccard.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the target weights take: ids with their leaf, tokens and copies."""
    return mix.mix(docs, queries.domain(), weights=queries.MIX_WEIGHTS)


STAGES = [("toxicity", drop_toxic), ("line dedup", dedup_lines), ("n-gram Jaccard join", dedup_documents), ("benchmark decontamination", drop_benchmark), ("mixing to target weights", mix_sources)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
