"""From raw documents to packed windows: the text-preparation operators in a row.

Every stage takes (spark, docs, sf_dir) and returns rows that are written as Parquet and
read again as the next one's docs. All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import postlake
from postlake.llm.decontaminate import without_leaks
from postlake.llm.minhash import without_near_duplicates
from postlake.llm.packing import pack
from postlake.llm.plans import table, vocabulary
from postlake.llm.secrets import redact_secrets
from postlake.llm.toxicity import without_toxic
from postlake.plans.registry import query
from postlake.sources.scratch import cut_lineage

# Python functions travel with their code, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(postlake)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies: the one with the least id."""
    return without_near_duplicates(docs, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark."""
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids, placed in windows."""
    return pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination),
    ("secrets", secrets), ("packing", packing),
]
#: Neither learned scores nor similarity joins nor token ids can be said in SQL.
ORACLE_SQL = None


@query("pipeline", ORACLE_SQL)
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
