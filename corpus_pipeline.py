"""A training corpus from ``documents``: good, different, clean of benchmarks, mixed by source, as token ids.

Every stage takes what the stage before it kept, as written and read again, and all but the last return the columns
of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bizmetrics.functions.lineage import cut_lineage
from bizmetrics.llm.catalog import default_tokenizer
from bizmetrics.llm.decontamination import decontaminate
from bizmetrics.llm.jaccard_join import keep_one
from bizmetrics.llm.quality_model import keep_good
from bizmetrics.llm.source_mixing import mixed_documents
from bizmetrics.llm.text import table
from bizmetrics.llm.token_files import read_ids, write_ids


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on ``labels``, does not reject."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark``."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target asks for: not at all, once or twice."""
    return mixed_documents(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-id files of the mix, read back: position, length and checksum of each document."""
    return read_ids(write_ids(docs, default_tokenizer()), ids=False).drop("ids")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("jaccard_join", jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("token_files", token_files),
]

#: A trained classifier, alignments and a range coder are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
