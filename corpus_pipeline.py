"""Corpus preparation: language, toxicity, near copies, private data, packing.

Each stage takes all that its predecessor kept and returns the columns of documents; the last one
returns a row for each packed piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cinderline.llm.common import materialise
from cinderline.llm.language import keep_languages
from cinderline.llm.packing import pack
from cinderline.llm.pseudonyms import without_private
from cinderline.llm.simhash import keep_one
from cinderline.llm.toxicity import keep_harmless


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models of this corpus recognise."""
    return keep_languages(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels, does not take for toxic."""
    return keep_harmless(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id."""
    return keep_one(docs)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with pseudonyms for personal data."""
    return without_private(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences."""
    return pack(docs)


STAGES = [("language", language), ("toxicity", toxicity), ("near_copies", near_copies), ("private_data", private_data), ("packing", packing)]

#: Models, forests of links and the packing program are beyond SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
