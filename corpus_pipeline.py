"""The corpus pipeline: five stages over the documents, each written and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerprep.llm import language, mixing
from ledgerprep.llm.decontaminate import judged, matches
from ledgerprep.llm.jaccard import one_of_each
from ledgerprep.llm.q_tokens import sequences
from ledgerprep.session import Scratch


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model does not reject. It learns from this stage's own labelled rows."""
    return language.predict(docs, language.train(docs)).filter("NOT rejected").select("row.*")


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles of a similarity of 0.8 or more."""
    return one_of_each(docs, Scratch(spark))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not hold a twentieth or more of benchmark passages."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return judged(matches(docs, items, Scratch(spark))).filter("NOT contaminated").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return mixing.mixed(docs, Scratch(spark))


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences in training order: one row for each sequence written."""
    return sequences(docs)


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard", ngram_jaccard),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("token_output", token_output),
]

#: the model of the first stage is not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark)
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
