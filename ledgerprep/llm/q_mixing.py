"""Query of operator 7: all documents mixed by weight of their sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerprep.llm import mixing
from ledgerprep.session import Scratch


def op7_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "source", "text")
    sized = scratch.keep(docs.select("doc_id", F.col("source").cast("string"), mixing.n_words(F.col("text")).alias("size")))
    taken = mixing.copies_of_sized(sized, scratch)
    return (
        sized.alias("d")
        .join(taken.alias("t"), mixing.same_document("d", "t"))
        .select("d.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "d.source", "copies")
    )


QUERIES = {"op7_mix_sources": op7_mix_sources}
ORACLES: dict[str, str] = {}
