"""Query of operator 10: language of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerprep.llm import language


def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = language.train(docs.select("doc_id", "text", "lang"))
    found = language.predict(docs.select("doc_id", "text"), model)
    out = F.coalesce(language.held_out(F.col("row.doc_id")), F.lit(False)).alias("held_out")
    return found.select("row.doc_id", out, "lang_pred", "score", "rejected")


QUERIES = {"op10_language_id": op10_language_id}
ORACLES: dict[str, str] = {}
