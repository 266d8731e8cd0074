"""Query of operator 6: main text of all pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerprep.llm.html_text import extract


def op6_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).withColumn("n_chars", F.char_length("text").cast("long"))


QUERIES = {"op6_html_extraction": op6_html_extraction}
ORACLES: dict[str, str] = {}
