"""Query of operator 4: all documents as token shards, read back by slot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerprep.llm.token_shards import read_shards, write_shards
from ledgerprep.session import Scratch


def sequences(docs: DataFrame) -> DataFrame:
    """slot, shard, byte, doc_ids and ids_sha256 of every sequence written for ``docs``."""
    scratch = Scratch(docs.sparkSession)
    path = scratch.path()
    plan = write_shards(docs, path, scratch)
    if not plan.take(1):
        return plan.withColumn("ids_sha256", F.lit(None).cast("string"))
    read = read_shards(docs.sparkSession, path).select("slot", F.sha2("ids", 256).alias("ids_sha256"))
    return plan.join(read, "slot")


def op4_token_shards(spark: SparkSession, folder: str) -> DataFrame:
    return sequences(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op4_token_shards": op4_token_shards}
ORACLES: dict[str, str] = {}
