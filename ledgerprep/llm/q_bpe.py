"""Query of operator 13: all documents encoded, and decoded from the ids."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerprep.llm.bpe import decode, encode


def op13_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return decode(encode(docs, path), path).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


QUERIES = {"op13_byte_bpe": op13_byte_bpe}
ORACLES: dict[str, str] = {}
