"""Queries of operators 1 and 9: passages that repeat across documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerprep.llm.suffixes import repeated_passages
from ledgerprep.llm.superkmers import remove_repeats
from ledgerprep.session import Scratch


def op1_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return repeated_passages(docs, Scratch(spark)).select(
        "doc_id", F.col("begin").alias("first_word"), (F.col("stop") - F.col("begin")).alias("n_words"), F.col("copy").alias("is_copy")
    )


def op9_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = remove_repeats(docs, Scratch(spark))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


_WINDOWS = r"""
w AS MATERIALIZED (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
),
p AS (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS pos FROM w WHERE len(words) >= 50),
h AS MATERIALIZED (SELECT doc_id, pos, sha256(array_to_string(words[pos:pos + 49], ' ')) AS h FROM p),
m AS (SELECT h, min(doc_id) AS least, max(doc_id) AS most FROM h GROUP BY h HAVING min(doc_id) < max(doc_id))
"""

_OP9 = f"""
WITH {_WINDOWS},
gone AS (
    SELECT doc_id, list_distinct(flatten(list(range(pos, pos + 50)))) AS gone
    FROM h JOIN m USING (h) WHERE doc_id > least GROUP BY doc_id
),
kept AS (
    SELECT doc_id, words, coalesce(gone, []) AS gone,
        list_filter(range(1, len(words) + 1), lambda i: NOT list_contains(coalesce(gone, []), i)) AS stay
    FROM w LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, len(words)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed,
    sha256(array_to_string(list_transform(stay, lambda i: words[i]), ' ')) AS kept_sha256
FROM kept
"""

_OP1 = f"""
WITH {_WINDOWS},
s AS (SELECT doc_id, pos, doc_id > least AS is_copy FROM h JOIN m USING (h)),
o AS (SELECT *, pos > lag(pos) OVER (PARTITION BY doc_id, is_copy ORDER BY pos) + 50 AS gap FROM s),
r AS (SELECT *, count(*) FILTER (gap) OVER (PARTITION BY doc_id, is_copy ORDER BY pos) AS run FROM o)
SELECT doc_id, (min(pos) - 1)::INTEGER AS first_word, (max(pos) - min(pos) + 50)::INTEGER AS n_words, is_copy
FROM r GROUP BY doc_id, is_copy, run
"""

QUERIES = {"op1_suffix_array_dedup": op1_suffix_array_dedup, "op9_substring_dedup": op9_substring_dedup}
ORACLES = {"op1_suffix_array_dedup": _OP1, "op9_substring_dedup": _OP9}
