"""Query of operator 2: documents linked by their shingles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerprep.llm.jaccard import near_duplicates
from ledgerprep.session import Scratch


def op2_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    found = near_duplicates(docs, Scratch(spark), k=3, num=90, den=100)
    return found.select("doc_id", "n_shingles", "component_id")


_OP2 = r"""
WITH RECURSIVE w AS MATERIALIZED (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
    FROM documents
),
s AS MATERIALIZED (
    SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
        ELSE list_distinct([array_to_string(words[i:i + 2], ' ') for i in range(1, len(words) - 1)]) END AS shingles
    FROM w
),
u AS MATERIALIZED (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s),
e AS MATERIALIZED (
    SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
        AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
),
r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT doc_id, len(shingles)::BIGINT AS n_shingles, least_id AS component_id
FROM s JOIN (SELECT a AS doc_id, min(b) AS least_id FROM r GROUP BY a) USING (doc_id)
"""

QUERIES = {"op2_ngram_jaccard": op2_ngram_jaccard}
ORACLES = {"op2_ngram_jaccard": _OP2}
