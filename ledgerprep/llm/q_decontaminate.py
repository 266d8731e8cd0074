"""Query of operator 3: benchmark passages in the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerprep.llm.decontaminate import judged, matches
from ledgerprep.session import Scratch


def op3_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    names = F.array_join(F.array_sort(F.transform("match.items", lambda i: i.cast("string"))), ",")
    return judged(matches(docs, items, Scratch(spark))).select(
        "row.doc_id", "n_words", "n_hit", (F.size("match.items") + F.col("match.unnamed").cast("int")).cast("long").alias("n_items"),
        F.sha2(names.cast("binary"), 256).alias("items_sha256"), "contaminated",
    )


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(table: str, key: str) -> str:
    return rf"""SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM {table}"""


_OP3 = f"""
WITH d AS MATERIALIZED ({_words('documents', 'doc_id')}),
b AS MATERIALIZED ({_words('benchmark', 'item_id')}),
v AS MATERIALIZED (
    SELECT item_id, least(13, len(words)) AS n,
        unnest([array_to_string(words[i:i + least(13, len(words)) - 1], ' ')
            for i in range(1, greatest(1, len(words) - 12) + 1)]) AS win
    FROM b WHERE len(words) > 0
),
sizes AS (SELECT DISTINCT n FROM v),
places AS (
    SELECT doc_id, n, words, unnest(range(1, len(words) - n + 2)) AS pos FROM d, sizes WHERE len(words) >= n
),
found AS MATERIALIZED (
    SELECT doc_id, pos, n, item_id FROM (SELECT doc_id, n, pos, array_to_string(words[pos:pos + n - 1], ' ') AS win FROM places)
    JOIN v USING (n, win)
),
hit AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS w FROM found) GROUP BY doc_id),
item AS (
    SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS names
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM found) GROUP BY doc_id
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(names, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN item USING (doc_id)
"""

QUERIES = {"op3_decontaminate": op3_decontaminate}
ORACLES = {"op3_decontaminate": _OP3}
