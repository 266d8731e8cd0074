"""Query of operator 12: the prefix tree of conversations, each rebuilt with the beginning of another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerprep.llm.trie import prefix_trie, sequences
from ledgerprep.session import Scratch

STEP, MOST = 5, 9


def rebuilt(given: DataFrame) -> DataFrame:
    """The first h turns of conversation c - c % 5, then c's own after its first h; h is crc32(c) % 9."""
    heads = given.filter(F.col("conv") % STEP == 0).select(
        F.col("conv").alias("source"), *(F.slice(c, 1, MOST - 1).alias(f"{c}_head") for c in ("codes", "sizes"))
    )
    h = (F.crc32(F.col("conv").cast("string")) % MOST).cast("int")
    own = given.select("*", (F.col("conv") - F.col("conv") % STEP).alias("source"), h.alias("h"))
    parts = (
        F.expr(f"concat(coalesce(slice({c}_head, 1, h), slice({c}, 1, 0)), slice({c}, h + 1, size({c})))").alias(c)
        for c in ("codes", "sizes")
    )
    return own.join(heads, "source", "left").select("conv", *parts)


def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    scratch = Scratch(spark)
    given = sequences(spark.read.parquet(f"{folder}/conversations.parquet"), scratch)
    return prefix_trie(rebuilt(given), scratch).withColumnRenamed("ends", "ends_sha256")


_CRC = """xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))
), 4294967295::BIGINT)"""
_OP12 = f"""
WITH g AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM g),
c AS (SELECT conv_id, {_CRC} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (
    SELECT c.conv_id, 0 AS part, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 5 AND pos <= h
    UNION ALL SELECT c.conv_id, 1, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND pos > h
),
s AS (
    SELECT c.conv_id, coalesce(list({{'role': role, 'text': text}} ORDER BY part, pos) FILTER (part IS NOT NULL), []) AS s
    FROM c LEFT JOIN r USING (conv_id) GROUP BY c.conv_id
),
p AS (SELECT conv_id, s, d, s[1:d] AS p FROM (SELECT *, unnest(range(len(s) + 1)) AS d FROM s)),
n AS MATERIALIZED (
    SELECT p, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(s) = d), '')) AS ends_sha256,
        CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * strlen(p[d].text) END AS saved
    FROM p GROUP BY p, d
),
k AS (SELECT p[1:depth - 1] AS p, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
m AS MATERIALIZED (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (p, depth)),
b AS (
    SELECT a.p, a.depth, count(*) FILTER (b.n_children = 0) AS n_leaves, sum(b.saved) AS saved_tokens
    FROM m a JOIN m b ON b.depth >= a.depth AND b.p[1:a.depth] = a.p GROUP BY ALL
)
SELECT m.conv_id, m.depth, u.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, m.ends_sha256
FROM m JOIN b USING (p, depth) LEFT JOIN m u ON m.depth > 0 AND u.depth = m.depth - 1 AND u.p = m.p[1:m.depth - 1]
"""

QUERIES = {"op12_prefix_trie": op12_prefix_trie}
ORACLES = {"op12_prefix_trie": _OP12}
