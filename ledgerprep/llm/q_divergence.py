"""Query of operator 11: the divergence of all sources of the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerprep.llm.divergence import Audit
from ledgerprep.session import Scratch


def parts(audit: Audit) -> DataFrame:
    both = (audit.pairs().withColumn("part", F.lit("pair")), audit.top_terms().withColumn("part", F.lit("term")))
    return both[0].unionByName(both[1]).select("lang", "source", "part", "item", "value", "rank")


def op11_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return parts(Audit(spark.read.parquet(f"{folder}/documents.parquet"), Scratch(spark)))


_OP11 = r"""
WITH d AS (
    SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
    FROM documents
),
o AS MATERIALIZED (SELECT id, lang, source, unnest(w) AS term FROM d),
v AS MATERIALIZED (SELECT lang, term, count(*) AS lang_n FROM o GROUP BY ALL HAVING count(DISTINCT id) >= 30),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM o JOIN v USING (lang, term) GROUP BY ALL),
l AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM v GROUP BY ALL),
t AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
g AS MATERIALIZED (
    SELECT lang, source, coalesce(v, 0) AS v, coalesce(lang_total, 0) AS lang_total, coalesce(total, 0) AS total
    FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN l USING (lang) LEFT JOIN t USING (lang, source)
),
x AS MATERIALIZED (
    SELECT lang, source, term, coalesce(n, 0) AS n,
        1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)) // (total + 5 * v) AS p,
        1 + (1000000000::HUGEINT * (lang_n + 5)) // (lang_total + 5 * v) AS q
    FROM g JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)
),
f AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM x JOIN x y USING (lang, term) WHERE x.source <> y.source GROUP BY ALL),
r AS (
    SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(value, 0)::BIGINT AS value
    FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN f ON f.lang = g.lang AND f.source = g.source AND f.item = h.source
    UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM x WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM r QUALIFY part = 'pair' OR rank <= 50
"""

QUERIES = {"op11_source_divergence": op11_source_divergence}
ORACLES = {"op11_source_divergence": _OP11}
