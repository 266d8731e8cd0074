"""Tables of the trade derived from the given ones, in SQL that Spark and DuckDB both read.

``{name}`` stands for a given table. The expressions give every row a right, wrong or
malformed value by the remainder of its key, so that all rules have work on the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerprep.session import tune

AS_OF = "2001-12-01"

_NIF = "substring('TRWAGMYFPDXBNJZSQVHLCKE', cast((c_custkey * 7919 + 12345) % 23 + 1 as int), 1)"
_EIGHT = "lpad(cast(c_custkey * 7919 + 12345 as string), 8, '0')"
_SEVEN = "lpad(cast((c_custkey * 7919 + 12345) % 10000000 as string), 7, '0')"
_CHECK = "lpad(cast(98 - (c_custkey * 1000000 + 142800) % 97 as string), 2, '0')"
_ACCOUNT = "lpad(cast(c_custkey as string), 20, '0')"

SQL = {
    "partner": f"""
        SELECT c_custkey AS row_id,
          'BP' || cast(c_custkey as string) AS PARTNER_ID,
          CASE WHEN c_custkey % 29 = 0 THEN NULL WHEN c_custkey % 17 = 0 THEN ' n/a '
               WHEN c_custkey % 11 = 0 THEN '  ' || lower(c_name) || '   s.l. '
               WHEN c_custkey % 31 = 0 THEN c_name || ' ' || c_name || ' ' || c_name || ' ' || c_name || ' ' || c_name
               WHEN c_custkey % 3 = 0 THEN 'Firma ' || cast(cast(floor(c_custkey / 12) as bigint) as string)
                 || CASE WHEN c_custkey % 2 = 0 THEN ' S.A.' ELSE ', s.l.' END
               ELSE c_name || '  ' || c_mktsegment END AS NAME,
          CASE WHEN c_custkey % 14 = 0 THEN {_EIGHT} || 'A'
               WHEN c_custkey % 14 = 1 THEN lower({_EIGHT} || '-' || {_NIF})
               WHEN c_custkey % 14 = 2 THEN 'X' || {_SEVEN} || substring('TRWAGMYFPDXBNJZSQVHLCKE', cast(((c_custkey * 7919 + 12345) % 10000000) % 23 + 1 as int), 1)
               WHEN c_custkey % 14 = 3 THEN 'B' || {_SEVEN} || cast(c_custkey % 10 as string)
               WHEN c_custkey % 14 = 4 THEN 'P-' || {_SEVEN} || substring('JABCDEFGHI', cast(c_custkey % 10 + 1 as int), 1)
               WHEN c_custkey % 14 = 5 THEN 'C.' || {_SEVEN} || cast(c_custkey % 10 as string)
               WHEN c_custkey % 14 = 6 THEN 'I' || {_SEVEN} || '1'
               WHEN c_custkey % 70 = 7 THEN NULL
               WHEN c_custkey % 70 = 21 THEN '-'
               WHEN c_custkey % 70 = 35 THEN '123'
               WHEN c_custkey % 70 = 49 THEN '1234X678Z'
               WHEN c_custkey % 70 = 63 THEN 'Z12X4567L'
               ELSE {_EIGHT} || {_NIF} END AS TAX_ID,
          CASE WHEN c_custkey % 13 = 0 THEN 'ES00' || {_ACCOUNT}
               WHEN c_custkey % 13 = 1 THEN lower('es' || {_CHECK} || ' ' || {_ACCOUNT})
               WHEN c_custkey % 26 = 2 THEN 'ES' || {_CHECK}
               WHEN c_custkey % 26 = 15 THEN 'DE' || {_CHECK} || {_ACCOUNT}
               WHEN c_custkey % 26 = 3 THEN '12' || {_ACCOUNT}
               WHEN c_custkey % 52 = 16 THEN NULL
               WHEN c_custkey % 52 = 42 THEN 'GB82 WEST 1234 5698 7654 32'
               ELSE 'ES' || {_CHECK} || {_ACCOUNT} END AS IBAN,
          CASE WHEN c_custkey % 9 = 0 THEN 'DEUTDEDB' WHEN c_custkey % 9 = 1 THEN 'bexp-es-21 xxx'
               WHEN c_custkey % 9 = 2 THEN 'BEXPE' WHEN c_custkey % 9 = 3 THEN '12XPES21'
               WHEN c_custkey % 27 = 4 THEN NULL ELSE 'BEXPES21XXX' END AS BIC,
          CASE WHEN c_custkey % 8 = 0 THEN '0034' || {_EIGHT} WHEN c_custkey % 8 = 1 THEN '+33 ' || {_EIGHT}
               WHEN c_custkey % 8 = 2 THEN '(93) ' || {_SEVEN} WHEN c_custkey % 8 = 3 THEN '-'
               WHEN c_custkey % 16 = 4 THEN NULL WHEN c_custkey % 16 = 12 THEN 'none'
               ELSE '6' || {_EIGHT} END AS TELEPHONE,
          CASE WHEN c_custkey % 10 = 0 THEN cast(1000 + c_custkey * 37 % 9000 as string)
               WHEN c_custkey % 10 = 1 THEN cast(c_custkey * 7 % 1000 as string)
               WHEN c_custkey % 10 = 2 THEN 'E-' || cast(10000 + c_custkey * 37 % 43000 as string)
               WHEN c_custkey % 40 = 3 THEN cast(53000 + c_custkey * 37 % 40000 as string)
               WHEN c_custkey % 40 = 13 THEN NULL WHEN c_custkey % 40 = 23 THEN '-'
               ELSE cast(10000 + c_custkey * 37 % 43000 as string) END AS POSTAL_CODE,
          CASE WHEN c_custkey % 6 = 0 THEN 'madrid' WHEN c_custkey % 6 = 1 THEN ' Las  Palmas '
               WHEN c_custkey % 36 = 2 THEN NULL ELSE 'BARCELONA' END AS PROVINCE,
          CASE WHEN c_nationkey % 5 = 0 THEN 'España' ELSE 'ES' END AS COUNTRY,
          CASE WHEN c_custkey % 12 = 0 THEN 'C/ Gran Via ' || cast(c_custkey as string) || ', 3 B'
               WHEN c_custkey % 12 = 1 THEN 'Av. Diagonal, ' || cast(c_custkey as string) || ', 4-A'
               WHEN c_custkey % 12 = 2 THEN 'Plaza   Mayor S/N'
               WHEN c_custkey % 12 = 3 THEN 'Carretera de Barcelona ' || cast(c_custkey as string) || ' Bis'
               WHEN c_custkey % 12 = 4 THEN 'carrer Balmes ' || cast(c_custkey as string) || ', 1-1'
               WHEN c_custkey % 12 = 5 THEN 'Travesia Sol sin numero, bajo'
               WHEN c_custkey % 12 = 6 THEN 'PL. ' || c_mktsegment || ' ' || cast(c_custkey as string) || 'B'
               WHEN c_custkey % 24 = 7 THEN NULL WHEN c_custkey % 24 = 19 THEN '-'
               WHEN c_custkey % 12 = 8 THEN 'Joan Sala, bajo'
               ELSE 'Ronda ' || c_mktsegment || ' ' || cast(c_custkey as string) || ' piso 2' END AS STREET
        FROM {{customer}}""",
    "material": """
        SELECT p_partkey AS row_id, 'P' || cast(p_partkey as string) AS MATERIAL, p_name AS DESCRIPTION,
          CASE WHEN p_partkey % 7 = 0 THEN ' roh ' WHEN p_partkey % 7 = 1 THEN 'HALB'
               WHEN p_partkey % 7 = 2 THEN 'FERT' WHEN p_partkey % 7 = 3 THEN 'XYZ'
               WHEN p_partkey % 49 = 4 THEN NULL ELSE 'ROH' END AS MAT_TYPE,
          CASE WHEN p_partkey % 5 = 0 THEN 'kg' WHEN p_partkey % 5 = 1 THEN 'BOX'
               WHEN p_partkey % 5 = 2 THEN '' ELSE 'PC' END AS BASE_UOM,
          CASE WHEN p_partkey % 6 = 0 THEN '-' || cast(p_size as string) || ',5' WHEN p_partkey % 6 = 1 THEN ''
               WHEN p_partkey % 6 = 2 THEN '1.234,5' ELSE cast(p_size as string) END AS NET_WEIGHT,
          CASE WHEN p_partkey % 4 = 0 THEN '' WHEN p_partkey % 4 = 1 THEN 'STONE' ELSE 'kg' END AS UNIT_OF_WEIGHT,
          CASE WHEN p_partkey % 8 = 0 THEN 'X' WHEN p_partkey % 8 = 1 THEN 'v' ELSE 'S' END AS PRICE_CTRL,
          CASE WHEN p_partkey % 9 = 0 THEN '0' WHEN p_partkey % 9 = 1 THEN '-1,25'
               WHEN p_partkey % 9 = 2 THEN 'invalid' WHEN p_partkey % 9 = 3 THEN '250000'
               WHEN p_partkey % 18 = 4 THEN NULL ELSE cast(p_retailprice as string) END AS PRICE
        FROM {part}""",
    "bom": """
        SELECT 'O' || cast(l_orderkey as string) AS MATERIAL_PARENT, 'P' || cast(l_partkey as string) AS COMPONENT,
          CASE WHEN l_linenumber % 2 = 0 THEN replace(cast(l_quantity as string), '.', ',')
               ELSE cast(l_quantity as string) END AS QUANTITY,
          'PC' AS UOM
        FROM {lineitem}""",
    "bom_raw": """
        SELECT l_orderkey * 8 + l_linenumber AS row_id, 'O' || cast(l_orderkey as string) AS MATERIAL_PARENT,
          'P' || cast(l_partkey as string) AS COMPONENT,
          CASE WHEN l_partkey % 11 = 0 THEN '0' WHEN l_partkey % 11 = 1 THEN '-' || cast(l_quantity as string)
               WHEN l_partkey % 11 = 2 THEN 'many' WHEN l_partkey % 11 = 3 THEN '12000'
               ELSE cast(l_quantity as string) END AS QUANTITY,
          CASE WHEN l_suppkey % 5 = 0 THEN 'XXX' WHEN l_suppkey % 5 = 1 THEN 'pc' ELSE 'KG' END AS UOM
        FROM {lineitem}""",
    "routing": """
        SELECT 'O' || cast(l_orderkey as string) AS MATERIAL, cast(l_tax as string) AS SETUP_TIME,
          cast(l_discount as string) AS MACHINE_TIME, cast(l_linenumber as string) AS LABOR_TIME,
          CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE cast(20 + l_suppkey % 30 as string) END AS RATE
        FROM {lineitem}""",
    "routing_raw": """
        SELECT l_orderkey * 8 + l_linenumber AS row_id, 'O' || cast(l_orderkey as string) AS MATERIAL,
          CASE WHEN l_suppkey % 6 = 0 THEN '' WHEN l_suppkey % 6 = 1 THEN ' - ' ELSE 'WC' || cast(l_suppkey as string) END AS WORK_CENTER,
          CASE WHEN l_partkey % 9 = 0 THEN '-1' WHEN l_partkey % 9 = 1 THEN 'x' ELSE cast(l_tax as string) END AS SETUP_TIME,
          CASE WHEN l_partkey % 10 = 0 THEN '-0,5' WHEN l_partkey % 10 = 1 THEN '' ELSE cast(l_discount as string) END AS MACHINE_TIME,
          CASE WHEN l_partkey % 12 = 0 THEN '-2' WHEN l_partkey % 12 = 1 THEN NULL WHEN l_partkey % 12 < 5 THEN '0'
               ELSE cast(l_linenumber as string) END AS LABOR_TIME
        FROM {lineitem}""",
    "cost_center": """
        SELECT s_suppkey AS row_id, 'CC' || cast(s_suppkey as string) AS COST_CENTER,
          CASE WHEN s_suppkey % 4 = 0 THEN '20260101' WHEN s_suppkey % 4 = 1 THEN '2026.01.01'
               WHEN s_suppkey % 4 = 2 THEN '' ELSE '01.01.2026' END AS VALID_FROM,
          CASE WHEN s_suppkey % 5 = 0 THEN '99991231' WHEN s_suppkey % 5 = 1 THEN 'never' ELSE '31.12.9999' END AS VALID_TO,
          CASE WHEN s_suppkey % 6 = 0 THEN '-' WHEN s_suppkey % 6 = 1 THEN NULL ELSE s_name END AS PERSON_IN_CHARGE,
          CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE 'SALES' END AS FUNCTIONAL_AREA,
          CASE WHEN s_suppkey % 3 = 0 THEN ' ' ELSE 'H01' END AS HIERARCHY_GROUP
        FROM {supplier}""",
    "master": """
        SELECT 'P' || cast(p_partkey as string) AS MATERIAL,
          CASE WHEN p_partkey % 97 = 0 THEN NULL WHEN p_partkey % 97 = 1 THEN '0'
               ELSE cast(p_retailprice as string) END AS PRICE
        FROM {part} WHERE p_partkey % 101 <> 0
        UNION ALL
        SELECT 'O' || cast(o_orderkey as string), cast(o_totalprice as string) FROM {orders}""",
    "stock": """
        SELECT p_partkey AS row_id, 'P' || cast(p_partkey as string) AS MATERIAL,
          lpad(cast(p_partkey % 10 as string), 4, '0') AS STORAGE_LOCATION,
          CASE WHEN p_partkey % 13 = 0 THEN '-' || cast(p_size as string) || ',5' WHEN p_partkey % 13 = 1 THEN 'n.a.'
               ELSE cast(p_size as string) END AS UNRESTRICTED_STOCK,
          CASE WHEN p_partkey % 17 = 0 THEN '-2' ELSE '0' END AS BLOCKED_STOCK,
          CASE WHEN p_partkey % 19 = 0 THEN ' -0,5' WHEN p_partkey % 19 = 1 THEN NULL ELSE '1' END AS QUALITY_STOCK,
          CASE WHEN p_partkey % 10 = 0 THEN 'g' WHEN p_partkey % 10 = 1 THEN 'TON' WHEN p_partkey % 10 = 2 THEN 'LB'
               WHEN p_partkey % 10 = 3 THEN 'CM' WHEN p_partkey % 10 = 4 THEN ' mm ' WHEN p_partkey % 10 = 5 THEN 'DM'
               WHEN p_partkey % 10 = 6 THEN 'ML' WHEN p_partkey % 10 = 7 THEN NULL ELSE 'PC' END AS BASE_UOM,
          CASE WHEN p_partkey % 23 = 0 THEN '0' ELSE cast(p_retailprice as string) END AS STANDARD_PRICE,
          CASE WHEN p_partkey % 29 = 0 THEN 'unknown'
               ELSE cast(cast(floor(p_retailprice * (70 + p_partkey % 61) / 100) as bigint) as string) END AS MOVING_AVG_PRICE,
          v.TOTAL_VALUE AS TOTAL_VALUE,
          CASE WHEN p_partkey % 6 = 0 THEN v.y || '-' || v.m || '-' || v.d
               WHEN p_partkey % 6 = 1 THEN v.d || '.' || v.m || '.' || v.y
               WHEN p_partkey % 6 = 2 THEN v.y || lpad(v.m, 2, '0') || lpad(v.d, 2, '0')
               WHEN p_partkey % 6 = 3 THEN v.d || '/' || v.m || '/' || v.y
               WHEN p_partkey % 6 = 4 THEN v.y || '-' || v.m || '-' || v.d || 'T00:00:00'
               ELSE 'some day' END AS LAST_MOVEMENT_DATE
        FROM {part} LEFT JOIN (
          SELECT l_partkey, cast(sum(cast(l_extendedprice as decimal(18,2))) as string) AS TOTAL_VALUE,
            cast(year(max(moved)) as string) AS y, cast(month(max(moved)) as string) AS m,
            cast(day(max(moved)) as string) AS d
          FROM (SELECT *, CASE WHEN l_shipdate < timestamp '2000-01-01 00:00:00' OR l_partkey % 2 = 0 THEN l_shipdate END AS moved
            FROM {lineitem})
          GROUP BY l_partkey) v ON p_partkey = v.l_partkey""",
    "supplier_names": """
        SELECT p_partkey AS row_id,
          p_name || ' ' || p_brand || CASE WHEN p_partkey % 4 = 0 THEN ' S.A.' WHEN p_partkey % 4 = 1 THEN ', s.l.u.'
            WHEN p_partkey % 4 = 2 THEN '' ELSE ' Sociedad  Limitada' END AS NAME,
          CASE WHEN p_partkey % 5 = 4 THEN '-' WHEN p_partkey % 40 = 3 THEN 'A-1'
            ELSE 'K ' || lpad(cast(cast(floor(p_partkey / 3) as bigint) as string), 8, '0') END AS TAX_ID,
          CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 3 = 1 THEN '-' ELSE 'mail' || cast(p_partkey as string) END AS EMAIL,
          p_partkey % 2 = 1 AS EMAIL_VALID
        FROM {part}""",
}

GIVEN = ["customer", "part", "orders", "lineitem", "supplier", "documents", "events"]


def given(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{folder}/{name}.parquet")


def derive(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The derived table as a lazy DataFrame over the given files."""
    text = SQL[name]
    used = {t: given(spark, folder, t) for t in GIVEN if "{" + t + "}" in text}
    return spark.sql(text, **used)


def duckdb(name: str) -> str:
    """The same table as DuckDB reads it."""
    text = SQL[name]
    for t in GIVEN:
        text = text.replace("{" + t + "}", t)
    return text
