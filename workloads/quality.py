"""Queries on profiles, files and the whole run."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerprep import fixed_values as fv
from ledgerprep.operators import profile
from ledgerprep.plans.cleanse import ROW_ID, Options, run_cleansing
from ledgerprep.plans.premigration import merge_duplicates, readiness_table, run_premigration, write_package
from ledgerprep.session import shared_folder
from ledgerprep.sources.csv import read_table, rejected_records
from ledgerprep.sources.sinks import read_package
from workloads import manufacturing
from workloads import oracle_rules as rules
from workloads import partner as partners
from workloads.derived import AS_OF, derive, duckdb, given

PARTNER = duckdb("partner")
_COLUMNS = ["row_id", *partners.TYPES]


def _texts(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


def null_profile(spark, folder):
    return profile.null_profile(_texts(derive(spark, folder, "partner")))


def _null_sql(source: str, columns: list[str]) -> str:
    parts = []
    for c in columns:
        n = f"count(*) FILTER (WHERE {c} IS NULL OR trim(CAST({c} AS varchar)) = '' OR CAST({c} AS varchar) = 'nan')"
        parts.append(f"SELECT '{c}' AS column, {n} AS null_count, round({n} / count(*) * 100, 2) AS null_percentage FROM src")
    return f"WITH src AS ({source}) " + " UNION ALL ".join(parts)


_TYPED = {
    "id_text": "cast(o_orderkey as string)", "padded": "lpad(cast(o_orderkey as string), 9, '0')",
    "whole": "cast(o_totalprice as string)", "as_int": "cast(o_custkey as string) || '.0'",
    "day": "substring(cast(o_orderdate as string), 1, 10)", "priority": "o_orderpriority",
    "nothing": "CASE WHEN o_orderkey >= 0 THEN ' ' END",
    "mixed": "CASE WHEN o_orderkey = 7 THEN 'seven' ELSE cast(o_orderkey as string) END",
}


def type_profile(spark, folder):
    orders = given(spark, folder, "orders")
    return profile.type_profile(orders.selectExpr(*[f"{e} AS {c}" for c, e in _TYPED.items()]))


def _type_sql() -> str:
    parts = []
    for c in _TYPED:
        filled = f"trim({c}) <> '' AND {c} <> 'nan'"
        num = f"TRY_CAST(trim({c}) AS double)"
        parts.append(
            f"""SELECT '{c}' AS column, CASE WHEN count(*) = 0 THEN 'empty'
              WHEN bool_and({num} IS NOT NULL) AND bool_or({c} LIKE '0_%') THEN 'numeric_str (leads 0)'
              WHEN bool_and({num} IS NOT NULL AND {num} = floor({num})) THEN 'integer' WHEN bool_and({num} IS NOT NULL) THEN 'decimal'
              WHEN bool_and(TRY_CAST({c} AS date) IS NOT NULL) THEN 'datetime' ELSE 'text' END AS inferred_type FROM src WHERE {filled}"""
        )
    columns = ", ".join(f"{e} AS {c}" for c, e in _TYPED.items())
    return f"WITH src AS (SELECT {columns} FROM orders) " + " UNION ALL ".join(parts)


def exact_duplicates(spark, folder):
    """All columns of all events; every seventh event comes once more and every 21st once more again."""
    events = given(spark, folder, "events")
    return profile.duplicate_rows(events.unionByName(events.filter("event_id % 7 = 0")).unionByName(events.filter("event_id % 21 = 0")))


def column_profile(spark, folder):
    return profile.column_profile(_texts(derive(spark, folder, "stock"))).select("column", "null_count", "null_percentage")


def csv_scan(spark, folder):
    """The partner table written as text by ``;`` and read back through dialect detection."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    rows = derive(spark, folder, "partner").select("row_id", "NAME", "TAX_ID", "COUNTRY")
    rows.write.options(
        sep=";", header=True, encoding="iso-8859-1", escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)
    return read_table(spark, path)


def _written(df, spark, name=None, mode="error", encoding="utf-8"):
    path = name or f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.mode(mode).options(
        sep=";", header=True, encoding=encoding, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)
    return path


_QUOTED = "concat(coalesce(NAME, ''), CASE row_id % 4 WHEN 0 THEN chr(10) || 'second; line' WHEN 1 THEN ' \"so\" named' ELSE '' END)"


def csv_scan_quoted(spark, folder):
    """Names with line breaks, separators and quotes inside, in every fourth row each."""
    rows = derive(spark, folder, "partner").selectExpr("row_id", f"{_QUOTED} AS NAME", "COUNTRY")
    return read_table(spark, _written(rows, spark))


QUOTED_SQL = f"SELECT CAST(row_id AS varchar) AS row_id, nullif({_QUOTED}, '') AS NAME, COUNTRY FROM ({PARTNER})"


def csv_scan_numbered(spark, folder):
    """The same in several files in order, with the number of each record over all files."""
    rows = derive(spark, folder, "partner").selectExpr("row_id", f"{_QUOTED} AS NAME", "COUNTRY")
    path = _written(rows.repartitionByRange(5, "row_id").sortWithinPartitions("row_id"), spark)
    return read_table(spark, path, row_id="number")


NUMBERED_SQL = f"""SELECT row_number() OVER (ORDER BY row_id) - 1 AS number, CAST(row_id AS varchar) AS row_id,
    nullif({_QUOTED}, '') AS NAME, COUNTRY FROM ({PARTNER})"""
_LAST = 25


def csv_unclosed_quote(spark, folder):
    """A file whose quote opens in one of the last rows and never closes: that record holds all after it."""
    rows = derive(spark, folder, "partner").select("row_id", "COUNTRY")
    last = rows.agg(F.max("row_id")).first()[0]
    mark = F.when(F.col("row_id") == last - _LAST, '"never closed').when(F.col("row_id") % 3 == 0, '"a\nb"').otherwise(F.col("COUNTRY"))
    lines = rows.select("row_id", F.concat_ws(";", "row_id", mark).alias("line"))
    head = spark.range(1).select(F.lit(-1).cast("long").alias("row_id"), F.lit("row_id;COUNTRY").alias("line"))
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    lines.unionByName(head).where(f"row_id % 3 <> 0 OR row_id <= {last - _LAST}").coalesce(1).sortWithinPartitions("row_id").select("line").write.text(path)
    kept = read_table(spark, path, surplus="skip").agg(
        F.lit("kept").alias("kind"), F.count_if(F.col("COUNTRY").contains("\n")).alias("broken"), F.count(F.lit(1)).cast("string").alias("row_id")
    )
    gone = rejected_records(spark, path).select(F.lit("rejected").alias("kind"), F.lit(0).cast("long").alias("broken"), F.sha2("record", 256).alias("row_id"))
    return kept.unionByName(gone)


UNCLOSED_SQL = f"""WITH src AS ({PARTNER}), l AS (SELECT row_id, max(row_id) OVER () - {_LAST} AS open, COUNTRY FROM src)
    SELECT 'kept' AS kind, count(*) FILTER (row_id % 3 = 0) AS broken, CAST(count(*) AS varchar) AS row_id FROM l WHERE row_id < open
    UNION ALL SELECT 'rejected', 0, sha256(string_agg(row_id || ';' || CASE WHEN row_id = open THEN '"never closed' ELSE COUNTRY END, chr(10) ORDER BY row_id))
      FROM l WHERE row_id = open OR row_id > open AND row_id % 3 <> 0"""


def csv_scan_mixed_encoding(spark, folder):
    """One folder of UTF-8 and ISO-8859-1 files; letters beyond ASCII stand in the last rows only."""
    rows = derive(spark, folder, "partner").selectExpr("row_id", "concat(COUNTRY, CASE WHEN row_id > 1000 THEN ' MUÑOZ' ELSE '' END) AS COUNTRY")
    rows = rows.sort("row_id")
    path = _written(rows.filter("row_id % 2 = 0"), spark)
    _written(rows.filter("row_id % 2 = 1"), spark, path, "append", "iso-8859-1")
    return read_table(spark, path)


MIXED_SQL = f"SELECT CAST(row_id AS varchar) AS row_id, COUNTRY || CASE WHEN row_id > 1000 THEN ' MUÑOZ' ELSE '' END AS COUNTRY FROM ({PARTNER})"
_WIDE = 250


def csv_scan_wide_header(spark, folder):
    """A header of 250 long names (over 10 KB), of which three columns are asked for."""
    rows = derive(spark, folder, "partner").select("row_id", *(F.col("row_id").alias(f"A_COLUMN_NAME_OF_MORE_THAN_FORTY_LETTERS_IN_ALL_{i}") for i in range(1, _WIDE)))
    return read_table(spark, _written(rows, spark)).select("row_id", "A_COLUMN_NAME_OF_MORE_THAN_FORTY_LETTERS_IN_ALL_200", f"A_COLUMN_NAME_OF_MORE_THAN_FORTY_LETTERS_IN_ALL_{_WIDE - 1}")


WIDE_SQL = f"""SELECT CAST(row_id AS varchar) AS row_id, CAST(row_id AS varchar) AS A_COLUMN_NAME_OF_MORE_THAN_FORTY_LETTERS_IN_ALL_200,
    CAST(row_id AS varchar) AS A_COLUMN_NAME_OF_MORE_THAN_FORTY_LETTERS_IN_ALL_{_WIDE - 1} FROM ({PARTNER})"""
CSV_SQL = f"SELECT CAST(row_id AS varchar) AS row_id, nullif(NAME, '') AS NAME, TAX_ID, COUNTRY FROM ({PARTNER})"

_DEDUP = Options(
    partners.TYPES, template=fv.BUSINESS_PARTNER, row_id="row_id", dedup_column="NAME", dedup_threshold=100.0, as_of=AS_OF,
    obsolescence_months=manufacturing.OBSOLETE_MONTHS,
)


def cleanse_run(spark, folder):
    """Accepted rows of a whole run after merging at threshold 100."""
    result = run_cleansing(derive(spark, folder, "partner"), _DEDUP)
    merged = merge_duplicates(result, "keep_primary")
    return merged.select(F.col(ROW_ID).alias("row_id"), "PARTNER_ID", "NAME", "TAX_ID", "PROVINCE", "BIC_VALID")


ACCEPTED = f"""{partners.MARKED}, ok AS (SELECT * FROM marked WHERE CAMPO_AFECTADO IS NULL),
    t AS (SELECT *, {rules.tax_key('TAX_ID')} AS tk, {rules.suffixless('NAME')} AS bare FROM ok),
    k AS (SELECT *, CASE WHEN tk IS NULL THEN row_id ELSE min(row_id) OVER (PARTITION BY tk) END AS key_rep FROM t),
    b AS (SELECT row_id, min(row_id) OVER (PARTITION BY bare) AS g FROM k WHERE row_id = key_rep AND NAME <> '-'),
    grouped AS (SELECT k.*, coalesce(b.g, k.key_rep) AS g FROM k LEFT JOIN b ON k.key_rep = b.row_id)"""


def full_run(spark, folder):
    """Readiness of a run with its side tables, duplicates merged by keeping the primary row."""
    result = run_premigration(
        derive(spark, folder, "partner"), _DEDUP, derive(spark, folder, "master"), derive(spark, folder, "bom"),
        derive(spark, folder, "routing"), derive(spark, folder, "stock"), "row_id",
    )
    return readiness_table(result, "keep_primary", merged=True)


_ISSUE = [c for c, t in partners.TYPES.items() if t in rules.ERROR]
FULL_SQL = f"""{ACCEPTED}, kept AS (SELECT * FROM grouped WHERE row_id = g),
    kk AS (SELECT {", ".join(partners._kpi_sql_parts()).replace("BIC_VALID", "bic_alone")}, count(CAMPO_AFECTADO) AS bad FROM marked),
    i AS (SELECT count(*) AS n, {" + ".join(f"count(*) FILTER (WHERE NOT {c}_VALID)" for c in _ISSUE)} AS crit,
      {" + ".join(f"count(*) FILTER (WHERE {c}_SAP_ERROR <> '')" for c in partners._TEMPLATE)} AS warns FROM kept),
    cc AS (SELECT * FROM ({manufacturing.ORACLES['margin_impact']})), vv AS (SELECT * FROM ({manufacturing.INVENTORY_SQL})),
    dup AS (SELECT g, count(*) AS n, count(*) FILTER (WHERE row_id <> key_rep) AS tax FROM grouped GROUP BY 1 HAVING count(*) > 1),
    fz AS (SELECT count(*) AS f FROM (SELECT DISTINCT g, NAME FROM grouped x WHERE row_id = key_rep AND g IN (SELECT g FROM dup)
      AND NAME <> (SELECT NAME FROM grouped y WHERE y.row_id = x.g))),
    f AS (SELECT n + bad AS total_records, n AS valid_records, bad AS rejected_records, kk.*, (SELECT count(*) FROM grouped) - n AS gone,
      crit + cost_deviations_error + negative_stocks AS critical_issues,
      warns + cost_deviations_warning + obsolete_materials + price_discrepancies AS warning_issues FROM i, kk, cc, vv)
    SELECT total_records, valid_records, rejected_records, round((tax_id_fixes * 10 + postal_code_fixes * 5 + iban_fixes * 15 + province_fixes * 5
        + bic_fixes * 5 + address_fixes * 10 + phone_fixes * 2 + gone * 20) / 60, 1) AS hours_saved,
      (iban_errors + iban_fixes) * 100 AS avoided_risk_eur, round(valid_records / total_records * 100, 1) AS ready_to_load_pct,
      critical_issues, warning_issues,
      greatest(0.0::double, least(100.0::double, round((1 - (critical_issues * 2 + warning_issues) / (total_records * {len(partners.TYPES)} * 2)) * 100, 1))) AS readiness_score,
      (SELECT count(*) FROM dup) AS duplicate_groups, (SELECT CAST(count(*) + coalesce(sum(tax), 0) AS bigint) FROM dup) + (SELECT f FROM fz) AS records_affected FROM f"""


def _package(spark, folder) -> dict[str, DataFrame]:
    """Tables of a package that a run writes, read back."""
    result = run_premigration(
        derive(spark, folder, "partner"), _DEDUP, derive(spark, folder, "master"), derive(spark, folder, "bom"),
        derive(spark, folder, "routing"), derive(spark, folder, "stock"), "row_id",
    )
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    write_package(result, path)
    return read_package(spark, path)


def package_files(spark, folder):
    """Rows of every table of a package."""
    tables, counts = _package(spark, folder), None
    for name in ("clean", "rejected", "staging", "inventory", "duplicates"):
        one = tables[name].agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("file"), "rows")
        counts = one if counts is None else counts.unionByName(one)
    return counts


FILES_SQL = f"""{ACCEPTED} SELECT 'clean' AS file, count(*) AS rows FROM ok UNION ALL SELECT 'staging', count(*) FROM ok
    UNION ALL SELECT 'rejected', count(CAMPO_AFECTADO) FROM marked UNION ALL SELECT 'inventory', count(*) FROM part
    UNION ALL SELECT 'duplicates', count(*) FROM grouped WHERE g IN (SELECT g FROM grouped GROUP BY 1 HAVING count(*) > 1)"""
_REASONS = ("MOTIVO_RECHAZO", "CAMPO_AFECTADO", "SUGERENCIA")


def package_clean(spark, folder):
    return _package(spark, folder)["clean"].select(*partners.TYPES)


def package_rejected(spark, folder):
    return _package(spark, folder)["rejected"].select("PARTNER_ID", "NAME", "TAX_ID", "IBAN", *_REASONS)


def package_staging(spark, folder):
    return _package(spark, folder)["staging"]


def package_duplicates(spark, folder):
    return _package(spark, folder)["duplicates"].select("group_id", "row_id", "match_type", "value")


def package_costing(spark, folder):
    """Costs as the package holds them."""
    cost = _package(spark, folder)["costing"]
    return cost.select("MATERIAL", *[F.round(F.col(c).cast("double"), 2).alias(c) for c in manufacturing.COST_COLUMNS], "DEV_STATUS", "DEV_DIRECTION")


def _as_read(columns) -> str:
    return ", ".join(f"nullif({c}, '') AS {c}" for c in columns)


CLEAN_SQL = f"{ACCEPTED} SELECT {_as_read(partners.TYPES)} FROM ok"
REJECTED_SQL = f"{ACCEPTED} SELECT {_as_read(['PARTNER_ID', 'NAME', 'TAX_ID', 'IBAN', *_REASONS])} FROM marked WHERE CAMPO_AFECTADO IS NOT NULL"
STAGED_SQL = f"{ACCEPTED} SELECT {', '.join(f"nullif(trim(coalesce({c}, '')), '') AS {c}" for c in fv.TEMPLATES[fv.BUSINESS_PARTNER])} FROM ok"
REPORT_SQL = f"""{ACCEPTED}, n AS (SELECT x.*, y.NAME AS first_name FROM grouped x JOIN grouped y ON y.row_id = x.g)
    SELECT g AS group_id, row_id, CASE WHEN row_id <> key_rep THEN 'tax_id' WHEN NAME = first_name OR row_id = g THEN 'primary' ELSE 'fuzzy' END AS match_type,
      NAME AS value FROM n WHERE g IN (SELECT g FROM grouped GROUP BY 1 HAVING count(*) > 1)"""


def table_profile(spark, folder):
    """Rows, copies and columns of a table, with the empty cells of each column."""
    table, columns = profile.table_profile(_texts(derive(spark, folder, "partner")))
    return columns.select("column", "null_count").join(table)


TABLE_SQL = f"""SELECT p."column", p.null_count, t.* FROM ({_null_sql(PARTNER, _COLUMNS)}) p,
    (SELECT count(*) AS total_rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM ({PARTNER}))) AS exact_duplicates,
      {len(_COLUMNS)} AS total_columns FROM ({PARTNER})) t"""


def audit_trail(spark, folder):
    result = run_cleansing(derive(spark, folder, "partner"), partners.OPTIONS)
    return result.audit.select("level", "step", "row_count")


AUDIT_SQL = f"""{partners.MARKED} SELECT 'SYSTEM' AS level, 'start' AS step, count(*) AS row_count FROM marked
    UNION ALL SELECT 'LEAN ALGORITHM', 'geography', count(*) FILTER (WHERE repaired) FROM marked
    UNION ALL SELECT 'WARNING', 'bank', count(*) FILTER (WHERE discrepant) FROM marked
    UNION ALL SELECT 'WARNING', 'industrial', 0 UNION ALL SELECT 'WARNING', 'cells', 0
    UNION ALL SELECT 'WARNING', 'quarantine', count(CAMPO_AFECTADO) FROM marked
    UNION ALL SELECT 'LEAN ALGORITHM', 'end', count(*) FILTER (WHERE CAMPO_AFECTADO IS NULL) FROM marked"""

_MATERIAL_TYPES = {
    "MATERIAL": "text", "DESCRIPTION": "text", "MAT_TYPE": "text", "BASE_UOM": "text", "NET_WEIGHT": "text",
    "UNIT_OF_WEIGHT": "text", "PRICE_CTRL": "text", "PRICE": "text",
}


def clean_and_material_rules(spark, folder):
    """Cleaning plus material rules, the run whose time is published."""
    options = Options(_MATERIAL_TYPES, template=fv.MATERIAL_MASTER, row_id="row_id")
    return run_cleansing(derive(spark, folder, "material"), options).kpis.select(
        "processed_rows", "rejected_rows", "text", "industrial_errors", "industrial_warnings", "rows_in_error"
    )


def _material_run_sql() -> str:
    base = "WITH " + rules.cleansed(duckdb("material"), _MATERIAL_TYPES) + ", " + rules.rejects(_MATERIAL_TYPES, "checked")
    found = manufacturing._material_found()
    head, tail = found.split(") FROM (", 1)[0], found[found.index("found AS"):]
    del head
    numbers = f"src2 AS (SELECT *, {rules.number('NET_WEIGHT')} AS n_NET_WEIGHT, {rules.number('PRICE')} AS n_PRICE FROM marked)"
    return f"""{base}, {numbers}, {tail.replace("FROM src)", "FROM src2)")}
      SELECT count(*) AS processed_rows, count(CAMPO_AFECTADO) AS rejected_rows, count(*) * {len(_MATERIAL_TYPES)} AS text,
        CAST(sum(len(es)) AS bigint) AS industrial_errors, CAST(sum(len(ws)) AS bigint) AS industrial_warnings,
        count(*) FILTER (WHERE len(es) > 0) AS rows_in_error FROM found"""


PAIRS = {
    "null_profile": (null_profile, _null_sql(PARTNER, _COLUMNS)),
    "type_profile": (type_profile, _type_sql()),
    "exact_duplicates": (
        exact_duplicates,
        """WITH e AS (SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_id % 7 = 0 UNION ALL SELECT * FROM events WHERE event_id % 21 = 0)
          SELECT count(*) AS total_rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM e)) AS exact_duplicates FROM e""",
    ),
    "column_profile": (
        column_profile,
        _null_sql(duckdb("stock"), [
            "row_id", "MATERIAL", "STORAGE_LOCATION", "UNRESTRICTED_STOCK", "BLOCKED_STOCK", "QUALITY_STOCK", "BASE_UOM",
            "STANDARD_PRICE", "MOVING_AVG_PRICE", "TOTAL_VALUE", "LAST_MOVEMENT_DATE",
        ]),
    ),
    "csv_scan": (csv_scan, CSV_SQL),
    "csv_scan_quoted": (csv_scan_quoted, QUOTED_SQL),
    "csv_scan_numbered": (csv_scan_numbered, NUMBERED_SQL),
    "csv_unclosed_quote": (csv_unclosed_quote, UNCLOSED_SQL),
    "csv_scan_mixed_encoding": (csv_scan_mixed_encoding, MIXED_SQL),
    "csv_scan_wide_header": (csv_scan_wide_header, WIDE_SQL),
    "cleanse_run": (
        cleanse_run, f"{ACCEPTED} SELECT row_id, PARTNER_ID, NAME, TAX_ID, PROVINCE, BIC_VALID FROM grouped WHERE row_id = g"
    ),
    "readiness": (full_run, FULL_SQL),
    "package_files": (package_files, FILES_SQL),
    "package_clean": (package_clean, CLEAN_SQL),
    "package_rejected": (package_rejected, REJECTED_SQL),
    "package_staging": (package_staging, STAGED_SQL),
    "package_duplicates": (package_duplicates, REPORT_SQL),
    "package_costing": (package_costing, manufacturing.PACKED_COST_SQL),
    "table_profile": (table_profile, TABLE_SQL),
    "audit_trail": (audit_trail, AUDIT_SQL),
    "clean_and_material_rules": (clean_and_material_rules, _material_run_sql()),
}
QUERIES = {name: pair[0] for name, pair in PAIRS.items()}
ORACLES = {name: pair[1] for name, pair in PAIRS.items()}
