"""Queries on the partner table: cleaning, checks, quarantine, mapping, figures of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerprep import fixed_values as fv
from ledgerprep.functions import address, contact, identifiers
from ledgerprep.functions.text import alphanumeric_code, clean_text, matching_tax_key, strip_legal_form
from ledgerprep.operators import cleansing, crosschecks, mapping, quarantine, readiness, schema
from ledgerprep.plans.cleanse import ROW_ID, Options, dry_run, judge, run_kpis, with_row_id
from ledgerprep.session import cut
from workloads import oracle_rules as rules
from workloads.derived import derive, duckdb, given

TYPES = {
    "PARTNER_ID": "text", "NAME": "text", "TAX_ID": "tax_id", "IBAN": "iban", "BIC": "bic",
    "TELEPHONE": "phone", "POSTAL_CODE": "postal_code", "PROVINCE": "province", "COUNTRY": "text",
    "STREET": "address",
}
OPTIONS = Options(TYPES, template=fv.BUSINESS_PARTNER, row_id="row_id")
PARTNER = duckdb("partner")


def partner(spark: SparkSession, folder: str) -> DataFrame:
    return derive(spark, folder, "partner")


def judged(spark: SparkSession, folder: str) -> DataFrame:
    return judge(with_row_id(partner(spark, folder), "row_id"), OPTIONS)


def written(spark: SparkSession, folder: str) -> DataFrame:
    """The judged rows as a run keeps them: written once, then split."""
    return cut(judged(spark, folder))


def _checked(column: str, semantic: str):
    def run(spark, folder):
        rows = cleansing.cleanse(partner(spark, folder).select("row_id", column), {column: semantic})
        return rows.select(
            "row_id", F.col(column).alias("cleaned"), F.col(f"{column}_VALID").alias("valid"),
            F.col(f"{column}_ERROR").alias("error"),
        )

    sql = f"""WITH c AS (SELECT row_id, {rules.CLEAN[semantic](column)} AS k FROM ({PARTNER})),
        e AS (SELECT *, {rules.ERROR[semantic]("k")} AS error FROM c)
        SELECT row_id, CASE WHEN k = '' THEN '-' ELSE k END AS cleaned, error = '' AS valid, error FROM e"""
    return run, sql


def _cleaned(source: str, column: str, expression, sql_expression, key: str = "row_id"):
    def run(spark, folder):
        rows = given(spark, folder, source) if source == "documents" else derive(spark, folder, source)
        return rows.select(key, expression(F.col(column)).alias("cleaned"))

    table = source if source == "documents" else f"({duckdb(source)})"
    return run, f"SELECT {key}, {sql_expression(column)} AS cleaned FROM {table}"


def province_lookup(spark, folder):
    digits = partner(spark, folder).select("row_id", contact.postal_digits(F.col("POSTAL_CODE")).alias("code"))
    return digits.select("row_id", "code", contact.province_of(F.col("code")).alias("province"))


PROVINCE_SQL = f"""WITH c AS (SELECT row_id, {rules.postal("POSTAL_CODE")} AS code FROM ({PARTNER}))
    SELECT row_id, code, {rules.province("code")} AS province FROM c"""


def bic_country_check(spark, folder):
    """BIC check with the country of the IBAN as an extra demand."""
    rows = partner(spark, folder).select(
        "row_id", alphanumeric_code(F.col("BIC")).alias("code"), F.col("IBAN")
    )
    return rows.select("row_id", "code", identifiers.bic_error(F.col("code"), F.col("IBAN")).alias("error"))


BIC_COUNTRY_SQL = f"""WITH c AS (SELECT row_id, {rules.code("BIC")} AS code, upper(substring(trim(IBAN), 1, 2)) AS wanted
      FROM ({PARTNER})), e AS (SELECT *, {rules.bic_error("code")} AS plain FROM c)
    SELECT row_id, code, CASE WHEN plain = '' AND length(wanted) = 2 AND wanted <> substring(code, 5, 2)
      THEN 'Discrepancia: el país del BIC ''' || substring(code, 5, 2) || ''' no coincide con el del IBAN ''' || wanted || ''''
      ELSE plain END AS error FROM e"""


def address_split(spark, folder):
    rows = cleansing.cleanse(partner(spark, folder).select("row_id", "STREET"), {"STREET": "address"})
    names = dict(zip(address.PART_SUFFIXES, ("street_type", "street_name", "house_number", "floor")))
    return rows.select("row_id", *[F.col(f"STREET{s}").alias(n) for s, n in names.items()])


def _address_sql() -> str:
    kinds = " ".join(
        f"WHEN regexp_matches(a, {rules.q('^(' + p.replace('º', chr(186)) + ')')}) THEN {rules.q(n)}"
        for p, n in fv.STREET_TYPES
    )
    words = "|".join(p for p, _ in fv.STREET_TYPES)
    anywhere, at_end = r"\b(" + fv.HOUSE_NUMBER + r")\b", r"\b(" + fv.HOUSE_NUMBER_AT_END + ")$"
    split = f"regexp_extract(rest, {rules.q('^(.*?)' + anywhere + '(.*)$')}, ['n', 'h', 'f'])"
    tail = f"regexp_extract(l, {rules.q('^(.*?)' + at_end)}, ['n', 'h'])"
    bare = lambda x: f"trim({x}, ' ,.-')"
    return f"""WITH c AS (SELECT row_id, coalesce({rules.address("STREET")}, '') AS a FROM ({PARTNER})),
      t AS (SELECT *, CASE {kinds} ELSE '' END AS kind,
        ltrim(substring(a, length(regexp_extract(a, {rules.q('^(' + words + ')')}, 1)) + 1)) AS rest FROM c),
      p AS (SELECT *, {bare("substring(rest, 1, instr(rest, ',') - 1)")} AS l FROM t),
      s AS (SELECT *, CASE WHEN instr(rest, ',') > 0 THEN {tail} END AS e, {split} AS w FROM p)
      SELECT row_id, CASE WHEN a = '' THEN '' ELSE kind END AS street_type,
        CASE WHEN a = '' THEN '' WHEN e.h <> '' THEN {bare("e.n")} WHEN w.h <> '' THEN {bare("w.n")} ELSE {bare("rest")} END AS street_name,
        CASE WHEN a = '' THEN '' WHEN e.h <> '' THEN e.h WHEN w.h <> '' THEN w.h ELSE 'S/N' END AS house_number,
        CASE WHEN a = '' THEN '' WHEN e.h <> '' THEN {bare("substring(rest, instr(rest, ',') + 1)")} WHEN w.h <> '' THEN {bare("w.f")} ELSE '' END AS floor
      FROM s"""


BASE = "WITH " + rules.cleansed(PARTNER, TYPES)
CROSSED = BASE + ", " + rules.crosschecked()
MARKED = CROSSED + ", " + rules.rejects(TYPES)
_TEMPLATE = [c for c in TYPES if rules.limits(c)]


def template_check(spark, folder):
    rows = cleansing.cleanse(partner(spark, folder), TYPES)
    return rows.select("row_id", *_TEMPLATE, *[f"{c}_SAP_ERROR" for c in _TEMPLATE])


def geo_repair(spark, folder):
    types = {"POSTAL_CODE": "postal_code", "PROVINCE": "province"}
    rows = cleansing.cleanse(partner(spark, folder).select("row_id", *types), types)
    return crosschecks.repair_province(rows, "POSTAL_CODE", "PROVINCE", "repaired").select(
        "row_id", "POSTAL_CODE", "PROVINCE", "repaired"
    )


def bank_coherence(spark, folder):
    types = {"IBAN": "iban", "BIC": "bic"}
    rows = cleansing.cleanse(partner(spark, folder).select("row_id", *types), types)
    return crosschecks.check_bank_country(rows, "IBAN", "BIC").select("row_id", "BIC", "BIC_VALID", "BIC_ERROR")


def quarantined(spark, folder):
    rows = quarantine.rejected(written(spark, folder))
    return rows.select("row_id", "TAX_ID", "IBAN", "MOTIVO_RECHAZO", "CAMPO_AFECTADO", "SUGERENCIA")


def accepted_rows(spark, folder):
    return quarantine.accepted(written(spark, folder)).select("row_id", *TYPES)


def reject_reasons(spark, folder):
    return quarantine.reject_reasons(quarantine.rejected(written(spark, folder)))


def _reasons_sql() -> str:
    cases = " ".join(
        "WHEN " + " OR ".join(f"contains(lower(MOTIVO_RECHAZO), {rules.q(w)})" for w in words) + f" THEN {rules.q(m)}"
        for words, m in quarantine._CATEGORIES
    )
    return f"""{MARKED} SELECT CAMPO_AFECTADO AS field, CASE {cases} ELSE MOTIVO_RECHAZO END AS reason, count(*) AS rows
      FROM marked WHERE CAMPO_AFECTADO IS NOT NULL GROUP BY 1, 2"""


def clean_kpis(spark, folder):
    rows = cleansing.cleanse(partner(spark, folder), TYPES, marks=True)
    return cleansing.cleaning_kpis(rows, TYPES)


def _kpi_sql_parts() -> list[str]:
    n = lambda cond: f"count(*) FILTER (WHERE {cond})"
    up = lambda c: f"upper(trim(coalesce(raw_{c}, '')))"
    return [
        f"count(*) * {sum(t == 'text' for t in TYPES.values())} AS text",
        n(f"TAX_ID_VALID AND {up('TAX_ID')} <> s_TAX_ID") + " AS tax_id_fixes",
        n("NOT TAX_ID_VALID") + " AS tax_id_errors",
        n("IBAN_VALID AND upper(replace(raw_IBAN, ' ', '')) <> s_IBAN") + " AS iban_fixes",
        n("NOT IBAN_VALID") + " AS iban_errors",
        n("trim(coalesce(raw_TELEPHONE, '')) <> s_TELEPHONE") + " AS phone_fixes",
        n("POSTAL_CODE_VALID AND trim(raw_POSTAL_CODE) <> s_POSTAL_CODE") + " AS postal_code_fixes",
        n("NOT POSTAL_CODE_VALID") + " AS postal_code_errors",
        n(f"{up('PROVINCE')} <> s_PROVINCE") + " AS province_fixes",
        n(f"BIC_VALID AND {up('BIC')} <> s_BIC") + " AS bic_fixes",
        n("NOT BIC_VALID") + " AS bic_errors",
        n(f"{up('STREET')} <> s_STREET") + " AS address_fixes",
    ]


def run_metrics(spark, folder):
    return quarantine.run_metrics(judged(spark, folder))


METRICS_SQL = f"""{MARKED} SELECT count(*) AS processed_rows, count(*) FILTER (WHERE CAMPO_AFECTADO IS NULL) AS valid_rows,
    count(CAMPO_AFECTADO) AS rejected_rows, round(count(CAMPO_AFECTADO) / count(*) * 100, 2) AS rejection_rate FROM marked"""


def dry(spark, folder):
    lines = dry_run(partner(spark, folder), OPTIONS, rows=25)
    return lines.select(
        F.col("Fila").cast("long").alias("line"), F.col("Estado").alias("state"),
        F.col("`TAX_ID (Origen)`").alias("tax_before"), F.col("`TAX_ID (Limpio)`").alias("tax_after"),
        F.col("`PROVINCE (Limpio)`").alias("province_after"),
    )


DRY_SQL = f"""{MARKED} SELECT row_number() OVER (ORDER BY row_id) AS line,
    CASE WHEN CAMPO_AFECTADO IS NULL THEN 'Válido' ELSE 'Rechazado (' || CAMPO_AFECTADO || ')' END AS state,
    coalesce(raw_TAX_ID, '') AS tax_before, TAX_ID AS tax_after, PROVINCE AS province_after
    FROM marked ORDER BY row_id LIMIT 25"""

_MAPPING = {"row_id": "KEY", "NAME": "CUSTOMER", "TAX_ID": "VAT", "PROVINCE": "REGION", "absent": "NOWHERE"}


def map_columns(spark, folder):
    return mapping.map_columns(
        partner(spark, folder), _MAPPING, ["CUSTOMER", "VAT", "REGION", "CURRENCY", "CHANNEL"],
        {"VAT": "UNKNOWN", "CURRENCY": "EUR"},
    )


MAP_SQL = f"""SELECT row_id AS KEY, coalesce(NAME, '-') AS CUSTOMER,
    CASE WHEN TAX_ID IS NULL OR TAX_ID = '-' THEN 'UNKNOWN' ELSE TAX_ID END AS VAT, coalesce(PROVINCE, '-') AS REGION,
    'EUR' AS CURRENCY, '-' AS CHANNEL FROM ({PARTNER})"""


def staging(spark, folder):
    return mapping.staging_projection(partner(spark, folder).drop("BIC"), fv.BUSINESS_PARTNER)


STAGING_SQL = "SELECT " + ", ".join(
    "'' AS BIC" if c == "BIC" else f"trim(coalesce({c}, '')) AS {c}" for c in fv.TEMPLATES[fv.BUSINESS_PARTNER]
) + f" FROM ({PARTNER})"


def technical_pruning(spark, folder):
    return mapping.prune_technical(
        cleansing.cleanse(partner(spark, folder).select("row_id", "NAME", "IBAN"), {"NAME": "text", "IBAN": "iban"})
    )


_CONSTRAINTS = {
    "row_id": {"required": True, "nullable": False, "type": "int"},
    "NAME": {"required": True, "nullable": False, "type": "str"},
    "POSTAL_CODE": {"required": True, "nullable": False, "type": "int"},
    "TELEPHONE": {"required": False, "nullable": True, "type": "float"},
    "CREDIT_LIMIT": {"required": True, "nullable": True, "type": "float"},
    "IBAN": {"required": False, "nullable": False, "type": "str"},
}


def schema_violations(spark, folder):
    found = schema.schema_violations(partner(spark, folder), _CONSTRAINTS, "row_id")
    return found.select("check", "column", "violations", F.array_join("rows", ",").alias("rows"), "value")


def _schema_sql() -> str:
    parts = ["SELECT 'missing_column' AS check, 'CREDIT_LIMIT' AS column, 1 AS violations, NULL AS rows, NULL AS value"]
    for c in ("NAME", "POSTAL_CODE", "IBAN"):
        parts.append(
            f"SELECT 'not_null', '{c}', count(*), array_to_string(list_sort(list(row_id + 1))[1:10], ','), NULL "
            f"FROM src WHERE {c} IS NULL OR trim({c}) = '' OR {c} = 'nan' HAVING count(*) > 0"
        )
    for c, kind in (("POSTAL_CODE", "int"), ("TELEPHONE", "float")):
        parts.append(
            f"SELECT 'type_{kind}', '{c}', 1, CAST(min(row_id) + 1 AS varchar), arg_min({c}, row_id) FROM src "
            f"WHERE trim({c}) <> '' AND NOT regexp_full_match(trim({c}), '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?') HAVING count(*) > 0"
        )
    return f"WITH src AS ({PARTNER}) " + " UNION ALL ".join(parts)


def column_quality(spark, folder):
    return readiness.column_quality(judged(spark, folder), TYPES)


def _quality_sql() -> str:
    parts = []
    ok = "CAMPO_AFECTADO IS NULL"
    for c, t in TYPES.items():
        nulls = f"count(*) FILTER (WHERE {ok} AND {c} IN ('', '-'))"
        errors = f"count(*) FILTER (WHERE {ok} AND NOT {c}_VALID)" if t in rules.ERROR else "0"
        warnings = f"count(*) FILTER (WHERE {ok} AND {c}_SAP_ERROR <> '')"
        parts.append(
            f"SELECT '{c}' AS column, '{t}' AS type, {nulls} AS nulls, round({nulls} / count(*) * 100, 1) AS null_pct, "
            f"{errors} AS errors, {warnings} AS template_warnings, CASE WHEN {errors} > 0 THEN 'error' "
            f"WHEN {warnings} > 0 THEN 'warning' ELSE 'ready' END AS status FROM marked"
        )
    return MARKED + " " + " UNION ALL ".join(parts)


def impact(spark, folder):
    return readiness.impact(run_kpis(judged(spark, folder), TYPES))


IMPACT_SQL = f"""{MARKED}, k AS (SELECT {", ".join(_kpi_sql_parts()).replace("BIC_VALID", "bic_alone")},
      count(*) AS total, count(*) FILTER (WHERE CAMPO_AFECTADO IS NULL) AS valid FROM marked)
    SELECT round((tax_id_fixes * 10 + postal_code_fixes * 5 + iban_fixes * 15 + province_fixes * 5 + bic_fixes * 5
        + address_fixes * 10 + phone_fixes * 2) / 60, 1) AS hours_saved,
      (iban_errors + iban_fixes) * 100 AS avoided_risk_eur, round(valid / total * 100, 1) AS ready_to_load_pct FROM k"""


def entry_table(spark, folder):
    """All KPIs of a run in one row."""
    return run_kpis(judged(spark, folder), TYPES).select(
        *cleansing.KPI_NAMES, "processed_rows", "valid_rows", "rejected_rows", "provinces_repaired", "bank_discrepancies"
    )


RUN_KPI_SQL = f"""{MARKED} SELECT {", ".join(_kpi_sql_parts()).replace("BIC_VALID", "bic_alone")}, count(*) AS processed_rows,
    count(*) FILTER (WHERE CAMPO_AFECTADO IS NULL) AS valid_rows, count(CAMPO_AFECTADO) AS rejected_rows,
    count(*) FILTER (WHERE repaired) AS provinces_repaired, count(*) FILTER (WHERE discrepant) AS bank_discrepancies FROM marked"""

PAIRS = {
    "text_clean": _cleaned("documents", "text", clean_text, rules.text, "doc_id"),
    "text_clean_case_kept": _cleaned(
        "documents", "text", lambda c: clean_text(c, uppercase=False), lambda c: rules.text(c, upper=False), "doc_id"
    ),
    "partner_name_clean": _cleaned("partner", "NAME", clean_text, rules.text),
    "province_clean": _cleaned("partner", "PROVINCE", clean_text, rules.text),
    "phone_norm": _cleaned("partner", "TELEPHONE", contact.normalize_phone, rules.phone),
    "address_clean": _cleaned(
        "partner", "STREET", address.clean_address, lambda c: f"coalesce({rules.address(c)}, '')"
    ),
    "suffix_strip": _cleaned("supplier_names", "NAME", strip_legal_form, rules.suffixless),
    "tax_key": _cleaned("supplier_names", "TAX_ID", matching_tax_key, rules.tax_key),
    "tax_id_check": _checked("TAX_ID", "tax_id"),
    "iban_check": _checked("IBAN", "iban"),
    "postal_check": _checked("POSTAL_CODE", "postal_code"),
    "bic_check": _checked("BIC", "bic"),
    "bic_country_check": (bic_country_check, BIC_COUNTRY_SQL),
    "province_lookup": (province_lookup, PROVINCE_SQL),
    "address_split": (address_split, _address_sql()),
    "template_check": (
        template_check,
        f"{BASE} SELECT row_id, {', '.join(_TEMPLATE)}, {', '.join(f'{c}_SAP_ERROR' for c in _TEMPLATE)} FROM checked",
    ),
    "geo_repair": (geo_repair, f"{CROSSED} SELECT row_id, POSTAL_CODE, PROVINCE, repaired FROM crossed"),
    "bank_coherence": (bank_coherence, f"{CROSSED} SELECT row_id, BIC, BIC_VALID, BIC_ERROR FROM crossed"),
    "quarantine": (
        quarantined,
        f"{MARKED} SELECT row_id, TAX_ID, IBAN, MOTIVO_RECHAZO, CAMPO_AFECTADO, SUGERENCIA FROM marked WHERE CAMPO_AFECTADO IS NOT NULL",
    ),
    "accepted_rows": (
        accepted_rows, f"{MARKED} SELECT row_id, {', '.join(TYPES)} FROM marked WHERE CAMPO_AFECTADO IS NULL"
    ),
    "reject_reasons": (reject_reasons, _reasons_sql()),
    "clean_kpis": (clean_kpis, f"{BASE} SELECT {', '.join(_kpi_sql_parts())} FROM checked"),
    "run_metrics": (run_metrics, METRICS_SQL),
    "run_kpis": (entry_table, RUN_KPI_SQL),
    "dry_run": (dry, DRY_SQL),
    "map_columns": (map_columns, MAP_SQL),
    "staging_projection": (staging, STAGING_SQL),
    "technical_pruning": (
        technical_pruning,
        f"WITH {rules.cleansed(PARTNER, {'NAME': 'text', 'IBAN': 'iban'})} SELECT row_id, NAME, IBAN FROM checked"
    ),
    "schema_violations": (schema_violations, _schema_sql()),
    "column_quality": (column_quality, _quality_sql()),
    "business_impact": (impact, IMPACT_SQL),
}
QUERIES = {name: pair[0] for name, pair in PAIRS.items()}
ORACLES = {name: pair[1] for name, pair in PAIRS.items()}
