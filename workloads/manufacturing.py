"""Queries on materials, bills of materials, routings, cost centers and stock."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerprep import fixed_values as fv
from ledgerprep.functions.numbers import number_text, parse_number, with_dates
from ledgerprep.operators import costing, industrial, inventory, readiness
from workloads import oracle_rules as rules
from workloads.derived import AS_OF, derive, duckdb

# ---------------------------------------------------------------- rules


def _rules(source: str, template: str, above: int = industrial.COMPLEX_BOM_ROWS):
    def run(spark, folder):
        rows = industrial.apply_rules(derive(spark, folder, source), template, above)
        return rows.select("row_id", "IND_VALID", "IND_ERROR")

    return run


COMPLEX_ABOVE = 8  # the given orders have at most 13 lines


def _numbers(source: str, *columns: str) -> str:
    parts = ", ".join(f"{rules.number(c)} AS n_{c}" for c in columns)
    return f"src AS (SELECT *{', ' + parts if parts else ''} FROM ({duckdb(source)}))"


def _verdict(errors: list[str], warnings: list[str], source: str = "src") -> str:
    e = "list_filter([" + ", ".join(f"'ERROR: ' || ({x})" for x in errors) + "], lambda m: m IS NOT NULL)"
    w = "list_filter([" + ", ".join(f"'WARN: ' || ({x})" for x in warnings) + "], lambda m: m IS NOT NULL)"
    return f"found AS (SELECT *, {e} AS es, {w} AS ws FROM {source})"


_SHOW = " SELECT row_id, len(es) = 0 AS IND_VALID, array_to_string(list_concat(es, ws), ' | ') AS IND_ERROR FROM found"


def up(c: str) -> str:
    return f"upper(trim(coalesce({c}, 'nan')))"


def as_is(c: str) -> str:
    return f"trim(coalesce({c}, 'nan'))"


def _material_found() -> str:
    kind, unit, weight, control = up("MAT_TYPE"), up("BASE_UOM"), up("UNIT_OF_WEIGHT"), up("PRICE_CTRL")
    errors = [
        f"CASE WHEN n_NET_WEIGHT < 0 THEN 'Peso neto negativo: ' || n_NET_WEIGHT WHEN n_NET_WEIGHT > 0 AND {weight} = '' THEN 'Peso neto indicado pero falta unidad de peso (UNIT_OF_WEIGHT)' END",
        f"CASE WHEN {control} NOT IN ('S', 'V') THEN 'Control de precio ''' || {control} || ''' incorrecto (Debe ser S o V)' END",
        "CASE WHEN n_PRICE IS NULL THEN 'Precio del material no es un valor numérico válido' WHEN n_PRICE < 0 THEN 'Precio negativo no permitido: ' || n_PRICE END",
    ]
    warnings = [
        f"CASE WHEN {kind} NOT IN ('ROH', 'HALB', 'FERT') THEN 'Tipo de material ''' || {kind} || ''' no estándar (ROH, HALB, FERT esperado)' END",
        f"CASE WHEN {unit} <> '' AND {unit} NOT IN {rules.in_list(fv.BASE_UNITS)} THEN 'Unidad de medida base ''' || {unit} || ''' no estándar en SAP' END",
        f"CASE WHEN {weight} <> '' AND {weight} NOT IN {rules.in_list(fv.WEIGHT_UNITS)} THEN 'Unidad de peso ''' || {weight} || ''' no estándar en SAP' END",
        "CASE WHEN n_PRICE = 0 THEN 'Precio del material es 0.0 (Posible falta de valoración)' END",
        f"CASE WHEN {kind} = 'ROH' AND {control} = 'S' AND n_PRICE > 100000 THEN 'Precio estándar de ROH inusualmente alto: ' || n_PRICE END",
    ]
    return f"{_numbers('material', 'NET_WEIGHT', 'PRICE')}, {_verdict(errors, warnings)}"


def _bom_found() -> str:
    unit = up("UOM")
    errors = ["CASE WHEN n_QUANTITY IS NULL THEN 'Cantidad de componente no es un valor numérico válido' WHEN n_QUANTITY <= 0 THEN 'Cantidad de componente menor o igual a cero: ' || n_QUANTITY END"]
    warnings = [
        "CASE WHEN n_QUANTITY >= 9999 THEN 'Cantidad de componente atípica / extremadamente alta: ' || n_QUANTITY END",
        f"CASE WHEN {unit} <> '' AND {unit} NOT IN {rules.in_list(fv.BASE_UNITS)} THEN 'Unidad de medida ''' || {unit} || ''' no estándar en SAP' END",
        f"CASE WHEN parent_rows > {COMPLEX_ABOVE} THEN 'BOM Compleja: El material padre ''' || MATERIAL_PARENT || ''' tiene ' || parent_rows || ' componentes.' END",
    ]
    counted = "counted AS (SELECT *, count(*) OVER (PARTITION BY MATERIAL_PARENT) AS parent_rows FROM src)"
    return f"{_numbers('bom_raw', 'QUANTITY')}, {counted}, {_verdict(errors, warnings, 'counted')}"


def _routing_found() -> str:
    center = as_is("WORK_CENTER")
    errors = [
        f"CASE WHEN {center} IN ('', '-') THEN 'Puesto de trabajo (WORK_CENTER) vacío o no especificado' END",
        "CASE WHEN n_SETUP_TIME IS NULL THEN 'Tiempo de preparación no es un valor numérico válido' WHEN n_SETUP_TIME < 0 THEN 'Tiempo de preparación negativo: ' || n_SETUP_TIME WHEN n_SETUP_TIME = 0 THEN 'SETUP_TIME crítico: tiempo de preparación es 0 en una ruta activa' END",
        "CASE WHEN n_MACHINE_TIME IS NULL THEN 'Tiempo de máquina no es un valor numérico válido' WHEN n_MACHINE_TIME < 0 THEN 'Tiempo de máquina negativo: ' || n_MACHINE_TIME END",
        "CASE WHEN n_LABOR_TIME IS NULL THEN 'Tiempo de mano de obra no es un valor numérico válido' WHEN n_LABOR_TIME < 0 THEN 'Tiempo de mano de obra negativo: ' || n_LABOR_TIME END",
    ]
    warnings = ["CASE WHEN n_MACHINE_TIME = 0 AND n_LABOR_TIME = 0 THEN 'Ambos tiempos de máquina y mano de obra son 0' END"]
    return f"{_numbers('routing_raw', 'SETUP_TIME', 'MACHINE_TIME', 'LABOR_TIME')}, {_verdict(errors, warnings)}"


def _cost_center_found() -> str:
    demanded = {
        "PERSON_IN_CHARGE": "Falta responsable asignado al Centro de Coste (PERSON_IN_CHARGE)",
        "FUNCTIONAL_AREA": "Falta área funcional obligatoria (FUNCTIONAL_AREA)",
        "HIERARCHY_GROUP": "Grupo de jerarquía estándar (HIERARCHY_GROUP) no especificado",
    }
    errors = [f"CASE WHEN {as_is(c)} IN ('', '-') THEN {rules.q(m)} END" for c, m in demanded.items()]
    warnings = [
        f"CASE WHEN {as_is(c)} <> '' AND NOT regexp_full_match({as_is(c)}, '[0-9]{{8}}|[0-9]{{2}}[.][0-9]{{2}}[.][0-9]{{4}}') "
        f"THEN 'Formato de fecha {w} ''' || {as_is(c)} || ''' no estándar (YYYYMMDD o DD.MM.YYYY esperado)' END"
        for c, w in (("VALID_FROM", "inicio"), ("VALID_TO", "fin"))
    ]
    return f"{_numbers('cost_center')}, {_verdict(errors, warnings)}"


_SOURCES = {
    fv.MATERIAL_MASTER: ("material", _material_found()),
    fv.BILL_OF_MATERIALS: ("bom_raw", _bom_found()),
    fv.ROUTING: ("routing_raw", _routing_found()),
    fv.COST_CENTER: ("cost_center", _cost_center_found()),
}


def rule_summary(spark, folder) -> DataFrame:
    result = None
    for template, (source, _) in _SOURCES.items():
        found = industrial.apply_rules(derive(spark, folder, source), template, COMPLEX_ABOVE, findings=True)
        row = industrial.rule_summary(found, template)
        result = row if result is None else result.unionByName(row)
    return result


SUMMARY_SQL = " UNION ALL ".join(
    f"""SELECT * FROM (WITH {found} SELECT '{template}' AS template, CAST(sum(len(es)) AS bigint) AS industrial_errors,
      CAST(sum(len(ws)) AS bigint) AS industrial_warnings,
      count(*) FILTER (WHERE len(list_filter(ws, lambda m: m LIKE 'WARN: BOM Compleja%')) > 0) AS complex_boms,
      count(*) FILTER (WHERE len(list_filter(es, lambda m: m LIKE 'ERROR: SETUP_TIME%')) > 0) AS zero_setup_routes,
      count(*) FILTER (WHERE len(es) > 0) AS rows_in_error FROM found)"""
    for template, (_, found) in _SOURCES.items()
)


def industrial_issues(spark, folder):
    rows = industrial.apply_rules(derive(spark, folder, "routing_raw"), fv.ROUTING)
    return readiness.industrial_issues(rows)


ISSUES_SQL = f"""WITH {_routing_found()}, lines AS (
      SELECT 'ERROR' AS severity, unnest(es) AS m FROM found UNION ALL SELECT 'WARN', unnest(ws) FROM found)
    SELECT severity, regexp_replace(m, '^(WARN|ERROR): ', '') AS message, count(*) AS rows FROM lines GROUP BY 1, 2"""


def first_issues(spark, folder):
    rows = industrial.apply_rules(derive(spark, folder, "material"), fv.MATERIAL_MASTER)
    return readiness.first_issues(rows, "row_id")


FIRST_SQL = f"""WITH {_material_found()} SELECT row_id, MATERIAL AS key, array_to_string(list_concat(es, ws), ' | ') AS issues
    FROM found WHERE len(es) + len(ws) > 0 ORDER BY row_id LIMIT 30"""


# ---------------------------------------------------------------- costing


def _cost(spark, folder) -> DataFrame:
    return costing.standard_cost(
        derive(spark, folder, "master"), derive(spark, folder, "bom"), derive(spark, folder, "routing")
    )


def _rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


_MONEY = {c: 2 for c in ("COST_BOM", "COST_ROUTING", "COST_TOTAL_CALC", "COST_LOADED", "DEVIATION_ABS")}


def standard_cost(spark, folder):
    return _rounded(_cost(spark, folder), **_MONEY, DEVIATION_PCT=4)


def cost_deviation(spark, folder):
    return _rounded(costing.classify_deviation(_cost(spark, folder)), **_MONEY, DEVIATION_PCT=4)


def margin_impact(spark, folder):
    return _rounded(
        costing.costing_kpis(costing.classify_deviation(_cost(spark, folder))),
        total_overvaluation=2, total_undervaluation=2,
    )


def cost_top20(spark, folder):
    return _rounded(costing.largest_deviations(_cost(spark, folder)), **_MONEY, DEVIATION_PCT=4)


def bom_cost(spark, folder):
    return _rounded(costing.bom_cost(derive(spark, folder, "bom"), derive(spark, folder, "master")), COST_BOM=2)


def routing_cost(spark, folder):
    return _rounded(costing.routing_cost(derive(spark, folder, "routing")), COST_ROUTING=2)


def cost_missing_price(spark, folder):
    return costing.unpriced_summary(derive(spark, folder, "bom"), derive(spark, folder, "master"))


COST_CTE = f"""mm AS (SELECT MATERIAL, coalesce({rules.number('PRICE')}, 0) AS PRICE FROM ({duckdb('master')})),
    lines AS (SELECT b.MATERIAL_PARENT, b.COMPONENT, coalesce({rules.number('b.QUANTITY')}, 0) AS q, coalesce(mm.PRICE, 0) AS p
      FROM ({duckdb('bom')}) b LEFT JOIN mm ON b.COMPONENT = mm.MATERIAL),
    bomc AS (SELECT MATERIAL_PARENT AS MATERIAL, sum(q * p) AS COST_BOM FROM lines GROUP BY 1),
    rout AS (SELECT MATERIAL, sum((coalesce({rules.number('SETUP_TIME')}, 0) + coalesce({rules.number('MACHINE_TIME')}, 0)
      + coalesce({rules.number('LABOR_TIME')}, 0)) * coalesce({rules.number('RATE')}, 35)) AS COST_ROUTING FROM ({duckdb('routing')}) GROUP BY 1),
    ids AS (SELECT MATERIAL FROM bomc UNION SELECT MATERIAL FROM rout UNION SELECT MATERIAL FROM mm),
    c1 AS (SELECT ids.MATERIAL, coalesce(COST_BOM, 0) AS COST_BOM, coalesce(COST_ROUTING, 0) AS COST_ROUTING,
      coalesce(PRICE, 0) AS COST_LOADED FROM ids LEFT JOIN bomc USING (MATERIAL) LEFT JOIN rout USING (MATERIAL) LEFT JOIN mm USING (MATERIAL)),
    c2 AS (SELECT *, COST_BOM + COST_ROUTING AS COST_TOTAL_CALC, abs(COST_LOADED - (COST_BOM + COST_ROUTING)) AS DEVIATION_ABS FROM c1),
    cost AS (SELECT *, CASE WHEN COST_TOTAL_CALC <> 0 THEN DEVIATION_ABS / COST_TOTAL_CALC * 100
      WHEN COST_LOADED <> 0 THEN 100.0 ELSE 0.0 END AS DEVIATION_PCT FROM c2),
    classed AS (SELECT *, CASE WHEN DEVIATION_PCT <= 5 THEN 'OK' WHEN DEVIATION_PCT <= 15 THEN 'WARNING' ELSE 'ERROR' END AS DEV_STATUS,
      CASE WHEN COST_LOADED > COST_TOTAL_CALC THEN 'overvalued' WHEN COST_LOADED < COST_TOTAL_CALC THEN 'undervalued' ELSE 'ok' END AS DEV_DIRECTION FROM cost)"""
_COST_SHOWN = "MATERIAL, " + ", ".join(f"round({c}, 2) AS {c}" for c in _MONEY) + ", round(DEVIATION_PCT, 4) AS DEVIATION_PCT"

# ---------------------------------------------------------------- inventory


def abc_class(spark, folder):
    stock = derive(spark, folder, "stock").select("row_id", "MATERIAL", "TOTAL_VALUE")
    return inventory.classify_abc(stock, "row_id").select("row_id", "MATERIAL", "ABC_CLASS")


def abc_summary(spark, folder):
    stock = derive(spark, folder, "stock").select("row_id", "TOTAL_VALUE")
    return inventory.abc_summary(inventory.classify_abc(stock, "row_id"))


ABC_CTE = f"""v AS (SELECT row_id, MATERIAL, CAST(coalesce({rules.number('TOTAL_VALUE')}, 0) AS decimal(28,6)) AS value FROM ({duckdb('stock')})),
    r AS (SELECT *, CAST(sum(value) OVER (ORDER BY value DESC, row_id ROWS UNBOUNDED PRECEDING) AS double) / (SELECT CAST(sum(value) AS double) FROM v) * 100 AS share FROM v),
    abc AS (SELECT *, CASE WHEN share <= 80 THEN 'A' WHEN share <= 95 THEN 'B' ELSE 'C' END AS ABC_CLASS FROM r)"""

_DATES = f"""CASE WHEN regexp_full_match(LAST_MOVEMENT_DATE, '[0-9]{{4}}-.*T.*') THEN strptime(LAST_MOVEMENT_DATE, '%Y-%m-%dT%H:%M:%S')
    WHEN regexp_full_match(LAST_MOVEMENT_DATE, '[0-9]{{4}}-.*') THEN strptime(LAST_MOVEMENT_DATE, '%Y-%m-%d')
    WHEN LAST_MOVEMENT_DATE LIKE '%.%' THEN strptime(LAST_MOVEMENT_DATE, '%d.%m.%Y')
    WHEN LAST_MOVEMENT_DATE LIKE '%/%' THEN strptime(LAST_MOVEMENT_DATE, '%d/%m/%Y')
    WHEN regexp_full_match(LAST_MOVEMENT_DATE, '[0-9]{{8}}') THEN strptime(LAST_MOVEMENT_DATE, '%Y%m%d') END"""
OBSOLETE_MONTHS = 23


def negative_stock(spark, folder):
    return inventory.negative_stock(derive(spark, folder, "stock")).select("row_id", "MATERIAL", *inventory.STOCK_COLUMNS)


_NEGATIVE = " OR ".join(f"coalesce({rules.number(c)}, 0) < 0" for c in inventory.STOCK_COLUMNS)


def obsolete_parts(spark, folder):
    rows = inventory.obsolete_stock(derive(spark, folder, "stock"), AS_OF, OBSOLETE_MONTHS)
    return rows.select("row_id", "MATERIAL", "LAST_MOVEMENT_DATE", F.col("MONTHS_INACTIVE").cast("long"))


_MONTHS = (
    f"list_max(list_filter(range(0, 1200), lambda m: d + to_months(CAST(m AS int)) <= timestamp '{AS_OF} 00:00:00'))"
)
_OBSOLETE = f"d < timestamp '{AS_OF} 00:00:00' - to_months({OBSOLETE_MONTHS})"
DATED = f"dated AS (SELECT *, {_DATES} AS d FROM ({duckdb('stock')}))"


def date_parse(spark, folder):
    stock = with_dates(derive(spark, folder, "stock"), {"d": F.col("LAST_MOVEMENT_DATE")})
    return stock.select("row_id", F.date_format("d", "yyyy-MM-dd HH:mm:ss").alias("moved"))


def number_parse(spark, folder):
    rows = derive(spark, folder, "material").select("row_id", parse_number(F.col("NET_WEIGHT")).alias("value"))
    return rows.withColumn("text", F.expr(number_text("value")))


def unreadable_dates(spark, folder):
    return inventory.unreadable_dates(derive(spark, folder, "stock"))


def price_discrepancy(spark, folder):
    rows = inventory.price_discrepancies(derive(spark, folder, "stock"))
    return rows.select("row_id", F.round("PRICE_DIFF_ABS", 4).alias("diff"), F.round("PRICE_DIFF_PCT", 4).alias("pct"), F.col("PRICE_DISC_STATUS").alias("status"))


def price_counts(spark, folder):
    return inventory.price_counts(derive(spark, folder, "stock"))


PRICED = f"""p AS (SELECT row_id, {rules.number('STANDARD_PRICE')} AS s, {rules.number('MOVING_AVG_PRICE')} AS a FROM ({duckdb('stock')})),
    j AS (SELECT *, abs(s - a) AS diff, abs(s - a) / s * 100 AS pct FROM p WHERE s > 0 AND a IS NOT NULL),
    priced AS (SELECT *, CASE WHEN pct > 20 THEN 'ERROR' WHEN pct > 10 THEN 'WARNING' ELSE 'OK' END AS status FROM j)"""


def unit_standardize(spark, folder):
    rows = inventory.standardize_units(derive(spark, folder, "stock"))
    return rows.select("row_id", "STOCK_STANDARDIZED", "STOCK_UNIT_STANDARDIZED")


_UNIT = "upper(trim(coalesce(BASE_UOM, '')))"
_FACTOR = f"CASE {_UNIT} " + " ".join(f"WHEN '{u}' THEN {f!r}" for u, (f, _) in fv.UNIT_FACTORS.items()) + " END"
_TARGET = f"CASE {_UNIT} " + " ".join(f"WHEN '{u}' THEN '{t}'" for u, (_, t) in fv.UNIT_FACTORS.items()) + f" ELSE {_UNIT} END"
_STOCK = rules.number("UNRESTRICTED_STOCK")


def inventory_kpis(spark, folder):
    enriched = inventory.enrich(derive(spark, folder, "stock"), "row_id")
    return inventory.health_kpis(enriched, AS_OF, OBSOLETE_MONTHS)


INVENTORY_SQL = f"""WITH {ABC_CTE}, {DATED}, {PRICED}
    SELECT (SELECT count(*) FROM dated WHERE {_NEGATIVE}) AS negative_stocks,
      (SELECT count(*) FROM dated WHERE {_OBSOLETE}) AS obsolete_materials,
      (SELECT count(*) FROM priced WHERE status <> 'OK') AS price_discrepancies,
      (SELECT count(*) FROM abc WHERE ABC_CLASS = 'A') AS abc_a_count, (SELECT count(*) FROM abc WHERE ABC_CLASS = 'B') AS abc_b_count,
      (SELECT count(*) FROM abc WHERE ABC_CLASS = 'C') AS abc_c_count,
      (SELECT count(*) FROM dated WHERE {_FACTOR} IS NOT NULL AND {_STOCK} IS NOT NULL) AS unit_conversions"""


def inventory_alerts(spark, folder):
    return readiness.inventory_alerts(derive(spark, folder, "stock"), "row_id", AS_OF, OBSOLETE_MONTHS)


ALERTS_SQL = f"""WITH {DATED} SELECT * FROM (SELECT row_id, MATERIAL AS material, 'negative_stock' AS alert,
      STORAGE_LOCATION || ': ' || UNRESTRICTED_STOCK AS detail FROM dated WHERE {_NEGATIVE} ORDER BY row_id LIMIT 10)
    UNION ALL SELECT * FROM (SELECT row_id, MATERIAL, 'obsolete', {_MONTHS} || ': ' || LAST_MOVEMENT_DATE
      FROM dated WHERE {_OBSOLETE} ORDER BY {_MONTHS} DESC, row_id LIMIT 10)"""

COST_COLUMNS = ("COST_BOM", "COST_ROUTING", "COST_TOTAL_CALC", "COST_LOADED", "DEVIATION_ABS", "DEVIATION_PCT")
PACKED_COST_SQL = f"WITH {COST_CTE} SELECT MATERIAL, " + ", ".join(f"round({c}, 2) AS {c}" for c in COST_COLUMNS) + ", DEV_STATUS, DEV_DIRECTION FROM classed"

PAIRS = {
    "mm_rules": (_rules("material", fv.MATERIAL_MASTER), "WITH " + _material_found() + _SHOW),
    "bom_rules": (_rules("bom_raw", fv.BILL_OF_MATERIALS, COMPLEX_ABOVE), "WITH " + _bom_found() + _SHOW),
    "routing_rules": (_rules("routing_raw", fv.ROUTING), "WITH " + _routing_found() + _SHOW),
    "cost_center_rules": (_rules("cost_center", fv.COST_CENTER), "WITH " + _cost_center_found() + _SHOW),
    "rule_summary": (rule_summary, SUMMARY_SQL),
    "industrial_issues": (industrial_issues, ISSUES_SQL),
    "first_issues": (first_issues, FIRST_SQL),
    "standard_cost": (standard_cost, f"WITH {COST_CTE} SELECT {_COST_SHOWN} FROM cost"),
    "cost_deviation": (cost_deviation, f"WITH {COST_CTE} SELECT {_COST_SHOWN}, DEV_STATUS, DEV_DIRECTION FROM classed"),
    "margin_impact": (
        margin_impact,
        f"""WITH {COST_CTE} SELECT count(*) FILTER (WHERE DEV_STATUS = 'OK') AS cost_deviations_ok,
          count(*) FILTER (WHERE DEV_STATUS = 'WARNING') AS cost_deviations_warning, count(*) FILTER (WHERE DEV_STATUS = 'ERROR') AS cost_deviations_error,
          round(sum(DEVIATION_ABS) FILTER (WHERE DEV_DIRECTION = 'overvalued'), 2) AS total_overvaluation,
          round(sum(DEVIATION_ABS) FILTER (WHERE DEV_DIRECTION = 'undervalued'), 2) AS total_undervaluation,
          count(*) FILTER (WHERE DEVIATION_PCT > 0) AS materials_with_deviation, count(*) AS materials_total,
          round(count(*) FILTER (WHERE DEVIATION_PCT > 0) / count(*) * 100, 2) AS pct_with_deviation FROM classed""",
    ),
    "cost_top20": (cost_top20, f"WITH {COST_CTE} SELECT {_COST_SHOWN} FROM (SELECT * FROM cost ORDER BY DEVIATION_PCT DESC, MATERIAL LIMIT 20)"),
    "bom_cost": (bom_cost, f"WITH {COST_CTE} SELECT MATERIAL, round(COST_BOM, 2) AS COST_BOM FROM bomc"),
    "routing_cost": (routing_cost, f"WITH {COST_CTE} SELECT MATERIAL, round(COST_ROUTING, 2) AS COST_ROUTING FROM rout"),
    "cost_missing_price": (
        cost_missing_price,
        f"""WITH {COST_CTE}, n AS (SELECT DISTINCT COMPONENT FROM lines WHERE p = 0)
          SELECT count(*) AS unpriced_components, array_to_string(list_sort(list(COMPONENT))[1:10], ', ') AS sample FROM n""",
    ),
    "abc_class": (abc_class, f"WITH {ABC_CTE} SELECT row_id, MATERIAL, ABC_CLASS FROM abc"),
    "abc_summary": (
        abc_summary,
        f"""WITH {ABC_CTE}, g AS (SELECT ABC_CLASS, count(*) AS n, CAST(sum(value) AS double) AS w FROM abc GROUP BY 1)
          SELECT k AS ABC_CLASS, coalesce(n, 0) AS count, round(coalesce(n, 0) / (SELECT count(*) FROM abc) * 100, 2) AS pct_items,
            round(coalesce(w, 0) / (SELECT CAST(sum(value) AS double) FROM abc) * 100, 2) AS pct_value
          FROM (SELECT unnest(['A', 'B', 'C']) AS k) LEFT JOIN g ON k = ABC_CLASS""",
    ),
    "negative_stock": (
        negative_stock, f"SELECT row_id, MATERIAL, UNRESTRICTED_STOCK, BLOCKED_STOCK, QUALITY_STOCK FROM ({duckdb('stock')}) WHERE {_NEGATIVE}"
    ),
    "obsolete_parts": (
        obsolete_parts, f"WITH {DATED} SELECT row_id, MATERIAL, LAST_MOVEMENT_DATE, {_MONTHS} AS MONTHS_INACTIVE FROM dated WHERE {_OBSOLETE}"
    ),
    "date_parse": (date_parse, f"WITH {DATED} SELECT row_id, strftime(d, '%Y-%m-%d %H:%M:%S') AS moved FROM dated"),
    "number_parse": (number_parse, f"SELECT row_id, {rules.number('NET_WEIGHT')} AS value, CAST({rules.number('NET_WEIGHT')} AS varchar) AS text FROM ({duckdb('material')})"),
    "unreadable_dates": (unreadable_dates, f"WITH {DATED} SELECT count(*) FILTER (WHERE d IS NULL AND trim(LAST_MOVEMENT_DATE) <> '') AS unreadable_dates FROM dated"),
    "price_discrepancy": (price_discrepancy, f"WITH {PRICED} SELECT row_id, round(diff, 4) AS diff, round(pct, 4) AS pct, status FROM priced WHERE status <> 'OK'"),
    "price_counts": (
        price_counts,
        f"""WITH {PRICED} SELECT count(*) FILTER (WHERE status = 'OK') AS ok, count(*) FILTER (WHERE status = 'WARNING') AS warning,
          count(*) FILTER (WHERE status = 'ERROR') AS error, count(*) FILTER (WHERE status <> 'OK') AS total_with_discrepancy FROM priced""",
    ),
    "unit_standardize": (
        unit_standardize,
        f"SELECT row_id, coalesce(round({_STOCK} * {_FACTOR}, 6), {_STOCK}) AS STOCK_STANDARDIZED, {_TARGET} AS STOCK_UNIT_STANDARDIZED FROM ({duckdb('stock')})",
    ),
    "inventory_kpis": (inventory_kpis, INVENTORY_SQL),
    "inventory_alerts": (inventory_alerts, ALERTS_SQL),
}
QUERIES = {name: pair[0] for name, pair in PAIRS.items()}
ORACLES = {name: pair[1] for name, pair in PAIRS.items()}
