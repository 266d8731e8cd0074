"""Business rules for materials, bills of materials, routings and cost centers.

A job is an ordered list of findings in SQL, each a message that is null when the rule holds.
They are computed once per row in a projection of their own; ``IND_VALID``, ``IND_ERROR`` and
the counters read them there. A null cell reads as ``nan``, which is what a null looks like as
text to the rules being matched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerprep import fixed_values as fv
from ledgerprep.functions.numbers import number_text, parse_number
from ledgerprep.functions.text import strip

ERRORS, WARNINGS, COMPLEX, ZERO_SETUP = "_IND_ERRORS", "_IND_WARNINGS", "_IND_COMPLEX", "_IND_ZERO_SETUP"
HELPERS = (ERRORS, WARNINGS, COMPLEX, ZERO_SETUP)
COMPLEX_BOM_ROWS = 50
COUNTERS = ("industrial_errors", "industrial_warnings", "complex_boms", "zero_setup_routes")

_PARENT_ROWS = "_PARENT_ROWS"
_NEVER = "false"


@dataclass(frozen=True)
class Job:
    """``texts`` are trimmed cells (``t_``), ``codes`` trimmed cells in upper case (``c_``) and
    ``numbers`` parsed cells (``n_``) the messages refer to."""

    errors: list[str]
    warnings: list[str]
    texts: tuple[str, ...] = ()
    codes: tuple[str, ...] = ()
    numbers: tuple[str, ...] = ()
    is_complex: str = _NEVER
    is_zero_setup: str = _NEVER


def _listed(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_MATERIAL_MASTER = Job(
    codes=("MAT_TYPE", "BASE_UOM", "UNIT_OF_WEIGHT", "PRICE_CTRL"),
    numbers=("NET_WEIGHT", "PRICE"),
    errors=[
        f"""CASE WHEN n_NET_WEIGHT < 0 THEN 'Peso neto negativo: ' || {number_text('n_NET_WEIGHT')}
            WHEN n_NET_WEIGHT > 0 AND c_UNIT_OF_WEIGHT = ''
            THEN 'Peso neto indicado pero falta unidad de peso (UNIT_OF_WEIGHT)' END""",
        f"""CASE WHEN c_PRICE_CTRL NOT IN {_listed(fv.PRICE_CONTROLS)}
            THEN "Control de precio '" || c_PRICE_CTRL || "' incorrecto (Debe ser S o V)" END""",
        f"""CASE WHEN n_PRICE IS NULL THEN 'Precio del material no es un valor numérico válido'
            WHEN n_PRICE < 0 THEN 'Precio negativo no permitido: ' || {number_text('n_PRICE')} END""",
    ],
    warnings=[
        f"""CASE WHEN c_MAT_TYPE NOT IN {_listed(fv.MATERIAL_TYPES)}
            THEN "Tipo de material '" || c_MAT_TYPE || "' no estándar (ROH, HALB, FERT esperado)" END""",
        f"""CASE WHEN c_BASE_UOM <> '' AND c_BASE_UOM NOT IN {_listed(fv.BASE_UNITS)}
            THEN "Unidad de medida base '" || c_BASE_UOM || "' no estándar en SAP" END""",
        f"""CASE WHEN c_UNIT_OF_WEIGHT <> '' AND c_UNIT_OF_WEIGHT NOT IN {_listed(fv.WEIGHT_UNITS)}
            THEN "Unidad de peso '" || c_UNIT_OF_WEIGHT || "' no estándar en SAP" END""",
        "CASE WHEN n_PRICE = 0 THEN 'Precio del material es 0.0 (Posible falta de valoración)' END",
        f"""CASE WHEN c_MAT_TYPE = 'ROH' AND c_PRICE_CTRL = 'S' AND n_PRICE > 100000
            THEN 'Precio estándar de ROH inusualmente alto: ' || {number_text('n_PRICE')} END""",
    ],
)

_TOO_MANY = f"{_PARENT_ROWS} IS NOT NULL AND t_MATERIAL_PARENT <> ''"
_BILL_OF_MATERIALS = Job(
    texts=("MATERIAL_PARENT",),
    codes=("UOM",),
    numbers=("QUANTITY",),
    errors=[
        f"""CASE WHEN n_QUANTITY IS NULL THEN 'Cantidad de componente no es un valor numérico válido'
            WHEN n_QUANTITY <= 0
            THEN 'Cantidad de componente menor o igual a cero: ' || {number_text('n_QUANTITY')} END"""
    ],
    warnings=[
        f"""CASE WHEN n_QUANTITY >= 9999
            THEN 'Cantidad de componente atípica / extremadamente alta: ' || {number_text('n_QUANTITY')} END""",
        f"""CASE WHEN c_UOM <> '' AND c_UOM NOT IN {_listed(fv.BASE_UNITS)}
            THEN "Unidad de medida '" || c_UOM || "' no estándar en SAP" END""",
        f"""CASE WHEN {_TOO_MANY} THEN "BOM Compleja: El material padre '" || t_MATERIAL_PARENT
            || "' tiene " || {_PARENT_ROWS} || ' componentes.' END""",
    ],
    is_complex=_TOO_MANY,
)

_ROUTING = Job(
    texts=("WORK_CENTER",),
    numbers=("SETUP_TIME", "MACHINE_TIME", "LABOR_TIME"),
    errors=[
        """CASE WHEN t_WORK_CENTER IN ('', '-')
            THEN 'Puesto de trabajo (WORK_CENTER) vacío o no especificado' END""",
        f"""CASE WHEN n_SETUP_TIME IS NULL THEN 'Tiempo de preparación no es un valor numérico válido'
            WHEN n_SETUP_TIME < 0 THEN 'Tiempo de preparación negativo: ' || {number_text('n_SETUP_TIME')}
            WHEN n_SETUP_TIME = 0
            THEN 'SETUP_TIME crítico: tiempo de preparación es 0 en una ruta activa' END""",
        f"""CASE WHEN n_MACHINE_TIME IS NULL THEN 'Tiempo de máquina no es un valor numérico válido'
            WHEN n_MACHINE_TIME < 0
            THEN 'Tiempo de máquina negativo: ' || {number_text('n_MACHINE_TIME')} END""",
        f"""CASE WHEN n_LABOR_TIME IS NULL
            THEN 'Tiempo de mano de obra no es un valor numérico válido'
            WHEN n_LABOR_TIME < 0
            THEN 'Tiempo de mano de obra negativo: ' || {number_text('n_LABOR_TIME')} END""",
    ],
    warnings=[
        """CASE WHEN n_MACHINE_TIME = 0 AND n_LABOR_TIME = 0
            THEN 'Ambos tiempos de máquina y mano de obra son 0' END"""
    ],
    is_zero_setup="n_SETUP_TIME = 0",
)


def _empty_cell(column: str, message: str) -> str:
    return f"CASE WHEN t_{column} IN ('', '-') THEN '{message}' END"


def _odd_date(column: str, which: str) -> str:
    return f"""CASE WHEN t_{column} <> '' AND NOT t_{column} RLIKE '^([0-9]{{8}}|[0-9]{{2}}[.][0-9]{{2}}[.][0-9]{{4}})$'
        THEN "Formato de fecha {which} '" || t_{column} || "' no estándar (YYYYMMDD o DD.MM.YYYY esperado)" END"""


_COST_CENTER = Job(
    texts=("PERSON_IN_CHARGE", "FUNCTIONAL_AREA", "HIERARCHY_GROUP", "VALID_FROM", "VALID_TO"),
    errors=[
        _empty_cell("PERSON_IN_CHARGE", "Falta responsable asignado al Centro de Coste (PERSON_IN_CHARGE)"),
        _empty_cell("FUNCTIONAL_AREA", "Falta área funcional obligatoria (FUNCTIONAL_AREA)"),
        _empty_cell("HIERARCHY_GROUP", "Grupo de jerarquía estándar (HIERARCHY_GROUP) no especificado"),
    ],
    warnings=[_odd_date("VALID_FROM", "inicio"), _odd_date("VALID_TO", "fin")],
)

_JOBS = {
    fv.MATERIAL_MASTER: _MATERIAL_MASTER,
    fv.BILL_OF_MATERIALS: _BILL_OF_MATERIALS,
    fv.ROUTING: _ROUTING,
    fv.COST_CENTER: _COST_CENTER,
}


def _text(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit("")
    return strip(F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("nan")))


def _number(df: DataFrame, name: str) -> Column:
    return parse_number(F.col(f"`{name}`")) if name in df.columns else F.lit(None).cast("double")


def has_rules(template: str | None) -> bool:
    return template in _JOBS


def _with_parent_rows(df: DataFrame, above: int) -> DataFrame:
    """Attach the row count of a parent with more than ``above`` rows (null elsewhere).

    Counts are pre-aggregated, so a parent that holds much of the table costs one row per task
    in the shuffle; only parents above the limit are joined back, and Spark decides from their
    measured size whether to broadcast them. Rows are counted under the raw parent and looked
    up under the trimmed one."""
    if "MATERIAL_PARENT" not in df.columns:
        return df.withColumn(_PARENT_ROWS, F.lit(None).cast("long"))
    large = (
        df.where(F.col("MATERIAL_PARENT").isNotNull())
        .groupBy(F.col("MATERIAL_PARENT").cast("string").alias("_PARENT"))
        .agg(F.count(F.lit(1)).alias(_PARENT_ROWS))
        .where(F.col(_PARENT_ROWS) > above)
    )
    return df.join(large, _text(df, "MATERIAL_PARENT") == F.col("_PARENT"), "left").drop("_PARENT")


def apply_rules(
    df: DataFrame, template: str, complex_above: int = COMPLEX_BOM_ROWS, findings: bool = False
) -> DataFrame:
    """Add ``IND_VALID`` and ``IND_ERROR`` for the template's rules.

    ``findings`` keeps the helper columns the counters are computed from: number of errors and
    of warnings, and the two special flags."""
    job = _JOBS[template]
    columns = [F.col(f"`{c}`") for c in df.columns]
    out = _with_parent_rows(df, complex_above) if template == fv.BILL_OF_MATERIALS else df
    out = out.withColumns(
        {f"t_{c}": _text(df, c) for c in job.texts}
        | {f"c_{c}": F.upper(_text(df, c)) for c in job.codes}
        | {f"n_{c}": _number(df, c) for c in job.numbers}
    )
    out = out.select(
        *columns,
        *[F.expr(sql).alias(f"_E{i}") for i, sql in enumerate(job.errors)],
        *[F.expr(sql).alias(f"_W{i}") for i, sql in enumerate(job.warnings)],
        F.expr(f"coalesce({job.is_complex}, false)").alias(COMPLEX),
        F.expr(f"coalesce({job.is_zero_setup}, false)").alias(ZERO_SETUP),
    )
    errors = [f"_E{i}" for i in range(len(job.errors))]
    warnings = [f"_W{i}" for i in range(len(job.warnings))]
    lines = [f"'ERROR: ' || {e}" for e in errors] + [f"'WARN: ' || {w}" for w in warnings]

    def how_many(names: list[str]) -> str:
        return " + ".join(f"int({n} IS NOT NULL)" for n in names)

    kept = [COMPLEX, ZERO_SETUP] if findings else []
    counts = [
        F.expr(how_many(errors)).alias(ERRORS), F.expr(how_many(warnings)).alias(WARNINGS)
    ]
    return out.select(
        *columns,
        F.expr(f"coalesce({', '.join(errors)}) IS NULL").alias("IND_VALID"),
        F.expr(f"concat_ws(' | ', {', '.join(lines)})").alias("IND_ERROR"),
        *(counts if findings else []),
        *kept,
    )


def counter_columns() -> list[Column]:
    """Aggregates over rows with findings, one per counter, and the rows in error."""
    return [
        F.coalesce(F.sum(ERRORS), F.lit(0)).cast("long").alias("industrial_errors"),
        F.coalesce(F.sum(WARNINGS), F.lit(0)).cast("long").alias("industrial_warnings"),
        F.count_if(F.col(COMPLEX)).alias("complex_boms"),
        F.count_if(F.col(ZERO_SETUP)).alias("zero_setup_routes"),
        F.count_if(~F.col("IND_VALID")).alias("rows_in_error"),
    ]


def rule_summary(found: DataFrame, template: str) -> DataFrame:
    """One row of counters for a table judged with ``findings=True``."""
    return found.agg(*counter_columns()).select(F.lit(template).alias("template"), "*")
