"""Standard cost: component prices, routing times, deviation from the loaded price.

Sums are exact, so a run gives the same digits however its rows are split over tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerprep.functions.numbers import exact_sum, parse_number

DEFAULT_RATE = 35.0
TOLERANCE_PCT = 5.0
RESULT = (
    "MATERIAL", "COST_BOM", "COST_ROUTING", "COST_TOTAL_CALC", "COST_LOADED", "DEVIATION_ABS",
    "DEVIATION_PCT",
)
_BOM_NEEDS = {"MATERIAL_PARENT", "COMPONENT", "QUANTITY"}
_ROUTING_NEEDS = {"MATERIAL", "SETUP_TIME", "MACHINE_TIME", "LABOR_TIME"}


def _or_zero(c: Column) -> Column:
    return F.coalesce(parse_number(c), F.lit(0.0))


def _null_as_key(column: str) -> Column:
    """The key with null as a value of its own, so that grouping and joining on it share one
    partitioning (a null-safe comparison would shuffle again)."""
    return F.coalesce(F.col(column).cast("string"), F.lit("\0"))


def usable(df: DataFrame | None, needs: set[str]) -> bool:
    return df is not None and needs <= set(df.columns)


def material_prices(master: DataFrame) -> DataFrame:
    return master.select("MATERIAL", _or_zero(F.col("PRICE")).alias("PRICE"))


def _priced_components(bom: DataFrame, master: DataFrame) -> DataFrame:
    """BOM lines with the price of their component.

    The master is summed per material before the join: a material listed twice adds both
    prices to each line, and this way the join stays one to one. Null keys match null keys.
    A component that many lines share is one hot key on the left only, which adaptive
    execution splits."""
    prices = (
        material_prices(master)
        .groupBy(_null_as_key("MATERIAL").alias("_KEY"))
        .agg(exact_sum(F.col("PRICE")).alias("COMP_PRICE"), F.min(F.abs("PRICE")).alias("_LOWEST"))
    )
    lines = bom.select(
        "MATERIAL_PARENT", "COMPONENT", _null_as_key("COMPONENT").alias("_KEY"),
        _or_zero(F.col("QUANTITY")).alias("QUANTITY"),
    )
    return lines.join(prices, "_KEY", "left").select(
        "MATERIAL_PARENT",
        "COMPONENT",
        "QUANTITY",
        F.coalesce("COMP_PRICE", F.lit(0.0)).alias("COMP_PRICE"),
        (F.coalesce("_LOWEST", F.lit(0.0)) == 0).alias("UNPRICED"),
    )


def _bom_lines(bom: DataFrame, master: DataFrame) -> DataFrame:
    return _priced_components(bom, master).where(F.col("MATERIAL_PARENT").isNotNull()).select(
        F.col("MATERIAL_PARENT").alias("MATERIAL"),
        (F.col("QUANTITY") * F.col("COMP_PRICE")).alias("BOM_LINE"),
        F.lit(None).cast("double").alias("ROUTING_LINE"),
    )


def _routing_lines(routing: DataFrame, default_rate: float) -> DataFrame:
    rate = F.lit(float(default_rate))
    if "RATE" in routing.columns:
        rate = F.coalesce(parse_number(F.col("RATE")), rate)
    hours = (
        _or_zero(F.col("SETUP_TIME")) + _or_zero(F.col("MACHINE_TIME")) + _or_zero(F.col("LABOR_TIME"))
    )
    return routing.where(F.col("MATERIAL").isNotNull()).select(
        "MATERIAL",
        F.lit(None).cast("double").alias("BOM_LINE"),
        (hours * rate).alias("ROUTING_LINE"),
    )


def bom_cost(bom: DataFrame, master: DataFrame) -> DataFrame:
    """Single-level cost of each parent: quantity times component price, summed."""
    return _bom_lines(bom, master).groupBy("MATERIAL").agg(exact_sum(F.col("BOM_LINE")).alias("COST_BOM"))


def routing_cost(routing: DataFrame, default_rate: float = DEFAULT_RATE) -> DataFrame:
    """Cost of the operations of each material: hours times rate, summed."""
    return (
        _routing_lines(routing, default_rate)
        .groupBy("MATERIAL")
        .agg(exact_sum(F.col("ROUTING_LINE")).alias("COST_ROUTING"))
    )


def unpriced_components(bom: DataFrame, master: DataFrame) -> DataFrame:
    """Distinct components whose price is zero or missing."""
    return _priced_components(bom, master).where("UNPRICED").select("COMPONENT").distinct()


def unpriced_summary(bom: DataFrame, master: DataFrame, sample: int = 10) -> DataFrame:
    """Count of unpriced components and the first few of them in key order."""
    names = unpriced_components(bom, master)
    first = names.orderBy("COMPONENT").limit(sample).agg(
        F.array_join(F.sort_array(F.collect_list("COMPONENT")), ", ").alias("sample")
    )
    return names.agg(F.count(F.lit(1)).alias("unpriced_components")).select(
        "unpriced_components", first.scalar().alias("sample")
    )


def standard_cost(
    master: DataFrame,
    bom: DataFrame | None = None,
    routing: DataFrame | None = None,
    default_rate: float = DEFAULT_RATE,
) -> DataFrame:
    """Calculated against loaded cost of every material of any of the three tables.

    BOM and routing lines are summed in one aggregate over their union, then joined once with
    the master rows. A side table without its columns counts as absent."""
    lines = []
    if usable(bom, _BOM_NEEDS):
        lines.append(_bom_lines(bom, master))
    if usable(routing, _ROUTING_NEEDS):
        lines.append(_routing_lines(routing, default_rate))
    loaded = material_prices(master).withColumnRenamed("PRICE", "COST_LOADED")
    if lines:
        costs = lines[0] if len(lines) == 1 else lines[0].unionByName(lines[1])
        costs = (
            costs.groupBy("MATERIAL")
            .agg(exact_sum(F.col("BOM_LINE")).alias("COST_BOM"), exact_sum(F.col("ROUTING_LINE")).alias("COST_ROUTING"))
            .withColumnRenamed("MATERIAL", "_MADE")
        )
        # No made material is null, so a null of the master stays a row of its own.
        joined = costs.join(loaded, costs["_MADE"] == loaded["MATERIAL"], "full")
        material = F.coalesce("_MADE", "MATERIAL")
    else:
        joined = loaded.withColumns(
            {"COST_BOM": F.lit(0.0), "COST_ROUTING": F.lit(0.0)}
        )
        material = F.col("MATERIAL")
    zero = F.lit(0.0)
    out = joined.select(
        material.alias("MATERIAL"),
        F.coalesce("COST_BOM", zero).alias("COST_BOM"),
        F.coalesce("COST_ROUTING", zero).alias("COST_ROUTING"),
        F.coalesce("COST_LOADED", zero).alias("COST_LOADED"),
    )
    out = out.withColumn("COST_TOTAL_CALC", F.col("COST_BOM") + F.col("COST_ROUTING"))
    out = out.withColumn("DEVIATION_ABS", F.abs(F.col("COST_LOADED") - F.col("COST_TOTAL_CALC")))
    percent = F.when(
        F.col("COST_TOTAL_CALC") != 0, F.col("DEVIATION_ABS") / F.col("COST_TOTAL_CALC") * 100.0
    ).otherwise(F.when(F.col("COST_LOADED") != 0, 100.0).otherwise(0.0))
    return out.withColumn("DEVIATION_PCT", percent).select(*RESULT)


def classify_deviation(cost: DataFrame, tolerance_pct: float = TOLERANCE_PCT) -> DataFrame:
    """Add the severity of the deviation and its direction."""
    size = F.abs("DEVIATION_PCT")
    loaded, calculated = F.col("COST_LOADED"), F.col("COST_TOTAL_CALC")
    return cost.withColumns(
        {
            "DEV_STATUS": F.when(size <= tolerance_pct, "OK")
            .when(size <= tolerance_pct * 3, "WARNING")
            .otherwise("ERROR"),
            "DEV_DIRECTION": F.when(loaded > calculated, "overvalued")
            .when(loaded < calculated, "undervalued")
            .otherwise("ok"),
        }
    )


def deviation_count_columns() -> list[Column]:
    status = F.col("DEV_STATUS")
    return [
        F.count_if(status == "OK").alias("cost_deviations_ok"),
        F.count_if(status == "WARNING").alias("cost_deviations_warning"),
        F.count_if(status == "ERROR").alias("cost_deviations_error"),
    ]


def margin_columns() -> list[Column]:
    loaded, calculated = F.col("COST_LOADED"), F.col("COST_TOTAL_CALC")
    size = F.col("DEVIATION_ABS")
    total, deviating = F.count(F.lit(1)), F.count_if(F.abs("DEVIATION_PCT") > 0)
    return [
        F.coalesce(exact_sum(F.when(loaded > calculated, size)), F.lit(0.0)).alias("total_overvaluation"),
        F.coalesce(exact_sum(F.when(loaded < calculated, size)), F.lit(0.0)).alias("total_undervaluation"),
        deviating.alias("materials_with_deviation"),
        total.alias("materials_total"),
        F.when(total > 0, F.round(deviating / total * 100.0, 2)).otherwise(0.0).alias(
            "pct_with_deviation"
        ),
    ]


def margin_impact(cost: DataFrame) -> DataFrame:
    """One row: total over- and undervaluation and the share of materials that deviate."""
    return cost.agg(*margin_columns())


def costing_kpis(classified: DataFrame) -> DataFrame:
    """Severity counts and margin impact in one aggregate."""
    return classified.agg(*deviation_count_columns(), *margin_columns())


def largest_deviations(cost: DataFrame, n: int = 20) -> DataFrame:
    """The materials that deviate most, in percent; ties by material."""
    return cost.orderBy(F.desc("DEVIATION_PCT"), "MATERIAL").limit(n)
