"""Checking a table against a declared schema."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerprep.functions.numbers import parse_strict_number
from ledgerprep.functions.text import strip

SHOWN_ROWS = 10
_SCHEMA = "check string, column string, violations long, rows array<long>, value string"


def read_schema(text: str) -> dict:
    """Column constraints out of the JSON form ``{"columns": {name: {...}}}``."""
    return json.loads(text).get("columns", {})


def _empty(cell: Column) -> Column:
    return cell.isNull() | (strip(cell) == "") | (cell == "nan")


def _first_empty_rows(df: DataFrame, names: list[str], row_id: str) -> DataFrame:
    """First rows with an empty cell, per column.

    The bound on ``row_number`` lets Spark keep ten rows per column in every task before the
    shuffle (a window group limit)."""
    hits = F.array_compact(
        F.array(*[F.when(_empty(F.col(f"`{n}`").cast("string")), F.lit(n)) for n in names])
    )
    cells = df.select((F.col(row_id) + 1).alias("r"), F.explode(hits).alias("column"))
    order = Window.partitionBy("column").orderBy("r")
    return cells.withColumn("n", F.row_number().over(order)).where(F.col("n") <= SHOWN_ROWS)


def schema_violations(
    df: DataFrame, constraints: Mapping[str, Mapping], row_id: str
) -> DataFrame:
    """One row per broken constraint: missing column, empty cells, first value of a wrong type.

    ``row_id`` is a dense number from 0; rows are reported from 1. One aggregate computes all
    counts and first offenders; a second scan finds the first ten rows with an empty cell.
    """
    spark = df.sparkSession
    missing = [
        ("missing_column", name, 1, None, None)
        for name, rule in constraints.items()
        if rule.get("required", False) and name not in df.columns
    ]
    checks = []
    empties = []
    for name in df.columns:
        rule = constraints.get(name)
        if rule is None:
            continue
        cell = F.col(f"`{name}`").cast("string")
        if not rule.get("nullable", True):
            empties.append(name)
            checks.append(
                F.struct(
                    F.lit("not_null").alias("check"),
                    F.lit(name).alias("column"),
                    F.count_if(_empty(cell)).alias("violations"),
                    F.lit(None).cast("long").alias("row"),
                    F.lit(None).cast("string").alias("value"),
                )
            )
        kind = rule.get("type", "str")
        if kind in ("int", "float"):
            number = parse_strict_number(cell)
            fits = number.isNotNull() | (F.lower(strip(cell)).rlike("^[+-]?nan$"))
            if kind == "int":
                fits = number.isNotNull() & (F.abs(number) != float("inf"))
            bad = cell.isNotNull() & (strip(cell) != "") & ~fits
            first = F.min_by(F.struct(F.col(row_id).alias("r"), cell.alias("v")), F.when(bad, F.col(row_id)))
            checks.append(
                F.struct(
                    F.lit(f"type_{kind}").alias("check"),
                    F.lit(name).alias("column"),
                    F.when(F.count_if(bad) > 0, 1).otherwise(0).cast("long").alias("violations"),
                    F.when(F.count_if(bad) > 0, first["r"] + 1).alias("row"),
                    F.when(F.count_if(bad) > 0, first["v"]).alias("value"),
                )
            )
    result = spark.createDataFrame(missing, _SCHEMA)
    if not checks:
        return result
    counted = (
        df.agg(F.array(*checks).alias("all"))
        .select(F.inline("all"))
        .where("violations > 0")
        .select("check", "column", "violations", "row", "value")
    )
    samples = _first_empty_rows(df, empties, row_id) if empties else None
    if samples is None:
        rows = counted.withColumn("rows", F.when(F.col("row").isNotNull(), F.array("row")))
    else:
        shown = samples.groupBy("column").agg(F.sort_array(F.collect_list("r")).alias("first_rows"))
        shown = shown.withColumn("check", F.lit("not_null"))
        rows = counted.join(shown, ["check", "column"], "left").withColumn(
            "rows", F.coalesce("first_rows", F.when(F.col("row").isNotNull(), F.array("row")))
        )
    return result.unionByName(rows.select("check", "column", "violations", "rows", "value"))
