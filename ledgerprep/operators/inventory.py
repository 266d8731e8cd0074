"""Health of stock tables before a load."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerprep import fixed_values as fv
from ledgerprep.functions.numbers import (
    as_timestamp,
    months_before,
    parse_number,
    whole_months,
    with_dates,
)
from ledgerprep.functions.text import is_blank, strip
from ledgerprep.operators.ordered import place, running_sum

STOCK_COLUMNS = ("UNRESTRICTED_STOCK", "BLOCKED_STOCK", "QUALITY_STOCK")
OBSOLETE_MONTHS = 24
PRICE_THRESHOLD_PCT = 10.0
_VALUE_TYPE = "decimal(34,6)"


def _amount(value_column: str) -> Column:
    """Exact amount of a cell; 0 where it is no number, infinite, or has over 28 digits before the point."""
    return F.coalesce(parse_number(F.col(value_column)).try_cast(_VALUE_TYPE), F.lit(0).cast(_VALUE_TYPE))


def unreadable_amounts(df: DataFrame, value_column: str = "TOTAL_VALUE") -> DataFrame:
    """Rows whose amount is text but counts as 0 because it cannot be read as an exact number."""
    given = ~is_blank(F.col(value_column))
    return df.where(given & parse_number(F.col(value_column)).try_cast(_VALUE_TYPE).isNull())


def _none(df: DataFrame) -> DataFrame:
    return df.where(F.lit(False))


def _is_negative(df: DataFrame) -> Column | None:
    if STOCK_COLUMNS[0] not in df.columns:
        return None
    hit = F.lit(False)
    for c in STOCK_COLUMNS:
        if c in df.columns:
            hit = hit | F.coalesce(parse_number(F.col(c)) < 0, F.lit(False))
    return hit


def negative_stock(df: DataFrame) -> DataFrame:
    """Rows with a negative stock of any kind; none without the main stock column."""
    hit = _is_negative(df)
    return _none(df) if hit is None else df.where(hit)


def obsolete_stock(df: DataFrame, as_of, months: int = OBSOLETE_MONTHS) -> DataFrame:
    """Rows last moved before ``as_of`` less ``months``, with the whole months since then.

    A date that cannot be read does not make a row obsolete."""
    if "LAST_MOVEMENT_DATE" not in df.columns:
        return _none(df).withColumn("MONTHS_INACTIVE", F.lit(None).cast("int"))
    now = as_timestamp(as_of)
    return (
        with_dates(df, {"_MOVED": F.col("LAST_MOVEMENT_DATE")})
        .where(F.col("_MOVED") < months_before(now, months))
        .withColumn("MONTHS_INACTIVE", whole_months(F.col("_MOVED"), now))
        .drop("_MOVED")
    )


def unreadable_dates(df: DataFrame) -> DataFrame:
    """One row: how many cells hold a text that is no date."""
    cell = F.col("LAST_MOVEMENT_DATE").cast("string")
    bad = cell.isNotNull() & (strip(cell) != "") & F.col("_MOVED").isNull()
    return with_dates(df, {"_MOVED": cell}).agg(F.count_if(bad).alias("unreadable_dates"))


def judge_prices(df: DataFrame, threshold_pct: float = PRICE_THRESHOLD_PCT) -> DataFrame:
    """Difference of standard and average price; the status is null where none can be given."""
    standard, average = parse_number(F.col("STANDARD_PRICE")), parse_number(F.col("MOVING_AVG_PRICE"))
    out = df.withColumns({"_STD": standard, "_AVG": average})
    out = out.withColumn(
        "PRICE_DIFF_ABS", F.when(F.col("_STD") > 0, F.abs(F.col("_STD") - F.col("_AVG")))
    )
    out = out.withColumn("PRICE_DIFF_PCT", F.col("PRICE_DIFF_ABS") / F.col("_STD") * 100.0)
    percent = F.col("PRICE_DIFF_PCT")
    return out.withColumn(
        "PRICE_DISC_STATUS",
        F.when(percent > threshold_pct * 2, "ERROR")
        .when(percent > threshold_pct, "WARNING")
        .when(percent.isNotNull(), "OK"),
    ).drop("_STD", "_AVG")


def has_prices(df: DataFrame) -> bool:
    return {"STANDARD_PRICE", "MOVING_AVG_PRICE"} <= set(df.columns)


def price_discrepancies(df: DataFrame, threshold_pct: float = PRICE_THRESHOLD_PCT) -> DataFrame:
    """Rows whose average price differs from the standard price by more than the threshold."""
    if not has_prices(df):
        return _none(df)
    return judge_prices(df, threshold_pct).where(
        F.col("PRICE_DISC_STATUS").isin("WARNING", "ERROR")
    )


def price_counts(df: DataFrame, threshold_pct: float = PRICE_THRESHOLD_PCT) -> DataFrame:
    status = F.col("PRICE_DISC_STATUS")
    return judge_prices(df, threshold_pct).agg(
        F.count_if(status == "OK").alias("ok"),
        F.count_if(status == "WARNING").alias("warning"),
        F.count_if(status == "ERROR").alias("error"),
        F.count_if(status.isin("WARNING", "ERROR")).alias("total_with_discrepancy"),
    )


def classify_abc(
    df: DataFrame, key: str, value_column: str = "TOTAL_VALUE"
) -> DataFrame:
    """Add ``ABC_CLASS`` by the running share of the total value, largest value first.

    ``key`` identifies a row (no nulls) and orders equal values. The running share is a distributed
    running sum over exact decimals, so it does not depend on the order of addition. The first
    row is A even if it alone exceeds the limit.
    """
    amount = _amount(value_column)
    order = [F.desc("_AMOUNT"), F.asc(key)]
    # Only the key and the amount are put in order; the table itself is joined once.
    placed = place(df.select(key, amount.alias("_AMOUNT")), order)
    # One row read by the driver: the total, and the first row of the order.
    first = F.struct(F.col("_AMOUNT").cast("double").alias("a"), F.col(key).alias("k"))
    whole = placed.agg(
        F.sum("_AMOUNT").cast("double").alias("total"),
        F.min_by(first, F.struct(-F.col("_AMOUNT"), F.col(key))).alias("top"),
    ).first()
    if not whole["total"]:
        return df.withColumn("ABC_CLASS", F.lit("C"))
    ranked = running_sum(placed, F.col("_AMOUNT"), order, "_CUMULATED")
    share = F.col("_CUMULATED").cast("double") / F.lit(whole["total"]) * 100.0
    letter = F.when(share <= 80.0, "A").when(share <= 95.0, "B").otherwise("C")
    top = whole["top"]
    if top["a"] / whole["total"] * 100.0 > 80.0 and ranked.where(share <= 80.0).isEmpty():
        letter = F.when(F.col(key) == F.lit(top["k"]), "A").otherwise(letter)
    return df.join(ranked.select(key, letter.alias("ABC_CLASS")), key)


def abc_summary(classified: DataFrame, value_column: str = "TOTAL_VALUE") -> DataFrame:
    """Count, share of rows and share of value of the three classes, all three always present."""
    amount = _amount(value_column)
    found = classified.groupBy("ABC_CLASS").agg(
        F.count(F.lit(1)).alias("count"), F.sum(amount).cast("double").alias("value")
    )
    spark = classified.sparkSession
    classes = spark.createDataFrame([("A",), ("B",), ("C",)], "ABC_CLASS string")
    per_class = classes.join(found, "ABC_CLASS", "left").select(
        "ABC_CLASS",
        F.coalesce("count", F.lit(0)).alias("count"),
        F.coalesce("value", F.lit(0.0)).alias("value"),
    )
    # Three rows, so the one-partition window over them is free.
    whole = Window.partitionBy(F.lit(0))
    rows, worth = F.sum("count").over(whole), F.sum("value").over(whole)
    return per_class.select(
        "ABC_CLASS",
        "count",
        F.when(rows > 0, F.round(F.col("count") / rows * 100.0, 2)).otherwise(0.0).alias("pct_items"),
        F.when(worth > 0, F.round(F.col("value") / worth * 100.0, 2)).otherwise(0.0).alias("pct_value"),
    )


def standardize_units(
    df: DataFrame, unit_column: str = "BASE_UOM", stock_columns: tuple[str, ...] = STOCK_COLUMNS[:1]
) -> DataFrame:
    """Add stock and unit in the standard unit of its dimension.

    Seven factors, held as a literal map. Units without a factor stay as they are."""
    stock = next((c for c in stock_columns if c in df.columns), None)
    if unit_column not in df.columns or stock is None:
        return df
    unit = F.coalesce(F.upper(strip(F.col(unit_column).cast("string"))), F.lit(""))
    factors = F.create_map(
        *[F.lit(x) for name, (factor, _) in fv.UNIT_FACTORS.items() for x in (name, factor)]
    )
    targets = F.create_map(
        *[F.lit(x) for name, (_, target) in fv.UNIT_FACTORS.items() for x in (name, target)]
    )
    out = df.withColumns({"_AMOUNT": parse_number(F.col(stock)), "_UNIT": unit})
    out = out.withColumn("_FACTOR", factors[F.col("_UNIT")])
    return out.withColumns(
        {
            "STOCK_STANDARDIZED": F.when(
                F.col("_FACTOR").isNotNull(), F.round(F.col("_AMOUNT") * F.col("_FACTOR"), 6)
            ).otherwise(F.col("_AMOUNT")),
            "STOCK_UNIT_STANDARDIZED": F.coalesce(targets[F.col("_UNIT")], F.col("_UNIT")),
        }
    ).drop("_AMOUNT", "_UNIT", "_FACTOR")


def _converted(df: DataFrame) -> Column:
    if not {"STOCK_STANDARDIZED", "BASE_UOM"} <= set(df.columns):
        return F.lit(False)
    unit = F.upper(strip(F.col("BASE_UOM").cast("string")))
    return F.coalesce(
        unit.isin(list(fv.UNIT_FACTORS)) & F.col("STOCK_STANDARDIZED").isNotNull(), F.lit(False)
    )


def enrich(df: DataFrame, key: str) -> DataFrame:
    """The stock table with its ABC class and standard units, as far as its columns allow."""
    out = classify_abc(df, key) if "TOTAL_VALUE" in df.columns else df
    return standardize_units(out)


def health_kpis(
    enriched: DataFrame,
    as_of,
    months: int = OBSOLETE_MONTHS,
    threshold_pct: float = PRICE_THRESHOLD_PCT,
) -> DataFrame:
    """All inventory counts in one aggregate over the enriched table."""
    never = F.lit(False)
    negative = _is_negative(enriched)
    obsolete = never
    judged, discrepant = enriched, never
    if "LAST_MOVEMENT_DATE" in enriched.columns:
        judged = with_dates(judged, {"_MOVED": F.col("LAST_MOVEMENT_DATE")})
        obsolete = F.col("_MOVED") < months_before(as_timestamp(as_of), months)
    if has_prices(enriched):
        judged = judge_prices(judged, threshold_pct)
        discrepant = F.col("PRICE_DISC_STATUS").isin("WARNING", "ERROR")
    letters = F.col("ABC_CLASS") if "ABC_CLASS" in enriched.columns else F.lit(None).cast("string")
    return judged.agg(
        F.count_if(never if negative is None else negative).alias("negative_stocks"),
        F.count_if(obsolete).alias("obsolete_materials"),
        F.count_if(discrepant).alias("price_discrepancies"),
        F.count_if(letters == "A").alias("abc_a_count"),
        F.count_if(letters == "B").alias("abc_b_count"),
        F.count_if(letters == "C").alias("abc_c_count"),
        F.count_if(_converted(judged)).alias("unit_conversions"),
    )
