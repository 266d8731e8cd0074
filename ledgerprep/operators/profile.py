"""Profile of a table as it was delivered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerprep.functions.numbers import parse_strict_number, with_dates
from ledgerprep.functions.text import strip


#: Bits (a power of two) of the table of fingerprints that repeat: at most a million words of 64 bits.
TABLE_BITS = 1 << 26


def _cell(name: str) -> Column:
    return F.col(f"`{name}`").cast("string")


def _empty(cell: Column) -> Column:
    return cell.isNull() | (strip(cell) == "") | (cell == "nan")


# Bits of what a cell could be; a column is what all its filled cells could be.
_INTEGER, _NUMBER, _DATE, _NO_LEADING_ZERO = 1, 2, 4, 8


def _possibilities(df: DataFrame) -> DataFrame:
    """Bits of each filled cell, null for an empty one, in columns ``_0``, ``_1`` ..."""
    count = range(len(df.columns))
    texts = df.select(*[_cell(c).alias(f"c{i}") for i, c in enumerate(df.columns)])
    texts = with_dates(texts, {f"d{i}": F.col(f"c{i}") for i in count})
    texts = texts.withColumns({f"n{i}": parse_strict_number(F.col(f"c{i}")) for i in count})

    def bits(i: int) -> Column:
        return F.expr(
            f"""CASE WHEN n{i} = floor(n{i}) THEN {_INTEGER + _NUMBER} WHEN n{i} IS NOT NULL THEN {_NUMBER} ELSE 0 END
              + if(d{i} IS NOT NULL, {_DATE}, 0) + if(c{i} LIKE '0_%', 0, {_NO_LEADING_ZERO})"""
        )

    return texts.select(*[F.when(~_empty(F.col(f"c{i}")), bits(i)).alias(f"_{i}") for i in count])


def _filled(df: DataFrame) -> DataFrame:
    """1 for each filled cell, null for an empty one, in columns ``_0``, ``_1`` ..."""
    return df.select(*[F.when(~_empty(_cell(c)), 1).alias(f"_{i}") for i, c in enumerate(df.columns)])


def _empties(cells: Column) -> list[Column]:
    total = F.count(F.lit(1))
    empties = total - F.count(cells)
    percent = F.when(total > 0, F.round(empties / total * 100, 2)).otherwise(0.0)
    return [empties.alias("null_count"), percent.alias("null_percentage")]


def _type(bits: Column) -> Column:
    common = F.bit_and(bits)

    def has(flag: int) -> Column:
        return common.bitwiseAND(F.lit(flag)) > 0

    return (
        F.when(common.isNull(), "empty")
        .when(has(_NUMBER) & ~has(_NO_LEADING_ZERO), "numeric_str (leads 0)")
        .when(has(_INTEGER), "integer")
        .when(has(_NUMBER), "decimal")
        .when(has(_DATE), "datetime")
        .otherwise("text")
        .alias("inferred_type")
    )


def _long(
    cells: DataFrame, columns: list[str], entries: Callable[[Column], list[Column]]
) -> DataFrame:
    """Aggregates over reduced cells, all from one scan, as one row per column."""
    rows = [F.struct(F.lit(c).alias("column"), *entries(F.col(f"_{i}"))) for i, c in enumerate(columns)]
    return cells.agg(F.array(*rows).alias("all")).select(F.inline("all"))


def null_profile(df: DataFrame) -> DataFrame:
    """Empty cells per column, as a count and in percent."""
    return _long(_filled(df), df.columns, _empties)


def type_profile(df: DataFrame) -> DataFrame:
    """Type the filled cells of each column have in common."""
    return _long(_possibilities(df), df.columns, lambda bits: [_type(bits)])


def column_profile(df: DataFrame) -> DataFrame:
    """Empty cells and type per column, in one scan."""
    return _long(_possibilities(df), df.columns, lambda bits: [*_empties(bits), _type(bits)])


def _fingerprint(df: DataFrame) -> list[Column]:
    """Two hashes of 64 bits over all cells. A hash passes over nulls, so where they lie is hashed too."""
    cells = [F.col(f"`{c}`") for c in df.columns]
    nulls = [c.isNull() for c in cells]
    return [F.xxhash64(F.lit(seed), *cells, *nulls) for seed in (1, 2)]


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: rows, and rows equal to an earlier one. Reads the table twice, and counts it.

    Fingerprints are counted first; only they are shuffled, and copies of one task collapse before.
    Those that repeat set bits of a table of fixed size, which every task gets; rows whose bit is
    set, so all copies and a few others, are compared in full. If far more fingerprints repeat than the table
    has bits, all rows are compared."""
    if not df.columns:
        return df.agg(F.count(F.lit(1)).alias("total_rows")).selectExpr("total_rows", "greatest(total_rows - 1, 0) AS exact_duplicates")
    suspects = _suspects(df)
    copies = suspects.groupBy(*suspects.columns).agg(F.count(F.lit(1)).alias("_n"))
    extra = copies.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("exact_duplicates"))
    return df.agg(F.count(F.lit(1)).alias("total_rows")).select("total_rows", extra.scalar().alias("exact_duplicates"))


def _suspects(df: DataFrame) -> DataFrame:
    """The rows that may have copies, their columns renamed ``c0``, ``c1`` ..."""
    one, two = _fingerprint(df)
    counted = df.select(one.alias("_1"), two.alias("_2")).groupBy("_1", "_2").agg(F.count(F.lit(1)).alias("_n"))
    bits = counted.where("_n > 1").groupBy(_word(F.col("_1")).alias("_word")).agg(F.bit_or(_bit(F.col("_1"))).alias("_bits"))
    named = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    hashed = named.withColumn("_1", _fingerprint(named)[0]).withColumn("_word", _word(F.col("_1")))
    # At most TABLE_BITS / 64 rows of two numbers.
    marked = hashed.join(F.broadcast(bits), "_word")
    return marked.where(F.col("_bits").bitwiseAND(_bit(F.col("_1"))) != 0).select(*named.columns)


def _word(hashed: Column) -> Column:
    return F.shiftrightunsigned(hashed, 6).bitwiseAND(F.lit(TABLE_BITS // 64 - 1))


def _bit(hashed: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), hashed.bitwiseAND(F.lit(63)).cast("int"))


def table_profile(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Table-level counts (one row) and the profile of each column."""
    table = duplicate_rows(df).withColumn("total_columns", F.lit(len(df.columns)))
    return table, column_profile(df)
