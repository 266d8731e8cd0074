"""Checks of one column against another."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerprep import fixed_values as fv
from ledgerprep.functions.contact import province_of


def first_of_type(df: DataFrame, column_types: Mapping[str, str], semantic: str) -> str | None:
    return next((c for c, t in column_types.items() if t == semantic and c in df.columns), None)


def _valid(df: DataFrame, column: str) -> Column:
    return F.col(f"`{column}_VALID`") if f"{column}_VALID" in df.columns else F.lit(True)


def repair_province(
    df: DataFrame, postal: str, province: str, repaired: str | None = None
) -> DataFrame:
    """Overwrite the province where a valid postal code lies in another one.

    ``repaired`` names an extra flag column of the rows that were changed."""
    expected = F.when(_valid(df, postal), province_of(F.col(f"`{postal}`")))
    wrong = expected.isNotNull() & ~F.col(f"`{province}`").eqNullSafe(expected)
    changes = {province: F.when(wrong, expected).otherwise(F.col(f"`{province}`"))}
    if repaired:
        changes[repaired] = wrong
    return df.withColumns(changes)


def check_bank_country(
    df: DataFrame, iban: str, bic: str, discrepant: str | None = None
) -> DataFrame:
    """Mark a BIC wrong when its country is not the country of the IBAN."""
    iban_value, bic_value = F.col(f"`{iban}`"), F.col(f"`{bic}`")
    here, there = F.upper(F.substring(bic_value, 5, 2)), F.upper(F.substring(iban_value, 1, 2))
    compared = (
        _valid(df, iban)
        & _valid(df, bic)
        & ~iban_value.isin("", fv.EMPTY_MARK)
        & ~bic_value.isin("", fv.EMPTY_MARK)
    )
    clash = F.coalesce(compared & (here != there), F.lit(False))
    note = F.concat(
        F.lit("Discrepancia de país: BIC '"), here, F.lit("' vs IBAN '"), there, F.lit("'")
    )
    old = F.col(f"`{bic}_ERROR`") if f"{bic}_ERROR" in df.columns else F.lit("")
    changes = {
        f"{bic}_VALID": _valid(df, bic) & ~clash,
        f"{bic}_ERROR": F.when(
            clash, F.when(old == "", note).otherwise(F.concat(old, F.lit(" | "), note))
        ).otherwise(old),
    }
    if discrepant:
        changes[discrepant] = clash
    return df.withColumns(changes)


def cross_check(df: DataFrame, column_types: Mapping[str, str]) -> DataFrame:
    """Both checks on the first column of each type, where the table has the pair."""
    postal, province = (first_of_type(df, column_types, t) for t in ("postal_code", "province"))
    if postal and province:
        df = repair_province(df, postal, province, repaired="_FIX_GEO")
    iban, bic = (first_of_type(df, column_types, t) for t in ("iban", "bic"))
    if iban and bic:
        df = check_bank_country(df, iban, bic, discrepant="_WRONG_BANK")
    return df
