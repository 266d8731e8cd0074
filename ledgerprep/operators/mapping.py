"""Renaming columns to a target layout and filling what the target requires."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerprep import fixed_values as fv

TECHNICAL_SUFFIXES = ("_VALID", "_ERROR")
TECHNICAL_NAMES = ("_CLEAN_LOG", "_CLEANSED")


def map_columns(
    df: DataFrame,
    mapping: Mapping[str, str],
    required: Iterable[str] = (),
    defaults: Mapping[str, str] | None = None,
    keep_unmapped: bool = False,
    carry: Iterable[str] = (),
) -> DataFrame:
    """Rename source columns to their targets; keep only targets unless told otherwise.

    Required targets that are missing are added, and nulls in them are filled, with the
    default (``-`` without one). A default other than ``-`` also replaces ``-``. Columns in
    ``carry`` (a row id) stay beside the targets.
    """
    defaults = defaults or {}
    out = df.withColumnsRenamed(dict(mapping))
    if not keep_unmapped:
        wanted = [c for c in carry if c in out.columns]
        wanted += [c for c in dict.fromkeys(mapping.values()) if c in out.columns]
        out = out.select(*[F.col(f"`{c}`") for c in wanted])
    fills = {}
    for field in required:
        default = defaults.get(field, fv.EMPTY_MARK)
        if field not in out.columns:
            fills[field] = F.lit(default)
            continue
        cell = F.col(f"`{field}`")
        filled = F.coalesce(cell.cast("string"), F.lit(default))
        if default != fv.EMPTY_MARK:
            filled = F.when(cell == fv.EMPTY_MARK, F.lit(default)).otherwise(filled)
        fills[field] = filled
    return out.withColumns(fills) if fills else out


def prune_technical(df: DataFrame) -> DataFrame:
    """Drop verdict and log columns."""
    return df.select(
        *[
            F.col(f"`{c}`")
            for c in df.columns
            if not c.endswith(TECHNICAL_SUFFIXES) and c not in TECHNICAL_NAMES
        ]
    )


def staging_projection(df: DataFrame, template: str) -> DataFrame:
    """Exactly the template's columns in its order, trimmed; missing and null become ``""``."""
    return df.select(
        *[
            F.coalesce(F.btrim(F.col(f"`{c}`").cast("string"), F.lit(fv.WHITESPACE)), F.lit("")).alias(c)
            if c in df.columns
            else F.lit("").alias(c)
            for c in fv.TEMPLATES[template]
        ]
    )
