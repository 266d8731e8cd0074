"""Cleaning and validating whole columns of a table.

``cleanse`` is one narrow projection chain: every step reads columns the step before has
materialised, so each code is cleaned once per row and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerprep import fixed_values as fv
from ledgerprep.functions import address, contact, identifiers
from ledgerprep.functions.text import alphanumeric_code, raw_text, squeeze, strip, text_or_mark

VALIDATED_TYPES = ("tax_id", "iban", "postal_code", "bic")
STRICT_TYPES = ("tax_id", "iban")
FAULT = "Error inesperado: la regla no dio resultado"

KPI_NAMES = (
    "text", "tax_id_fixes", "tax_id_errors", "iban_fixes", "iban_errors", "phone_fixes",
    "postal_code_fixes", "postal_code_errors", "province_fixes", "bic_fixes", "bic_errors",
    "address_fixes",
)

@dataclass(frozen=True)
class Rule:
    """How a semantic type is cleaned: ``tidy`` on the raw cell, ``finish`` on the tidied one
    (a projection of its own), and ``reason``, on the finished one, why it is wrong."""

    tidy: Callable[[Column], Column]
    finish: Callable[[Column], Column] | None = None
    reason: Callable[[Column], Column] | None = None


RULES: dict[str, Rule] = {
    "text": Rule(squeeze, text_or_mark),
    "province": Rule(squeeze, text_or_mark),
    "phone": Rule(contact.phone_letters, contact.with_prefix),
    "address": Rule(address.clean_address),
    "tax_id": Rule(alphanumeric_code, reason=identifiers.tax_id_error),
    "iban": Rule(alphanumeric_code, reason=identifiers.iban_error),
    "bic": Rule(alphanumeric_code, reason=identifiers.bic_error),
    "postal_code": Rule(contact.only_digits, contact.padded, contact.postal_code_error),
}
OTHER_RULE = Rule(squeeze, lambda c: text_or_mark(c, uppercase=False))


def fix_mark(column: str) -> str:
    return f"_FIX_{column}"


def wrong_mark(column: str) -> str:
    return f"_WRONG_{column}"


def fault_mark(column: str) -> str:
    return f"_FAULT_{column}"


def is_mark(column: str) -> bool:
    return column.startswith(("_FIX_", "_WRONG_", "_FAULT_", "_RAW_"))


def typed_columns(df: DataFrame, column_types: Mapping[str, str]) -> dict[str, str]:
    """Declared columns the table has; the others are left out (and reported in the audit)."""
    return {c: t for c, t in column_types.items() if c in df.columns}


def _as_typed(raw: Column, semantic: str) -> Column | None:
    """Raw cell in the form a fix is counted against; null for types without a count."""
    if semantic in ("tax_id", "bic", "province", "address"):
        return F.upper(strip(raw))
    if semantic == "iban":
        return F.upper(F.translate(raw, " ", ""))
    if semantic in ("postal_code", "phone"):
        return strip(raw)
    return None


def cleanse(
    df: DataFrame,
    column_types: Mapping[str, str],
    rules: Mapping[str, Rule] | None = None,
    marks: bool = False,
) -> DataFrame:
    """Clean every typed column and add the columns its type derives.

    With ``marks`` the flags the KPIs are counted from are kept as ``_FIX_``, ``_WRONG_`` and
    ``_FAULT_`` columns. A rule that yields null is a fault: the raw cell stays, marked wrong.
    """
    rules = {**RULES, **(rules or {})}
    typed = typed_columns(df, column_types)
    raw = {c: f"_RAW_{c}" for c in typed}
    chosen = {c: rules.get(t, OTHER_RULE) for c, t in typed.items()}

    out = df.withColumns({raw[c]: raw_text(F.col(f"`{c}`")) for c in typed})
    out = out.withColumns({c: chosen[c].tidy(F.col(f"`{raw[c]}`")) for c in typed})
    finishes = {c: r.finish(F.col(f"`{c}`")) for c, r in chosen.items() if r.finish}
    out = out.withColumns(finishes) if finishes else out

    reasons = {
        f"{c}_ERROR": r.reason(F.col(f"`{c}`")) for c, r in chosen.items() if r.reason is not None
    }
    prefixes = {
        f"_PREFIX_{c}": address.street_type_prefix(F.col(f"`{c}`"))
        for c, t in typed.items()
        if t == "address"
    }
    out = out.withColumns({**reasons, **prefixes}) if reasons or prefixes else out

    parts = {}
    for c, t in typed.items():
        if t == "address":
            rest = F.ltrim(F.substr(F.col(f"`{c}`"), F.length(f"`_PREFIX_{c}`") + 1))
            parts[f"_PARTS_{c}"] = address.split_rest(rest)
    out = out.withColumns(parts) if parts else out

    last: dict[str, Column] = {}
    kept: list[str] = []
    for c, t in typed.items():
        cell, before = F.col(f"`{c}`"), F.col(f"`{raw[c]}`")
        has_reason = f"{c}_ERROR" in reasons
        reason = F.col(f"`{c}_ERROR`")
        fault = (cell.isNull() | reason.isNull()) if has_reason else cell.isNull()
        wrong = fault | (reason != "") if has_reason else F.lit(False)
        shown = F.coalesce(cell, before)
        if has_reason:
            shown = F.when(fault, before).when(cell == "", F.lit(fv.EMPTY_MARK)).otherwise(cell)
        last[c] = shown
        if has_reason:
            last[f"{c}_VALID"] = ~wrong
            last[f"{c}_ERROR"] = F.coalesce(reason, F.lit(FAULT))
        if t == "address":
            empty = cell == ""
            got = F.col(f"`_PARTS_{c}`")
            kind = address.street_type(F.col(f"`_PREFIX_{c}`"))
            for suffix, value in zip(
                address.PART_SUFFIXES, (kind, got["name"], got["number"], got["floor"])
            ):
                last[c + suffix] = F.when(empty, F.lit("")).otherwise(F.coalesce(value, F.lit("")))
        if marks:
            against = _as_typed(before, t)
            fixed = F.lit(False) if against is None else ~wrong & (against != shown)
            last[fix_mark(c)] = fixed
            last[wrong_mark(c)] = wrong
            last[fault_mark(c)] = fault
            kept += [fix_mark(c), wrong_mark(c), fault_mark(c)]
    untouched = [F.col(f"`{c}`") for c in df.columns if c not in typed]
    order = {c: i for i, c in enumerate(df.columns)}
    in_place = [(order[c], last.pop(c).alias(c)) for c in typed]
    base = [(order[c], col) for c, col in zip([c for c in df.columns if c not in typed], untouched)]
    front = [col for _, col in sorted(in_place + base, key=lambda pair: pair[0])]
    keep_raw = [F.col(f"`{raw[c]}`") for c in typed] if marks else []
    shown = out.select(*front, *[v.alias(k) for k, v in last.items()], *keep_raw)
    return apply_template_limits(shown, typed)


def _template_limits(column: str) -> tuple[int, bool] | None:
    """Shortest limit and strictest demand over the templates that have the column."""
    found = [cols[column.upper()] for cols in fv.TEMPLATES.values() if column.upper() in cols]
    if not found:
        return None
    return min(size for size, _ in found), any(required for _, required in found)


def apply_template_limits(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Cut cleaned values to their template's length and report what the template objects to.

    Cleaned values have no blanks at their ends, so their length is the length that counts."""
    changed: dict[str, Column] = {}
    for c in columns:
        limits = _template_limits(c)
        if limits is None:
            continue
        size, required = limits
        notes = [
            f"if(length(`{c}`) > {size}, concat('Valor truncado de ', length(`{c}`), ' a {size} caracteres'), null)"
        ]
        if required:
            notes.insert(0, f"if(`{c}` IN ('', '-'), 'Campo obligatorio en SAP vacío', null)")
        broken = f"length(`{c}`) > {size}" + (f" OR `{c}` IN ('', '-')" if required else "")
        changed[f"{c}_SAP_VALID"] = F.expr(f"NOT ({broken})")
        changed[f"{c}_SAP_ERROR"] = F.expr(f"concat_ws(' | ', {', '.join(notes)})")
        changed[c] = F.expr(f"substring(`{c}`, 1, {size})")
    return df.withColumns(changed) if changed else df


def drop_marks(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in df.columns if not is_mark(c)])


def kpi_columns(column_types: Mapping[str, str], columns: list[str]) -> list[Column]:
    """Aggregates over marked rows, one per KPI name."""
    sums: dict[str, list[Column]] = {name: [] for name in KPI_NAMES}
    for c, t in column_types.items():
        if wrong_mark(c) not in columns:
            continue
        if t == "text":
            sums["text"].append(F.count_if(~F.col(f"`{fault_mark(c)}`")))
        if f"{t}_fixes" in sums:
            sums[f"{t}_fixes"].append(F.count_if(F.col(f"`{fix_mark(c)}`")))
        if f"{t}_errors" in sums:
            sums[f"{t}_errors"].append(F.count_if(F.col(f"`{wrong_mark(c)}`")))
    return [
        (sum(parts[1:], parts[0]) if parts else F.lit(0)).cast("long").alias(name)
        for name, parts in sums.items()
    ]


def cleaning_kpis(marked: DataFrame, column_types: Mapping[str, str]) -> DataFrame:
    """One row of counts: cells processed, repaired and found wrong, by semantic type."""
    return marked.agg(*kpi_columns(column_types, marked.columns))


def cell_faults(marked: DataFrame, column_types: Mapping[str, str], row_id: str) -> DataFrame:
    """Cells a rule gave no result for: column, row, raw value and whether the type is strict."""
    typed = {c: t for c, t in column_types.items() if fault_mark(c) in marked.columns}
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"`_RAW_{c}`").alias("value"),
                F.lit(t in STRICT_TYPES).alias("strict"),
                F.col(f"`{fault_mark(c)}`").alias("fault"),
            )
            for c, t in typed.items()
        ]
    )
    any_fault = F.lit(False)
    for c in typed:
        any_fault = any_fault | F.col(f"`{fault_mark(c)}`")
    return (
        marked.where(any_fault)
        .select(F.col(row_id).alias("row_id"), F.inline(F.filter(cells, lambda s: s["fault"])))
        .drop("fault")
        .withColumn("error", F.lit(FAULT))
    )
