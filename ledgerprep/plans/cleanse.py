"""The cleaning run: map, clean, cross-check, apply rules, quarantine and match duplicates."""

from __future__ import annotations

import datetime as dt
import time
import uuid
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerprep import fixed_values as fv
from ledgerprep.operators import (
    cleansing,
    costing,
    crosschecks,
    entity,
    industrial,
    inventory,
    mapping,
    quarantine,
)
from ledgerprep.session import cut

ROW_ID = "_ROW_ID"


@dataclass
class Options:
    """What to do with a table. ``row_id`` names a stable number column of the input; without
    one the run numbers the rows and writes them once before it goes on."""

    column_types: Mapping[str, str]
    mapping: Mapping[str, str] = field(default_factory=dict)
    required: Iterable[str] | None = None
    defaults: Mapping[str, str] = field(default_factory=dict)
    keep_unmapped: bool = False
    template: str | None = None
    row_id: str | None = None
    rules: Mapping[str, cleansing.Rule] = field(default_factory=dict)
    dedup_column: str | None = None
    dedup_threshold: float = entity.THRESHOLD
    blocking: str = "first_3_chars"
    scorer: str = "indel"
    default_rate: float = costing.DEFAULT_RATE
    obsolescence_months: int = inventory.OBSOLETE_MONTHS
    as_of: dt.datetime | str | None = None


@dataclass
class CostingResult:
    cost: DataFrame
    kpis: DataFrame


@dataclass
class InventoryResult:
    enriched: DataFrame
    negative: DataFrame
    obsolete: DataFrame
    discrepancies: DataFrame
    abc: DataFrame | None
    kpis: DataFrame


@dataclass
class RunResult:
    """Tables of a run. They are lazy over one written table of judged rows (``marked``)."""

    run_id: str
    options: Options
    marked: DataFrame
    accepted: DataFrame
    rejected: DataFrame
    kpis: DataFrame
    faults: DataFrame
    audit: DataFrame
    duplicates: DataFrame | None = None
    costing: CostingResult | None = None
    inventory: InventoryResult | None = None


def with_row_id(df: DataFrame, row_id: str | None) -> DataFrame:
    """The table with a stable ``_ROW_ID``.

    Numbers made by the run follow the order of the partitions and are written before use,
    because a recomputed partition could be numbered otherwise."""
    if row_id is not None:
        return df.withColumn(ROW_ID, F.col(f"`{row_id}`").cast("long"))
    return cut(df.withColumn(ROW_ID, F.monotonically_increasing_id()))


def judge(df: DataFrame, options: Options) -> DataFrame:
    """Stateless part of the run, from raw rows to rows with verdicts, flags and reject columns.

    Only the bill-of-materials rule looks beyond a row; without it the plan is a chain of
    projections that also runs on a stream."""
    required = options.required if options.required is not None else options.mapping.values()
    if options.mapping:
        df = mapping.map_columns(
            df, options.mapping, required, options.defaults, options.keep_unmapped, carry=[ROW_ID]
        )
    out = cleansing.cleanse(df, options.column_types, options.rules, marks=True)
    out = crosschecks.cross_check(out, options.column_types)
    if industrial.has_rules(options.template):
        out = industrial.apply_rules(out, options.template, findings=True)
    return quarantine.mark_rejects(out, options.column_types)


def presented(marked: DataFrame) -> DataFrame:
    """Rows without the helper columns KPIs are counted from."""
    return cleansing.drop_marks(marked).drop(*industrial.HELPERS)


def run_kpis(marked: DataFrame, column_types: Mapping[str, str]) -> DataFrame:
    """One row with every count of the run, from one scan of the judged rows."""
    columns = marked.columns
    counts = quarantine.metric_columns(F.col(quarantine.REJECTED))
    counts += cleansing.kpi_columns(column_types, columns)
    counts += [
        (F.count_if(flag) if flag in columns else F.lit(0)).cast("long").alias(name)
        for flag, name in (("_FIX_GEO", "provinces_repaired"), ("_WRONG_BANK", "bank_discrepancies"))
    ]
    if "IND_VALID" in columns:
        counts += industrial.counter_columns()
    else:
        counts += [F.lit(0).cast("long").alias(n) for n in (*industrial.COUNTERS, "rows_in_error")]
    faults = [F.count_if(F.col(f"`{c}`")) for c in columns if c.startswith("_FAULT_")]
    counts.append(sum(faults, F.lit(0)).cast("long").alias("cell_faults"))
    return marked.agg(*counts)


def audit_events(
    run_id: str, kpis: DataFrame, df: DataFrame, options: Options
) -> DataFrame:
    """Audit trail: one row per step with its level, message and row count."""
    missing = [c for c in options.column_types if c not in df.columns]

    def event(level: str, step: str, message: str, count: Column) -> Column:
        return F.struct(
            F.lit(level).alias("level"), F.lit(step).alias("step"), F.lit(message).alias("message"),
            count.cast("long").alias("row_count"),
        )

    header = f"template={options.template or '-'} columns={len(df.columns)}"
    events = [
        event("SYSTEM", "start", header, F.col("processed_rows")),
        *[event("WARNING", "cleanse", f"Column '{c}' is declared but not in the data", F.lit(0)) for c in missing],
        event("LEAN ALGORITHM", "geography", "Provinces repaired", F.col("provinces_repaired")),
        event("WARNING", "bank", "IBAN and BIC of different countries", F.col("bank_discrepancies")),
        event("WARNING", "industrial", "Rows in error", F.col("rows_in_error")),
        event("WARNING", "cells", "Cells a rule gave no result for", F.col("cell_faults")),
        event("WARNING", "quarantine", "Rows set aside for critical errors", F.col("rejected_rows")),
        event("LEAN ALGORITHM", "end", "Rows ready to load", F.col("valid_rows")),
    ]
    return kpis.select(F.inline(F.array(*events))).select(
        F.lit(run_id).alias("run_id"), F.current_timestamp().alias("ts"), "*"
    )


def run_costing(
    master: DataFrame, bom: DataFrame | None, routing: DataFrame | None, default_rate: float
) -> CostingResult:
    cost = costing.classify_deviation(costing.standard_cost(master, bom, routing, default_rate))
    return CostingResult(cost, costing.costing_kpis(cost))


def run_inventory(stock: DataFrame, row_id: str, as_of, months: int) -> InventoryResult:
    enriched = cut(inventory.enrich(stock, row_id))  # read by its figures, its classes and its file
    return InventoryResult(
        enriched,
        inventory.negative_stock(stock),
        inventory.obsolete_stock(stock, as_of, months),
        inventory.price_discrepancies(stock),
        inventory.abc_summary(enriched) if "ABC_CLASS" in enriched.columns else None,
        inventory.health_kpis(enriched, as_of, months),
    )


def run_cleansing(df: DataFrame, options: Options) -> RunResult:
    """Run the steps on a table. The judged rows are written once; every table of the result
    reads that copy, so accepted and rejected rows come from the same evaluation.

    Judging a row costs far more than moving it, and a file of one row group is read by one task
    whatever its size, so the rows are dealt evenly to all tasks first."""
    run_id = uuid.uuid4().hex
    numbered = with_row_id(df, options.row_id).hint("rebalance")
    marked = cut(judge(numbered, options))
    kpis = run_kpis(marked, options.column_types)
    shown = presented(marked)
    result = RunResult(
        run_id=run_id,
        options=options,
        marked=marked,
        accepted=quarantine.accepted(shown),
        rejected=quarantine.rejected(shown),
        kpis=kpis,
        faults=cleansing.cell_faults(marked, options.column_types, ROW_ID),
        audit=audit_events(run_id, kpis, marked, options),
    )
    if options.dedup_column and options.dedup_column in marked.columns:
        types = options.column_types
        members = entity.find_duplicates(
            result.accepted,
            ROW_ID,
            options.dedup_column,
            crosschecks.first_of_type(marked, types, "tax_id"),
            crosschecks.first_of_type(marked, types, "postal_code"),
            crosschecks.first_of_type(marked, types, "province"),
            options.dedup_threshold,
            options.blocking,
            options.scorer,
        )
        result.duplicates = cut(members)  # merging, figures and the report read it several times
    return result


def measured(result: RunResult, started: float) -> dict:
    """The one-row KPI table as a dict, with the seconds since ``started``."""
    return {**result.kpis.first().asDict(), "process_time_sec": round(time.time() - started, 2)}


def dry_run(df: DataFrame, options: Options, rows: int = 5) -> DataFrame:
    """Before and after of the typed columns of the first rows, with the fate of each row."""
    if options.row_id is None:
        sample = with_row_id(df.limit(rows), None)
    else:
        sample = with_row_id(df, options.row_id).orderBy(ROW_ID).limit(rows)
    plain = Options(**{**options.__dict__, "keep_unmapped": True})
    typed = list(options.column_types)
    before = {f"_BEFORE_{i}": F.col(f"`{c}`") for i, c in enumerate(typed) if c in df.columns}
    judged = judge(sample.withColumns(before) if before else sample, plain)
    state = F.when(
        F.col(quarantine.REJECTED),
        F.concat(F.lit("Rechazado ("), F.col(quarantine.FIELD), F.lit(")")),
    ).otherwise("Válido")
    empty = F.lit("")
    shown = []
    for i, c in enumerate(typed):
        origin = F.coalesce(F.col(f"_BEFORE_{i}").cast("string"), empty) if f"_BEFORE_{i}" in judged.columns else empty
        clean = F.coalesce(F.col(f"`{c}`").cast("string"), empty) if c in judged.columns else empty
        shown += [origin.alias(f"{c} (Origen)"), clean.alias(f"{c} (Limpio)")]
    # The window numbers the few sampled rows only.
    line = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(ROW_ID))
    return judged.select(line.alias("Fila"), state.alias("Estado"), *shown)
