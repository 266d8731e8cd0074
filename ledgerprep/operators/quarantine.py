"""Separating rows with critical errors from the rows to load."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerprep.operators.cleansing import STRICT_TYPES

REASON, FIELD, ADVICE = "MOTIVO_RECHAZO", "CAMPO_AFECTADO", "SUGERENCIA"
REJECTED = "_REJECTED"


def _candidate(error: str, field: str, advice: str, condition: Column) -> Column:
    return F.when(
        condition,
        F.struct(
            F.col(f"`{error}`").alias(REASON), F.lit(field).alias(FIELD), F.lit(advice).alias(ADVICE)
        ),
    )


def mark_rejects(df: DataFrame, column_types: Mapping[str, str]) -> DataFrame:
    """Add the reject columns (null on accepted rows) and the flag ``_REJECTED``.

    A missing mandatory template field rejects first, in column order; then the first error of
    a tax id or IBAN column."""
    template = [c for c in df.columns if c.endswith("_SAP_ERROR")]
    strict = [
        c
        for c in df.columns
        if c.endswith("_ERROR")
        and c not in template
        and column_types.get(c.removesuffix("_ERROR")) in STRICT_TYPES
    ]
    causes = [
        _candidate(
            c,
            c.removesuffix("_SAP_ERROR"),
            "Rellenar el campo obligatorio para SAP.",
            F.lower(f"`{c}`").contains("obligatorio"),
        )
        for c in template
    ] + [
        _candidate(
            c,
            c.removesuffix("_ERROR"),
            f"Revisar el formato del {column_types[c.removesuffix('_ERROR')].upper()}.",
            F.col(f"`{c}`") != "",
        )
        for c in strict
    ]
    if not causes:
        nothing = F.lit(None).cast("string")
        return df.withColumns(
            {REASON: nothing, FIELD: nothing, ADVICE: nothing, REJECTED: F.lit(False)}
        )
    marked = df.withColumn("_CAUSE", F.coalesce(*causes))
    return marked.withColumns(
        {name: F.col("_CAUSE")[name] for name in (REASON, FIELD, ADVICE)}
        | {REJECTED: F.col("_CAUSE").isNotNull()}
    ).drop("_CAUSE")


def accepted(marked: DataFrame) -> DataFrame:
    """Rows to load. ``marked`` should be a written table, as both halves read it: a filter on a
    lazy one is pushed below all the rules and makes Spark evaluate them again."""
    return marked.where(~F.col(REJECTED)).drop(REASON, FIELD, ADVICE, REJECTED)


def rejected(marked: DataFrame) -> DataFrame:
    return marked.where(REJECTED).drop(REJECTED)


def metric_columns(flag: Column) -> list[Column]:
    total, bad = F.count(F.lit(1)), F.count_if(flag)
    return [
        total.alias("processed_rows"),
        (total - bad).alias("valid_rows"),
        bad.alias("rejected_rows"),
        F.when(total > 0, F.round(bad / total * 100, 2)).otherwise(0.0).alias("rejection_rate"),
    ]


def run_metrics(marked: DataFrame) -> DataFrame:
    """One row: rows processed, valid and rejected, and the rejection rate in percent."""
    return marked.agg(*metric_columns(F.col(REJECTED)))


# Keywords (lower case) -> category, tried in this order.
_CATEGORIES = [
    (("dígito de control", "letra", "checksum"), "La letra o dígito de control no coincide con los números. Revisa si hay algún número equivocado al teclear."),
    (("longitud",), "El número de letras o números es incorrecto. Comprueba si falta algún dígito."),
    (("formato", "estructura"), "El orden o la estructura de letras y números no es válido. Comprueba el formato."),
    (("mod-97", "modulo-97", "código de control"), "Los dígitos de verificación de la cuenta bancaria son incorrectos. Revisa si hay algún número equivocado."),
    (("país", "pais"), "El código de país no coincide con las normas internacionales o con el banco asociado."),
    (("rango",), "El código postal no existe o está fuera del territorio español."),
]


def plain_reason(message: Column) -> Column:
    """What a technical reason means to a business user; the reason itself if nothing fits."""
    lowered = F.lower(message)
    result = F.when(message.isNull() | (message == ""), F.lit(""))
    for words, meaning in _CATEGORIES:
        hit = lowered.contains(words[0])
        for word in words[1:]:
            hit = hit | lowered.contains(word)
        result = result.when(hit, F.lit(meaning))
    return result.otherwise(message)


def reject_reasons(rejects: DataFrame) -> DataFrame:
    """Rejected rows counted by field and plain reason."""
    return rejects.groupBy(
        F.col(FIELD).alias("field"), plain_reason(F.col(REASON)).alias("reason")
    ).agg(F.count(F.lit(1)).alias("rows"))
