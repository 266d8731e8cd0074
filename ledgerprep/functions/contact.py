"""Phone, postal code and province expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerprep import fixed_values as fv
from ledgerprep.functions.identifiers import EMPTY_VALUE
from ledgerprep.functions.text import raw_text, strip


def phone_letters(c: Column) -> Column:
    """Digits and plus signs of a phone number; a leading ``00`` reads as ``+``."""
    text = strip(raw_text(c))
    international = F.when(text.startswith("00"), F.concat(F.lit("+"), F.substr(text, F.lit(3))))
    return F.regexp_replace(international.otherwise(text), "[^0-9+]", "")


def with_prefix(letters: Column, prefix: str = fv.DIAL_PREFIX) -> Column:
    return (
        F.when(letters == "", F.lit(fv.EMPTY_MARK))
        .when(letters.startswith("+"), letters)
        .otherwise(F.concat(F.lit(prefix), letters))
    )


def normalize_phone(c: Column, prefix: str = fv.DIAL_PREFIX) -> Column:
    """International phone number; one without prefix gets ``prefix``."""
    return with_prefix(phone_letters(c), prefix)


def only_digits(c: Column) -> Column:
    return F.regexp_replace(raw_text(c), "[^0-9]", "")


def padded(digits: Column) -> Column:
    return F.when(F.length(digits) == 4, F.concat(F.lit("0"), digits)).otherwise(digits)


def postal_digits(c: Column) -> Column:
    """Digits of a postal code; four get a leading zero."""
    return padded(only_digits(c))


def postal_code_error(digits: Column) -> Column:
    size = F.length(digits)
    return (
        F.when(digits == "", F.lit(EMPTY_VALUE))
        .when(
            size != 5,
            F.concat(
                F.lit("Longitud incorrecta: "), size.cast("string"), F.lit(" dígitos (deben ser 5)")
            ),
        )
        .when(
            ~digits.between("01000", "52999"),
            F.lit("Código postal fuera del rango de España (01000 - 52999)"),
        )
        .otherwise("")
    )


def province_of(digits: Column) -> Column:
    """Province of a cleaned postal code, null when there is none.

    A literal list of 52 names: the lookup is an array access inside the projection, so it
    needs neither a join nor a broadcast."""
    names = F.array(*[F.lit(name) for name in fv.PROVINCES])
    position = F.substring(digits, 1, 2).try_cast("int")
    return F.when((F.length(digits) == 5) & position.between(1, len(fv.PROVINCES)), names[position - 1])
