"""Tax id, IBAN and BIC rules.

Each ``*_error`` takes the already cleaned code (see ``alphanumeric_code``) and gives the
reason it is wrong, ``""`` when it is right. Callers materialise the code in a projection of
its own so that it is computed once per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerprep import fixed_values as fv

EMPTY_VALUE = "Valor vacío o no válido"


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _digit(code: Column, position: int) -> Column:
    return F.ascii(F.substring(code, position, 1)) - 48


def _nif_letter(digits: Column) -> Column:
    number = digits.try_cast("int")
    return F.substring(F.lit(fv.NIF_LETTERS), number % 23 + 1, F.lit(1))


def _control_verdict(expected: Column, last: Column) -> Column:
    return F.when(
        expected != last,
        _text("Dígito de control incorrecto. Esperado '", expected, "', recibido '", last, "'"),
    ).otherwise("")


def tax_id_error(code: Column) -> Column:
    first, last = F.substring(code, 1, 1), F.substring(code, 9, 1)
    middle = F.substring(code, 2, 7)
    seven_digits = middle.rlike("^[0-9]{7}$")

    foreigner_number = F.concat(F.translate(first, "XYZ", "012"), middle)
    foreigner = F.when(
        ~seven_digits, F.lit("NIE con caracteres no numéricos en la parte central")
    ).otherwise(_control_verdict(_nif_letter(foreigner_number), last))

    eight = F.substring(code, 1, 8)
    person = F.when(
        ~eight.rlike("^[0-9]{8}$"), F.lit("NIF con caracteres no numéricos en la parte central")
    ).otherwise(_control_verdict(_nif_letter(eight), last))

    # Doubling digit d and adding the digits of the result gives 2d, less 9 from five on.
    doubled = [2 * _digit(code, p) - F.when(_digit(code, p) > 4, 9).otherwise(0) for p in (2, 4, 6, 8)]
    total = sum(doubled[1:], doubled[0]) + _digit(code, 3) + _digit(code, 5) + _digit(code, 7)
    control = (10 - total % 10) % 10
    as_digit = control.cast("string")
    as_letter = F.substring(F.lit(fv.CIF_CONTROL_LETTERS), control + 1, F.lit(1))
    company = (
        F.when(~seven_digits, F.lit("CIF con caracteres no numéricos en la parte central"))
        .when(
            first.isin(*fv.CIF_LETTER_ONLY),
            F.when(
                last != as_letter,
                _text("Dígito de control de CIF debe ser la letra '", as_letter, "'"),
            ).otherwise(""),
        )
        .when(
            first.isin(*fv.CIF_DIGIT_ONLY),
            F.when(
                last != as_digit,
                _text("Dígito de control de CIF debe ser el número '", as_digit, "'"),
            ).otherwise(""),
        )
        .when(
            (last != as_digit) & (last != as_letter),
            _text(
                "Dígito de control de CIF incorrecto. Esperado '", as_digit, "' o '", as_letter, "'"
            ),
        )
        .otherwise("")
    )
    return (
        F.when(code == "", F.lit(EMPTY_VALUE))
        .when(
            F.length(code) != 9,
            _text("Longitud incorrecta: ", F.length(code).cast("string"), " caracteres (deben ser 9)"),
        )
        .when(first.isin("X", "Y", "Z"), foreigner)
        .when(first.between("0", "9"), person)
        .when(first.isin(*fv.CIF_PREFIXES), company)
        .otherwise(_text("Tipo de Tax ID no identificado o prefijo '", first, "' inválido"))
    )


def iban_remainder(code: Column) -> Column:
    """Remainder by 97 of the code with its first four characters moved to the end and
    letters read as 10 to 35. One pass over the characters, as the number has up to 68 digits."""
    turned = F.concat(F.substr(code, F.lit(5)), F.substring(code, 1, 4))

    def step(acc: Column, ch: Column) -> Column:
        value = F.ascii(ch)
        return F.when(value < 58, (acc * 10 + value - 48) % 97).otherwise(
            (acc * 100 + value - 55) % 97
        )

    return F.aggregate(F.split(turned, ""), F.lit(0), step)


def iban_error(code: Column) -> Column:
    size, country = F.length(code), F.substring(code, 1, 2)
    lengths = F.create_map(*[F.lit(x) for pair in fv.IBAN_LENGTHS.items() for x in pair])
    expected = lengths[country]
    return (
        F.when(code == "", F.lit(EMPTY_VALUE))
        .when(
            ~size.between(15, 34),
            _text(
                "Longitud incorrecta: ", size.cast("string"), " caracteres (debe estar entre 15 y 34)"
            ),
        )
        .when(
            ~country.rlike("^[A-Z]{2}$"),
            F.lit("El IBAN debe comenzar con un código de país de 2 letras"),
        )
        .when(
            expected != size,
            _text(
                "Longitud incorrecta para país ", country, ": ", size.cast("string"),
                " (deberían ser ", expected.cast("string"), ")",
            ),
        )
        .when(
            iban_remainder(code) != 1,
            F.lit("Algoritmo de control (Módulo 97) fallido: IBAN matemáticamente incorrecto"),
        )
        .otherwise("")
    )


def bic_error(code: Column, country: Column | None = None) -> Column:
    """``country`` (a country code or an IBAN) adds the check that the BIC belongs to it."""
    size, own = F.length(code), F.substring(code, 5, 2)
    verdict = (
        F.when(code == "", F.lit(EMPTY_VALUE))
        .when(
            ~size.isin(8, 11),
            _text("Longitud incorrecta: ", size.cast("string"), " caracteres (deben ser 8 u 11)"),
        )
        .when(~code.rlike(fv.BIC_PATTERN), F.lit("Estructura de BIC/SWIFT no válida"))
    )
    if country is not None:
        wanted = F.substring(F.upper(F.btrim(country, F.lit(fv.WHITESPACE))), 1, 2)
        verdict = verdict.when(
            (F.length(wanted) == 2) & (own != wanted),
            _text(
                "Discrepancia: el país del BIC '", own, "' no coincide con el del IBAN '", wanted, "'"
            ),
        )
    return verdict.otherwise("")
