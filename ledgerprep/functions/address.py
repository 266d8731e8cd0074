"""Address cleaning and splitting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerprep import fixed_values as fv
from ledgerprep.functions.text import raw_text, squeeze

_EDGES = " ,.-"
_NUMBER = "(?U)\\b(" + fv.HOUSE_NUMBER + ")\\b"
_NUMBER_AT_END = "(?U)\\b(" + fv.HOUSE_NUMBER_AT_END + ")$"

PART_SUFFIXES = ("_TIPO_VIA", "_NOMBRE_VIA", "_NUMERO", "_PISO")


def clean_address(c: Column) -> Column:
    text = raw_text(c)
    return F.when(text == fv.EMPTY_MARK, F.lit("")).otherwise(F.upper(squeeze(text)))


def _bare(c: Column) -> Column:
    return F.btrim(c, F.lit(_EDGES))


def street_type_prefix(address: Column) -> Column:
    """The words at the start that name the street type, ``""`` without one."""
    words = "|".join(pattern for pattern, _ in fv.STREET_TYPES)
    return F.regexp_extract(address, "(?U)^(" + words + ")", 1)


def street_type(prefix: Column) -> Column:
    """Street type a prefix found by ``street_type_prefix`` stands for."""
    result = None
    for pattern, name in fv.STREET_TYPES:
        hit = prefix.rlike("(?U)^(" + pattern + ")")
        result = F.when(hit, F.lit(name)) if result is None else result.when(hit, F.lit(name))
    return result.otherwise("")


def split_rest(rest: Column) -> Column:
    """Street name, number and floor of an address without its street type, as a struct."""
    comma = F.instr(rest, ",")
    left = _bare(F.substring(rest, F.lit(1), comma - 1))
    end_number = F.when(comma > 0, F.regexp_extract(left, _NUMBER_AT_END, 1)).otherwise("")
    by_comma = F.struct(
        _bare(F.substring(left, F.lit(1), F.length(left) - F.length(end_number))).alias("name"),
        end_number.alias("number"),
        _bare(F.substr(rest, comma + 1)).alias("floor"),
    )
    number = F.regexp_extract(rest, _NUMBER, 1)
    start = F.regexp_instr(rest, F.lit(_NUMBER))
    anywhere = F.struct(
        _bare(F.substring(rest, F.lit(1), start - 1)).alias("name"),
        number.alias("number"),
        _bare(F.substr(rest, start + F.length(number))).alias("floor"),
    )
    none = F.struct(
        _bare(rest).alias("name"), F.lit(fv.NO_HOUSE_NUMBER).alias("number"), F.lit("").alias("floor")
    )
    return F.when(end_number != "", by_comma).when(number != "", anywhere).otherwise(none)
