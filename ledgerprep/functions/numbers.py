"""Numbers and dates held as text."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerprep.functions.text import strip

_DIGITS = r"\d+(_\d+)*"
_GROUPED = rf"^[+-]?({_DIGITS}(\.({_DIGITS})?)?|\.{_DIGITS})([eE][+-]?{_DIGITS})?$"
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_INFINITE = ["inf", "+inf", "-inf", "infinity", "+infinity", "-infinity"]


def parse_plain_number(text: Column) -> Column:
    """Double of a text without blanks around it and with a decimal point, else null.

    The grammar is checked first: a cast alone would also take ``1.0d``, and a failed cast
    costs far more than a failed match. Not-a-number reads as missing."""
    return (
        F.when(text.rlike(_NUMBER), text.try_cast("double"))
        .when(text.contains("_") & text.rlike(_GROUPED), F.translate(text, "_", "").try_cast("double"))
        .when(F.lower(text).isin(_INFINITE), text.try_cast("double"))
    )


def _plain_first(cell: Column, otherwise: Column) -> Column:
    """Cells that hold nothing but a number skip all preparation."""
    return F.when(cell.rlike(_NUMBER), cell.try_cast("double")).otherwise(otherwise)


def parse_number(c: Column) -> Column:
    """Number in a cell: blanks are dropped and a decimal comma is a point."""
    cell = c.cast("string")
    return _plain_first(cell, parse_plain_number(F.translate(strip(cell), ", ", ".")))


def parse_strict_number(c: Column) -> Column:
    """Number in a cell that must already be written with a decimal point."""
    cell = c.cast("string")
    return _plain_first(cell, parse_plain_number(strip(cell)))


def exact_sum(amount: Column) -> Column:
    """Sum of doubles whose last digit does not depend on the order of addition; null without amounts.

    Amounts are added as decimals with 12 digits after the point. What has more than 18 digits before
    it, or is infinite or not a number, is no amount a ledger holds and is added as doubles."""
    held = F.abs(amount) < 1e18  # not-a-number is larger than any number
    exact = F.sum(F.when(held, amount).cast("decimal(30,12)")).cast("double")
    beyond = F.sum(F.when(~held, amount))
    return F.coalesce(exact + beyond, exact, beyond)


def number_text(name: str) -> str:
    """SQL for the shortest decimal text of a double column as messages show it: ``-0.5``,
    ``9999.0``, ``1e+16``."""
    plain, size = f"cast({name} AS string)", f"abs({name})"
    digits = f"rtrim('0', cast(try_cast({plain} AS decimal(38,18)) AS string))"
    exponent = f"regexp_extract({plain}, 'E-?([0-9]+)$', 1)"
    return f"""CASE WHEN {size} = double('infinity') THEN if({name} > 0, 'inf', '-inf')
      WHEN {size} = 0 OR ({size} >= 1e-3 AND {size} < 1e7) THEN {plain}
      WHEN {size} >= 1e-4 AND {size} < 1e16 THEN if(endswith({digits}, '.'), {digits} || '0', {digits})
      ELSE replace(substring_index({plain}, 'E', 1), '.0', '') || if(contains({plain}, 'E-'), 'e-', 'e+')
        || if(length({exponent}) < 2, lpad({exponent}, 2, '0'), {exponent}) END"""


def _shapes(*patterns: str) -> list[str]:
    """Shapes (digits as 0) of patterns in which ``?`` stands for one or two digits."""
    done, todo = [], list(patterns)
    while todo:
        pattern = todo.pop()
        if "?" in pattern:
            todo += [pattern.replace("?", "0", 1), pattern.replace("?", "00", 1)]
        else:
            done.append(pattern)
    return sorted(done)


# The agreed formats: year first with - (and a time after T), day first with points or slashes,
# eight digits. The others stand in for a lenient reader: month first where the day is not,
# year first with slashes, a time after a blank, two digits of the year (month first).
DATE_SHAPES = _shapes(
    "0000-?-?", "0000-?-?T?:?:?", "?.?.0000", "00000000", "?/?/0000", "0000/?/?", "?-?-0000",
    "0000-?-? ?:00", "0000-?-? ?:00:00", "?/?/00", "?-?-00",
)
# A time with a fraction or a zone; the zone is not applied, the text's own clock counts.
_CLOCK = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}[T ][0-9]{1,2}:[0-9]{2}(:[0-9]{2}([.,][0-9]+)?)?( ?(Z|[+-][0-9]{2}(:?[0-9]{2})?))?$"
_ZONE = r" ?(Z|[+-][0-9]{2}(:?[0-9]{2})?)$"
_DAY_OF_MONTH = r"^([0-9]{1,2})(?:st|nd|rd|th)?[ -]([a-z]+)[.]?,?[ -]([0-9]{4})$"
_MONTH_DAY = r"^([a-z]+)[.]? ([0-9]{1,2})(?:st|nd|rd|th)?,? ([0-9]{4})$"
_MONTHS = "array('january', 'february', 'march', 'april', 'may', 'june', 'july', 'august', 'september', 'october', 'november', 'december')"


def _named_month(pattern: str, text: str, day: int, month: int) -> str:
    """SQL for a date with an English month name, whole or of three letters."""
    part = lambda i: f"regexp_extract({text}, '{pattern}', {i})"
    place = f"coalesce(nullif(array_position({_MONTHS}, {part(month)}), 0), array_position(transform({_MONTHS}, m -> left(m, 3)), {part(month)}))"
    return f"try_make_timestamp(int({part(3)}), int({place}), int({part(day)}), 0, 0, 0)"


_LIST = ", ".join(f"'{s}'" for s in DATE_SHAPES)
_TIME = "coalesce(int(get({p}, 3)), 0), coalesce(int(get({p}, 4)), 0), coalesce(int(get({p}, 5)), 0)"


def with_dates(df: DataFrame, dates: Mapping[str, Column]) -> DataFrame:
    """Add columns of timestamps read from texts, null where a text is no date.

    A text is first reduced to its shape; only texts of a known shape are cut into parts. Each
    step has a projection of its own, so that it is computed once."""
    kept = df.columns
    out = df.withColumns({f"_T_{n}": strip(c.cast("string")) for n, c in dates.items()})
    out = out.withColumns(
        {
            f"_S_{n}": F.expr(f"if(length(`_T_{n}`) >= 6, translate(`_T_{n}`, '123456789', '000000000'), null)")
            for n in dates
        }
    )
    out = out.withColumns(
        {
            f"_P_{n}": F.expr(f"if(`_S_{n}` IN ({_LIST}), split(translate(`_T_{n}`, '-/.T:', '     '), ' '), null)")
            for n in dates
        }
    )

    def read(n: str) -> Column:
        t, s, p = f"`_T_{n}`", f"`_S_{n}`", f"`_P_{n}`"
        day_first = f"try_make_timestamp(int({p}[2]), int({p}[1]), int({p}[0]), 0, 0, 0)"
        month_first = f"try_make_timestamp(int({p}[2]), int({p}[0]), int({p}[1]), 0, 0, 0)"
        # A year of two digits lies less than 50 years ahead.
        year = f"(2000 + int({p}[2]) - if(2000 + int({p}[2]) >= year(current_date()) + 50, 100, 0))"
        short_month_first = f"try_make_timestamp({year}, int({p}[0]), int({p}[1]), 0, 0, 0)"
        short_day_first = f"try_make_timestamp({year}, int({p}[1]), int({p}[0]), 0, 0, 0)"
        return F.expr(
            f"""CASE WHEN {p} IS NULL THEN CASE
                  WHEN {s} IS NULL THEN NULL
                  WHEN {t} RLIKE '{_CLOCK}' THEN try_cast(replace(regexp_replace({t}, '{_ZONE}', ''), ',', '.') AS timestamp)
                  WHEN lower({t}) RLIKE '{_DAY_OF_MONTH}' THEN {_named_month(_DAY_OF_MONTH, f"lower({t})", 1, 2)}
                  WHEN lower({t}) RLIKE '{_MONTH_DAY}' THEN {_named_month(_MONTH_DAY, f"lower({t})", 2, 1)} END
                WHEN size({p}) = 1 THEN try_make_timestamp(
                  int(substring({t}, 1, 4)), int(substring({t}, 5, 2)), int(substring({t}, 7, 2)), 0, 0, 0)
                WHEN length({p}[0]) = 4 THEN try_make_timestamp(
                  int({p}[0]), int({p}[1]), int({p}[2]), {_TIME.format(p=p)})
                WHEN length({p}[2]) = 2 THEN coalesce({short_month_first}, {short_day_first})
                WHEN contains({s}, '-') THEN coalesce({month_first}, {day_first})
                WHEN contains({s}, '/') THEN coalesce({day_first}, {month_first})
                ELSE {day_first} END"""
        )

    out = out.withColumns({n: read(n) for n in dates})
    return out.select(*[F.col(f"`{c}`") for c in [*kept, *[n for n in dates if n not in kept]]])


def _shifted(day: Column, months: Column) -> Column:
    return day + F.make_ym_interval(F.lit(0), months)


def as_timestamp(moment: dt.datetime | dt.date | str) -> Column:
    return F.lit(str(moment)).cast("timestamp")


def months_before(moment: Column, months: int) -> Column:
    return _shifted(moment, F.lit(-months))


def whole_months(day: Column, until: Column) -> Column:
    """Largest m with ``day`` plus m months not after ``until`` (month ends are clipped)."""
    rough = ((F.year(until) - F.year(day)) * 12 + F.month(until) - F.month(day)).cast("int")
    return F.when(_shifted(day, rough) <= until, rough).otherwise(rough - 1)
