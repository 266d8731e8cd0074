"""Text cleaning expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerprep import fixed_values as fv

_BLANKS = " " * len(fv.WHITESPACE)
_LONGEST_NULL = max(map(len, fv.TEXT_NULL_TOKENS))


def raw_text(c: Column) -> Column:
    """The cell as text; null reads as the empty text."""
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(fv.WHITESPACE))


def squeeze(c: Column) -> Column:
    """Runs of whitespace become one blank, none at the ends.

    Pattern matching is kept for the few texts that hold a run of blanks."""
    blank = F.translate(c, fv.WHITESPACE, _BLANKS)
    return F.btrim(
        F.when(blank.contains("  "), F.regexp_replace(blank, " {2,}", " ")).otherwise(blank)
    )


def text_or_mark(squeezed: Column, uppercase: bool = True) -> Column:
    """A squeezed text as it is kept: the empty mark for words that mean nothing."""
    nothing = (F.length(squeezed) <= _LONGEST_NULL) & F.lower(squeezed).isin(fv.TEXT_NULL_TOKENS)
    shown = F.upper(squeezed) if uppercase else squeezed
    return F.when(nothing, F.lit(fv.EMPTY_MARK)).otherwise(shown)


def clean_text(c: Column, uppercase: bool = True) -> Column:
    """Both steps at once. Where speed counts, squeeze in a projection before: Spark evaluates
    what two branches of a condition share twice."""
    return text_or_mark(squeeze(raw_text(c)), uppercase)


def alphanumeric_code(c: Column) -> Column:
    """Letters and digits of the cell in upper case, ``""`` when it holds none."""
    return F.upper(F.regexp_replace(raw_text(c), "[^a-zA-Z0-9]", ""))


def is_blank(c: Column) -> Column:
    """Empty for matching and merging purposes."""
    return c.isNull() | strip(c.cast("string")).isin(fv.BLANK_TOKENS)


# The last one, two or three words of a name, where blanks or a dot part words.
_LAST_WORDS = [rf"(?U)\b\w+(?:(?:\s+\.?\s*|\.\s*)\w+){{{n - 1}}}\s*\.?\s*$" for n in (3, 2, 1)]
_LAST_LETTERS = sorted({form[-1] for form in fv.LEGAL_FORMS + fv.LEGAL_FORMS_SPELLED})


def _is_legal_form(end: Column) -> Column:
    short = F.regexp_replace(end, r"(?U)[.\s]+", "").isin(fv.LEGAL_FORMS)
    return short | F.regexp_replace(strip(end), r"(?U)\s+", " ").isin(fv.LEGAL_FORMS_SPELLED)


def strip_legal_form(c: Column) -> Column:
    """Company name in upper case without its legal form and without edge punctuation.

    The longest end of up to three words that is a legal form goes: without dots and blanks it is
    an abbreviation, or with single blanks a form spelled out. Only names whose last letter can
    end a form are matched, and each end of those once."""
    upper = F.upper(strip(raw_text(c)))
    ends = F.array(*[F.regexp_extract(upper, pattern, 0) for pattern in _LAST_WORDS])
    may_end = F.right(F.rtrim(upper, F.lit(fv.WHITESPACE + ".")), F.lit(1)).isin(_LAST_LETTERS)
    form = F.when(may_end, F.get(F.filter(ends, _is_legal_form), F.lit(0)))
    cut = F.left(upper, F.length(upper) - F.coalesce(F.length(form), F.lit(0)))
    return F.btrim(cut, F.lit(fv.WHITESPACE + ",.-/"))


def matching_tax_key(c: Column) -> Column:
    """Tax id reduced to its matching key; null where it cannot identify anyone."""
    key = F.upper(F.translate(c.cast("string"), " .-", ""))
    return F.when(~is_blank(c) & (F.length(key) >= 7), key)
