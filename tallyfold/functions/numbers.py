"""Figures as printed, exact money, and differences between what is stated and what is computed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Currencies that may stand before a figure, and the form of a figure.
CURRENCIES = ("EUR", "USD", "GBP", "SEK", "NOK", "DKK", "CHF", "INR", "€", r"\$", "£", "₹")
FIGURE = r"\A-?[\d,]+\.?\d*\z"

MONEY = "decimal(18,6)"
CENTS = "decimal(18,2)"


def without_currency(text: Column) -> Column:
    """The text without a leading currency, where a digit, a bracket or a minus follows."""
    return F.regexp_replace(F.trim(text), rf"(?i)^(?:{'|'.join(CURRENCIES)})\s*(?=[\d(-])", "")


def is_figure(text: Column) -> Column:
    """Whether a word is a figure, with thousands separators and after its currency; false for null."""
    return F.coalesce(figure(text).isNotNull(), F.lit(False))


def figure(text: Column) -> Column:
    """The figure as a double, null if the word is none."""
    plain = without_currency(text)
    return F.when(plain.rlike(FIGURE), F.regexp_replace(plain, ",", "").try_cast("double"))


def money(value: Column) -> Column:
    """Exact decimal of a number or numeric text, by its shortest spelling; null if it is none."""
    return value.cast("string").try_cast(MONEY)


def cents(value: Column) -> Column:
    """To the cent, halves away from zero."""
    return F.round(value, 2).try_cast(CENTS)


def difference(expected: Column, stated: Column) -> Column:
    return cents(stated - expected)


def percentage(expected: Column, stated: Column) -> Column:
    """Size of the difference in percent of what was expected, null where that is zero."""
    return F.when(expected != 0, cents(F.abs(stated - expected).cast("decimal(18,2)") * 100 / F.abs(expected)))


def severity(expected: Column, stated: Column, rounding: Column, reporting: Column) -> Column:
    """Null within the rounding tolerance, ``rounding`` within the reporting tolerance, else ``material``; bounds belong to the milder class."""
    size = F.abs(difference(expected, stated))
    return F.when(size <= rounding, None).when(size <= reporting, F.lit("rounding")).when(size.isNotNull(), F.lit("material"))


def as_text(value: Column) -> Column:
    """A decimal as its plain digits."""
    return value.cast("string")


def printed(value: Column) -> Column:
    """A figure with two decimals and thousands separators."""
    return F.format_number(value, 2)
