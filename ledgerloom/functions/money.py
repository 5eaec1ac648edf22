"""Exact money: signed integers of the smallest unit, never floating point."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Decimal places per ISO 4217 currency.
MINOR_UNITS = {"GBP": 2, "USD": 2, "EUR": 2, "JPY": 0}

# The whole text as an amount, else the first amount inside it.
AMOUNT = r"^[-+]?[\d,]+\.\d+$|[-+]?[\d,]+\.\d{2}"


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _scale(currency: Column | str) -> Column:
    """Minor units per major unit; null for an unknown currency."""
    if isinstance(currency, str):
        known = MINOR_UNITS.get(currency)
        return F.lit(None if known is None else 10**known).cast("long")
    chosen = F.lit(None).cast("long")
    for code, places in MINOR_UNITS.items():
        chosen = F.when(currency == code, F.lit(10**places).cast("long")).otherwise(chosen)
    return chosen


def try_parse_money(text: Column | str, currency: Column | str = "GBP") -> Column:
    """Minor units in `text`, null where there is no exact amount (never 0).

    `currency` is a code or a column of codes. A lone dash is not an amount, a CR
    mark is dropped, and digits beyond the currency's places are cut off."""
    plain = F.regexp_replace(_column(text), "[£,]|[Cc][Rr]", "")
    plain = F.trim(plain, F.lit(" \t\n\x0b\f\r"))
    number = F.regexp_extract(plain, AMOUNT, 0)
    return (number.try_cast("decimal(28,8)") * _scale(currency)).try_cast("long")


def parse_money(text: Column | str, currency: Column | str = "GBP") -> Column:
    """As `try_parse_money`, but a value without an amount fails the query."""
    parsed = try_parse_money(text, currency)
    shown = F.coalesce(_column(text), F.lit("null"))
    return F.when(parsed.isNotNull(), parsed).otherwise(
        F.raise_error(F.concat(F.lit("no exact amount in: "), shown)).cast("long")
    )


def minor_to_decimal(minor: Column | str, currency: str = "GBP") -> Column:
    places = MINOR_UNITS[currency]
    return (_column(minor).cast("decimal(24,0)") / F.lit(10**places).cast("decimal(10,0)")).cast(
        f"decimal(24,{places})"
    )


def format_minor(minor: Column | str, currency: str = "GBP") -> Column:
    """£1,234.56 for GBP, "JPY 1,234" style for any other currency."""
    prefix = "£" if currency == "GBP" else f"{currency} "
    return F.concat(F.lit(prefix), F.format_number(minor_to_decimal(minor, currency), MINOR_UNITS[currency]))


def format_signed_minor(minor: Column | str, currency: str = "GBP") -> Column:
    """A change, with its sign before the currency: +£1.00, -£1.00."""
    value = _column(minor)
    return F.concat(F.when(value < 0, "-").otherwise("+"), format_minor(F.abs(value), currency))
