"""Spending over time. Only outgoing amounts count, shown as positive."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.dates import month_of, week_of


def outgoing(transactions: DataFrame) -> DataFrame:
    return transactions.filter("amount_minor < 0").withColumn("spend_minor", -F.col("amount_minor"))


def _in_year(year: int) -> Column:
    """A date range rather than year(...), so that it reaches the scan."""
    day = F.col("transaction_date")
    return (day >= F.lit(dt.date(year, 1, 1))) & (day < F.lit(dt.date(year + 1, 1, 1)))


def _in_month(month: dt.date) -> Column:
    first = month.replace(day=1)
    following = (first + dt.timedelta(days=32)).replace(day=1)
    day = F.col("transaction_date")
    return (day >= F.lit(first)) & (day < F.lit(following))


def _total(rows: DataFrame, part: Column, name: str) -> DataFrame:
    return rows.groupBy(part.alias(name)).agg(F.sum("spend_minor").alias("spend_minor"))


def monthly_spend(transactions: DataFrame, year: int) -> DataFrame:
    return _total(outgoing(transactions.filter(_in_year(year))), month_of("transaction_date"), "month").orderBy("month")


def weekly_spend(transactions: DataFrame, month: dt.date) -> DataFrame:
    """Weeks of one month; the first may start in the month before."""
    return _total(outgoing(transactions.filter(_in_month(month))), week_of("transaction_date"), "week").orderBy("week")


def max_weekly_spend(transactions: DataFrame, year: int) -> DataFrame:
    weeks = _total(outgoing(transactions.filter(_in_year(year))), week_of("transaction_date"), "week")
    return weeks.agg(F.max("spend_minor").alias("max_spend_minor"))


def max_monthly_spend(transactions: DataFrame) -> DataFrame:
    months = _total(outgoing(transactions), month_of("transaction_date"), "month")
    return months.agg(F.max("spend_minor").alias("max_spend_minor"))


def available_months(transactions: DataFrame) -> DataFrame:
    return transactions.select(month_of("transaction_date").alias("month")).distinct().orderBy("month")


def available_years(transactions: DataFrame) -> DataFrame:
    return transactions.select(F.year("transaction_date").alias("year")).distinct().orderBy("year")
