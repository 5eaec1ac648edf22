"""Statement dates: parsing per layout, and years where none is printed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Days a printed date may lie outside its statement's period, and
# days a statement may be uploaded before the dates it prints.
PERIOD_TOLERANCE_DAYS = 3
UPLOAD_TOLERANCE_DAYS = 7

DAY_FULL_MONTH_YEAR = "d MMMM yyyy"
DAY_MONTH_YEAR = "d MMM yyyy"
DAY_MONTH_SHORT_YEAR = "d MMM yy"
MONTH_DAY_YEAR = "MMM d yyyy"
SLASHED = "d/M/yyyy"
SLASHED_TIME = "d/M/yyyy H:m:s"


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def try_format(text: Column, fmt: str) -> Column:
    return F.try_to_timestamp(text, F.lit(fmt)).cast("timestamp_ntz")


def _iso(text: Column) -> Column:
    """ISO 8601; a zone is dropped, the printed clock time is kept."""
    local = F.regexp_replace(text, r"(Z|[+-]\d{2}:?\d{2})$", "")
    return F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), local.try_cast("timestamp_ntz"))


def parse_date(text: Column | str, fmt: str | None = None) -> Column:
    """The given format first, then the common ones; null when none fits."""
    trimmed = F.regexp_replace(F.trim(_column(text)), r"\s+", " ")
    tries = [_iso(trimmed)] + [try_format(trimmed, f) for f in (DAY_MONTH_YEAR, DAY_FULL_MONTH_YEAR)]
    if fmt == DAY_MONTH_SHORT_YEAR:
        parsed = try_format(trimmed, fmt)
        # Two-digit years 69..99 belong to the last century.
        first = F.when(F.year(parsed) >= 2069, parsed - F.expr("INTERVAL '100' YEAR")).otherwise(parsed)
        tries = [first, *tries]
    elif fmt is not None:
        tries = [try_format(trimmed, fmt), *tries]
    return F.coalesce(*tries)


def infer_year(day_month: Column | str, reference: Column | str) -> Column:
    """Date a "15 Jan" from the upload time: the latest of this and last year's
    date that is at most a week after it, else the earlier of the two."""
    text, ref = F.trim(_column(day_month)), _column(reference).cast("timestamp_ntz")
    years = [F.year(ref), F.year(ref) - 1]
    candidates = F.array_compact(
        F.array(*[try_format(F.concat_ws(" ", text, y.cast("string")), DAY_MONTH_YEAR) for y in years])
    )
    limit = ref + F.expr(f"INTERVAL '{UPLOAD_TOLERANCE_DAYS}' DAY")
    return F.coalesce(F.array_max(F.filter(candidates, lambda c: c <= limit)), F.array_min(candidates))


def parse_or_infer(text: Column | str, reference: Column | str) -> Column:
    """A day and month with a year when one is printed, inferred otherwise."""
    column = _column(text)
    printed = F.when(column.rlike(r"\d{4}"), parse_date(column, DAY_MONTH_YEAR))
    return F.coalesce(printed, infer_year(column, reference))


def year_in_period(day_month: Column | str, start: Column | str, end: Column | str) -> Column:
    """"15 Jan" with the year of the period's start or end that puts it inside
    the period (three days of slack on both sides), else null."""
    text, lo, hi = _column(day_month), _column(start), _column(end)

    def dated(year: Column) -> Column:
        full = F.concat_ws(" ", text, year.cast("string"))
        day = try_format(full, DAY_MONTH_YEAR).cast("date")
        inside = (day >= F.date_sub(lo, PERIOD_TOLERANCE_DAYS)) & (day <= F.date_add(hi, PERIOD_TOLERANCE_DAYS))
        return F.when(inside, full)

    return F.coalesce(dated(F.year(lo)), dated(F.year(hi)))


def month_of(value: Column | str) -> Column:
    return F.trunc(_column(value).cast("date"), "month")


def week_of(value: Column | str) -> Column:
    """Monday of the week."""
    return F.trunc(_column(value).cast("date"), "week")
