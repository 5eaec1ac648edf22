"""Raw rows of any layout to the common tables: one projection per table.

Each source declares how its payload is read; the declarations become CASE
branches, so Bronze is passed over once whatever the number of sources."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import dates as D
from ledgerloom.functions.money import try_parse_money
from ledgerloom.operators.ordered import row_number, scan
from ledgerloom.registries import LEDGER_SOURCES


def raw(key: str) -> Column:
    return F.try_element_at("raw_data", F.lit(key))


def raw_minor(key: str) -> Column:
    """A whole number of minor units, 0 when it is missing."""
    return F.coalesce(raw(key).try_cast("long"), F.lit(0).cast("long"))


def _present(key: str) -> Column:
    return F.nullif(raw(key), F.lit(""))


@dataclass(frozen=True)
class Reading:
    """How one source's payload gives a dated row."""

    date: Callable[[], Column]
    description: Callable[[], Column] = lambda: F.coalesce(raw("description"), F.lit(""))
    currency: Callable[[], Column] = lambda: F.lit("GBP")
    category: Callable[[], Column] = lambda: F.lit(None).cast("string")
    bank_transaction_id: Callable[[], Column] = lambda: F.lit(None).cast("string")


def _fixed(fmt: str) -> Callable[[], Column]:
    return lambda: D.parse_date(raw("date"), fmt)


def _maybe_dated() -> Column:
    return D.parse_or_infer(raw("date"), "upload_timestamp")


def _search_export() -> Column:
    """The shorter of the two CSV exports names its columns in lower case."""
    return F.map_contains_key("raw_data", "id") & F.map_contains_key("raw_data", "created")


def _either(short: Column, full: Column) -> Column:
    return F.when(_search_export(), short).otherwise(full)


def _csv_date() -> Column:
    with_time = D.parse_date(F.concat_ws(" ", _present("Date"), _present("Time")), D.SLASHED_TIME)
    return _either(D.parse_date(raw("created")), F.coalesce(with_time, D.parse_date(raw("Date"), D.SLASHED)))


READINGS: dict[str, Reading] = {
    "monzo": Reading(
        date=_csv_date,
        description=lambda: _either(
            F.coalesce(_present("title"), _present("subtitle"), F.lit("")),
            F.coalesce(_present("Name"), _present("Description"), F.lit("")),
        ),
        currency=lambda: F.coalesce(_either(_present("currency"), _present("Currency")), F.lit("GBP")),
        category=lambda: _either(raw("categories"), raw("Category")),
        bank_transaction_id=lambda: F.nullif(F.trim(_either(raw("id"), raw("Transaction ID"))), F.lit("")),
    ),
    "kroo": Reading(_fixed(D.DAY_FULL_MONTH_YEAR)),
    "natwest-transactions": Reading(_maybe_dated),
    "natwest-statement": Reading(_maybe_dated),
    "amex": Reading(_maybe_dated),
    "chase": Reading(_maybe_dated),
    "firstdirect": Reading(_fixed(D.DAY_MONTH_SHORT_YEAR)),
    "vanguard-pdf": Reading(_fixed(D.SLASHED)),
    "monzo-pdf": Reading(_fixed(D.SLASHED)),
    "monzo-flex": Reading(_fixed(D.SLASHED)),
}


def _by_source(readings: dict[str, Reading], field: str) -> Column:
    """CASE source_type ...; sources that read a field alike share a branch."""
    branches: dict[Callable[[], Column], list[str]] = {}
    for source, reading in readings.items():
        branches.setdefault(getattr(reading, field), []).append(source)
    chosen = None
    for read, sources in branches.items():
        test = F.col("source_type").isin(*sources)
        chosen = F.when(test, read()) if chosen is None else chosen.when(test, read())
    return chosen


def _record_id() -> Column:
    return F.coalesce("bronze_record_id", "bronze_source_key").alias("bronze_record_id")


def _recorded_as(bronze: DataFrame, record_type: str) -> DataFrame:
    return bronze.filter(F.col("record_type") == record_type)


def normalize_transactions(bronze: DataFrame, readings: dict[str, Reading] = READINGS) -> DataFrame:
    """Rows with account_id already resolved, in the common transaction schema."""
    rows = _recorded_as(bronze, "transaction").filter(F.col("source_type").isin(*readings))
    return rows.select(
        _record_id(), "bronze_source_key", "ingestion_id", "source_type", "account_id",
        _by_source(readings, "date").alias("transaction_date"),
        _by_source(readings, "description").alias("description"),
        raw_minor("amount_minor").alias("amount_minor"),
        _by_source(readings, "currency").alias("currency"),
        _by_source(readings, "category").alias("category"),
        _by_source(readings, "bank_transaction_id").alias("bank_transaction_id"),
        "upload_timestamp", "statement_period_from", "statement_period_to", "line_number",
    )


def normalize_holdings(bronze: DataFrame) -> DataFrame:
    rows = _recorded_as(bronze, "holding").filter("source_type = 'vanguard-pdf'")
    return rows.select(
        _record_id(), "bronze_source_key", "account_id",
        F.lit(None).cast("string").alias("isin"),
        raw("fund_name").alias("fund_name"),
        F.coalesce(_present("quantity_text"), raw("quantity"), F.lit("")).alias("quantity"),
        raw_minor("unit_price_minor").alias("unit_price_minor"),
        raw_minor("total_value_minor").alias("total_value_minor"),
        F.lit("GBP").alias("currency"),
        F.coalesce(
            D.parse_date(raw("as_of_date"), D.DAY_FULL_MONTH_YEAR), F.col("upload_timestamp").cast("timestamp_ntz")
        ).cast("date").alias("as_of_date"),
    )


def _plan_minor(field: str) -> Column:
    """Minor units when given as such, else parsed from the printed text.

    The printed plan amounts are text, so reading only the minor-unit keys would
    turn every one of them into 0."""
    return F.coalesce(raw(f"{field}_minor").try_cast("long"), try_parse_money(raw(field)), F.lit(0).cast("long"))


# The amounts of an instalment plan.
PLAN_FIELDS = (
    "plan_total", "plan_lifetime_fee", "remaining_balance",
    "due_this_month_plan", "due_this_month_fee", "due_this_month_total",
)


def normalize_instalments(bronze: DataFrame) -> DataFrame:
    rows = _recorded_as(bronze, "plan_it_instalment").filter("source_type = 'amex'")
    return rows.select(
        _record_id(), "bronze_source_key", "account_id",
        D.parse_date(raw("start_date"), D.MONTH_DAY_YEAR).cast("date").alias("start_date"),
        raw("description").alias("description"),
        *[_plan_minor(f).alias(f"{f}_minor") for f in PLAN_FIELDS],
        raw("instalment_progress").alias("instalment_progress"),
        F.coalesce(
            D.parse_date(raw("as_of_date"), D.DAY_MONTH_YEAR), F.col("upload_timestamp").cast("timestamp_ntz")
        ).cast("date").alias("as_of_date"),
    )


def normalize_ledger(bronze: DataFrame, sources=LEDGER_SOURCES, readings: dict[str, Reading] = READINGS) -> DataFrame:
    """Printed balances, with the verdict of the file they were printed in."""
    rows = _recorded_as(bronze, "transaction").filter(F.col("source_type").isin(*sources))
    return rows.select(
        _record_id(), "bronze_source_key", "account_id", "source_type",
        raw_minor("balance_minor").alias("balance_minor"),
        F.lit("GBP").alias("currency"),
        _by_source({s: readings[s] for s in sources}, "date").cast("date").alias("as_of_date"),
        "upload_timestamp", "statement_period_to", "line_number",
        F.col("reconciliation_matches").alias("reconciled"),
        F.lit("printed").alias("balance_source"),
    )


def suffix_repeats(rows: DataFrame) -> DataFrame:
    """Rows of one file that would share a source key are different rows: the
    second becomes key_dup1, the third key_dup2."""
    # The rows of a file came out of one row of text, so they fit in one task.
    numbered = scan(rows, ["ingestion_id", "bronze_source_key"], ["line_number"], {"_nth": row_number()}, split=False)
    suffix = F.when(F.col("_nth") > 1, F.concat(F.lit("_dup"), (F.col("_nth") - 1).cast("string"))).otherwise("")
    return numbered.withColumn("bronze_source_key", F.concat("bronze_source_key", suffix)).drop("_nth")
