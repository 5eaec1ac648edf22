"""Balances, holdings and net worth, now or as of any date.

"The latest row per account" is an aggregate (largest order key wins), never a
sort of an account's rows, so it combines before the shuffle and a hot account
costs no more than a cold one."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.money import format_minor
from ledgerloom.registries import NEWEST_FIRST_SOURCES
from ledgerloom.session import materialized


def not_disproven() -> Column:
    """True and unknown verdicts both count."""
    return ~F.col("reconciled").eqNullSafe(F.lit(False))


def line_in_time() -> Column:
    """Line number that rises with time, also where the file prints backwards."""
    line = F.col("line_number")
    return F.when(F.col("source_type").isin(*NEWEST_FIRST_SOURCES), -line).otherwise(line)


def _until(rows: DataFrame, as_of: dt.date | Column | None) -> DataFrame:
    if as_of is None:
        return rows
    limit = as_of if isinstance(as_of, Column) else F.lit(as_of)
    return rows.filter(F.col("as_of_date") <= limit)


def recency() -> Column:
    """What makes one ledger row later than another of its account."""
    cycle = F.coalesce(F.col("statement_period_to").cast("timestamp_ntz"), F.col("upload_timestamp").cast("timestamp_ntz"))
    return F.struct(
        F.col("as_of_date"), cycle.alias("cycle"), line_in_time().alias("line"), F.col("bronze_record_id")
    )


def current_balances(ledger: DataFrame, as_of: dt.date | Column | None = None) -> DataFrame:
    """One row per account: its latest balance that no check disproved, dated to
    the end of the statement that reported it. Stale means a later, disproven
    balance is on file. Accounts with only disproven rows are left out."""
    rows = _until(ledger, as_of).withColumns(
        {
            "_fine": not_disproven(),
            "_when": recency(),
            "_row": F.struct("balance_minor", "currency", "as_of_date", "statement_period_to", "balance_source"),
        }
    )
    latest = rows.groupBy("account_id").agg(
        F.expr("max_by(_row, _when) FILTER (WHERE _fine)").alias("row"),
        F.expr("max(as_of_date) FILTER (WHERE NOT _fine)").alias("disproven"),
    )
    as_of_date = F.greatest(F.col("row.as_of_date"), F.col("row.statement_period_to"))
    return latest.filter("row IS NOT NULL").select(
        "account_id",
        F.col("row.balance_minor").alias("balance_minor"),
        F.col("row.currency").alias("currency"),
        as_of_date.alias("as_of_date"),
        F.coalesce(F.col("disproven") > as_of_date, F.lit(False)).alias("balance_may_be_stale"),
        F.col("row.balance_source").alias("balance_source"),
    )


def wholly_disproven_accounts(ledger: DataFrame) -> DataFrame:
    """Accounts `current_balances` leaves out."""
    return ledger.groupBy("account_id").agg(F.max(not_disproven()).alias("any")).filter("NOT any").select("account_id")


def latest_holdings(holdings: DataFrame, as_of: dt.date | Column | None = None) -> DataFrame:
    """All rows of each account's newest snapshot."""
    rows = _until(holdings, as_of)
    newest = rows.groupBy("account_id").agg(F.max("as_of_date").alias("as_of_date"))
    return rows.join(newest, ["account_id", "as_of_date"])


def currency_check(balances: DataFrame, holdings: DataFrame) -> DataFrame:
    """Currencies in use, with a count and one account each."""
    both = balances.select("account_id", "currency").unionByName(holdings.select("account_id", "currency"))
    return (
        both.filter("currency IS NOT NULL")
        .groupBy("currency")
        .agg(F.count("*").alias("record_count"), F.min("account_id").alias("sample_account_id"))
    )


MIXED = "MIXED_CURRENCIES"


def one_currency(least: Column, most: Column, value: Column) -> Column:
    """`value`, or a failure of the query where two currencies were added up. It is
    part of the plan: nothing is collected, and no second pass is made."""
    said = F.concat(F.lit(f"{MIXED}: refusing to add "), least, F.lit(" and "), most, F.lit("; see currency_check()"))
    return F.when(least < most, F.raise_error(said)).otherwise(value)


def with_contribution(balances: DataFrame, accounts: DataFrame) -> DataFrame:
    """A credit balance is what is owed, so it counts against net worth."""
    types = accounts.select("account_id", "account_type")
    owed = F.col("account_type") == "credit"
    return balances.join(types, "account_id", "left").withColumn(
        "contribution_to_net_worth", F.when(owed, -F.col("balance_minor")).otherwise(F.col("balance_minor"))
    )


def _parts(balances: DataFrame, snapshot: DataFrame, accounts: DataFrame) -> DataFrame:
    return with_contribution(balances, accounts).select(
        F.col("contribution_to_net_worth").alias("v"), "currency"
    ).unionByName(snapshot.select(F.col("total_value_minor").alias("v"), "currency"))


def _worth(parts: DataFrame, check_currency: bool = True) -> DataFrame:
    summed = parts.agg(
        F.coalesce(F.sum("v"), F.lit(0)).alias("worth"), F.min("currency").alias("least"), F.max("currency").alias("most")
    )
    worth = F.col("worth")
    return summed.select(
        (one_currency(F.col("least"), F.col("most"), worth) if check_currency else worth).alias("net_worth_minor")
    )


def net_worth(
    ledger: DataFrame, holdings: DataFrame, accounts: DataFrame, as_of: dt.date | Column | None = None,
    check_currency: bool = True,
) -> DataFrame:
    """One row: balances, credit taken off, plus the latest holdings."""
    return _worth(_parts(current_balances(ledger, as_of), latest_holdings(holdings, as_of), accounts), check_currency)


def balance_states(ledger: DataFrame) -> DataFrame:
    """What each account and day adds to an as-of balance: its latest row that no check
    disproved, and what makes that row late. States of several days merge by `max_by`,
    so a balance of any date is one aggregate over the states up to it."""
    rows = ledger.select(
        "account_id", "as_of_date", recency().alias("when"), not_disproven().alias("fine"),
        F.struct("balance_minor", "currency", F.greatest("as_of_date", "statement_period_to").alias("dated")).alias("row"),
    ).filter("fine")
    return rows.groupBy("account_id", "as_of_date").agg(F.max_by("row", "when").alias("row"), F.max("when").alias("when"))


def net_worth_change(ledger: DataFrame, holdings: DataFrame, accounts: DataFrame) -> DataFrame:
    """Net worth now and its change since a month before the newest balance.

    The ledger is read once, into states by account and day; from these both dates come
    out of one aggregate, and so do both snapshots out of the holdings. The date to
    compare with is a scalar subquery over the states and does not pass the driver."""
    states = materialized(balance_states(ledger))
    held = materialized(holdings.groupBy("account_id", "as_of_date", "currency").agg(F.sum("total_value_minor").alias("total_value_minor")))
    newest = states.groupBy("account_id").agg(F.max_by("row", "when").alias("row")).agg(F.max("row.dated").alias("d"))
    month_before = F.add_months(newest.scalar(), -1)

    balances = (
        states.withColumn("before", F.col("as_of_date") <= month_before).groupBy("account_id")
        .agg(F.max_by("row", "when").alias("now"), F.expr("max_by(row, when) FILTER (WHERE before)").alias("then"))
        .join(accounts.select("account_id", "account_type"), "account_id", "left")
    )
    sign = F.when(F.col("account_type") == "credit", F.lit(-1)).otherwise(F.lit(1))
    from_ledger = [
        balances.filter(F.col(at).isNotNull()).select(F.lit(at).alias("at"), (sign * F.col(f"{at}.balance_minor")).alias("v"), f"{at}.currency")
        for at in ("now", "then")
    ]
    limited = held.withColumn("before", F.col("as_of_date") <= month_before)
    dates = limited.groupBy("account_id").agg(F.max("as_of_date").alias("now"), F.expr("max(as_of_date) FILTER (WHERE before)").alias("then"))
    met = held.join(dates, "account_id").filter("as_of_date = now OR as_of_date = then")
    at = F.filter(F.array(F.when(F.col("as_of_date") == F.col("now"), F.lit("now")), F.when(F.col("as_of_date") == F.col("then"), F.lit("then"))), lambda x: x.isNotNull())
    from_holdings = met.select(F.explode(at).alias("at"), F.col("total_value_minor").alias("v"), "currency")

    parts = from_ledger[0].unionByName(from_ledger[1]).unionByName(from_holdings)
    whole = parts.groupBy().agg(
        *[
            F.expr(f"{f}({c}) FILTER (WHERE at = '{a}')").alias(f"{a}_{f}")
            for a in ("now", "then") for f, c in (("sum", "v"), ("min", "currency"), ("max", "currency"))
        ]
    )
    now, then = (
        one_currency(F.col(f"{a}_min"), F.col(f"{a}_max"), F.coalesce(F.col(f"{a}_sum"), F.lit(0).cast("long"))) for a in ("now", "then")
    )
    return whole.select(now.alias("net_worth_minor"), F.when(month_before.isNotNull(), now - then).alias("delta_minor"))


def net_worth_breakdown(
    ledger: DataFrame, holdings: DataFrame, accounts: DataFrame, check_currency: bool = True
) -> DataFrame:
    """A row per account balance and per holding, newest and largest first."""
    balances, snapshot = current_balances(ledger), latest_holdings(holdings)
    from_ledger = with_contribution(balances, accounts).select(
        "currency", "account_id", F.col("account_id").alias("source"), F.col("balance_minor").alias("balance_or_value"),
        "as_of_date", "contribution_to_net_worth", "balance_may_be_stale",
    )
    from_holdings = snapshot.select(
        "currency", "account_id", F.col("fund_name").alias("source"), F.col("total_value_minor").alias("balance_or_value"),
        "as_of_date", F.col("total_value_minor").alias("contribution_to_net_worth"),
        F.lit(False).alias("balance_may_be_stale"),
    )
    lines = from_ledger.unionByName(from_holdings)
    if check_currency:
        lines = materialized(lines)
        used = lines.agg(F.min("currency").alias("least"), F.max("currency").alias("most"))
        lines = lines.filter(used.select(one_currency(F.col("least"), F.col("most"), F.lit(True))).scalar())
    return lines.drop("currency").orderBy(
        F.desc_nulls_last("as_of_date"), F.desc_nulls_last("contribution_to_net_worth"), "account_id", "source"
    )


def breakdown_with_names(breakdown: DataFrame, accounts: DataFrame) -> DataFrame:
    named = accounts.select("account_id", "display_name", "account_type")
    return breakdown.join(named, "account_id", "left")


def wrapper_label(name: Column | str) -> Column:
    lowered = F.lower(F.col(name) if isinstance(name, str) else name)
    return (
        F.when(lowered.contains("isa"), "Stocks & Shares ISA")
        .when(lowered.contains("pension"), "Pension")
        .otherwise("Holdings")
    )


def account_breakdown(breakdown: DataFrame, accounts: DataFrame) -> DataFrame:
    """The breakdown as a report: funds of one wrapper are one line, cash and
    ledger balances keep theirs."""
    named = breakdown_with_names(breakdown, accounts).withColumn(
        "display_name", F.coalesce("display_name", "account_id")
    )
    is_ledger, is_cash = F.col("source") == F.col("account_id"), F.col("source") == "Cash account"
    columns = ["account_id", "display_name", "detail", "balance_or_value", "contribution_to_net_worth", "as_of_date"]
    capital = F.concat(F.upper(F.substring("account_type", 1, 1)), F.lower(F.expr("substring(account_type, 2)")))
    singles = named.filter(is_ledger | is_cash).withColumn(
        "detail", F.when(is_ledger, capital).otherwise("Cash account")
    )
    funds = (
        named.filter(~is_ledger & ~is_cash)
        .withColumn("detail", wrapper_label("display_name"))
        .groupBy("account_id", "display_name", "detail")
        .agg(
            F.sum("balance_or_value").alias("balance_or_value"),
            F.sum("contribution_to_net_worth").alias("contribution_to_net_worth"),
            F.max("as_of_date").alias("as_of_date"),
        )
    )
    return (
        singles.select(*columns).unionByName(funds.select(*columns))
        .withColumns(
            {
                "balance_text": format_minor("balance_or_value"),
                "contribution_text": format_minor("contribution_to_net_worth"),
            }
        )
        .orderBy(F.desc_nulls_last("as_of_date"), F.desc_nulls_last("contribution_to_net_worth"))
    )


def total_contribution(breakdown: DataFrame) -> DataFrame:
    return breakdown.agg(F.coalesce(F.sum("contribution_to_net_worth"), F.lit(0)).alias("total_minor"))
