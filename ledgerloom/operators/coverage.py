"""Which dates the statements of an account cover, and where they do not."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.accounts import resolve_accounts
from ledgerloom.operators.ordered import hot_keys, max_before, running_sum, scan
from ledgerloom.registries import GAP_TOLERANCE_DAYS, PERIOD_SOURCES
from ledgerloom.session import materialized

PERIOD_COLUMNS = ("account_id", "source_type", "ingestion_id", "filename", "period_from", "period_to")


def statement_periods(bronze: DataFrame, registry: DataFrame, sources: Sequence[str] = PERIOD_SOURCES) -> DataFrame:
    """One row per (file, account) with a printed period; unregistered accounts
    are skipped."""
    per_file = (
        bronze.filter(F.col("source_type").isin(*sources))
        .filter("statement_period_from IS NOT NULL AND statement_period_to IS NOT NULL")
        .groupBy("ingestion_id", "account_identifier", "source_type")
        .agg(
            F.min(F.struct("filename", "statement_period_from", "statement_period_to")).alias("file")
        )
    )
    return (
        resolve_accounts(per_file, registry)
        .filter("account_id IS NOT NULL")
        .select(
            "account_id", "source_type", "ingestion_id", "file.filename",
            F.col("file.statement_period_from").alias("period_from"),
            F.col("file.statement_period_to").alias("period_to"),
        )
    )


def coverage_gaps(periods: DataFrame, tolerance: int = GAP_TOLERANCE_DAYS) -> DataFrame:
    """Stretches longer than the tolerance that no statement of the account
    covers; overlapping statements of several sources count as one."""
    distinct = periods.filter("account_id IS NOT NULL").select("account_id", "period_from", "period_to").distinct()
    reached = scan(
        distinct, ["account_id"], ["period_from", "period_to"], {"gap_start": max_before("period_to")}, sized_by=periods
    )
    return reached.withColumn("days", F.datediff("period_from", "gap_start")).filter(F.col("days") > tolerance).select(
        "account_id", "gap_start", F.col("period_from").alias("gap_end"), F.col("days").cast("long").alias("days")
    )


def coverage_runs(periods: DataFrame) -> DataFrame:
    """account_id, status, month_from, month_to: stretches of months that statements
    cover, and the gaps between them, over each account's own range.

    Months are never listed: statements are swept in order of their first month, a run
    ends where the next statement begins more than a month beyond all before it, and
    what lies between two runs is a gap. A statement of the year 201 is one more run. An
    account whose periods all end before they begin is one row of nulls."""
    first, last = F.trunc("period_from", "month"), F.trunc("period_to", "month")
    known = periods.filter("account_id IS NOT NULL")
    # A period that ends before it begins covers nothing but widens the range.
    reaches = known.groupBy("account_id", first.alias("month_from")).agg(
        F.max(F.when(F.col("period_from") <= F.col("period_to"), last)).alias("month_to"), F.max(last).alias("named_to")
    )
    split = bool(hot_keys(known.select("account_id"), ["account_id"]))
    swept = scan(reaches, ["account_id"], ["month_from"], {"reach": max_before("month_to")}, split=split)
    begins = F.col("month_to").isNotNull() & (F.col("reach").isNull() | (F.col("month_from") > F.add_months("reach", 1)))
    told = scan(
        swept.withColumn("begins", begins.cast("int")), ["account_id"], ["month_from"], {"run": running_sum("begins")}, split=split
    )
    runs = told.groupBy("account_id", "run").agg(
        F.min(F.when(F.col("month_to").isNotNull(), F.col("month_from"))).alias("month_from"), F.max("month_to").alias("month_to"),
        F.min("month_from").alias("own_first"), F.max("named_to").alias("own_last"),
    )
    # Runs of an account lie a month apart at least, so they are fewer than its months.
    covered = F.expr("collect_list(struct(month_from, month_to)) FILTER (WHERE month_from IS NOT NULL)")
    own = runs.groupBy("account_id").agg(
        F.sort_array(covered).alias("covered"), F.min("own_first").alias("own_first"), F.max("own_last").alias("own_last")
    )
    ends = F.concat(F.array("own_first"), F.transform("covered", lambda r: F.add_months(r["month_to"], 1)))
    starts = F.concat(F.transform("covered", lambda r: F.add_months(r["month_from"], -1)), F.array("own_last"))
    between = F.filter(
        F.zip_with(ends, starts, lambda a, b: F.struct(F.lit("gap").alias("status"), a.alias("month_from"), b.alias("month_to"))),
        lambda g: g["month_from"] <= g["month_to"],
    )
    known_runs = F.transform("covered", lambda r: F.struct(F.lit("covered").alias("status"), r["month_from"], r["month_to"]))
    return own.select("account_id", F.inline_outer(F.concat(known_runs, between)))


def _within(runs: DataFrame, first: dt.date, last: dt.date) -> DataFrame:
    """Runs clipped to the months from `first` to `last`, and what an account lacks there as no_data."""
    first, last = (F.trunc(F.lit(d), "month") for d in (first, last))
    each = runs.groupBy("account_id").agg(
        F.coalesce(F.min("month_from"), F.add_months(last, 1)).alias("own_first"), F.coalesce(F.max("month_to"), last).alias("own_last"),
        F.sort_array(F.expr("collect_list(struct(month_from, month_to, status)) FILTER (WHERE status IS NOT NULL)")).alias("runs"),
    ).withColumns({"first": first, "last": last})
    none = lambda a, b: F.array(F.struct(a.alias("month_from"), b.alias("month_to"), F.lit("no_data").alias("status")))
    whole = F.concat(
        none(F.col("first"), F.add_months("own_first", -1)), "runs", none(F.add_months("own_last", 1), F.col("last"))
    )
    clipped = F.transform(
        whole,
        lambda r: F.struct(
            F.greatest(r["month_from"], F.col("first")).alias("month_from"), F.least(r["month_to"], F.col("last")).alias("month_to"),
            r["status"].alias("status"),
        ),
    )
    return each.select("account_id", F.filter(clipped, lambda r: r["month_from"] <= r["month_to"]).alias("runs"))


def _months(run: Column) -> Column:
    return F.months_between(run["month_to"], run["month_from"]).cast("int") + 1


def _named(rows: DataFrame, accounts: DataFrame) -> DataFrame:
    return rows.join(accounts.select("account_id", "display_name"), "account_id", "left").withColumn(
        "display_name", F.coalesce("display_name", "account_id")
    )


def coverage_calendar(
    periods: DataFrame, accounts: DataFrame, first: dt.date | None = None, last: dt.date | None = None
) -> DataFrame:
    """A row per account and month: covered, gap, or no_data outside the account's own
    range. Months are those from `first` to `last`, or else the whole range of all
    statements; runs are expanded to months here and nowhere before."""
    runs = coverage_runs(periods)
    if first is None or last is None:
        runs = materialized(runs)
        whole = runs.agg(F.min("month_from").alias("a"), F.max("month_to").alias("b")).first()
        first, last = first or whole["a"] or dt.date(1970, 1, 1), last or whole["b"] or dt.date(1970, 1, 1)
    months = F.flatten(
        F.transform(
            "runs",
            lambda r: F.transform(
                F.sequence(F.lit(0), _months(r) - 1),
                lambda i: F.struct(F.add_months(r["month_from"], i).alias("month"), r["status"].alias("status")),
            ),
        )
    )
    return _named(_within(runs, first, last), accounts).select("account_id", "display_name", F.inline(months))


def coverage_pivot(
    periods: DataFrame, accounts: DataFrame, first: dt.date, last: dt.date
) -> DataFrame:
    """Accounts down, the months from `first` to `last` across.

    The runs of an account tile the months asked for, so they are unrolled into one
    array and every month is a place in it."""
    months, at = [], first.replace(day=1)
    while at <= last:
        months.append(at)
        at = (at.replace(day=28) + dt.timedelta(days=4)).replace(day=1)
    cells = F.flatten(F.transform("runs", lambda r: F.array_repeat(r["status"], _months(r))))
    rows = _named(_within(coverage_runs(periods), first, last).select("account_id", cells.alias("cells")), accounts)
    return rows.select(
        "account_id", "display_name", *[F.get("cells", F.lit(i)).alias(m.strftime("%b %Y")) for i, m in enumerate(months)]
    )


def contiguous_end(periods: DataFrame, anchors: DataFrame, tolerance: int = GAP_TOLERANCE_DAYS) -> DataFrame:
    """Per account, the date up to which its periods run on from the anchor date
    without a gap. Accounts without any period are left out: nothing limits them."""
    rows = periods.select("account_id", "period_from", "period_to").distinct().join(
        anchors.select("account_id", "anchor_date"), "account_id"
    )
    reached = scan(
        rows, ["account_id"], ["period_from", "period_to"], {"before": max_before("period_to")}, sized_by=periods
    ).withColumn("reach", F.greatest("before", "anchor_date"))
    # The running maximum at the first break is where the stretch ends.
    broken = reached.withColumn(
        "breaks", F.col("period_from") > F.date_add("reach", tolerance)
    ).withColumn("place", F.struct("period_from", "period_to"))
    return (
        broken.groupBy("account_id")
        .agg(
            F.expr("min_by(reach, place) FILTER (WHERE breaks)").alias("at_break"),
            F.greatest(F.max("period_to"), F.max("anchor_date")).alias("at_end"),
        )
        .select("account_id", F.coalesce("at_break", "at_end").alias("contiguous_to"))
    )
