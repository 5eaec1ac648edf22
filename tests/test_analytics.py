"""Balances, coverage, checks and derived balances on hand-made rows."""

import datetime as dt
import random

import pytest

from ledgerloom.operators import accounts as A
from ledgerloom.operators import balances as B
from ledgerloom.operators import coverage as C
from ledgerloom.operators import derived as V
from ledgerloom.operators import eligibility as E
from ledgerloom.operators import reconcile as R
from ledgerloom.registries import DerivedAnchor

LEDGER = (
    "bronze_record_id string, bronze_source_key string, account_id string, source_type string, balance_minor bigint, "
    "currency string, as_of_date date, upload_timestamp timestamp_ntz, statement_period_to date, line_number int, "
    "reconciled boolean, balance_source string"
)
PERIODS = "account_id string, source_type string, ingestion_id string, filename string, period_from date, period_to date"


def d(month, day, year=2026):
    return dt.date(year, month, day)


def balance(n, when, minor, to=None, line=1, fine=None, source="kroo", account="a", currency="GBP"):
    return (f"r{n}", "k", account, source, minor, currency, when, dt.datetime(2026, 7, 1), to, line, fine, "printed")


def ledger(spark, *rows):
    return spark.createDataFrame(list(rows), LEDGER)


def holdings(spark, *rows):
    return spark.createDataFrame(list(rows), "account_id string, fund_name string, currency string, total_value_minor bigint, as_of_date date")


ACCOUNTS = "account_id string, display_name string, account_type string"


def test_latest_balance_ties(spark):
    later_cycle = ledger(spark, balance(1, d(1, 5), 1, to=d(1, 31), line=9), balance(2, d(1, 5), 2, to=d(2, 28)))
    (row,) = B.current_balances(later_cycle).collect()
    assert (row.balance_minor, row.as_of_date, row.balance_may_be_stale) == (2, d(2, 28), False)
    newest_first = ledger(spark, balance(1, d(1, 5), 1, line=1, source="monzo-pdf"), balance(2, d(1, 5), 2, line=2, source="monzo-pdf"))
    assert B.current_balances(newest_first).head().balance_minor == 1


def test_disproven_rows_are_passed_over(spark):
    rows = ledger(
        spark, balance(1, d(1, 5), 1, fine=True), balance(2, d(3, 5), 2, fine=False), balance(3, d(1, 1), 9, fine=False, account="b"),
    )
    (row,) = B.current_balances(rows).collect()
    assert (row.account_id, row.balance_minor, row.balance_may_be_stale) == ("a", 1, True)
    assert [r.account_id for r in B.wholly_disproven_accounts(rows).collect()] == ["b"]
    assert B.current_balances(rows, d(1, 31)).head().balance_may_be_stale is False


def test_net_worth(spark):
    rows = ledger(spark, balance(1, d(1, 5), 1000), balance(2, d(1, 5), 300, account="c"))
    held = holdings(spark, ("h", "F", "GBP", 50, d(1, 1)), ("h", "F", "GBP", 70, d(2, 1)), ("h", "G", "GBP", 5, d(2, 1)))
    people = spark.createDataFrame([("a", "A", "current"), ("c", "C", "credit"), ("h", "My ISA", "investment")], ACCOUNTS)
    assert B.net_worth(rows, held, people).head()[0] == 1000 - 300 + 75
    assert B.net_worth(rows, held, people, d(1, 4)).head()[0] == 50
    report = {(r.display_name, r.detail): r.balance_text for r in B.account_breakdown(B.net_worth_breakdown(rows, held, people), people).collect()}
    assert report == {("A", "Current"): "£10.00", ("C", "Credit"): "£3.00", ("My ISA", "Stocks & Shares ISA"): "£0.75"}


def test_net_worth_of_nothing(spark):
    people = spark.createDataFrame([], ACCOUNTS)
    assert B.net_worth(ledger(spark), holdings(spark), people).head()[0] == 0
    row = B.net_worth_change(ledger(spark), holdings(spark), people).head()
    assert (row.net_worth_minor, row.delta_minor) == (0, None)


def test_month_before_the_newest_balance(spark):
    people = spark.createDataFrame([("a", "A", "current")], ACCOUNTS)
    rows = ledger(spark, balance(1, d(2, 27), 100), balance(2, d(3, 1), 130), balance(3, d(3, 31), 200))
    row = B.net_worth_change(rows, holdings(spark), people).head()
    assert (row.net_worth_minor, row.delta_minor) == (200, 100)


def test_mixed_currencies_are_refused(spark):
    rows = ledger(spark, balance(1, d(1, 5), 1), balance(2, d(1, 5), 1, account="b", currency="EUR"), balance(3, d(1, 5), 1, account="n", currency=None))
    people = spark.createDataFrame([], ACCOUNTS)
    for refused in (
        B.net_worth(rows, holdings(spark), people), B.net_worth_change(rows, holdings(spark), people),
        B.net_worth_breakdown(rows, holdings(spark), people),
    ):
        with pytest.raises(Exception, match="refusing to add EUR and GBP"):
            refused.collect()
    assert B.net_worth(rows, holdings(spark), people, check_currency=False).head().net_worth_minor is not None


def periods(spark, *spans, account="a", source="kroo"):
    return spark.createDataFrame([(account, source, f"i{n}", f"f{n}", a, b) for n, (a, b) in enumerate(spans)], PERIODS)


def test_gaps(spark):
    found = C.coverage_gaps(periods(spark, (d(1, 1), d(1, 31)), (d(1, 10), d(1, 12)), (d(2, 3), d(2, 10)), (d(2, 14), d(2, 20)))).collect()
    assert [(r.gap_start, r.gap_end, r.days) for r in found] == [(d(2, 10), d(2, 14), 4)]


@pytest.mark.parametrize("seed", range(3))
def test_gaps_and_contiguity_against_a_walk(spark, seed):
    pick = random.Random(seed)
    spans = []
    for _ in range(25):
        start = dt.date(2026, 1, 1) + dt.timedelta(days=pick.randint(0, 200))
        spans.append((start, start + dt.timedelta(days=pick.randint(0, 9))))
    gaps, reach = [], None
    for a, b in sorted(spans):
        if reach and (a - reach).days > 3:
            gaps.append((reach, a))
        reach = b if reach is None else max(reach, b)
    rows = periods(spark, *spans)
    assert sorted((r.gap_start, r.gap_end) for r in C.coverage_gaps(rows).collect()) == gaps
    anchor = dt.date(2026, 1, 1) + dt.timedelta(days=pick.randint(0, 100))
    end = anchor
    for a, b in sorted(spans):
        if (a - end).days > 3:
            break
        end = max(end, b)
    anchors = spark.createDataFrame([("a", anchor)], "account_id string, anchor_date date")
    assert C.contiguous_end(rows, anchors).head().contiguous_to == end


def test_calendar(spark):
    rows = periods(spark, (d(1, 5), d(1, 20)), (d(4, 1), d(4, 30))).unionByName(periods(spark, (d(3, 1), d(3, 2)), account="b"))
    people = spark.createDataFrame([("a", "Main", "current")], ACCOUNTS)
    calendar = C.coverage_calendar(rows, people)
    made = {(r.display_name, r.month.month): r.status for r in calendar.collect()}
    assert [made["Main", m] for m in (1, 2, 3, 4)] == ["covered", "gap", "gap", "covered"]
    assert [made["b", m] for m in (1, 2, 3, 4)] == ["no_data", "no_data", "covered", "no_data"]
    wide = C.coverage_pivot(rows, people, d(1, 1), d(5, 1))
    assert wide.columns == ["account_id", "display_name", "Jan 2026", "Feb 2026", "Mar 2026", "Apr 2026", "May 2026"]
    assert {tuple(r[1:]) for r in wide.collect()} == {
        ("Main", "covered", "gap", "gap", "covered", "no_data"), ("b", "no_data", "no_data", "covered", "no_data", "no_data")
    }


def plain_calendar(spans, first, last):
    """Status by account and month, looking at every statement for every month."""
    months = [(y, m) for y in range(first[0], last[0] + 1) for m in range(1, 13) if first <= (y, m) <= last]
    at = lambda day: (day.year, day.month)
    found = {}
    for account in {a for a, *_ in spans}:
        own = [(f, t) for a, f, t in spans if a == account]
        begin, end = min(at(f) for f, _ in own), max(at(t) for _, t in own)
        for month in months:
            covered = any(f <= t and at(f) <= month <= at(t) for f, t in own)
            found[account, month] = "covered" if covered else "gap" if begin <= month <= end else "no_data"
    return found


@pytest.mark.parametrize("seed", range(3))
def test_runs_equal_a_plain_calendar(spark, seed):
    pick = random.Random(seed)
    spans = []
    for n in range(60):
        start = dt.date(2024, 1, 1) + dt.timedelta(days=pick.randrange(900))
        spans.append((f"acc{n % 7}", start, start + dt.timedelta(days=pick.randrange(-40, 120))))
    spans += [("back", d(5, 1), d(2, 1)), ("old", dt.date(201, 2, 3), dt.date(201, 2, 4)), ("old", d(3, 1), d(3, 2))]
    rows = spark.createDataFrame(spans, "account_id string, period_from date, period_to date")
    people = spark.createDataFrame([], ACCOUNTS)
    window = dt.date(2024, 3, 1), dt.date(2026, 6, 1)
    told = plain_calendar(spans, (2024, 3), (2026, 6))
    calendar = C.coverage_calendar(rows, people, *window)
    assert {(r.account_id, (r.month.year, r.month.month)): r.status for r in calendar.collect()} == told
    wide = C.coverage_pivot(rows, people, *window).collect()
    assert {(r[0], at): s for r in wide for at, s in zip(sorted({m for _, m in told}), r[2:], strict=True)} == told
    # Runs tile the range of their account, and an old statement is one run and one gap more.
    assert C.coverage_runs(rows).filter("account_id = 'old'").count() == 3
    whole = C.coverage_calendar(rows.filter("account_id != 'old'"), people)
    assert whole.select("month").distinct().count() * whole.select("account_id").distinct().count() == whole.count()


def test_runs_of_a_hot_account_are_the_same(splitting):
    pick = random.Random(9)
    spans = [("a", dt.date(2024, 1, 1) + dt.timedelta(days=n), dt.date(2024, 1, 1) + dt.timedelta(days=n + pick.randrange(70))) for n in range(0, 3000, 61)]
    rows = splitting.createDataFrame(spans, "account_id string, period_from date, period_to date")
    found = {(r.account_id, (r.month.year, r.month.month)): r.status for r in C.coverage_calendar(rows, splitting.createDataFrame([], ACCOUNTS)).collect()}
    assert found == plain_calendar(spans, min(k[1] for k in found), max(k[1] for k in found))


def test_continuity(spark):
    spans = periods(spark, (d(1, 1), d(1, 31)), (d(2, 1), d(2, 28)), (d(3, 1), d(3, 31)), (d(5, 1), d(5, 31)), (d(6, 1), d(6, 30)))
    figures = [(0, 100), (100, 200), (201, 300), (300, 400), (None, 500)]
    anchors = spark.createDataFrame(
        [("a", "kroo", f"i{n}", "same.pdf", "check", o, c, c, True) for n, (o, c) in enumerate(figures)],
        "account_id string, source_type string, ingestion_id string, filename string, check_name string, "
        "expected_opening_minor bigint, expected_closing_minor bigint, derived_closing_minor bigint, matches boolean",
    )
    found = R.balance_continuity(anchors, spans).orderBy("ingestion_id").collect()
    assert [(r.matches, r.gap_related) for r in found] == [(True, False), (False, False), (None, True), (None, False)]


def test_rollforward_signs_and_adjustments(spark):
    anchors = spark.createDataFrame(
        [("a", "amex", "i1", "f", "c", 100, 140, 140, True), ("a", "chase", "i2", "f", "c", 100, 70, 70, True),
         ("a", "kroo", "i3", "f", "c", 1, 1, 1, True), ("a", "chase", "i4", "f", "c", None, 1, 1, True)],
        "account_id string, source_type string, ingestion_id string, filename string, check_name string, "
        "expected_opening_minor bigint, expected_closing_minor bigint, derived_closing_minor bigint, matches boolean",
    )
    moved = spark.createDataFrame([("i1", -30), ("i2", -30)], "ingestion_id string, contribution_minor bigint")
    due = spark.createDataFrame([("i1", 10)], "ingestion_id string, adjustment_minor bigint")
    found = R.silver_rollforward(anchors, moved, due).orderBy("ingestion_id").collect()
    assert [(r.ingestion_id, r.silver_derived_closing_minor, r.matches) for r in found] == [("i1", 140, True), ("i2", 70, True)]


def test_derived_balances(spark):
    anchor = ledger(
        spark, balance(1, d(1, 31), 100, fine=True, source="stmt"), balance(2, d(2, 28), 200, fine=None, source="stmt"),
    )
    txns = spark.createDataFrame(
        [("a", "exp", f"r{n}", "k", amount, when, "GBP", None, None, n)
         for n, (when, amount) in enumerate([(d(1, 31), 5), (d(2, 2), 10), (d(2, 2), -3), (d(2, 20), 1), (d(4, 1), 7)])],
        "account_id string, source_type string, bronze_record_id string, bronze_source_key string, amount_minor bigint, "
        "transaction_date date, currency string, upload_timestamp timestamp_ntz, statement_period_to date, line_number int",
    )
    pair = DerivedAnchor("exp", "stmt", 1)
    spans = periods(spark, (d(2, 1), d(2, 28)), (d(3, 25), d(4, 5)), source="exp")
    made = V.derived_ledger(txns, anchor, spans, pair).orderBy("line_number").collect()
    assert [r.balance_minor for r in made] == [110, 107, 108]
    assert all(r.balance_source == "derived" and r.reconciled is None for r in made)
    unlimited = V.derived_ledger(txns, anchor, periods(spark, source="exp"), pair)
    assert unlimited.count() == 4


def test_eligibility(spark):
    from ledgerloom import schemas

    rows = [
        {"ingestion_id": "ok", "status": "complete", "reconciliation_matches": True},
        {"ingestion_id": "failed", "status": "parse_failed"},
        {"ingestion_id": "bad", "status": "complete", "reconciliation_matches": False},
        {"ingestion_id": "inner", "status": "complete", "reconciliations": [("c", 1, 2, False, "x"), ("c", 1, 1, True, "y")]},
        {"ingestion_id": "let", "status": "complete", "reconciliation_matches": False, "promotion_override": ("allow", "r", "t")},
        {"ingestion_id": "open", "status": "complete", "reconciliations": [("c", 1, None, None, None)]},
    ]
    schema = schemas.parsed(schemas.MANIFEST)
    manifest = spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in rows], schema)
    assert {r.ingestion_id for r in E.exclusions(manifest).collect()} == {"failed", "bad", "inner"}
    assert {(r.ingestion_id, r.check_name) for r in E.quarantined(manifest).collect()} == {("bad", None), ("inner", "c")}
    bronze = spark.createDataFrame([("ok",), ("bad",), (None,), ("unknown",)], "ingestion_id string")
    assert {r[0] for r in E.eligible_rows(bronze, E.exclusions(manifest)).collect()} == {"ok", "unknown"}


def test_account_fallbacks_differ(spark):
    registry = spark.createDataFrame(
        [("identifier", "i1", "one", "One", "current"), ("source_type", "csv", "two", "Two", "credit")],
        "kind string, key string, account_id string, display_name string, account_type string",
    )
    bronze = spark.createDataFrame(
        [("csv", "i1", "i", 1, {"title": "t"}), ("csv", "other", "i", 2, {"description": ""}), ("csv", None, "i", 3, {}), ("pdf", None, "i", 4, {"Name": "n"})],
        "source_type string, account_identifier string, ingestion_id string, line_number int, raw_data map<string,string>",
    )
    assert [r.account_id for r in A.resolve_accounts(bronze, registry).orderBy("line_number").collect()] == ["one", "two", "two", None]
    # Even where nothing may be broadcast, rows move once, for their identifier.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = A.resolve_accounts(bronze, registry)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning(account_identifier" in plan and "hashpartitioning(source_type" not in plan
    found = A.unmapped_accounts(bronze, registry).orderBy("source_type").collect()
    assert [(r.source_type, r.account_identifier, r.sample_description, r.record_count) for r in found] == [
        ("csv", "other", '{"description":""}', 1), ("pdf", None, "n", 1)]


def test_upsert(spark):
    names = "kind string, key string, account_id string, display_name string, account_type string"
    old = spark.createDataFrame([("identifier", "a", "x", "X", "current"), ("identifier", "b", "y", "Y", "current")], names)
    new = spark.createDataFrame([("identifier", "a", "z", "Z", "credit")], names)
    assert sorted(r.account_id for r in A.upsert_registry(old, new).collect()) == ["y", "z"]
