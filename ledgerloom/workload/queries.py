"""Every registered query: an operator over the whole test tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import dates as D
from ledgerloom.functions import keys as K
from ledgerloom.functions import money as M
from ledgerloom.operators import accounts as A
from ledgerloom.operators import balances as B
from ledgerloom.operators import coverage as C
from ledgerloom.operators import derived as V
from ledgerloom.operators import eligibility as E
from ledgerloom.operators import matching as X
from ledgerloom.operators import normalize as N
from ledgerloom.operators import overlaps as O
from ledgerloom.operators import reconcile as R
from ledgerloom.operators import running as U
from ledgerloom.operators import spending as S
from ledgerloom.registries import DerivedAnchor, MatchPolicy
from ledgerloom.sources import lake as L
from ledgerloom.sources import segments as G
from ledgerloom.sources import statements as P
from ledgerloom.session import materialized
from ledgerloom.sources.layouts import LAYOUTS
from ledgerloom.workload import statements as T
from ledgerloom.workload import views as W

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

POLICIES = (MatchPolicy(preferred="bank-statement", other="bank-export"),)
CARD_SIGNS = {"card-statement": 1, "bank-statement": 1}
AS_OF = dt.date(2024, 1, 20)
BY_NAME = {layout.source_type: layout for layout in LAYOUTS}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


# --- spending -----------------------------------------------------------------


@query
def monthly_spend(spark, folder):
    return S.monthly_spend(W.order_spending(spark, folder), 1997)


@query
def weekly_spend(spark, folder):
    return S.weekly_spend(W.order_spending(spark, folder), dt.date(1997, 5, 1))


@query
def max_weekly_spend(spark, folder):
    return S.max_weekly_spend(W.order_spending(spark, folder), 1997)


@query
def max_monthly_spend(spark, folder):
    return S.max_monthly_spend(W.order_spending(spark, folder))


@query
def available_months(spark, folder):
    return S.available_months(W.order_spending(spark, folder))


@query
def available_years(spark, folder):
    return S.available_years(W.order_spending(spark, folder)).select(F.col("year").cast("long").alias("year"))


# --- functions ----------------------------------------------------------------


@query
def money_parse(spark, folder):
    """Every way an amount is printed, and some that are none."""
    amount = F.format_number(F.col("value").cast("decimal(18,2)"), 2)
    turn = F.col("event_id") % 9
    text = (
        F.when(turn == 0, F.concat(F.lit("£"), amount)).when(turn == 1, F.concat(F.lit("-£"), amount))
        .when(turn == 2, F.concat(amount, F.lit("CR"))).when(turn == 3, F.lit("-"))
        .when(turn == 4, F.col("value").cast("decimal(18,2)").cast("bigint").cast("string"))
        .when(turn == 5, F.concat(F.lit("+"), amount, F.lit("9")))
        .when(turn == 6, F.concat(F.lit("paid "), amount, F.lit(" today")))
        .when(turn == 7, F.concat(F.lit("1 "), amount)).otherwise(F.concat(F.lit("  "), amount, F.lit("  ")))
    )
    return W.table(spark, folder, "events").select("event_id", M.try_parse_money(text).alias("amount_minor"))


@query
def money_format(spark, folder):
    minor = W.cents("o_totalprice") - 20_000_000
    return W.table(spark, folder, "orders").select(
        "o_orderkey", M.format_minor(minor).alias("plain"), M.format_signed_minor(minor).alias("signed"),
        M.format_minor(minor, "USD").alias("dollars"), M.format_minor(minor, "JPY").alias("yen"),
    )


@query
def description_normalize(spark, folder):
    return W.table(spark, folder, "conversations").select(
        "conv_id", "turn", K.normalize_description(F.concat(F.lit("£5 we'll don't "), "text")).alias("normalized")
    )


@query
def fingerprints(spark, folder):
    return W.events(spark, folder).select(
        "event_id",
        K.fingerprint("account_id", "transaction_date", "amount_minor", "description").alias("content"),
        K.loose_fingerprint("account_id", "amount_minor", "description").alias("loose"),
    )


@query
def source_keys(spark, folder):
    printed = F.date_format("transaction_date", "dd/MM/yyyy")
    return W.events(spark, folder).select(
        "event_id",
        K.transaction_source_key("card_txn", printed, "description", "amount_minor", "account_id").alias("txn_key"),
        K.snapshot_source_key("holding", "description", printed, "account_id", printed).alias("snapshot_key"),
        K.bronze_record_id("account_id", F.lit("transaction"), "event_id").alias("record_id"),
    )


@query
def masked_ids(spark, folder):
    return W.table(spark, folder, "customer").select(
        "c_custkey", K.mask_identifier(F.concat(F.lit(" ab "), "c_name", F.lit(" 1"))).alias("masked"),
        K.slug("c_mktsegment").alias("slug"),
    )


@query
def year_inference(spark, folder):
    """Dates printed without a year, seen from an upload up to 40 days later."""
    day = F.col("o_orderdate").cast("date")
    uploaded = F.date_add(day, (F.col("o_orderkey") % 41).cast("int") - 9)
    return W.table(spark, folder, "orders").select(
        "o_orderkey", D.infer_year(F.date_format(day, "d MMM"), uploaded).cast("date").alias("inferred")
    )


@query
def year_in_period(spark, folder):
    day = F.col("o_orderdate").cast("date")
    start = F.date_sub(day, (F.col("o_orderkey") % 31).cast("int") - 6)
    return W.table(spark, folder, "orders").select(
        "o_orderkey", D.year_in_period(F.date_format(day, "d MMM"), start, F.date_add(start, 29)).alias("dated")
    )


# --- accounts -----------------------------------------------------------------


@query
def accounts_table(spark, folder):
    made = A.accounts_table(W.registry(spark, folder))
    return made.select(
        "account_id", "display_name", "account_type",
        F.array_join("account_identifiers", ",").alias("account_identifiers"),
        F.array_join("source_types", ",").alias("source_types"),
    )


@query
def account_resolution(spark, folder):
    resolved = A.resolve_accounts(W.bronze(spark, folder), W.registry(spark, folder))
    return resolved.select("bronze_record_id", "source_type", "account_identifier", "account_id")


@query
def unmapped_accounts(spark, folder):
    return A.unmapped_accounts(W.bronze(spark, folder), W.registry(spark, folder))


@query
def eligible_rows(spark, folder):
    kept = E.eligible_rows(W.bronze(spark, folder), E.exclusions(W.manifest(spark, folder)))
    return kept.select("bronze_record_id", "ingestion_id")


@query
def excluded_ingestions(spark, folder):
    return E.exclusions(W.manifest(spark, folder))


@query
def quarantine_list(spark, folder):
    return E.quarantined(W.manifest(spark, folder))


# --- matching -----------------------------------------------------------------


@query
def occurrence_numbers(spark, folder):
    numbered = X.number_occurrences(X.with_match_keys(W.transactions(spark, folder)))
    return numbered.select("bronze_record_id", F.col("_occurrence").alias("occurrence"), X.ID)


@query
def dup_suffix(spark, folder):
    """Repeats of a key within one file get a suffix, the first keeps its key."""
    rows = W.events(spark, folder).select(
        "event_id", F.col("account_id").alias("ingestion_id"), F.col("event_id").alias("line_number"),
        F.col("description").alias("bronze_source_key"),
    )
    return N.suffix_repeats(rows).select("event_id", "bronze_source_key")


@query
def overlap_pairs(spark, folder):
    return O.find_overlapping_ingestions(W.transactions(spark, folder))


@query
def overlap_stretches(spark, folder):
    return O.overlap_stretches(W.transactions(spark, folder))


@query
def overlap_members(spark, folder):
    return O.overlap_members(W.transactions(spark, folder))


def _marked(rows: DataFrame) -> DataFrame:
    return X.mark_duplicates(rows)


@query
def overlap_dedupe(spark, folder):
    kept = X.overlap_survivors(_marked(W.transactions(spark, folder)))
    return kept.select(X.ID, "bronze_record_id", "ingestion_id", "amount_minor")


@query
def date_drift_dedupe(spark, folder):
    return X.drift_edges(_marked(W.transactions(spark, folder)))


@query
def cross_source_dedupe(spark, folder):
    numbered = X.number_occurrences(X.with_match_keys(W.cross_transactions(spark, folder)))
    marked = X.mark_cross_source(numbered, POLICIES[0])
    return marked.filter("_cross IS NOT NULL").select(F.col(X.ID).alias("absorbed"), F.col("_cross").alias("survivor"))


@query
def match_transactions(spark, folder):
    matched = X.match_transactions(W.matched_input(spark, folder), POLICIES)
    return matched.transactions.select(
        X.ID, "bronze_record_id", "ingestion_id", "source_type", "account_id", "transaction_date", "description", "amount_minor"
    )


@query
def transaction_sources(spark, folder):
    return X.match_transactions(W.matched_input(spark, folder), POLICIES).sources


@query
def deduplicated_monthly_spend(spark, folder):
    """The flagship: spending per account and month that counts nothing twice."""
    matched = X.match_transactions(W.matched_input(spark, folder), POLICIES).transactions
    return (
        S.outgoing(matched)
        .groupBy("account_id", D.month_of("transaction_date").alias("month"))
        .agg(F.sum("spend_minor").alias("spend_minor"), F.count("*").alias("payments"))
    )


# --- balances -----------------------------------------------------------------


@query
def current_balances(spark, folder):
    return B.current_balances(W.ledger(spark, folder))


@query
def balances_as_of(spark, folder):
    return B.current_balances(W.ledger(spark, folder), AS_OF)


@query
def wholly_disproven_accounts(spark, folder):
    verdict = F.when(F.col("user_id") % 9 == 0, F.lit(False)).otherwise(F.col("reconciled"))
    return B.wholly_disproven_accounts(W.ledger(spark, folder).withColumn("reconciled", verdict))


@query
def latest_holdings(spark, folder):
    return B.latest_holdings(W.holdings(spark, folder)).select("account_id", "fund_name", "as_of_date", "total_value_minor")


@query
def net_worth(spark, folder):
    return B.net_worth(W.ledger(spark, folder), W.holdings(spark, folder), W.accounts(spark, folder))


@query
def balances_newest_first(spark, folder):
    """Half of the accounts from a source that prints its newest line first."""
    backwards = F.when(F.col("user_id") % 2 == 0, "monzo-flex").otherwise(F.col("source_type"))
    found = B.current_balances(W.ledger(spark, folder).withColumn("source_type", backwards))
    return found.select("account_id", "balance_minor", "as_of_date")


@query
def net_worth_delta(spark, folder):
    rows = W.order_spending(spark, folder)
    # One balance row per order: what it moved, as the account's newest figure.
    ledger = rows.select(
        F.col("o_orderkey").cast("string").alias("bronze_record_id"), "account_id", F.lit("card-statement").alias("source_type"),
        F.col("amount_minor").alias("balance_minor"), F.lit("GBP").alias("currency"),
        F.col("transaction_date").alias("as_of_date"), F.lit(None).cast("timestamp_ntz").alias("upload_timestamp"),
        F.lit(None).cast("date").alias("statement_period_to"), F.col("o_orderkey").alias("line_number"),
        F.lit(True).alias("reconciled"), F.lit("printed").alias("balance_source"),
    )
    return B.net_worth_change(ledger, W.holdings(spark, folder), W.accounts(spark, folder))


def _breakdown(spark, folder):
    return B.net_worth_breakdown(W.ledger(spark, folder), W.holdings(spark, folder), W.accounts(spark, folder))


@query
def net_worth_breakdown(spark, folder):
    return _breakdown(spark, folder)


@query
def breakdown_with_names(spark, folder):
    return B.breakdown_with_names(_breakdown(spark, folder), W.accounts(spark, folder))


@query
def account_breakdown(spark, folder):
    return B.account_breakdown(_breakdown(spark, folder), W.accounts(spark, folder))


@query
def total_contribution(spark, folder):
    return B.total_contribution(_breakdown(spark, folder))


@query
def currency_check(spark, folder):
    foreign = F.when(F.col("user_id") % 4 == 0, "EUR").when(F.col("user_id") % 4 == 1, F.lit(None)).otherwise("GBP")
    return B.currency_check(W.ledger(spark, folder).withColumn("currency", foreign), W.holdings(spark, folder))


# --- coverage -----------------------------------------------------------------


@query
def statement_periods(spark, folder):
    return C.statement_periods(W.bronze(spark, folder), W.registry(spark, folder), W.SOURCES)


@query
def coverage_gaps(spark, folder):
    bronze = W.bronze(spark, folder, gap=True)
    return C.coverage_gaps(C.statement_periods(bronze, W.registry(spark, folder), W.SOURCES))


@query
def coverage_gaps_orders(spark, folder):
    return C.coverage_gaps(W.order_periods(spark, folder))


@query
def coverage_calendar(spark, folder):
    return C.coverage_calendar(W.order_periods(spark, folder), W.accounts(spark, folder))


@query
def coverage_pivot(spark, folder):
    months = dt.date(1995, 1, 1), dt.date(2001, 12, 1)
    return C.coverage_pivot(W.order_periods(spark, folder), W.accounts(spark, folder), *months)


@query
def coverage_runs(spark, folder):
    return C.coverage_runs(W.order_periods(spark, folder))


@query
def contiguous_end(spark, folder):
    periods = W.order_periods(spark, folder)
    anchors = periods.groupBy("account_id").agg(F.date_add(F.min("period_from"), 60).alias("anchor_date"))
    return C.contiguous_end(periods, anchors, tolerance=90)


# --- reconciliation -----------------------------------------------------------


def _status(spark, folder):
    return R.reconciliation_status(W.bronze(spark, folder), W.registry(spark, folder), W.SOURCES)


def _continuity(spark, folder, status=None):
    periods = C.statement_periods(W.bronze(spark, folder), W.registry(spark, folder), W.SOURCES)
    return R.balance_continuity(_status(spark, folder) if status is None else status, periods)


def _weekly_matched(spark, folder):
    return X.match_transactions(W.transactions(spark, folder), POLICIES)


@query
def reconciliation_status(spark, folder):
    return _status(spark, folder)


@query
def balance_continuity(spark, folder):
    # Both sides are made from one read.
    bronze, registry = materialized(W.bronze(spark, folder, gap=True)), W.registry(spark, folder)
    status = R.reconciliation_status(bronze, registry, W.SOURCES)
    return R.balance_continuity(status, C.statement_periods(bronze, registry, W.SOURCES))


@query
def contribution_by_ingestion(spark, folder):
    matched = _weekly_matched(spark, folder)
    return R.contribution_by_ingestion(None, matched.transactions)


@query
def contribution_by_survivor(spark, folder):
    matched = _weekly_matched(spark, folder)
    return R.contribution_by_ingestion(matched.sources, matched.transactions, attribute="survivor")


def _rollforward(spark, folder, status=None):
    matched = _weekly_matched(spark, folder)
    contributions = R.contribution_by_ingestion(None, matched.transactions)
    return R.silver_rollforward(_status(spark, folder) if status is None else status, contributions, signs=CARD_SIGNS)


@query
def silver_rollforward(spark, folder):
    return _rollforward(spark, folder)


def _log(spark, folder):
    # One row per file, read by all three checks.
    status = materialized(_status(spark, folder))
    return R.reconciliation_log(status, _continuity(spark, folder, status), _rollforward(spark, folder, status))


@query
def reconciliation_log(spark, folder):
    return _log(spark, folder)


@query
def mismatch_listing(spark, folder):
    """What the strict gate lists, as a table."""
    return _log(spark, folder).filter(F.col("matches").eqNullSafe(F.lit(False)))


@query
def rollforward_signs(spark, folder):
    """Sources whose balance moves against their amounts, and plan adjustments."""
    status = materialized(_status(spark, folder)).withColumn(
        "source_type", F.when(F.col("source_type") == "card-statement", "amex").otherwise("chase")
    )
    contributions = materialized(W.bronze(spark, folder).groupBy("ingestion_id").agg(F.sum("amount_minor").alias("contribution_minor")))
    week = F.substring("ingestion_id", -1, 1).cast("int")
    adjustments = contributions.filter(week % 2 == 0).select("ingestion_id", (week * 100).cast("long").alias("adjustment_minor"))
    return R.silver_rollforward(status, contributions, adjustments)


@query
def reconciliation_summary(spark, folder):
    return R.reconciliation_summary(_log(spark, folder))


# --- derived balances ---------------------------------------------------------


@query
def derived_ledger(spark, folder):
    """Exports rolled on from balances that are confirmed up to 10 January only."""
    confirmed = F.when(F.col("as_of_date") <= F.lit(dt.date(2024, 1, 10)), F.col("reconciled"))
    ledger = W.ledger(spark, folder).withColumn("reconciled", confirmed)
    rows = W.weekly_transactions(spark, folder)
    periods = rows.select(
        "account_id", "source_type", F.col("statement_period_from").alias("period_from"),
        F.col("statement_period_to").alias("period_to"),
    )
    made = V.derived_ledger(rows, ledger, periods, DerivedAnchor("bank-export", "bank-export", 1))
    return made.select("bronze_record_id", "account_id", "balance_minor", "as_of_date", "balance_source", "reconciled")


# --- raw rows to common tables --------------------------------------------------


@query
def normalize_transactions(spark, folder):
    made = N.normalize_transactions(T.printed_rows(spark, folder))
    return made.select(
        "bronze_record_id", "source_type", F.col("transaction_date").cast("string").alias("transaction_date"), "description",
        "amount_minor", "currency", "category", "bank_transaction_id",
    )


@query
def normalize_ledger(spark, folder):
    made = N.normalize_ledger(T.printed_rows(spark, folder))
    return made.select("bronze_record_id", "source_type", "balance_minor", "as_of_date", "reconciled", "balance_source")


@query
def normalize_holdings(spark, folder):
    made = N.normalize_holdings(T.snapshot_rows(spark, folder))
    return made.select("bronze_record_id", "account_id", "fund_name", "quantity", "unit_price_minor", "total_value_minor", "as_of_date")


@query
def normalize_instalments(spark, folder):
    made = N.normalize_instalments(T.snapshot_rows(spark, folder))
    return made.select(
        "bronze_record_id", "account_id", "description", "start_date", "as_of_date", "instalment_progress",
        *[f"{f}_minor" for f in N.PLAN_FIELDS],
    )


@query
def instalment_adjustments(spark, folder):
    return R.instalment_adjustments(T.snapshot_rows(spark, folder))


# --- running figures ------------------------------------------------------------


@query
def running_liability_balance(spark, folder):
    rows = U.roll_on(
        W.events(spark, folder), ["account_id"], ["transaction_date", "event_id"], "amount_minor", F.lit(10_000), "balance_minor", sign=-1
    )
    return rows.select("event_id", "balance_minor")


@query
def amount_from_balance_delta(spark, folder):
    rows = U.step_from_previous(
        W.ledger(spark, folder).drop("amount_minor"), ["account_id"], ["as_of_date", "event_id"], "balance_minor", "amount_minor"
    )
    return rows.select("event_id", "amount_minor")


@query
def forward_fill_dates(spark, folder):
    """Dates printed on every third row only."""
    rows = W.events(spark, folder).withColumn(
        "printed", F.when(F.col("event_id") % 3 == 0, F.col("transaction_date"))
    )
    return U.fill_down(rows, ["account_id"], ["event_id"], "printed", "filled").select("event_id", "filled")


# --- statements -----------------------------------------------------------------


def _parsed(layout):
    def run(spark, folder):
        made = P.parse_layout(T.statement_texts(spark, folder, layout), BY_NAME[layout])
        raw = F.col("raw_data")
        return made.select(
            "ingestion_id", "line_number", "record_type", "account_identifier",
            raw["date"].alias("date"), F.coalesce(raw["description"], raw["fund_name"]).alias("description"),
            raw["amount_minor"].cast("long").alias("amount_minor"), raw["balance_minor"].cast("long").alias("balance_minor"),
            "statement_period_from", "statement_period_to", "reconciliation_check",
            F.col("reconciliation_expected_opening_minor").alias("opening_minor"),
            F.col("reconciliation_expected_closing_minor").alias("closing_minor"),
            F.col("reconciliation_derived_closing_minor").alias("derived_minor"),
            F.col("reconciliation_matches").alias("matches"),
        )

    return run


for _layout in BY_NAME:
    QUERIES[f"parse_{_layout.replace('-', '_')}"] = _parsed(_layout)


@query
def layout_detection(spark, folder):
    """Marker rules over every page and document, with ties between them."""
    texts = W.table(spark, folder, "pages").select(F.concat(F.lit("p"), "page_id").alias("id"), F.col("html").alias("text")).unionByName(
        W.table(spark, folder, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text")
    )
    return _by_markers(texts)


def _by_markers(texts: DataFrame) -> DataFrame:
    text = F.col("text")
    rules = (
        ("page", 0.99, text.contains("<html") & text.contains("</html>")),
        ("french", 0.95, text.contains(" les ") & text.contains(" que ")),
        ("german", 0.95, text.contains(" der ") & text.contains(" und ")),
        ("english", 0.93, text.contains(" the ") | text.contains(" and ")),
        ("spanish", 0.85, text.contains(" los ") | text.contains(" una ")),
    )
    candidates = F.array(
        *[
            F.struct(F.when((F.length(text) >= 50) & test, confidence).otherwise(0.0).alias("confidence"), F.lit(name).alias("layout"))
            for name, confidence, test in rules
        ]
    )
    best = texts.withColumn("best", P.best_layout(candidates))
    return best.select("id", F.col("best.layout").alias("layout"), F.col("best.status").alias("detection"))


@query
def statement_detection(spark, folder):
    """All layouts over texts of all of them, and over texts that are none."""
    printed = T.texts_by_layout(spark, folder, list(BY_NAME))
    pages = W.table(spark, folder, "pages").select(F.lit("page").alias("printed_as"), F.col("html").alias("text"))
    return P.detect_layouts(printed.unionByName(pages)).groupBy("printed_as", "layout", "detection").agg(F.count("*").alias("texts"))


@query
def wrapper_labels(spark, folder):
    """Holdings reported under wrappers whose names tell what they are."""
    suffix = F.element_at(F.array(*[F.lit(n) for n in (" ISA", " Personal Pension", " General")]), (F.col("c_custkey") % 3 + 1).cast("int"))
    customers = W.table(spark, folder, "customer")
    people = customers.select(
        F.concat(F.lit("acc_"), "c_custkey").alias("account_id"), F.concat("c_name", suffix).alias("display_name"),
        F.lit("investment").alias("account_type"),
    )
    snapshot = B.latest_holdings(W.holdings(spark, folder))
    cash = F.when(F.length("fund_name") % 4 == 0, "Cash account").otherwise(F.col("fund_name"))
    lines = snapshot.select(
        "account_id", cash.alias("source"), F.col("total_value_minor").alias("balance_or_value"), "as_of_date",
        F.col("total_value_minor").alias("contribution_to_net_worth"), F.lit(False).alias("balance_may_be_stale"),
    )
    report = B.account_breakdown(lines, people)
    return report.groupBy("account_id", "display_name", "detail").agg(
        F.sum("balance_or_value").alias("value_minor"), F.count("*").alias("lines"), F.max("as_of_date").alias("as_of_date")
    )


@query
def text_segmentation(spark, folder):
    """Every document cut into blocks, each from a line that starts with A to E."""
    cut = G.blocks(G.lines_of(F.col("text")), G.begins_with("^[A-E]"))
    return (
        W.table(spark, folder, "documents")
        .select("doc_id", F.posexplode_outer(cut).alias("block_no", "lines"))
        .filter("block_no IS NOT NULL")
        .select("doc_id", F.col("block_no").cast("long").alias("block_no"), F.size("lines").cast("long").alias("n_lines"),
                F.sha2(F.array_join("lines", "\n"), 256).alias("digest"))
    )


# --- catalogue ------------------------------------------------------------------


@query
def ingestion_list(spark, folder):
    return L.ingestion_list(W.manifest(spark, folder))


@query
def build_listing(spark, folder):
    """One build per order month, newest first."""
    month = F.trunc("o_orderdate", "month")
    builds = W.table(spark, folder, "orders").groupBy(
        F.date_format(month, "yyyyMM").alias("build_id"), month.alias("built_at")
    ).agg(F.count("*").alias("transactions"))
    return L.newest_first(builds)


@query
def manifest_summary(spark, folder):
    """Manifest rows as ingesting would write them, out of parsed statements."""
    texts = T.statement_texts(spark, folder, "kroo").withColumns({"layout": F.lit("kroo"), "detection": F.lit("matched")})
    made = L.manifest_of(texts, P.parse_layout(texts, BY_NAME["kroo"]))
    return made.select("ingestion_id", "status", "source_type", "record_count", "reconciliation_matches")
