"""Do printed balances agree with each other and with the transactions?

Every verdict is true, false or null; null means there was nothing to compare."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.money import try_parse_money
from ledgerloom.operators.accounts import resolve_accounts
from ledgerloom.operators.ordered import previous, scan
from ledgerloom.registries import ANCHORED_SOURCES, GAP_TOLERANCE_DAYS, ROLLFORWARD_SIGN
from ledgerloom.session import listing


class ReconciliationMismatchError(Exception):
    def __init__(self, listing: str):
        super().__init__("balances that do not reconcile:\n" + listing)


def reconciliation_status(bronze: DataFrame, registry: DataFrame, sources: Sequence[str] = ANCHORED_SOURCES) -> DataFrame:
    """One row per (file, account) that carries a check; unregistered accounts
    are skipped."""
    fields = {
        "filename": "filename",
        "reconciliation_check": "check_name",
        "reconciliation_expected_opening_minor": "expected_opening_minor",
        "reconciliation_expected_closing_minor": "expected_closing_minor",
        "reconciliation_derived_closing_minor": "derived_closing_minor",
        "reconciliation_matches": "matches",
    }
    per_file = (
        bronze.filter(F.col("source_type").isin(*sources) & F.col("reconciliation_check").isNotNull())
        .groupBy("ingestion_id", "account_identifier", "source_type")
        .agg(F.min(F.struct(*[F.col(old).alias(new) for old, new in fields.items()])).alias("file"))
    )
    return (
        resolve_accounts(per_file, registry)
        .filter("account_id IS NOT NULL")
        .select("account_id", "source_type", "ingestion_id", "file.*")
    )


def balance_continuity(anchors: DataFrame, periods: DataFrame, tolerance: int = GAP_TOLERANCE_DAYS) -> DataFrame:
    """Does each file open where the account's previous file closed? One row per
    pair of neighbours. Files meet their periods on ingestion_id, not on their
    name, since two files may share one."""
    dated = anchors.join(
        periods.select("account_id", "source_type", "ingestion_id", "period_from", "period_to"),
        ["account_id", "source_type", "ingestion_id"],
    ).withColumn("this", F.struct("source_type", "ingestion_id", "filename", "expected_closing_minor", "period_to"))
    paired = scan(
        dated, ["account_id"], ["period_from", "period_to", "ingestion_id"], {"prev": previous("this")}, sized_by=anchors
    ).filter("prev IS NOT NULL")
    gap = F.datediff("period_from", "prev.period_to") > tolerance
    verdict = F.when(~gap, F.col("prev.expected_closing_minor") == F.col("expected_opening_minor"))
    return paired.select(
        "account_id",
        F.col("prev.source_type").alias("source_type"), F.col("source_type").alias("next_source_type"),
        F.col("prev.ingestion_id").alias("ingestion_id"), F.col("ingestion_id").alias("next_ingestion_id"),
        F.col("prev.filename").alias("filename"), F.col("filename").alias("next_filename"),
        F.col("prev.expected_closing_minor").alias("expected_closing_minor"),
        "expected_opening_minor",
        verdict.alias("matches"), gap.alias("gap_related"),
    )


def contribution_by_ingestion(sources: DataFrame | None, transactions: DataFrame, attribute: str = "record") -> DataFrame:
    """Net amount each file contributes to the surviving transactions.

    `record` credits the file whose own row survived. `survivor` credits every
    file that reported the transaction, also where another file's row was kept.

    A surviving row is its own source, so where transactions name their file, `record`
    is told from them alone, and neither sources nor their join are computed."""
    if attribute == "record" and "ingestion_id" in transactions.columns:
        joined = transactions
    elif attribute == "record":
        joined = sources.select("bronze_record_id", "ingestion_id").join(
            transactions.select("bronze_record_id", "amount_minor"), "bronze_record_id"
        )
    else:
        told = sources.select("silver_transaction_id", "ingestion_id").distinct()
        joined = told.join(transactions.select("silver_transaction_id", "amount_minor"), "silver_transaction_id")
    return joined.groupBy("ingestion_id").agg(F.sum("amount_minor").alias("contribution_minor"))


def instalment_adjustments(bronze: DataFrame) -> DataFrame:
    """Instalments due per file, from its plan rows; unreadable ones are skipped."""
    due = try_parse_money(F.try_element_at("raw_data", F.lit("due_this_month_plan")))
    return (
        bronze.filter("source_type = 'amex' AND record_type = 'plan_it_instalment'")
        .select("ingestion_id", due.alias("due"))
        .filter("due IS NOT NULL")
        .groupBy("ingestion_id")
        .agg(F.sum("due").alias("adjustment_minor"))
    )


def rolled_forward(opening: Column, change: Column, sign: Column) -> Column:
    return opening + sign * change


def silver_rollforward(
    anchors: DataFrame, contributions: DataFrame, adjustments: DataFrame | None = None,
    signs: dict[str, int] = ROLLFORWARD_SIGN,
) -> DataFrame:
    """Do the surviving transactions still lead from a file's opening balance to
    its closing one? Only files with an opening balance and a known sign."""
    sign = F.lit(None).cast("long")
    for source, value in signs.items():
        sign = F.when(F.col("source_type") == source, F.lit(value).cast("long")).otherwise(sign)
    rows = anchors.filter(F.col("expected_opening_minor").isNotNull() & F.col("source_type").isin(*signs)).join(
        contributions, "ingestion_id", "left"
    )
    extra = F.lit(0)
    if adjustments is not None:
        rows = rows.join(adjustments, "ingestion_id", "left")
        extra = F.coalesce("adjustment_minor", F.lit(0))
    derived = rolled_forward(F.col("expected_opening_minor"), F.coalesce("contribution_minor", F.lit(0)), sign) + extra
    return rows.select(
        "account_id", "source_type", "ingestion_id", "filename", "expected_opening_minor", "expected_closing_minor",
        derived.alias("silver_derived_closing_minor"),
        # A closing balance that was never printed is a break, not a null.
        F.coalesce(derived == F.col("expected_closing_minor"), F.lit(False)).alias("matches"),
    )


LOG_COLUMNS = (
    "check_type", "check_name", "account_id", "source_type", "next_source_type", "ingestion_id", "next_ingestion_id",
    "filename", "next_filename", "expected_opening_minor", "expected_closing_minor", "derived_closing_minor",
    "matches", "gap_related",
)


def reconciliation_log(status: DataFrame, continuity: DataFrame, rollforward: DataFrame) -> DataFrame:
    """The three kinds of check as one table, told apart by check_type."""

    def logged(rows: DataFrame, check_type: str, **given: Column) -> DataFrame:
        text, whole = F.lit(None).cast("string"), F.lit(None).cast("long")
        defaults = {
            "check_type": F.lit(check_type), "next_source_type": text, "next_ingestion_id": text, "next_filename": text,
            "derived_closing_minor": whole, "gap_related": F.lit(False), **given,
        }
        return rows.select(*[(defaults[c] if c in given or c not in rows.columns else F.col(c)).alias(c) for c in LOG_COLUMNS])

    return (
        logged(status, "bronze_self_check")
        .unionByName(logged(continuity, "continuity", check_name=F.lit("balance_continuity")))
        .unionByName(
            logged(
                rollforward, "silver_rollforward", check_name=F.lit("silver_rollforward"),
                derived_closing_minor=F.col("silver_derived_closing_minor"),
            )
        )
    )


def reconciliation_summary(log: DataFrame) -> DataFrame:
    """Checks by type and verdict; the inconclusive ones are a group of their own."""
    return log.groupBy("check_type", "matches").agg(F.count("*").alias("checks"))


def require_reconciled(log: DataFrame) -> None:
    """The strict gate: any false verdict stops the build, all of them listed in a table."""
    broken = log.filter(F.col("matches").eqNullSafe(F.lit(False)))
    count, shown, path = listing(broken.orderBy("check_type", "account_id", "ingestion_id"))
    if count:
        lines = [
            f"  [{r.check_type}] {r.account_id} {r.source_type} {r.filename}"
            + (f" -> {r.next_filename}" if r.next_filename else "")
            + f": expected {r.expected_closing_minor}, derived {r.derived_closing_minor}"
            for r in shown
        ]
        raise ReconciliationMismatchError("\n".join([f"{count} mismatches, all in {path}; for example", *lines]))
