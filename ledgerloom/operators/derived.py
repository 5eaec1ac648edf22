"""Balances for a source that prints none, rolled on from one that does."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.balances import recency
from ledgerloom.operators.coverage import contiguous_end
from ledgerloom.operators.ordered import running_sum, scan
from ledgerloom.registries import DerivedAnchor

LEDGER_COLUMNS = (
    "bronze_record_id", "bronze_source_key", "account_id", "source_type", "balance_minor", "currency", "as_of_date",
    "upload_timestamp", "statement_period_to", "line_number", "reconciled", "balance_source",
)


def latest_anchors(ledger: DataFrame, source_type: str) -> DataFrame:
    """Each account's latest confirmed balance of one source."""
    confirmed = ledger.filter((F.col("source_type") == source_type) & F.col("reconciled").eqNullSafe(F.lit(True)))
    return (
        confirmed.withColumn("_when", recency())
        .groupBy("account_id")
        .agg(F.max_by(F.struct("as_of_date", "balance_minor"), "_when").alias("a"))
        .select("account_id", F.col("a.as_of_date").alias("anchor_date"), F.col("a.balance_minor").alias("anchor_minor"))
    )


def derived_ledger(
    transactions: DataFrame, ledger: DataFrame, periods: DataFrame, pair: DerivedAnchor
) -> DataFrame:
    """Ledger rows for the dependent source: the anchor balance plus the signed
    amounts dated after it, up to the first gap in the dependent's statements."""
    anchors = latest_anchors(ledger, pair.anchor)
    dependent = transactions.filter(F.col("source_type") == pair.dependent)
    ends = contiguous_end(periods.filter(F.col("source_type") == pair.dependent), anchors)
    moved = (
        dependent.join(anchors, "account_id")
        .join(ends, "account_id", "left")
        .filter(F.col("transaction_date") > F.col("anchor_date"))
        .filter(F.col("contiguous_to").isNull() | (F.col("transaction_date") <= F.col("contiguous_to")))
        .withColumn("_move", F.col("amount_minor") * pair.sign)
    )
    rolled = scan(
        moved, ["account_id"], ["transaction_date", "line_number", "bronze_record_id"], {"_moved": running_sum("_move")},
        sized_by=transactions,
    )
    return rolled.select(
        F.concat(F.lit("derived_"), "bronze_record_id").alias("bronze_record_id"),
        F.concat(F.lit("derived_"), "bronze_source_key").alias("bronze_source_key"),
        "account_id", "source_type",
        (F.col("anchor_minor") + F.col("_moved")).alias("balance_minor"),
        F.coalesce("currency", F.lit("GBP")).alias("currency"),
        F.col("transaction_date").cast("date").alias("as_of_date"),
        "upload_timestamp", "statement_period_to",
        F.coalesce("line_number", F.lit(0)).alias("line_number"),
        F.lit(None).cast("boolean").alias("reconciled"),
        F.lit("derived").alias("balance_source"),
    )
