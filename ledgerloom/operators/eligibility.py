"""Which ingestions may be promoted, and why the others may not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPLETE = "complete"


def any_mismatch() -> Column:
    """A false verdict for the file or for any account in it."""
    by_account = F.exists(
        F.coalesce("reconciliations", F.array()), lambda r: r["matches"].eqNullSafe(F.lit(False))
    )
    return F.col("reconciliation_matches").eqNullSafe(F.lit(False)) | by_account


def overridden() -> Column:
    return F.col("promotion_override.decision").eqNullSafe(F.lit("allow"))


def exclusions(manifest: DataFrame) -> DataFrame:
    """Ingestions kept out, with the reason. One that has no manifest is let in."""
    incomplete = ~F.col("status").eqNullSafe(F.lit(COMPLETE))
    reason = F.when(
        incomplete, F.concat(F.lit("manifest status is "), F.coalesce("status", F.lit("unknown")), F.lit(", not complete"))
    ).when(any_mismatch() & ~overridden(), F.lit("reconciliation mismatch, no allow override"))
    return manifest.select(
        "ingestion_id", F.coalesce("source_type", F.lit("unknown")).alias("source_type"), reason.alias("reason")
    ).filter("reason IS NOT NULL")


def eligible_rows(bronze: DataFrame, excluded: DataFrame) -> DataFrame:
    """Rows of eligible ingestions; a row without an ingestion id is dropped."""
    return bronze.filter("ingestion_id IS NOT NULL").join(
        excluded.select("ingestion_id").distinct(), "ingestion_id", "left_anti"
    )


def quarantined(manifest: DataFrame) -> DataFrame:
    """Mismatching ingestions nobody overrode, with each failed check."""
    failed = F.filter(
        F.coalesce("reconciliations", F.array()), lambda r: r["matches"].eqNullSafe(F.lit(False))
    )
    return (
        manifest.filter(any_mismatch() & ~overridden())
        .withColumn("failed", F.explode_outer(failed))
        .select(
            "ingestion_id", "source_type", "failed.check_name", "failed.expected_closing_minor",
            "failed.derived_closing_minor",
        )
    )
