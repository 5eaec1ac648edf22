"""From identifiers printed on statements to accounts.

A registry row is (kind, key, account_id, display_name, account_type): kind
`identifier` maps a masked identifier, kind `source_type` is what a source falls
back to. Joins are left to the planner, which sends the registry to every task
only while it is measured to be small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import listing

IDENTIFIER, FALLBACK = "identifier", "source_type"


class UnmappedAccountsError(Exception):
    def __init__(self, listing: str):
        super().__init__("accounts without a registry entry:\n" + listing)


def accounts_table(registry: DataFrame) -> DataFrame:
    """One row per account with the identifiers and sources that lead to it."""
    gathered = registry.groupBy("account_id").agg(
        # The first entry names the account, identifiers before fallbacks.
        F.min_by(F.struct("display_name", "account_type"), F.struct("kind", "key")).alias("named"),
        F.sort_array(F.collect_set(F.when(F.col("kind") == IDENTIFIER, F.col("key")))).alias("account_identifiers"),
        F.sort_array(F.collect_set(F.when(F.col("kind") == FALLBACK, F.col("key")))).alias("source_types"),
    )
    return gathered.select(
        "account_id", "named.display_name", "named.account_type", "account_identifiers", "source_types"
    )


def _lookup(registry: DataFrame, kind: str, key: str, value: str) -> DataFrame:
    return registry.filter(F.col("kind") == kind).select(F.col("key").alias(key), F.col("account_id").alias(value))


def resolve_accounts(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """Add account_id: by identifier, else by source type, else null.

    What sources fall back to has one entry per source type, of which there are as many
    as layouts, and is one map in the plan; rows move for their identifier alone, and
    only where the registry is measured to be large."""
    by_identifier = _lookup(registry, IDENTIFIER, "account_identifier", "_by_identifier")
    fallback = (
        registry.filter((F.col("kind") == FALLBACK) & F.col("key").isNotNull())
        .agg(F.map_from_entries(F.collect_set(F.struct("key", "account_id")))).scalar()
    )
    return (
        rows.join(by_identifier, "account_identifier", "left")
        .withColumn("account_id", F.coalesce("_by_identifier", F.try_element_at(fallback, F.col("source_type"))))
        .drop("_by_identifier")
    )


def sample_description():
    """What to show of a row: the first named text, else the start of it all."""
    # Payload keys in the order they are tried.
    tried = ("description", "Transaction Narrative", "fund_name", "Name", "title")
    named = [F.nullif(F.try_element_at("raw_data", F.lit(k)), F.lit("")) for k in tried]
    return F.coalesce(*named, F.substring(F.to_json("raw_data"), 1, 60))


def unmapped_accounts(bronze: DataFrame, registry: DataFrame) -> DataFrame:
    """(source, identifier) combinations nobody registered. An identifier that is
    unknown is listed even where its source has a fallback."""
    known = _lookup(registry, IDENTIFIER, "account_identifier", "_a").select("account_identifier")
    sources = _lookup(registry, FALLBACK, "source_type", "_a").select("source_type")
    rows = bronze.select(
        "source_type", "account_identifier", "ingestion_id", "line_number", sample_description().alias("sample")
    )
    # Count first: what meets the registry is one row per combination.
    grouped = rows.groupBy("source_type", "account_identifier").agg(
        F.min_by("sample", F.struct("ingestion_id", "line_number", "sample")).alias("sample_description"),
        F.count("*").alias("record_count"),
    )
    unknown = grouped.filter("account_identifier IS NOT NULL").join(known, "account_identifier", "left_anti")
    nameless = grouped.filter("account_identifier IS NULL").join(sources, "source_type", "left_anti")
    return unknown.unionByName(nameless).select(
        "source_type", "account_identifier", "sample_description", "record_count"
    )


def require_mapped(bronze: DataFrame, registry: DataFrame) -> None:
    """Fail, with every combination listed in a table, before anything is built."""
    missing = unmapped_accounts(bronze, registry)
    count, shown, path = listing(missing.orderBy("source_type", "account_identifier"))
    if count:
        lines = [
            f"  {r.source_type} {r.account_identifier}: {r.sample_description!r} ({r.record_count} records)"
            for r in shown
        ]
        raise UnmappedAccountsError("\n".join([f"{count} unmapped, all in {path}; for example", *lines]))


def upsert_registry(registry: DataFrame, entries: DataFrame) -> DataFrame:
    """New entries replace old ones of the same (kind, key)."""
    return registry.join(entries, ["kind", "key"], "left_anti").unionByName(entries)
