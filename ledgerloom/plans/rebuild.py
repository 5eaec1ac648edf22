"""The whole way: files to Bronze, Bronze to one published Silver build."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import accounts as A
from ledgerloom.operators import coverage as C
from ledgerloom.operators import derived as V
from ledgerloom.operators import eligibility as E
from ledgerloom.operators import matching as X
from ledgerloom.operators import normalize as N
from ledgerloom.operators import reconcile as R
from ledgerloom.registries import DERIVED_ANCHORS, MATCH_POLICIES, DerivedAnchor, MatchPolicy
from ledgerloom.session import materialized, released
from ledgerloom.sources.files import new_files, one_per_content
from ledgerloom.sources.lake import Lake, manifest_of, new_build_id
from ledgerloom.sources.layouts import LAYOUTS, Layout
from ledgerloom.sources.statements import detect_layouts, parse_statements


def ingest_texts(lake: Lake, texts: DataFrame, layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """Detect, parse and store texts that are new; returns their manifest rows.

    A manifest row says `archived` before Bronze is touched and `complete` after.
    An ingest that is cut off in between leaves the first, so doing it again looks
    for rows of these files in Bronze and adds none twice."""
    known = lake.manifest()
    scratch: list[str] = []
    read = materialized(new_files(texts, known), scratch)  # the one time that files are read
    fresh = materialized(detect_layouts(one_per_content(read), layouts), scratch, by="layout")
    suspects = materialized(_seen_before(fresh, known))
    lake.write_manifest(_archived(fresh))
    rows = materialized(parse_statements(fresh, layouts), scratch)
    lake.write_bronze(rows, suspects)
    manifests = materialized(manifest_of(fresh, rows))
    lake.write_manifest(manifests)
    released(lake.spark, scratch)
    return manifests


def _seen_before(files: DataFrame, manifest: DataFrame) -> DataFrame:
    return files.select("ingestion_id").join(manifest.select("ingestion_id"), "ingestion_id", "left_semi")


def _archived(files: DataFrame) -> DataFrame:
    return files.select(
        "ingestion_id", F.col("filename").alias("original_filename"), "raw_artifact_path", F.lit("archived").alias("status")
    )


def ingest_rows(lake: Lake, rows: DataFrame) -> DataFrame:
    """Store rows that need no layout, such as CSV exports."""
    known = lake.manifest()
    done = known.filter("status = 'complete'").select("ingestion_id")
    rows = materialized(rows.join(done, "ingestion_id", "left_anti"))
    files = rows.select("ingestion_id", "filename", "raw_artifact_path").distinct().withColumns(
        {"layout": F.lit(None).cast("string"), "detection": F.lit("matched")}
    )
    suspects = materialized(_seen_before(files, known))
    lake.write_manifest(_archived(files))
    lake.write_bronze(rows, suspects)
    manifests = materialized(manifest_of(files, rows))
    lake.write_manifest(manifests)
    return manifests


def rebuild(
    lake: Lake,
    strict: bool = False,
    policies: Sequence[MatchPolicy] = MATCH_POLICIES,
    anchors: Sequence[DerivedAnchor] = DERIVED_ANCHORS,
    build_id: str | None = None,
) -> str:
    """Recompute every Silver table from all of Bronze and publish them together.

    Stops before anything is written when an account is not registered and, when
    strict, when a balance does not reconcile."""
    build_id = build_id or new_build_id()
    registry = lake.registry()
    bronze = lake.bronze()
    A.require_mapped(bronze, registry)

    excluded = materialized(E.exclusions(lake.manifest()))
    resolved = materialized(A.resolve_accounts(bronze, registry))
    eligible = E.eligible_rows(resolved, excluded)

    matched = X.match_transactions(N.normalize_transactions(eligible), policies)
    transactions = materialized(matched.transactions)
    sources = materialized(matched.sources)
    printed = N.normalize_ledger(eligible)

    periods = materialized(C.statement_periods(bronze, registry))
    # What the dependents' statements cover; rows without an identifier say nothing.
    named_periods = C.statement_periods(bronze.filter("account_identifier IS NOT NULL"), registry)
    ledger = printed
    for pair in anchors:
        ledger = ledger.unionByName(V.derived_ledger(transactions, printed, named_periods, pair).select(*printed.columns))

    status = materialized(R.reconciliation_status(bronze, registry))
    contributions = R.contribution_by_ingestion(sources, transactions)
    rollforward = R.silver_rollforward(status, contributions, R.instalment_adjustments(eligible))
    log = materialized(R.reconciliation_log(status, R.balance_continuity(status, periods), rollforward))
    if strict:
        R.require_reconciled(log)

    now = F.current_timestamp().cast("timestamp_ntz")
    tables = {
        "accounts": A.accounts_table(registry),
        "transactions": transactions.withColumn("ingested_at", now),
        "transaction_sources": sources,
        "holdings": N.normalize_holdings(eligible),
        "account_ledger": ledger,
        "plan_it_instalments": N.normalize_instalments(eligible),
        "reconciliation_log": log.withColumns({"build_id": F.lit(build_id), "computed_at": now}),
        "build_inputs": eligible.select("ingestion_id").distinct(),
        "excluded_ingestions": excluded,
    }
    lake.publish(tables, build_facts(eligible, excluded), build_id)
    return build_id


def build_facts(eligible: DataFrame, excluded: DataFrame) -> DataFrame:
    """One row on what a build was made from: how many ingestions, which parser
    per source, how many were kept out. The ids are tables of the build."""
    parsers = eligible.groupBy("source_type").agg(F.min("parser_version").alias("version"))
    versions = parsers.filter("version IS NOT NULL").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("source_type", "version")))).alias("parser_versions")
    )
    inputs = eligible.agg(F.count_distinct("ingestion_id").alias("input_ingestion_ids"))
    left_out = excluded.agg(F.count("*").alias("excluded"))
    return versions.select(
        "parser_versions", inputs.scalar().alias("input_ingestion_ids"), left_out.scalar().alias("excluded")
    )
