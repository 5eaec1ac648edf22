"""Schemas of the stored tables; an empty table is written with its schema too."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


BRONZE = (
    "source_type string, filename string, ingestion_id string, parser_version string, raw_artifact_path string, "
    "file_hash string, account_identifier string, record_type string, raw_data map<string,string>, line_number int, "
    "source_ordinal int, bronze_record_id string, bronze_source_key string, upload_timestamp timestamp_ntz, "
    "statement_period_from date, statement_period_to date, reconciliation_check string, "
    "reconciliation_expected_opening_minor bigint, reconciliation_expected_closing_minor bigint, "
    "reconciliation_derived_closing_minor bigint, reconciliation_matches boolean"
)

MANIFEST = (
    "ingestion_id string, original_filename string, raw_artifact_path string, status string, source_type string, "
    "parser_version string, record_count bigint, error string, reconciliation_matches boolean, "
    "reconciliations array<struct<check_name:string,expected_closing_minor:bigint,derived_closing_minor:bigint,"
    "matches:boolean,account_identifier:string>>, promotion_override struct<decision:string,reason:string,at:string>, "
    "updated_at timestamp_ntz"
)

REGISTRY = ("kind string, key string, account_id string, display_name string, account_type string")

BUILDS = (
    "build_id string, built_at timestamp_ntz, input_ingestion_ids bigint, row_counts map<string,bigint>, "
    "parser_versions map<string,string>, excluded bigint"
)

SILVER: dict[str, str] = {
    "accounts": (
        "account_id string, display_name string, account_type string, account_identifiers array<string>, source_types array<string>"
    ),
    "transactions": (
        "bronze_record_id string, silver_transaction_id string, bronze_source_key string, ingestion_id string, "
        "source_type string, account_id string, transaction_date timestamp_ntz, description string, amount_minor bigint, "
        "currency string, category string, bank_transaction_id string, ingested_at timestamp_ntz, "
        "upload_timestamp timestamp_ntz, statement_period_from date, statement_period_to date, line_number int"
    ),
    "transaction_sources": (
        "silver_transaction_id string, bronze_record_id string, ingestion_id string, source_type string, match_policy string"
    ),
    "holdings": (
        "bronze_record_id string, bronze_source_key string, account_id string, isin string, fund_name string, "
        "quantity string, unit_price_minor bigint, total_value_minor bigint, currency string, as_of_date date"
    ),
    "account_ledger": (
        "bronze_record_id string, bronze_source_key string, account_id string, source_type string, balance_minor bigint, "
        "currency string, as_of_date date, upload_timestamp timestamp_ntz, statement_period_to date, line_number int, "
        "reconciled boolean, balance_source string"
    ),
    "plan_it_instalments": (
        "bronze_record_id string, bronze_source_key string, account_id string, start_date date, description string, "
        "plan_total_minor bigint, plan_lifetime_fee_minor bigint, remaining_balance_minor bigint, "
        "due_this_month_plan_minor bigint, due_this_month_fee_minor bigint, due_this_month_total_minor bigint, "
        "instalment_progress string, as_of_date date"
    ),
    "reconciliation_log": (
        "check_type string, check_name string, account_id string, source_type string, next_source_type string, "
        "ingestion_id string, next_ingestion_id string, filename string, next_filename string, "
        "expected_opening_minor bigint, expected_closing_minor bigint, derived_closing_minor bigint, matches boolean, "
        "gap_related boolean, build_id string, computed_at timestamp_ntz"
    ),
    "build_inputs": ("ingestion_id string"),
    "excluded_ingestions": ("ingestion_id string, source_type string, reason string"),
}


def parsed(schema: str) -> T.StructType:
    return T.StructType.fromDDL(schema)


def conform(df: DataFrame, schema: str) -> DataFrame:
    """The schema's columns in its order and types; a missing one is null."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in parsed(schema).fields
        ]
    )
