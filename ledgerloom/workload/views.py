"""The test tables seen as statements: each view is plain Spark over whole tables.

The SQL twins live in `oracle.py`, written on their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import keys as K
from ledgerloom.operators.ordered import running_sum, scan


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def cents(column: str) -> Column:
    return F.round(F.col(column) * 100).cast("long")


def accounts(spark: SparkSession, folder: str) -> DataFrame:
    segment = F.col("c_mktsegment")
    return table(spark, folder, "customer").select(
        F.concat(F.lit("acc_"), "c_custkey").alias("account_id"),
        F.col("c_name").alias("display_name"),
        F.when(segment == "AUTOMOBILE", "credit").when(segment == "BUILDING", "investment")
        .when(segment == "FURNITURE", "savings").otherwise("current").alias("account_type"),
    )


def events(spark: SparkSession, folder: str) -> DataFrame:
    """one clean transaction per event."""
    user, day = F.col("user_id"), F.col("ts").cast("date")
    spent = F.col("event_type").isin("purchase", "error", "click")
    return table(spark, folder, "events").select(
        "event_id", "user_id",
        F.concat(F.lit("acc_"), user).alias("account_id"),
        day.alias("transaction_date"),
        F.when(spent, -cents("value")).otherwise(cents("value")).alias("amount_minor"),
        F.concat(F.upper("event_type"), F.lit(" "), F.col("event_id") % 5).alias("description"),
        F.when(user % 3 == 0, "card-statement").when(user % 3 == 1, "bank-statement")
        .otherwise("bank-export").alias("source_type"),
        F.least(F.floor((F.dayofmonth(day) - 1) / 7) + 1, F.lit(4)).cast("int").alias("wk"),
    )


def _as_transactions(rows: DataFrame) -> DataFrame:
    return rows.select(
        "account_id", "transaction_date", "amount_minor", "description", "source_type",
        K.bronze_record_id("ingestion_id", F.lit("transaction"), "event_id").alias("bronze_record_id"),
        K.transaction_source_key(
            "txn", F.col("transaction_date").cast("string"), "description", "amount_minor", "account_id"
        ).alias("bronze_source_key"),
        "ingestion_id",
        F.lit("2024-02-01 00:00:00").cast("timestamp_ntz").alias("upload_timestamp"),
        "statement_period_from", "statement_period_to",
        F.col("event_id").cast("int").alias("line_number"),
        F.lit(None).cast("string").alias("bank_transaction_id"),
        F.lit("GBP").alias("currency"),
        F.lit(None).cast("string").alias("category"),
        "user_id", "wk",
    )


def _day(n: Column | int) -> Column:
    return F.make_date(F.lit(2024), F.lit(1), F.lit(n) if isinstance(n, int) else n)


def weekly(spark: SparkSession, folder: str, gap: bool = False) -> DataFrame:
    """Weekly statements of all events; with `gap`, every seventh user lost one."""
    start = (F.col("wk") - 1) * 7 + 1
    end = F.when(F.col("wk") == 4, 31).otherwise(F.col("wk") * 7)
    lost = (F.col("user_id") % 7 == 0) & (F.col("wk") == 3)
    rows = events(spark, folder).filter(~lost) if gap else events(spark, folder)
    return rows.withColumns(
        {
            "ingestion_id": F.concat(F.col("user_id").cast("string"), F.lit("-W"), F.col("wk").cast("string")),
            "statement_period_from": _day(start),
            "statement_period_to": _day(end),
        }
    )


def weekly_transactions(spark: SparkSession, folder: str, gap: bool = False) -> DataFrame:
    return _as_transactions(weekly(spark, folder, gap))


def transactions(spark: SparkSession, folder: str) -> DataFrame:
    """weekly statements, and a second download over 10..20 January."""
    again = (
        events(spark, folder)
        .filter((F.col("user_id") % 2 == 0) & F.col("transaction_date").between("2024-01-10", "2024-01-20"))
        .withColumns(
            {
                "ingestion_id": F.concat(F.col("user_id").cast("string"), F.lit("-R")),
                "statement_period_from": _day(10),
                "statement_period_to": _day(20),
                "transaction_date": F.when(
                    F.col("event_id") % 50 == 0, F.date_add("transaction_date", 2)
                ).otherwise(F.col("transaction_date")),
            }
        )
    )
    return _as_transactions(weekly(spark, folder).unionByName(again))


def cross_transactions(spark: SparkSession, folder: str) -> DataFrame:
    """every fourth bank-statement row again in an export, worded otherwise."""
    base = events(spark, folder).withColumns(
        {
            "ingestion_id": F.concat(F.col("user_id").cast("string"), F.lit("-M")),
            "statement_period_from": F.lit(None).cast("date"),
            "statement_period_to": F.lit(None).cast("date"),
        }
    )
    export = base.filter((F.col("user_id") % 3 == 1) & (F.col("event_id") % 4 == 0)).withColumns(
        {
            "ingestion_id": F.concat(F.col("user_id").cast("string"), F.lit("-X")),
            "source_type": F.lit("bank-export"),
            "description": F.concat(F.lit("CARD "), "description"),
        }
    )
    return _as_transactions(base.unionByName(export))


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """a running balance per account over the weekly statements."""
    rows = scan(events(spark, folder), ["account_id"], ["transaction_date", "event_id"], {"balance_minor": running_sum("amount_minor")})
    mark = F.col("user_id") + F.col("wk")
    return rows.select(
        K.bronze_record_id(
            F.concat(F.col("user_id").cast("string"), F.lit("-W"), F.col("wk").cast("string")), F.lit("transaction"), "event_id"
        ).alias("bronze_record_id"),
        F.concat(F.lit("k"), F.col("event_id").cast("string")).alias("bronze_source_key"),
        "account_id", "source_type", "balance_minor", F.lit("GBP").alias("currency"),
        F.col("transaction_date").alias("as_of_date"),
        F.lit("2024-02-01 00:00:00").cast("timestamp_ntz").alias("upload_timestamp"),
        _day(F.when(F.col("wk") == 4, 31).otherwise(F.col("wk") * 7)).alias("statement_period_to"),
        F.col("event_id").cast("int").alias("line_number"),
        F.when(mark % 11 == 0, False).when(mark % 13 == 0, F.lit(None)).otherwise(F.lit(True)).alias("reconciled"),
        F.lit("printed").alias("balance_source"),
        "user_id", "wk", "event_id", "amount_minor",
    )


def holdings(spark: SparkSession, folder: str) -> DataFrame:
    """month-end holdings per supplier and part name."""
    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("fund_name"))
    return (
        table(spark, folder, "lineitem")
        .select(
            "l_partkey",
            F.concat(F.lit("acc_"), "l_suppkey").alias("account_id"),
            F.last_day(F.col("l_shipdate").cast("date")).alias("as_of_date"),
            cents("l_extendedprice").alias("value"),
        )
        .join(parts, "l_partkey")
        .groupBy("account_id", "fund_name", "as_of_date")
        .agg(F.sum("value").alias("total_value_minor"))
        .withColumn("currency", F.lit("GBP"))
    )


def identifier(key: Column) -> Column:
    return F.substring(F.sha2(F.concat(F.lit("CUST"), key.cast("string")), 256), 1, 12)


def registry(spark: SparkSession, folder: str) -> DataFrame:
    """registered identifiers (one customer in ten is missing) and one fallback."""
    known = table(spark, folder, "customer").filter("c_custkey % 10 <> 9")
    entries = known.select(
        F.lit("identifier").alias("kind"),
        identifier(F.col("c_custkey")).alias("key"),
        F.concat(F.lit("acc_"), "c_custkey").alias("account_id"),
        F.col("c_name").alias("display_name"),
        F.when(F.col("c_mktsegment") == "AUTOMOBILE", "credit").when(F.col("c_mktsegment") == "BUILDING", "investment")
        .when(F.col("c_mktsegment") == "FURNITURE", "savings").otherwise("current").alias("account_type"),
    )
    fallback = spark.sql(
        "SELECT 'source_type' AS kind, 'bank-export' AS key, 'acc_export' AS account_id, "
        "'Export account' AS display_name, 'current' AS account_type"
    )
    return entries.unionByName(fallback)


def matched_input(spark: SparkSession, folder: str) -> DataFrame:
    """F2 and the exports of F3 together, so that every tier has work."""
    exports = cross_transactions(spark, folder).filter(F.col("ingestion_id").endswith("-X"))
    return transactions(spark, folder).unionByName(exports)


def anchors(spark: SparkSession, folder: str) -> DataFrame:
    """opening and closing balance per (user, week), some of them wrong."""
    rows = ledger(spark, folder)
    wrong = F.when((F.col("user_id") + F.col("wk")) % 11 == 0, 1).otherwise(0)
    return rows.groupBy("user_id", "wk").agg(
        F.max_by("balance_minor", F.struct("as_of_date", "event_id")).alias("derived_minor"),
        F.sum("amount_minor").alias("moved"),
    ).select(
        "user_id", "wk",
        (F.col("derived_minor") - F.col("moved")).alias("opening_minor"),
        (F.col("derived_minor") + wrong).alias("closing_minor"),
        "derived_minor",
    )


def bronze(spark: SparkSession, folder: str, gap: bool = False) -> DataFrame:
    """The weekly statements as raw rows, with payload, identifiers and checks."""
    rows = weekly_transactions(spark, folder, gap)
    checked = rows.join(anchors(spark, folder), ["user_id", "wk"])
    export = F.col("source_type") == "bank-export"
    return checked.select(
        "source_type",
        F.concat(F.col("ingestion_id"), F.lit(".txt")).alias("filename"),
        "ingestion_id",
        F.when(~export, identifier(F.col("user_id"))).alias("account_identifier"),
        F.lit("transaction").alias("record_type"),
        F.create_map(
            F.lit("date"), F.date_format("transaction_date", "d MMM"),
            F.lit("description"), F.col("description"),
            F.lit("amount_minor"), F.col("amount_minor").cast("string"),
        ).alias("raw_data"),
        "line_number", "bronze_record_id", "bronze_source_key", "upload_timestamp",
        "statement_period_from", "statement_period_to",
        F.when(~export, "closing_balance").alias("reconciliation_check"),
        F.col("opening_minor").alias("reconciliation_expected_opening_minor"),
        F.col("closing_minor").alias("reconciliation_expected_closing_minor"),
        F.col("derived_minor").alias("reconciliation_derived_closing_minor"),
        (F.col("closing_minor") == F.col("derived_minor")).alias("reconciliation_matches"),
        "transaction_date", "amount_minor",
    )


SOURCES = ("card-statement", "bank-statement", "bank-export")


def order_spending(spark: SparkSession, folder: str) -> DataFrame:
    """seven years of card spending."""
    out = F.col("o_orderstatus").isin("F", "P")
    return table(spark, folder, "orders").select(
        "o_orderkey",
        F.concat(F.lit("acc_"), "o_custkey").alias("account_id"),
        F.col("o_orderdate").cast("date").alias("transaction_date"),
        F.when(out, -cents("o_totalprice")).otherwise(cents("o_totalprice")).alias("amount_minor"),
    )


def order_periods(spark: SparkSession, folder: str) -> DataFrame:
    """A statement per customer and quarter, from its first order to its last."""
    day = F.col("o_orderdate").cast("date")
    return (
        table(spark, folder, "orders")
        .select("o_custkey", day.alias("d"), F.trunc(day, "quarter").alias("q"))
        .groupBy("o_custkey", "q")
        .agg(F.min("d").alias("period_from"), F.max("d").alias("period_to"))
        .select(
            F.concat(F.lit("acc_"), "o_custkey").alias("account_id"),
            F.lit("card-statement").alias("source_type"),
            F.concat_ws("-", F.col("o_custkey").cast("string"), F.col("q").cast("string")).alias("ingestion_id"),
            "period_from", "period_to",
        )
    )


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """F8: one manifest row per weekly statement."""
    rows = weekly(spark, folder).select("user_id", "wk", "ingestion_id", "source_type").groupBy(
        "user_id", "wk", "ingestion_id", "source_type"
    ).agg(F.count("*").alias("record_count"))
    checked = rows.join(anchors(spark, folder), ["user_id", "wk"])
    verdict = F.col("closing_minor") == F.col("derived_minor")
    allow = F.col("user_id") % 5 == 0
    return checked.select(
        "ingestion_id",
        F.concat(F.col("ingestion_id"), F.lit(".txt")).alias("original_filename"),
        F.when((F.col("user_id") + F.col("wk")) % 17 == 0, "parse_failed").otherwise("complete").alias("status"),
        "source_type", "record_count",
        verdict.alias("reconciliation_matches"),
        F.array(
            F.struct(
                F.lit("closing_balance").alias("check_name"),
                F.col("closing_minor").alias("expected_closing_minor"),
                F.col("derived_minor").alias("derived_closing_minor"),
                verdict.alias("matches"),
                F.lit(None).cast("string").alias("account_identifier"),
            )
        ).alias("reconciliations"),
        F.when(allow, F.struct(F.lit("allow").alias("decision"), F.lit("manual override").alias("reason"),
                               F.lit("2024-02-01").alias("at"))).alias("promotion_override"),
        F.expr("timestamp_ntz'2024-02-01 00:00:00' + make_dt_interval(0, 0, wk)").alias("updated_at"),
    )
