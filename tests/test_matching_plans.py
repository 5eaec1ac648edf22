"""What the matching tiers and contributions move, as the plans show it."""

from pyspark.sql import functions as F

from ledgerloom.operators import matching as X
from ledgerloom.operators import reconcile as R
from ledgerloom.workload import views as W
from ledgerloom.workload.queries import POLICIES

FOLDER = "/root/testdata/sf0.001"


def shuffles(df):
    df.sparkSession.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    finally:
        df.sparkSession.conf.unset("spark.sql.adaptive.enabled")


def test_contributions_of_records_need_no_sources(spark):
    matched = X.match_transactions(W.matched_input(spark, FOLDER), POLICIES)
    told = R.contribution_by_ingestion(None, matched.transactions)
    joined = matched.sources.select("bronze_record_id", "ingestion_id").join(
        matched.transactions.select("bronze_record_id", "amount_minor"), "bronze_record_id"
    ).groupBy("ingestion_id").agg(F.sum("amount_minor").alias("contribution_minor"))
    assert sorted(told.collect()) == sorted(joined.collect()) != []
    # Transactions that do not name their file still meet it in the sources.
    nameless = R.contribution_by_ingestion(matched.sources, matched.transactions.drop("ingestion_id"))
    assert sorted(nameless.collect()) == sorted(joined.collect())


def test_a_cross_source_policy_takes_one_shuffle(spark):
    numbered = X.materialized(X.number_occurrences(X.with_match_keys(W.cross_transactions(spark, FOLDER))))
    marked = X.mark_cross_source(numbered, POLICIES[0])
    assert shuffles(marked) == 1
    assert marked.filter("_cross IS NOT NULL").count() > 0


def test_rows_without_a_source_keep_their_provenance(spark):
    rows = W.matched_input(spark, FOLDER).withColumn("source_type", F.when(F.col("user_id") > 3, F.col("source_type")))
    matched = X.match_transactions(rows, POLICIES)
    assert matched.sources.select("bronze_record_id").distinct().count() == rows.select("bronze_record_id").distinct().count()
