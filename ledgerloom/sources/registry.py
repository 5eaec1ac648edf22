"""The account registry as it is kept: a JSON file of two maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.accounts import FALLBACK, IDENTIFIER

ENTRY = "struct<account_id:string,display_name:string,account_type:string>"


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Registry rows of `{"identifiers": {...}, "source_type_fallback": {...}}`."""
    schema = f"identifiers map<string,{ENTRY}>, source_type_fallback map<string,{ENTRY}>"
    stored = spark.read.schema(schema).option("multiLine", "true").json(path)

    def rows(kind: str, column: str) -> DataFrame:
        return stored.select(F.explode(column).alias("key", "entry")).select(F.lit(kind).alias("kind"), "key", "entry.*")

    return rows(IDENTIFIER, "identifiers").unionByName(rows(FALLBACK, "source_type_fallback"))


def entry(spark: SparkSession, kind: str, key: str, account_id: str, display_name: str, account_type: str) -> DataFrame:
    return spark.createDataFrame(
        [(kind, key, account_id, display_name, account_type)],
        "kind string, key string, account_id string, display_name string, account_type string",
    )
