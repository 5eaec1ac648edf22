"""CSV exports in two header variants, any mix of files in one folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import schemas
from ledgerloom.functions import keys as K
from ledgerloom.functions.money import try_parse_money
from ledgerloom.session import materialized
from ledgerloom.sources.csv_records import cells, csv_records

# The two header rows.
FULL_HEADER = (
    "Transaction ID", "Date", "Time", "Type", "Name", "Emoji", "Category", "Amount", "Currency",
    "Local Amount", "Local Currency", "Notes", "Receipt", "Description",
)
SEARCH_HEADER = ("id", "created", "title", "subtitle", "amount", "currency", "categories")
LEAST_CONFIDENCE = 0.8
COMPARED = 5


def header_confidence(header: Column) -> Column:
    """Share of the first five names of a variant that are there; best variant."""
    scores = [
        F.size(F.array_intersect(F.array(*[F.lit(n) for n in names[:COMPARED]]), header)) / F.lit(COMPARED)
        for names in (FULL_HEADER, SEARCH_HEADER)
    ]
    return F.greatest(*scores)


def _headers(records: DataFrame) -> DataFrame:
    """path and names of the files whose first record is a header that is known."""
    firsts = materialized(records.filter("number = 1").select("path", "text"))
    # No header has more names than commas and one; there is one header a file.
    commas = F.length("text") - F.length(F.replace("text", F.lit(","), F.lit("")))
    widest = max(COMPARED, (firsts.agg(F.max(commas)).first()[0] or 0) + 1)
    names = F.transform(
        F.filter(cells(F.col("text"), widest), lambda h: h.isNotNull()), lambda h: F.trim(F.regexp_replace(h, "\ufeff", ""))
    )
    named = firsts.select("path", names.alias("names"))
    return named.filter(header_confidence(F.col("names")) >= LEAST_CONFIDENCE)


def read_exports(spark: SparkSession, folder: str, glob: str = "*.csv") -> DataFrame:
    """Bronze rows of every recognised export below a folder. Blank rows are
    skipped but counted; the header is line 1. A large file is read by many tasks."""
    records = materialized(csv_records(spark, folder, glob))
    headers = materialized(_headers(records))
    widest = headers.agg(F.max(F.size("names"))).first()[0] or COMPARED
    rows = records.filter("number > 1").join(headers, "path").select(
        "path", "upload_timestamp", F.col("number").cast("int").alias("line_number"), "names",
        cells(F.col("text"), widest).alias("cells"),
    )
    rows = rows.filter(F.exists("cells", lambda c: F.coalesce(c, F.lit("")) != ""))
    filled = F.transform(F.slice("cells", F.lit(1), F.size("names")), lambda c: F.coalesce(c, F.lit("")))
    rows = rows.withColumn("raw_data", F.map_from_arrays("names", filled))

    digests = (
        spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
        .select("path", F.sha2("content", 256).alias("ingestion_id"))
    )
    # Copies of a file are one ingestion, known by its first path.
    known = digests.groupBy("ingestion_id").agg(F.min("path").alias("path"))
    rows = rows.join(known, "path")

    def raw(key: str) -> Column:
        return F.try_element_at("raw_data", F.lit(key))

    printed = F.coalesce(F.nullif(raw("Amount"), F.lit("")), F.nullif(raw("amount"), F.lit("")))
    identity = F.nullif(F.trim(F.coalesce(raw("id"), raw("Transaction ID"))), F.lit(""))
    rows = rows.withColumns({"_printed": printed, "_minor": try_parse_money(printed), "_id": identity})
    amounts = F.create_map(
        F.lit("amount_minor"), F.col("_minor").cast("string"), F.lit("amount_text"), F.col("_printed")
    )
    made = rows.withColumns(
        {
            "raw_data": F.when(F.col("_minor").isNotNull(), F.map_concat("raw_data", amounts)).otherwise(F.col("raw_data")),
            "source_type": F.lit("monzo"),
            "parser_version": F.lit("2"),
            "record_type": F.lit("transaction"),
            "filename": F.element_at(F.split("path", "/"), -1),
            "raw_artifact_path": F.col("path"),
            "file_hash": F.col("ingestion_id"),
            "source_ordinal": F.col("line_number"),
            "bronze_record_id": K.bronze_record_id("ingestion_id", F.lit("transaction"), "line_number"),
            "bronze_source_key": F.coalesce(
                F.concat(F.lit("monzo_txn_"), "_id"), F.concat(F.lit("monzo_unknown_"), F.col("line_number").cast("string"))
            ),
        }
    )
    return schemas.conform(made, schemas.BRONZE)
