"""Statement files: read once, known by the hash of their bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# How Spark's `binaryFile` gives files.
FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"
FILE_COLUMNS = ("ingestion_id", "filename", "raw_artifact_path", "text", "upload_timestamp")


def _described(files: DataFrame, upload_timestamp: Column | None = None) -> DataFrame:
    """From (path, content, modificationTime) to the statement-text schema.

    The upload time is the file's own, so reading a file again gives the same row."""
    seen = F.col("modificationTime").cast("timestamp_ntz") if upload_timestamp is None else upload_timestamp
    return files.select(
        F.sha2("content", 256).alias("ingestion_id"),
        F.element_at(F.split("path", "/"), -1).alias("filename"),
        F.col("path").alias("raw_artifact_path"),
        F.decode("content", "UTF-8").alias("text"),
        seen.alias("upload_timestamp"),
    )


def read_texts(spark: SparkSession, folder: str, glob: str = "*.txt") -> DataFrame:
    """Statement texts below a folder, one row per file; copies are told apart later,
    from what was written down, so that a file is read and hashed once."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    return _described(files)


def stream_texts(spark: SparkSession, folder: str, glob: str = "*.txt") -> DataFrame:
    """The same files as a stream; content hashes may repeat."""
    files = (
        spark.readStream.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
        .schema(FILE_SCHEMA).load(folder)
    )
    return _described(files)


def stream_packed(spark: SparkSession, folder: str) -> DataFrame:
    """Files that arrive packed, as rows of Parquet files with the columns of `FILE_SCHEMA`.

    A file of its own is listed, logged, opened and committed for itself, which takes
    longer than reading a statement; packed, statements cost what their bytes do."""
    return _described(spark.readStream.schema(FILE_SCHEMA).parquet(folder))


def one_per_content(texts: DataFrame) -> DataFrame:
    """Files with the same bytes are one ingestion, known by its first path.

    Paths are compared before texts are moved: the text of a copy never is."""
    first = texts.groupBy("ingestion_id").agg(F.min("raw_artifact_path").alias("raw_artifact_path"))
    return texts.join(first, ["ingestion_id", "raw_artifact_path"], "left_semi")


def new_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose content has not been ingested completely before."""
    done = manifest.filter("status = 'complete'").select("ingestion_id").distinct()
    return files.join(done, "ingestion_id", "left_anti")
