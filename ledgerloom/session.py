"""Session settings and the two facts every plan may ask of its session."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cpus: str | int = "*", app: str = "ledgerloom") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    partitions = os.cpu_count() if cpus == "*" else cpus
    return (
        builder.config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", os.environ.get("LEDGERLOOM_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


SCRATCH = "spark.ledgerloom.scratch"  # can be set on a live session, unlike spark.checkpoint.dir


def scratch_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: `spark.ledgerloom.scratch`,
    or else `spark.checkpoint.dir`. Only a local master, where all tasks see the same
    disk, may go without; a folder of its own is made for it."""
    named = spark.conf.get(SCRATCH, None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    named = named or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError(f"set spark.checkpoint.dir or {SCRATCH} to a folder that all executors share")
    if not _OWN_FOLDER:
        _OWN_FOLDER.append(tempfile.mkdtemp(prefix="spark-ledgerloom-"))
        atexit.register(shutil.rmtree, _OWN_FOLDER[0], ignore_errors=True)
    return _OWN_FOLDER[0]


_OWN_FOLDER: list[str] = []


def materialized(df: DataFrame, kept_in: list[str] | None = None, by: str | None = None) -> DataFrame:
    """Compute `df` once, as a table in the scratch folder.

    Later readers pick their columns from it, Catalyst knows its size, and a lost
    executor costs no recomputation. Used where a result is read several times.
    The path is added to `kept_in`, for `released` once the last reader is done. With
    `by`, readers that filter on that column read its rows only."""
    path = f"{scratch_folder(df.sparkSession).rstrip('/')}/ledgerloom/{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=by)
    if kept_in is not None:
        kept_in.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


EXAMPLES = 20


def listing(df: DataFrame) -> tuple[int, list, str]:
    """All rows of an error listing, written down: how many, some examples, where."""
    paths: list[str] = []
    rows = materialized(df, paths)
    count = rows.count()
    return count, rows.limit(EXAMPLES).collect() if count else [], paths[0]


def released(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch tables that nothing reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
    paths.clear()


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's own size estimate of a plan; it errs high after joins."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
