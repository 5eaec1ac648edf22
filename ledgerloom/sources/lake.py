"""Where tables live: Bronze by source type, Silver by build, and their manifests.

A build is a folder of tables plus one row in `builds`; writing that row is the
commit. Readers go by the rows, never by listing folders, so a build that was
interrupted is never seen."""

from __future__ import annotations

import datetime as dt
import json
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ledgerloom import schemas
from ledgerloom.functions.keys import view_name
from ledgerloom.operators.eligibility import COMPLETE, any_mismatch, overridden
from ledgerloom.session import materialized


class StaleBuildError(Exception):
    """The current build's tables are not where its manifest row says."""


def _missing(error: AnalysisException) -> bool:
    return "PATH_NOT_FOUND" in str(error)


def _read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if not _missing(error):
            raise
        return spark.createDataFrame([], schema)


@dataclass(frozen=True)
class Lake:
    spark: SparkSession
    root: str

    def _at(self, *parts: str) -> str:
        return "/".join([self.root.rstrip("/"), *parts])

    # --- Bronze -------------------------------------------------------------

    def bronze(self, *source_types: str) -> DataFrame:
        """All rows, or those of some source types: their partitions only. Files
        may differ in columns; a column a file lacks is null."""
        rows = _read_or_empty(self.spark, self._at("bronze"), schemas.BRONZE)
        return rows.filter(F.col("source_type").isin(*source_types)) if source_types else rows

    def write_bronze(self, rows: DataFrame, suspects: DataFrame | None = None) -> DataFrame:
        """Append rows of ingestions that are not stored yet; returns these rows.
        What is stored is never rewritten.

        `suspects` are the ingestion ids that may be stored already, from an
        ingest that was cut off. As a rule there are none, and Bronze is not read."""
        fresh = schemas.conform(rows, schemas.BRONZE)
        if suspects is None or not suspects.isEmpty():
            stored = self.bronze().select("ingestion_id")
            if suspects is not None:
                stored = stored.join(suspects.select("ingestion_id"), "ingestion_id", "left_semi")
            # Written down first, since Bronze is both read and added to.
            fresh = materialized(fresh.join(stored.distinct(), "ingestion_id", "left_anti"))
        fresh.write.partitionBy("source_type").mode("append").parquet(self._at("bronze"))
        return fresh

    # --- manifests ----------------------------------------------------------

    def manifest_log(self) -> DataFrame:
        return _read_or_empty(self.spark, self._at("manifests"), schemas.MANIFEST)

    def manifest(self) -> DataFrame:
        """Latest state per ingestion."""
        log = self.manifest_log()
        row = F.struct(*[c for c in log.columns if c != "ingestion_id"])
        return log.groupBy("ingestion_id").agg(F.max_by(row, "updated_at").alias("row")).select("ingestion_id", "row.*")

    def write_manifest(self, rows: DataFrame) -> None:
        stamped = rows.withColumn("updated_at", F.current_timestamp().cast("timestamp_ntz"))
        schemas.conform(stamped, schemas.MANIFEST).write.mode("append").parquet(self._at("manifests"))

    # --- registry -----------------------------------------------------------

    def registry(self) -> DataFrame:
        log = _read_or_empty(self.spark, self._at("registry"), schemas.REGISTRY + ", updated_at timestamp_ntz")
        row = F.struct("account_id", "display_name", "account_type")
        return log.groupBy("kind", "key").agg(F.max_by(row, "updated_at").alias("row")).select("kind", "key", "row.*")

    def register(self, entries: DataFrame) -> None:
        """Add or replace registry entries; the newest of a (kind, key) counts."""
        stamped = schemas.conform(entries, schemas.REGISTRY).withColumn(
            "updated_at", F.current_timestamp().cast("timestamp_ntz")
        )
        stamped.write.mode("append").parquet(self._at("registry"))

    # --- builds -------------------------------------------------------------

    def builds(self) -> DataFrame:
        """Committed builds, newest first."""
        return newest_first(_read_or_empty(self.spark, self._at("builds"), schemas.BUILDS))

    def current_build_id(self) -> str | None:
        newest = self.builds().select("build_id").head()
        return None if newest is None else newest["build_id"]

    def publish(self, tables: dict[str, DataFrame], facts: DataFrame, build_id: str) -> dict[str, int]:
        """Write every table below the build, counting rows as they are written, then commit.

        `facts` is one row of (input_ingestion_ids, parser_versions, excluded)."""
        if not self.builds().filter(F.col("build_id") == build_id).isEmpty():
            raise FileExistsError(f"build {build_id} is already published; builds are never rewritten")
        counts: dict[str, int] = {}
        for name, rows in tables.items():
            path = self._at("silver", build_id, name)
            seen = Observation(name)
            counted = schemas.conform(rows, schemas.SILVER[name]).observe(seen, F.count(F.lit(1)).alias("rows"))
            counted.write.mode("error").parquet(path)
            counts[name] = seen.get["rows"]
        pairs: list[Column] = []
        for name, count in counts.items():
            pairs += [F.lit(name), F.lit(count).cast("long")]
        row = facts.withColumns(
            {
                "build_id": F.lit(build_id),
                "built_at": F.current_timestamp().cast("timestamp_ntz"),
                "row_counts": F.create_map(*pairs),
            }
        )
        schemas.conform(row, schemas.BUILDS).coalesce(1).write.mode("append").parquet(self._at("builds"))
        return counts

    def silver(self, name: str, build_id: str | None = None) -> DataFrame | None:
        """A table of the current build, None before the first build."""
        build_id = build_id or self.current_build_id()
        if build_id is None:
            return None
        try:
            return self.spark.read.schema(schemas.SILVER[name]).parquet(self._at("silver", build_id, name))
        except AnalysisException as error:
            if not _missing(error):
                raise
            raise StaleBuildError(
                f"build {build_id} is current but its table {name} is gone; rebuild instead of reading older data"
            ) from error

    def write_gold(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(self._at("gold", name))

    def gold(self, name: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(self._at("gold", name))
        except AnalysisException as error:
            if not _missing(error):
                raise
            return None

    # --- SQL ----------------------------------------------------------------

    def _state(self) -> str:
        """What the views depend on: this lake, its current build, its manifest."""
        log = self.manifest_log().agg(F.count(F.lit(1)), F.max("updated_at")).first()
        return json.dumps([self.root, self.current_build_id(), log[0], str(log[1])])

    def refresh_views(self) -> list[str]:
        """Register the current build's tables and each source's Bronze as views of
        this session. All views of an earlier state or of another lake are dropped
        first. What is registered is kept in the session's own settings."""
        conf, state = self.spark.conf, self._state()
        for name in json.loads(conf.get(_VIEWS, "[]")):
            self.spark.catalog.dropTempView(name)
        made: list[str] = []
        build_id = self.current_build_id()
        if build_id is not None:
            for name in schemas.SILVER:
                self.silver(name, build_id).createOrReplaceTempView(name)
                made.append(name)
        # A manifest row per file says which sources there are; Bronze is not read.
        sources = self.manifest().filter(F.col("status") == COMPLETE).select("source_type").distinct().collect()
        for source in sorted(row["source_type"] for row in sources if row["source_type"]):
            view = f"bronze_{view_name(source)}"
            self.bronze(source).createOrReplaceTempView(view)
            made.append(view)
        conf.set(_VIEWS, json.dumps(made))
        conf.set(_STATE, state)
        return made

    def query(self, sql: str, **args) -> DataFrame:
        """Spark SQL over the views, which follow the current build and new files."""
        if self.spark.conf.get(_STATE, None) != self._state():
            self.refresh_views()
        return self.spark.sql(sql, args=args or None)


_VIEWS, _STATE = "spark.ledgerloom.views", "spark.ledgerloom.views.state"


def newest_first(builds: DataFrame) -> DataFrame:
    """The build list, the current build marked. Comparing with the newest id is
    an aggregate, so no task sees all builds."""
    newest = builds.agg(F.max_by("build_id", F.struct("built_at", "build_id"))).scalar()
    return builds.withColumn("is_current", F.col("build_id") == newest).orderBy(F.desc("built_at"), F.desc("build_id"))


def ingestion_list(manifest: DataFrame) -> DataFrame:
    """The ingestion catalogue with one mark each: ok, nothing to check, mismatch,
    or a mismatch somebody allowed."""
    mark = (
        F.when(any_mismatch() & overridden(), "overridden")
        .when(any_mismatch(), "mismatch")
        .when(F.col("reconciliation_matches"), "ok")
        .otherwise("unchecked")
    )
    listed = manifest.select("ingestion_id", "source_type", "status", "record_count", mark.alias("mark"), "updated_at")
    return listed.orderBy(F.desc("updated_at"), "ingestion_id").drop("updated_at")


def new_build_id() -> str:
    return dt.datetime.now(dt.timezone.utc).strftime("%Y%m%d-%H%M%S-%f")[:-3]


def find_manifests(manifest: DataFrame, prefix: str) -> DataFrame:
    return manifest.filter(F.col("ingestion_id").startswith(prefix))


def with_override(manifest: DataFrame, prefix: str, decision: str = "allow", reason: str = "manual override") -> DataFrame:
    """Manifest rows of a prefix with the decision put in, to be written back."""
    at = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    return find_manifests(manifest, prefix).withColumn(
        "promotion_override", F.struct(F.lit(decision).alias("decision"), F.lit(reason).alias("reason"), at.alias("at"))
    )


def attach_file_checks(rows: DataFrame, checks: DataFrame) -> DataFrame:
    """One verdict per file onto all its rows. `checks` is keyed by ingestion_id."""
    return rows.join(_check_fields(checks, ["ingestion_id"]), "ingestion_id", "left")


def attach_account_checks(rows: DataFrame, checks: DataFrame) -> DataFrame:
    """One verdict per (file, account identifier); a null identifier meets null."""
    renamed = _check_fields(checks, ["ingestion_id", "account_identifier"]).withColumnsRenamed(
        {"ingestion_id": "_ingestion", "account_identifier": "_identifier"}
    )
    same = (F.col("ingestion_id") == F.col("_ingestion")) & F.col("account_identifier").eqNullSafe(F.col("_identifier"))
    return rows.join(renamed, same, "left").drop("_ingestion", "_identifier")


def attach_checks(rows: DataFrame, per_file: DataFrame | None = None, per_account: DataFrame | None = None) -> DataFrame:
    """Verdicts come per file or per account of a file, not both at once."""
    if per_file is not None and per_account is not None:
        raise ValueError("give verdicts per file or per account, not both")
    if per_file is not None:
        return attach_file_checks(rows, per_file)
    return rows if per_account is None else attach_account_checks(rows, per_account)


def _check_fields(checks: DataFrame, keys: list[str]) -> DataFrame:
    names = {
        "check_name": "reconciliation_check",
        "expected_opening_minor": "reconciliation_expected_opening_minor",
        "expected_closing_minor": "reconciliation_expected_closing_minor",
        "derived_closing_minor": "reconciliation_derived_closing_minor",
        "matches": "reconciliation_matches",
    }
    return checks.select(*keys, *[F.col(old).alias(new) for old, new in names.items()])


def manifest_of(files: DataFrame, rows: DataFrame) -> DataFrame:
    """Manifest rows for files that were read: complete, or why not.

    `files` is the detected texts; `rows` the Bronze rows that came out of them."""
    verdicts = F.struct(
        F.col("reconciliation_check").alias("check_name"),
        F.col("reconciliation_expected_closing_minor").alias("expected_closing_minor"),
        F.col("reconciliation_derived_closing_minor").alias("derived_closing_minor"),
        F.col("reconciliation_matches").alias("matches"),
        F.col("account_identifier"),
    )
    # One row per check first: a file has a handful of them, whatever its length.
    per_check = rows.groupBy("ingestion_id", "source_type", "parser_version", verdicts.alias("verdict")).agg(
        F.count("*").alias("records")
    )
    parsed = per_check.groupBy("ingestion_id").agg(
        F.min("source_type").alias("parsed_type"),
        F.min("parser_version").alias("parser_version"),
        F.sum("records").alias("record_count"),
        F.collect_set(F.when(F.col("verdict.check_name").isNotNull(), F.col("verdict"))).alias("reconciliations"),
    )
    joined = files.join(parsed, "ingestion_id", "left")
    done = F.col("record_count") > 0
    error = (
        F.when(done, F.lit(None))
        .when(F.col("detection") == "unrecognised", "no layout recognises this file")
        .when(F.col("detection") == "ambiguous", "more than one layout fits this file")
        .otherwise("no records were found")
    )
    matches = F.when(
        F.size("reconciliations") > 0, F.forall("reconciliations", lambda r: ~r["matches"].eqNullSafe(F.lit(False)))
    )
    return joined.select(
        "ingestion_id", F.col("filename").alias("original_filename"), "raw_artifact_path",
        F.when(done, COMPLETE).otherwise("parse_failed").alias("status"),
        F.coalesce("parsed_type", "layout").alias("source_type"),
        "parser_version", "record_count", error.cast("string").alias("error"),
        matches.alias("reconciliation_matches"), "reconciliations",
        F.lit(None).cast("struct<decision:string,reason:string,at:string>").alias("promotion_override"),
    )
