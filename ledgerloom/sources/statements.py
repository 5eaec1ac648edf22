"""Statement texts to Bronze rows: find the layout, read the records, check them.

Input is a table of (ingestion_id, filename, raw_artifact_path, text,
upload_timestamp), one row per statement. The text of a document is taken as
given; getting it out of a file format is not done here."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom import schemas
from ledgerloom.functions import keys as K
from ledgerloom.functions.dates import year_in_period
from ledgerloom.operators.normalize import suffix_repeats
from ledgerloom.operators.ordered import row_number, scan
from ledgerloom.operators.running import fill_down, roll_on, step_from_previous
from ledgerloom.sources.segments import let
from ledgerloom.sources.layouts import (
    AMBIGUITY, BROUGHT_FORWARD, CONFIDENCE, LAYOUTS, MIN_TEXT, PLAN_FEE, Layout, wrapper_check_name, wrapper_totals,
)

MATCHED, UNRECOGNISED, AMBIGUOUS = "matched", "unrecognised", "ambiguous"


def best_layout(candidates: Column, least: float = 0.0, closest: float = AMBIGUITY) -> Column:
    """struct(layout, status) out of an array of struct(confidence, layout).

    The highest confidence wins; two tops closer than `closest` are ambiguous."""

    def by_confidence(a: Column, b: Column) -> Column:
        return (
            F.when(a["confidence"] > b["confidence"], -1).when(a["confidence"] < b["confidence"], 1)
            .when(a["layout"] < b["layout"], -1).when(a["layout"] > b["layout"], 1).otherwise(0)
        )

    def decide(ranked: Column) -> Column:
        first, second = F.get(ranked, 0), F.get(ranked, 1)
        tied = second.isNotNull() & (F.abs(first["confidence"] - second["confidence"]) < closest)
        status = F.when(first.isNull(), UNRECOGNISED).when(tied, AMBIGUOUS).otherwise(MATCHED)
        return F.struct(F.when(first.isNotNull() & ~F.coalesce(tied, F.lit(False)), first["layout"]).alias("layout"), status.alias("status"))

    found = F.filter(candidates, lambda c: c["confidence"] > least)
    return let(F.array_sort(found, by_confidence), decide)


def detect_layouts(documents: DataFrame, layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """Add `layout` and `detection` to every text, in one pass."""
    text = F.col("text")
    long_enough = F.coalesce(F.length(text) >= MIN_TEXT, F.lit(False))
    candidates = F.array(
        *[
            F.struct(
                F.when(long_enough & layout.matches(text), CONFIDENCE).otherwise(0.0).alias("confidence"),
                F.lit(layout.source_type).alias("layout"),
            )
            for layout in layouts
        ]
    )
    return documents.withColumn("_best", best_layout(candidates)).select(
        *documents.columns, F.col("_best.layout").alias("layout"), F.col("_best.status").alias("detection")
    )


def _minor(name: str) -> Column:
    return F.try_element_at("raw_data", F.lit(name)).try_cast("long")


def _put(**values: Column) -> Column:
    """The payload with some keys replaced."""
    names = list(values)
    pairs: list[Column] = []
    for name in names:
        pairs += [F.lit(name), values[name].cast("string")]
    kept = F.map_filter("raw_data", lambda k, v: ~k.isin(*names))
    return F.map_concat(kept, F.create_map(*pairs))


def _by_file() -> Window:
    """One file was one row of text, so its records fit in one task."""
    return Window.partitionBy("ingestion_id")


def _amounts_from_balances(rows: DataFrame) -> DataFrame:
    """Fill dates down, and take each amount as the step from the balance before.
    The first balance of a file is where it starts from, not a transaction."""
    dated_rows = rows.withColumn("_date", F.try_element_at("raw_data", F.lit("date")))
    filled = fill_down(dated_rows, ["ingestion_id"], ["_position"], "_date", "_filled", split=False)
    priced = filled.withColumn("_balance", _minor("balance_minor")).filter("_balance IS NOT NULL")
    stepped = step_from_previous(priced, ["ingestion_id"], ["_position"], "_balance", "_step", split=False)
    marked = stepped.withColumn("_final_balance", F.max_by("_balance", "_position").over(_by_file()))
    printed = F.coalesce("_filled", F.lit(""))
    dated = F.when(printed.rlike(r"\d{4}"), printed).otherwise(
        F.coalesce(year_in_period(printed, "statement_period_from", "statement_period_to"), printed)
    )
    return (
        marked.filter(F.col("_step").isNotNull() & (F.col("raw_data")["description"] != BROUGHT_FORWARD))
        .withColumn("raw_data", _put(date=dated, amount_minor=F.col("_step")))
        .drop("_date", "_filled", "_balance", "_step")
    )


def _liability_balances(rows: DataFrame) -> DataFrame:
    """Roll the opening balance on against the amounts. What instalments add
    beyond their own fee rows goes on the last transaction."""
    is_txn = F.col("record_type") == "transaction"
    rolled = roll_on(
        rows.withColumn("_moved_by", F.when(is_txn, _minor("amount_minor"))),
        ["ingestion_id"], ["_position"], "_moved_by", F.col("_opening"), "_rolled", sign=-1, split=False,
    )
    last = F.max(F.when(is_txn, F.col("_position"))).over(_by_file())
    extra = F.when(is_txn & (F.col("_position") == last), F.coalesce("_extra", F.lit(0))).otherwise(0)
    return rolled.withColumn(
        "raw_data",
        F.when(is_txn & F.col("_rolls"), _put(balance_minor=F.col("_rolled") + extra)).otherwise(F.col("raw_data")),
    ).drop("_moved_by", "_rolled")


def _derived_closing(layout: Layout) -> Column:
    """The closing balance that follows from the records, per file."""
    records = F.col("_records")
    txns = F.filter(records, lambda r: r["record_type"] == "transaction")
    if layout.derived in ("first", "last"):
        row = F.get(txns, 0) if layout.derived == "first" else F.get(txns, F.size(txns) - 1)
        return row["raw_data"]["balance_minor"].try_cast("long")
    total = F.aggregate(
        txns, F.lit(0).cast("long"), lambda acc, r: acc + F.coalesce(r["raw_data"]["amount_minor"].try_cast("long"), F.lit(0))
    )
    if layout.derived == "plus":
        return F.col("_opening") + total
    return F.col("_opening") - total + F.coalesce("_extra", F.lit(0))


def _fee_total() -> Column:
    """Instalment fees that are transactions already."""
    fees = F.filter(F.col("_records"), lambda r: r["raw_data"]["description"] == PLAN_FEE)
    return F.aggregate(
        fees, F.lit(0).cast("long"), lambda acc, r: acc - F.coalesce(r["raw_data"]["amount_minor"].try_cast("long"), F.lit(0))
    )


def parse_layout(documents: DataFrame, layout: Layout) -> DataFrame:
    """Bronze rows of texts that are all of one layout."""
    text = F.col("text")
    # Sections are a column, since both the records and the wrappers' totals come out of them.
    cut = text if layout.sections is None else F.col("_sections")
    read = documents.withColumn("_period", layout.period(text))
    if layout.sections is not None:
        read = read.withColumn("_sections", layout.sections(text))
    read = read.withColumns(
        {
            "_identifier": layout.identifier(text),
            "_opening": layout.opening(text),
            "_closing": layout.closing(text),
            "_records": layout.records(cut, F.col("_period")),
        }
    )
    wrapped = layout.source_type == "vanguard-pdf"
    read = read.withColumn("_extra", layout.adjustment(text) - _fee_total())
    # The summary box rolls balances on only where it could be read whole.
    read = read.withColumn("_rolls", F.col("_opening").isNotNull() & F.lit(layout.running == "liability"))
    if layout.derived is not None:
        read = read.withColumn("_derived", _derived_closing(layout))
    totals = wrapper_totals(cut) if wrapped else F.lit(None).cast("array<struct<wrapper:string,closing_minor:bigint>>")
    rows = read.withColumn("_totals", totals).select(
        "ingestion_id", "filename", "raw_artifact_path", "upload_timestamp",
        F.col("_period.from").alias("statement_period_from"), F.col("_period.to").alias("statement_period_to"),
        "_identifier", "_opening", "_closing", "_extra", "_rolls", "_totals",
        F.col("_derived") if layout.derived is not None else F.lit(None).cast("long").alias("_derived"),
        # A plain explode makes the optimizer test the array's size in a filter of
        # its own, for which all records would be parsed a second time.
        F.posexplode_outer("_records").alias("_position", "_record"),
    ).filter("_position IS NOT NULL").select("*", "_record.record_type", "_record.raw_data", "_record.wrapper").drop("_record")

    if layout.running == "delta":
        rows = _amounts_from_balances(rows)
        rows = scan(rows, ["ingestion_id"], ["_position"], {"_line": row_number()}, split=False).withColumns(
            {"_derived": F.col("_final_balance"), "_line": F.col("_line").cast("int")}
        )
    else:
        if layout.running == "liability":
            rows = _liability_balances(rows)
        rows = rows.withColumn("_line", F.col("_position") + 1)

    raw_identifier = F.when(F.lit(wrapped), F.concat("_identifier", F.lit("_"), "wrapper")).otherwise(F.col("_identifier"))
    rows = rows.withColumns(
        {
            "source_type": F.lit(layout.source_type),
            "parser_version": F.lit(layout.parser_version),
            "file_hash": F.col("ingestion_id"),
            "account_identifier": K.mask_identifier(raw_identifier),
            "line_number": F.col("_line"),
            "source_ordinal": F.col("_line"),
            "bronze_record_id": K.bronze_record_id("ingestion_id", "record_type", "_line"),
        }
    )
    rows = rows.withColumn("bronze_source_key", _source_key(layout))
    rows = _with_wrapper_checks(rows) if wrapped else _with_file_check(rows, layout)
    return schemas.conform(suffix_repeats(rows), schemas.BRONZE)


def _source_key(layout: Layout) -> Column:
    raw = F.col("raw_data")
    txn = K.transaction_source_key(
        layout.prefix, raw["date"], raw["description"], F.coalesce(raw["amount_minor"], F.lit("0")), F.col("account_identifier")
    )
    if not layout.snapshot_prefix:
        return txn
    label = F.coalesce(raw["fund_name"], raw["description"])
    snapshot = K.snapshot_source_key(
        layout.snapshot_prefix, label, raw["as_of_date"], F.col("account_identifier"), raw["start_date"]
    )
    return F.when(F.col("record_type") == "transaction", txn).otherwise(snapshot)


def _check_columns(name: Column, opening: Column, closing: Column, derived: Column, present: Column) -> dict[str, Column]:
    return {
        "reconciliation_check": F.when(present, name),
        "reconciliation_expected_opening_minor": F.when(present, opening),
        "reconciliation_expected_closing_minor": F.when(present, closing),
        "reconciliation_derived_closing_minor": F.when(present, derived),
        "reconciliation_matches": F.when(present, closing == derived),
    }


def _with_file_check(rows: DataFrame, layout: Layout) -> DataFrame:
    """One verdict for all rows of a file; none where an anchor is missing."""
    closing, derived = F.col("_closing"), F.col("_derived")
    present = closing.isNotNull() & derived.isNotNull()
    if layout.check_name is None:
        present = F.lit(False)
    return rows.withColumns(
        _check_columns(F.lit(layout.check_name).cast("string"), F.col("_opening"), closing, derived, present)
    )


def _with_wrapper_checks(rows: DataFrame) -> DataFrame:
    """A verdict per wrapper: its printed total against its holdings. A holding
    whose value cannot be read leaves that wrapper without a verdict."""
    per_wrapper = Window.partitionBy("ingestion_id", "wrapper")
    value = F.when(F.col("record_type") == "holding", _minor("total_value_minor"))
    held = F.count(F.when(F.col("record_type") == "holding", 1)).over(per_wrapper)
    readable = F.count(value).over(per_wrapper)
    total = F.when((held > 0) & (held == readable), F.sum(value).over(per_wrapper))
    printed = F.get(F.filter("_totals", lambda t: t["wrapper"] == F.col("wrapper")), 0)["closing_minor"]
    rows = rows.withColumns({"_total": total, "_printed": printed})
    present = F.col("_total").isNotNull() & F.col("_printed").isNotNull()
    none = F.lit(None).cast("long")
    return rows.withColumns(
        _check_columns(wrapper_check_name(F.col("wrapper")), none, F.col("_printed"), F.col("_total"), present)
    )


def parse_statements(detected: DataFrame, layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """Bronze rows of all matched texts. Each layout reads its own share of
    `detected`, so store that partitioned by `layout` before parsing much."""
    parts = [parse_layout(detected.filter(F.col("layout") == lay.source_type), lay) for lay in layouts]
    return reduce(DataFrame.unionByName, parts)

