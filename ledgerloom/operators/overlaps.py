"""Overlapping statements by a plane sweep.

Every statement of an (account, source) opens at its first day and closes behind its
last. Swept in order of days, the sums of openings and closings give stretches over
which the same statements are open. A statement is open over a run of consecutive
stretches, so membership is two numbers per statement, and everything is linear in the
statements however many of them overlap. Pairs, which can be quadratic by nature, are
listed only on request: a statement meets those that open while it is open, so the work
is that of the pairs listed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.ordered import desc, hot_keys, previous, row_number, running_sum, scan
from ledgerloom.session import materialized

PLACE = ["account_id", "source_type"]


def statement_spans(transactions: DataFrame) -> DataFrame:
    """One row per statement with a period that does not end before it begins."""
    return (
        transactions.filter("statement_period_from IS NOT NULL AND statement_period_to IS NOT NULL")
        .filter("account_id IS NOT NULL AND source_type IS NOT NULL")
        .groupBy(*PLACE, "ingestion_id")
        .agg(F.min("statement_period_from").alias("period_from"), F.min("statement_period_to").alias("period_to"))
        .filter("period_from <= period_to")
    )


def _swept(spans: DataFrame) -> DataFrame:
    """Every day on which statements open or close: its number, and who is open from then on until when."""
    change = lambda day, by: F.struct(day.alias("day"), F.lit(by).alias("change"))
    both = F.array(change(F.col("period_from"), 1), change(F.date_add("period_to", 1), -1))
    # Statements of one day are one row before the shuffle is over, so keys are judged by days.
    days = spans.select(*PLACE, F.inline(both)).groupBy(*PLACE, "day").agg(F.sum("change").alias("change"))
    split = bool(hot_keys(spans.select(*PLACE), PLACE))
    swept = scan(days, PLACE, ["day"], {"stretch": row_number(), "members": running_sum("change")}, split=split)
    return scan(swept, PLACE, [desc("day")], {"next": previous("day")}, split=split)


def overlap_stretches(transactions: DataFrame) -> DataFrame:
    """Stretches of days over which at least two statements are open, and how many are."""
    return _swept(statement_spans(transactions)).filter("members > 1").select(
        *PLACE, "stretch", F.col("day").alias("stretch_from"), F.date_sub("next", 1).alias("stretch_to"), "members"
    )


def _members(spans: DataFrame) -> DataFrame:
    days = materialized(_swept(spans).select(*PLACE, "day", "stretch"))
    opened = days.select(*PLACE, F.col("day").alias("period_from"), F.col("stretch").alias("first_stretch"))
    closed = days.select(*PLACE, F.date_sub("day", 1).alias("period_to"), (F.col("stretch") - 1).alias("last_stretch"))
    return spans.join(opened, [*PLACE, "period_from"]).join(closed, [*PLACE, "period_to"]).select(
        *PLACE, "ingestion_id", "period_from", "period_to", "first_stretch", "last_stretch"
    )


def overlap_members(transactions: DataFrame) -> DataFrame:
    """Every statement with the run of stretches over which it is open."""
    return _members(materialized(statement_spans(transactions)))


def find_overlapping_ingestions(transactions: DataFrame) -> DataFrame:
    """Pairs of ingestions of one (account, source) whose periods overlap, with the
    shared window. A report; no tier of matching lists pairs.

    A statement counts at most two stretches for each other that it overlaps, so what
    is exploded here is in proportion to the pairs that come out."""
    members = materialized(overlap_members(transactions))
    there = members.select(
        *PLACE, F.col("ingestion_id").alias("one"), F.col("period_to").alias("one_to"), F.col("first_stretch").alias("since"),
        F.explode(F.sequence("first_stretch", "last_stretch")).alias("stretch"),
    )
    opening = members.select(
        *PLACE, F.col("ingestion_id").alias("two"), "period_from", F.col("period_to").alias("two_to"), F.col("first_stretch").alias("stretch")
    )
    # Of two that open together, the one with the smaller id was there first.
    before = (F.col("since") < F.col("stretch")) | (F.col("one") < F.col("two"))
    return there.join(opening, [*PLACE, "stretch"]).filter(before & (F.col("one") != F.col("two"))).select(
        *PLACE, F.least("one", "two").alias("ingestion_a"), F.greatest("one", "two").alias("ingestion_b"),
        F.col("period_from").alias("window_from"), F.least("one_to", "two_to").alias("window_to"),
    )
