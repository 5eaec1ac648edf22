"""Running figures along an order: filled, stepped or rolled on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.ordered import Order, last_known, previous, running_sum, scan


def fill_down(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Order], column: str, into: str, split: bool | None = None
) -> DataFrame:
    """The latest value that is not null, up to and with each row."""
    return scan(df, keys, order, {into: last_known(column)}, split=split)


def step_from_previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Order], column: str, into: str, split: bool | None = None
) -> DataFrame:
    """How far each value is from the one before it; null on the first row."""
    before = scan(df, keys, order, {"_before": previous(column)}, split=split)
    return before.withColumn(into, F.col(column) - F.col("_before")).drop("_before")


def roll_on(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Order], amount: str, opening: Column, into: str,
    sign: int = 1, split: bool | None = None,
) -> DataFrame:
    """The opening balance moved by the signed amounts up to and with each row.
    Sign -1 is a liability: what comes in lowers it."""
    moved = scan(df, keys, order, {"_moved": running_sum(amount)}, split=split)
    return moved.withColumn(into, opening + sign * F.coalesce("_moved", F.lit(0))).drop("_moved")
