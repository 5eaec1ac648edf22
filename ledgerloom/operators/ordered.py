"""Ordered scans (row numbers, running sums, look-backs) that survive a hot key.

A window sends every row of a key to one task. That is right while keys are
small, and it is what `scan` plans for them. When there are enough rows for a hot
key, `scan` first takes one pass with a heavy-hitter sketch (fixed memory, nothing
shuffled). Rows of the few keys it reports are range-partitioned by (key,
order), so that one key covers many tasks; each piece is scanned on its own, the
pieces' totals (at most one row per piece and key) are scanned once more, and
every row is put right with the total of the pieces before its own. Both paths
give the same result; the order must be total.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import estimated_bytes, materialized

MIN_BYTES = "spark.ledgerloom.split.minBytes"  # smaller inputs are never split
MIN_ROWS = "spark.ledgerloom.split.minRows"  # a key below this is never split
DEFAULT_MIN_ROWS = 5_000_000
DEFAULT_MIN_BYTES = DEFAULT_MIN_ROWS  # a stored row takes a byte at least, so fewer bytes hold no hot key
SKETCHED = 5_000  # hot keys that one pass finds

_HASH, _PIECE, _LOCAL = "__key_hash", "__piece", "__local_row"


@dataclass(frozen=True)
class Order:
    name: str
    descending: bool = False

    @property
    def column(self) -> Column:
        return F.col(self.name).desc_nulls_last() if self.descending else F.col(self.name).asc_nulls_first()


def desc(name: str) -> Order:
    return Order(name, True)


@dataclass(frozen=True)
class Look:
    """One look along the order: what to compute, from which column."""

    kind: str
    source: str | None = None


def row_number() -> Look:
    return Look("row_number")


def running_sum(source: str) -> Look:
    return Look("running_sum", source)


def max_before(source: str) -> Look:
    """Largest value over the earlier rows of the key."""
    return Look("max_before", source)


def min_before(source: str) -> Look:
    return Look("min_before", source)


def previous(source: str) -> Look:
    """Value of the row just before, null on the first."""
    return Look("previous", source)


def last_known(source: str) -> Look:
    """Latest non-null value up to and with this row."""
    return Look("last_known", source)


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Order],
    looks: dict[str, Look],
    sized_by: DataFrame | None = None,
    split: bool | None = None,
) -> DataFrame:
    """Add one column per look.

    `sized_by` is a frame that is cheaper to read than `df`, has its keys, and no
    fewer rows of any key: hot keys are looked for there. `split` states instead
    what to do with all rows: False where keys are known to be small, True where
    the caller has set the hot ones apart (see `hot_keys` and `part`)."""
    orders = [o if isinstance(o, Order) else Order(o) for o in order]
    if split is None:
        hot = hot_keys(df if sized_by is None else sized_by, keys)
        if hot:
            cold, warm = part(materialized(df), keys, hot)
            return _local(cold, list(keys), orders, looks).unionByName(_split(warm, list(keys), orders, looks))
    return _split(df, list(keys), orders, looks) if split else _local(df, list(keys), orders, looks)


def hot_keys(df: DataFrame, keys: Sequence[str]) -> list[int]:
    """Hashes of the keys with too many rows for one task.

    Keys are judged by their rows: fewer rows than that in all hold no such key, and
    only then is the sketch left out. A pass that finds as many hot keys as it can
    is followed by another over the rest, so none stays whole."""
    conf = df.sparkSession.conf
    least = int(conf.get(MIN_ROWS, str(DEFAULT_MIN_ROWS)))
    if estimated_bytes(df) < int(conf.get(MIN_BYTES, str(DEFAULT_MIN_BYTES))) or df.count() < least:
        return []
    hot: list[int] = []
    hashed = df.select(F.xxhash64(*keys).alias(_HASH))
    while True:
        rest = hashed.join(_listed(df, hot), _HASH, "left_anti") if hot else hashed
        found = (
            rest.agg(F.expr(f"approx_top_k({_HASH}, {SKETCHED}, {SKETCHED * 20})").alias("top"))
            .select(F.inline("top"))
            .filter(F.col("count") >= least)
        )
        more = [row["item"] for row in found.collect()]
        hot += more
        if len(more) < SKETCHED:
            return hot


def _listed(df: DataFrame, hot: Sequence[int]) -> DataFrame:
    # A key has MIN_ROWS rows at least, so the list is at most rows / MIN_ROWS longs.
    return F.broadcast(df.sparkSession.createDataFrame([(h,) for h in hot], f"{_HASH} long"))


def part(df: DataFrame, keys: Sequence[str], hot: Sequence[int]) -> tuple[DataFrame, DataFrame]:
    """Rows of the other keys, and rows of the hot keys."""
    hashes = _listed(df, hot)
    hashed = df.withColumn(_HASH, F.xxhash64(*keys))
    return hashed.join(hashes, _HASH, "left_anti").drop(_HASH), hashed.join(hashes, _HASH, "left_semi").drop(_HASH)


def _local(df: DataFrame, keys: list[str], orders: list[Order], looks: dict[str, Look]) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*[o.column for o in orders])
    earlier = window.rowsBetween(Window.unboundedPreceding, -1)
    so_far = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    made = {
        "row_number": lambda c: F.row_number().over(window).cast("long"),
        "running_sum": lambda c: F.sum(c).over(so_far),
        "max_before": lambda c: F.max(c).over(earlier),
        "min_before": lambda c: F.min(c).over(earlier),
        "previous": lambda c: F.lag(c).over(window),
        "last_known": lambda c: F.last(c, ignorenulls=True).over(so_far),
    }
    return df.withColumns({name: made[look.kind](look.source) for name, look in looks.items()})


# What one piece hands to the pieces after it: the aggregate over its rows, the
# aggregate that folds earlier pieces together, and how a row takes the carry in.
def _sum_or_null(left: Column, right: Column) -> Column:
    return F.coalesce(left + right, left, right)


_TOTAL = {
    "row_number": lambda name, c: F.max(name),
    "running_sum": lambda name, c: F.sum(c),
    "max_before": lambda name, c: F.max(c),
    "min_before": lambda name, c: F.min(c),
    "previous": lambda name, c: F.max_by(c, _LOCAL),
    "last_known": lambda name, c: F.max_by(name, _LOCAL),
}
_FOLD = {
    "row_number": lambda c: F.sum(c),
    "running_sum": lambda c: F.sum(c),
    "max_before": lambda c: F.max(c),
    "min_before": lambda c: F.min(c),
    "previous": None,
    "last_known": lambda c: F.last(c, ignorenulls=True),
}
_TAKE = {
    "row_number": _sum_or_null,
    "running_sum": _sum_or_null,
    "max_before": F.greatest,
    "min_before": F.least,
    "previous": lambda local, carry: F.when(F.col(_LOCAL) == 1, carry).otherwise(local),
    "last_known": F.coalesce,
}


def _pieces(
    df: DataFrame, keys: list[str], orders: list[Order], looks: dict[str, Look]
) -> tuple[DataFrame, DataFrame, Column]:
    """Rows scanned within their piece, what pieces carry on, and how the two meet."""
    pieces = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(
        pieces, *[F.col(k).asc_nulls_first() for k in keys], *[o.column for o in orders]
    )
    # Piece numbers must be the same wherever they are read: written down once.
    numbered = materialized(ranged.withColumn(_PIECE, F.spark_partition_id()))
    local = _local(numbered, [*keys, _PIECE], orders, {**looks, _LOCAL: row_number()})

    totals = local.groupBy(*keys, _PIECE).agg(
        *[_TOTAL[look.kind](name, look.source).alias(f"__total_{name}") for name, look in looks.items()]
    )
    by_piece = Window.partitionBy(*keys).orderBy(_PIECE)
    before = by_piece.rowsBetween(Window.unboundedPreceding, -1)
    carries = totals.select(
        *[F.col(k).alias(f"__carry_key_{i}") for i, k in enumerate(keys)],
        F.col(_PIECE).alias("__carry_piece"),
        *[
            (
                F.lag(f"__total_{name}").over(by_piece)
                if _FOLD[look.kind] is None
                else _FOLD[look.kind](f"__total_{name}").over(before)
            ).alias(f"__carry_{name}")
            for name, look in looks.items()
        ],
        F.lag(F.lit(1)).over(by_piece).alias("__earlier"),
    ).filter("__earlier IS NOT NULL").drop("__earlier")
    same = F.col(_PIECE) == F.col("__carry_piece")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__carry_key_{i}"))
    return local, carries, same


def _split(df: DataFrame, keys: list[str], orders: list[Order], looks: dict[str, Look]) -> DataFrame:
    columns = df.columns
    local, carries, same = _pieces(df, keys, orders, looks)
    # A carry is for a key whose rows began in an earlier piece. Pieces are ranges in
    # key order, so only one key runs on from each piece to the next: at most pieces - 1 rows.
    joined = local.join(F.broadcast(carries), same, "left")
    return joined.select(
        *columns,
        *[
            _TAKE[look.kind](F.col(name), F.col(f"__carry_{name}")).alias(name)
            for name, look in looks.items()
        ],
    )
