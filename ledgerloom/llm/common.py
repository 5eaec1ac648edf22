"""What several corpus operators share: row keys, exact numbering, scratch tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import materialized, released

__all__ = ["materialized", "released", "fresh", "keyed", "moved_alike", "numbered", "shuffle_partitions", "uniform", "document_text"]


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def keyed(df: DataFrame, name: str, kept_in: list[str] | None = None) -> DataFrame:
    """A written copy of `df` with a unique long per row, the same for every reader."""
    return materialized(df.withColumn(name, F.monotonically_increasing_id()), kept_in)


def moved_alike(df: DataFrame) -> DataFrame:
    """`df` as the side of a join that moves whole texts: merged at every size, so that
    small inputs show what large ones will move."""
    return df.hint("merge")


def document_text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def uniform(*parts: Column | str, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the values alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *parts), 11) / F.lit(float(1 << 53))


def numbered(df: DataFrame, groups: list[str], order: list[str], name: str) -> DataFrame:
    """Number the rows of each group from 0, without gaps, however large the group.

    Rows are dealt into buckets by a hash of the first column of `order`, whose values
    repeat seldom and which is unique with the others; buckets are
    counted, their counts summed up in bucket order (a few rows per group), and a
    window numbers each (group, bucket) on its own."""
    bucket, first, row = fresh(df, "bucket"), fresh(df, "first"), fresh(df, "row")
    n = 4 * shuffle_partitions(df)
    dealt = df.withColumn(bucket, F.pmod(F.xxhash64(F.lit(97), F.col(order[0])), F.lit(n)).cast("int"))
    before = Window.partitionBy(*groups).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    firsts = (
        dealt.groupBy(*groups, bucket).agg(F.count(F.lit(1)).alias(row))
        .select(*groups, bucket, F.coalesce(F.sum(row).over(before), F.lit(0)).alias(first))
    )
    inside = Window.partitionBy(*groups, bucket).orderBy(*order)
    return (
        dealt.withColumn(row, F.row_number().over(inside) - 1)
        .join(firsts, [*groups, bucket])
        .withColumn(name, (F.col(first) + F.col(row)).cast("long"))
        .drop(bucket, first, row)
    )
