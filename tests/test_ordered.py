"""Both paths of an ordered scan give the same rows."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import ordered as O

LOOKS = {
    "n": O.row_number(), "total": O.running_sum("v"), "high": O.max_before("v"), "low": O.min_before("v"),
    "prev": O.previous("v"), "known": O.last_known("v"),
}


def rows(spark):
    """One key with half of all rows, one null key, many small ones; some nulls."""
    key = F.when(F.col("id") % 2 == 0, F.lit("hot")).when(F.col("id") % 7 == 0, F.lit(None)).otherwise(
        (F.col("id") % 50).cast("string")
    )
    value = F.when(F.col("id") % 5 == 0, F.lit(None)).otherwise(F.pmod(F.xxhash64("id"), F.lit(1000)))
    return spark.range(4000).select(key.alias("k"), "id", value.alias("v"))


@pytest.mark.parametrize("order", [["id"], [O.desc("id")]])
def test_split_equals_window(spark, order):
    df = rows(spark)
    plain = O.scan(df, ["k"], order, LOOKS, split=False)
    split = O.scan(df, ["k"], order, LOOKS, split=True)
    assert plain.exceptAll(split).isEmpty() and split.exceptAll(plain).isEmpty()


def test_hot_keys_are_found_and_set_apart(splitting):
    spark = splitting
    spark.conf.set(O.MIN_ROWS, "1000")
    df = rows(spark)
    hot = O.hot_keys(df, ["k"])
    assert len(hot) == 1
    cold, warm = O.part(df, ["k"], hot)
    assert {r.k for r in warm.select("k").distinct().collect()} == {"hot"}
    assert cold.count() + warm.count() == df.count()
    auto = O.scan(df, ["k"], ["id"], LOOKS)
    plain = O.scan(df, ["k"], ["id"], LOOKS, split=False)
    assert plain.exceptAll(auto).isEmpty() and auto.count() == df.count()


def test_small_inputs_take_no_extra_pass(spark):
    assert O.hot_keys(rows(spark), ["k"]) == []


def test_a_hot_key_is_spread_over_pieces(spark):
    df = spark.range(10000).withColumn("k", F.lit(1))
    pieces = df.repartitionByRange(4, "k", "id").select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(pieces) == 4 and max(r["count"] for r in pieces) < 6000


def test_carries_are_fewer_than_pieces(spark):
    """Also where the keys are far finer than the hot key."""
    df = rows(spark).withColumn("fine", F.pmod(F.xxhash64("id"), F.lit(900)))
    pieces = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for keys in (["k"], ["k", "fine"], ["fine"]):
        _, carries, _ = O._pieces(df, keys, [O.Order("id")], LOOKS)
        assert carries.count() < pieces
        plain, split = (O.scan(df, keys, ["id"], LOOKS, split=s) for s in (False, True))
        assert plain.exceptAll(split).isEmpty() and split.exceptAll(plain).isEmpty()


def test_hot_keys_beyond_one_pass_are_found(splitting, monkeypatch):
    spark = splitting
    monkeypatch.setattr(O, "SKETCHED", 4)
    spark.conf.set(O.MIN_ROWS, "50")
    df = spark.range(1000).select((F.col("id") % 10).alias("k"), "id")
    assert len(O.hot_keys(df, ["k"])) == 10


def test_keys_are_judged_by_rows_not_bytes(splitting):
    spark = splitting
    spark.conf.set(O.MIN_ROWS, "3000")
    assert O.hot_keys(rows(spark).limit(2000), ["k"]) == []
    assert len(O.hot_keys(spark.range(4000).select(F.lit(1).alias("k")), ["k"])) == 1
