"""Shards of equal row counts that keep linked documents together.

Documents with equal texts are linked. A group starts in a shard by hash of its text, a
large one in the next few too, as many as its size needs at `FULL` of a quota; balanced
label propagation then moves linked documents, round by round, to the shard that holds
most of their neighbours: rows are counted per (group, shard), the counts name a
target, and a join tells each row. A shard takes no more than its quota and those who
leave allow; when more want in, a hash decides who goes first. Shards that could not
take all are no targets from then on. At last every shard gets exactly its quota:
shards above it give up unlinked documents first, then whole small groups, numbered
without gaps, to the shards below.

A group is never gathered: it is counted before the shuffle, at most `shards` rows
of it meet, and joins on a hot group are such as Spark splits. The driver sees one
number per pair of shards.

The law is `rows`: counts differ by one at most. Defined results: a null text has
size 1 and CRC 0 and equals other null or empty texts; null or repeated doc_ids are
rows like others; other columns are not read; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import document_text, keyed, materialized, numbered, uniform

SHARDS, ROUNDS = 8, 8
FULL = 0.75
SMALL = 64  # copies of a group that moves as a whole where a shard must give up rows


def _chosen(of: Column, values: list) -> Column:
    """The value at place `of` of a list with one entry per shard."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), of + 1)


def _accepted(free: list[int], wish: list[list[int]]) -> list[float]:
    """The share of those who want into each shard that its quota lets in, when rows
    that leave make room: the largest shares that fit, by iteration from above."""
    shards = range(len(free))
    share = [1.0] * len(free)
    for _ in range(100):
        room = [free[t] + sum(wish[t][u] * share[u] for u in shards) for t in shards]
        wanted = [sum(wish[s][t] for s in shards) for t in shards]
        share = [min(share[t], max(0.0, room[t] / wanted[t])) if wanted[t] else 1.0 for t in shards]
    return share


def propagated(linked: DataFrame, quotas: list[int], rounds: int = ROUNDS) -> DataFrame:
    """Rows (row_id, group, grade, shard) after up to `rounds` rounds of moves."""
    shards = len(quotas)
    state, is_open = linked, [True] * shards
    for turn in range(rounds):
        tally = state.groupBy("group", "shard").agg(F.count(F.lit(1)).alias("rows"))
        of_group = Window.partitionBy("group")
        weight = F.struct(F.col("rows"), F.xxhash64("group", "shard").alias("tie"), F.col("shard").alias("to"))
        targets = (
            tally.withColumn("own", weight)
            .withColumn("best", F.max(F.when(_chosen(F.col("shard"), is_open), weight)).over(of_group))
            .filter("best > own").select("group", "shard", F.col("best.to").alias("to"))
        )
        wanting = materialized(state.join(targets, ["group", "shard"], "left"))
        wish, load = [[0] * shards for _ in range(shards)], [0] * shards
        for r in wanting.groupBy("shard", "to").count().collect():
            load[r["shard"]] += r["count"]
            if r["to"] is not None:
                wish[r["shard"]][r["to"]] = r["count"]
        if not any(map(any, wish)):
            break  # also when no shard is open
        share = _accepted([q - n for q, n in zip(quotas, load, strict=True)], wish)
        is_open = [was and x > 0.999 for was, x in zip(is_open, share, strict=True)]
        goes = F.col("to").isNotNull() & (uniform("row_id", seed=turn + 1) < _chosen(F.coalesce("to", F.lit(0)), share))
        state = wanting.select(
            "row_id", "group", "grade", F.when(goes, F.col("to")).otherwise(F.col("shard")).alias("shard")
        )
    return materialized(state)


def balanced(placed: DataFrame, quotas: list[int]) -> DataFrame:
    """(row_id, shard) with exactly quotas[s] rows in shard s.

    `grade` says who moves first: 0 for unlinked rows, 1 for small groups, whose rows
    move together, 2 for rows of large groups."""
    shards = len(quotas)
    rows = {(r["shard"], r["grade"]): r["count"] for r in placed.groupBy("shard", "grade").count().collect()}
    below = [[sum(rows.get((s, g), 0) for g in range(grade)) for s in range(shards)] for grade in range(4)]
    over = [max(0, t - q) for t, q in zip(below[3], quotas, strict=True)]
    under = [max(0, q - t) for t, q in zip(below[3], quotas, strict=True)]
    place = numbered(placed, ["shard", "grade"], ["lump", "row_id"], "place").withColumn(
        "place", F.col("place")
        + F.when(F.col("grade") == 0, 0).when(F.col("grade") == 1, _chosen(F.col("shard"), below[1])).otherwise(_chosen(F.col("shard"), below[2]))
    )
    leaves = F.col("place") < _chosen(F.col("shard"), over)
    ticket = F.col("place") + _chosen(F.col("shard"), [sum(over[:s]) for s in range(shards)])
    to = F.lit(shards - 1)
    for s in reversed(range(shards)):
        to = F.when(ticket < sum(under[: s + 1]), F.lit(s)).otherwise(to)
    return place.select("row_id", F.when(leaves, to).otherwise(F.col("shard")).alias("shard"))


def sharded(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = document_text()
    rows = keyed(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("group"),
        ),
        "row_id",
    )
    n = rows.count()
    quotas = [n // shards + (s < n % shards) for s in range(shards)]
    spread = F.ceil(F.col("copies") / F.lit(max(1.0, FULL * n / shards)))
    among = F.floor(uniform("row_id", seed=0) * F.least(spread, F.lit(shards)))
    start = F.pmod(F.xxhash64("group") % shards + among, F.lit(shards)).cast("int").alias("shard")
    groups = rows.groupBy("group").agg(F.count(F.lit(1)).alias("copies"))
    grade = F.when(F.col("copies") == 1, 0).when(F.col("copies") <= SMALL, 1).otherwise(2)
    state = materialized(rows.join(groups, "group").select("row_id", "group", start, grade.alias("grade")))
    moved = propagated(state.filter("grade > 0").select("row_id", "group", "shard", "grade"), quotas, rounds)
    lump = F.when(F.col("grade") == 1, F.xxhash64("group")).otherwise(F.col("row_id")).alias("lump")
    placed = materialized(
        moved.select("row_id", "shard", "grade", lump)
        .unionByName(state.filter("grade = 0").select("row_id", "shard", "grade", F.col("row_id").alias("lump")))
    )
    final = numbered(materialized(balanced(placed, quotas)), ["shard"], ["row_id"], "slot")
    return rows.join(final, "row_id").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "group",
    )


def cut_links(sharding: DataFrame) -> DataFrame:
    """One row: links between equal texts, and those whose ends lie in different shards."""
    per_shard = sharding.groupBy("group", "shard").agg(F.count(F.lit(1)).alias("n"))
    pairs = lambda n: n * (n - 1) / 2
    whole = per_shard.groupBy("group").agg(F.sum("n").alias("all"), F.sum(pairs(F.col("n"))).alias("inside"))
    return whole.agg(
        F.coalesce(F.sum(pairs(F.col("all"))), F.lit(0)).cast("long").alias("links"),
        F.coalesce(F.sum(pairs(F.col("all")) - F.col("inside")), F.lit(0)).cast("long").alias("cut"),
    )
