"""Exact duplicates by deterministic block naming.

A normalised text is cut into blocks of a fixed number of code points. Distinct
blocks are sorted and take integer names. Adjacent names are then paired, distinct
pairs take names of the next level, and so on until a document is one name. Two
documents of as many blocks have the same last name exactly when their texts are
equal: a name stands for one block or one pair, never for a hash.

Blocks cross the network once, after equal ones were combined where they are read.
They find their names through a 64-bit hash, and that every hash belongs to one
block only is checked on the whole table; should two blocks ever share one, naming
starts again with another seed. From there on only longs move.

Defined results: a null text is empty; empty texts are equal to each other and to
texts of white space; a null doc_id is a document like any other and is kept only
where no copy has an id; rows that agree in everything are copies, of which one
stays; other columns are neither read nor changed; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import document_text, fresh, keyed, materialized, moved_alike, released

BLOCK = 4096
SPACES = r"[\x20\x09-\x0D]+"


def normalized(text: Column) -> Column:
    return F.regexp_replace(text, SPACES, "")


def _hashes(blocks: str, seed: int) -> Column:
    return F.transform(F.col(blocks), lambda b: F.xxhash64(F.lit(seed), b))


def _texts(docs: DataFrame, row: str, block: int) -> DataFrame:
    text = document_text()
    cut = docs.select(
        F.col(row).alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"),
        F.length(text).cast("long").alias("points"), normalized(text).alias("normal"),
    )
    blocks = F.when(F.col("normal") == "", F.array(F.lit(""))).otherwise(
        F.regexp_extract_all("normal", F.lit(f"(?s).{{1,{block}}}"), 0)
    )
    return cut.select(
        "row_id", "doc_id", "points", F.sha2("normal", 256).alias("text_sha256"), blocks.alias("blocks")
    ).withColumns({"hashes": _hashes("blocks", 0), "width": F.size("blocks")})


def _block_names(texts: DataFrame, scratch: list[str]) -> tuple[DataFrame, DataFrame]:
    """Texts with the hashes that were used, and (hash, name) of every distinct block."""
    seed = 0
    while True:
        distinct = (
            texts.select(F.inline(F.arrays_zip(F.col("hashes").alias("hash"), F.col("blocks").alias("block"))))
            .groupBy("hash", "block").agg(F.count(F.lit(1)).alias("uses"))
        )
        names = materialized(
            distinct.sortWithinPartitions("hash", "block").select("hash", F.monotonically_increasing_id().alias("name")),
            scratch,
        )
        if names.groupBy("hash").count().filter("count > 1").isEmpty():
            return texts, names
        seed += 1
        texts = materialized(texts.withColumn("hashes", _hashes("blocks", seed)), scratch)


def identities(texts: DataFrame, scratch: list[str]) -> DataFrame:
    """(row_id, width, name): equal (width, name) means equal text."""
    texts, names = _block_names(texts, scratch)
    placed = texts.select("row_id", "width", F.posexplode("hashes").alias("place", "hash"))
    level = materialized(placed.join(names, "hash").select("row_id", "width", "place", "name"), scratch)
    done = [level.filter("width = 1").select("row_id", "width", "name")]
    left = level.filter("width > 1").withColumn("rest", F.col("width"))
    widest = left.agg(F.max("width")).first()[0] or 1
    while widest > 1:
        pairs = left.groupBy("row_id", "width", "rest", F.expr("place div 2").alias("place")).agg(
            F.max(F.when(F.col("place") % 2 == 0, F.col("name"))).alias("one"),
            F.coalesce(F.max(F.when(F.col("place") % 2 == 1, F.col("name"))), F.lit(-1)).alias("two"),
        )
        pairs = materialized(pairs, scratch)
        named = materialized(
            pairs.groupBy("one", "two").agg(F.count(F.lit(1)).alias("uses"))
            .sortWithinPartitions("one", "two").select("one", "two", F.monotonically_increasing_id().alias("name")),
            scratch,
        )
        level = materialized(
            pairs.join(named, ["one", "two"])
            .select("row_id", "width", "place", "name", F.expr("(rest + 1) div 2").alias("rest")),
            scratch,
        )
        done.append(level.filter("rest = 1").select("row_id", "width", "name"))
        left, widest = level.filter("rest > 1"), (widest + 1) // 2
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return found


def duplicates(docs: DataFrame, row: str | None = None, block: int = BLOCK) -> DataFrame:
    """One row per document: row_id, doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the most code points stays, then the smallest
    doc_id. `row` names a unique long column; without it rows are numbered here."""
    scratch: list[str] = []
    if row is None:
        row = fresh(docs, "row_id")
        docs = docs.withColumn(row, F.monotonically_increasing_id())
    texts = materialized(_texts(docs, row, block), scratch)
    members = materialized(
        identities(texts, scratch).join(texts.select("row_id", "doc_id", "points", "text_sha256"), "row_id")
    )
    released(docs.sparkSession, scratch)
    best = members.groupBy("width", "name").agg(
        F.count(F.lit(1)).alias("group_size"),
        F.max(F.struct("points", F.bitwise_not("doc_id").alias("id"), F.bitwise_not("row_id").alias("row"))).alias("best"),
    )
    return members.join(best, ["width", "name"]).select(
        "row_id", "doc_id", F.bitwise_not("best.id").alias("keep_id"), "group_size",
        (F.col("row_id") == F.bitwise_not("best.row")).alias("kept"), "text_sha256",
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, with their own columns."""
    row = fresh(docs, "row_id")
    copy = keyed(docs, row)
    kept = materialized(duplicates(copy, row).filter("kept").select(F.col("row_id").alias(row)))
    return copy.join(moved_alike(kept), row, "left_semi").drop(row)
