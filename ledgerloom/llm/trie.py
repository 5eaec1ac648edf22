"""Prefix trie of conversations by whole-sequence collapse.

1. Rebuild: every conversation starts with the first few turns of the first of its
   hundred, then goes on with its own. Texts are read once: from then on a turn is a
   SHA-256 digest and a number of code points.
2. Prefixes get keys: a running sum, along a conversation, of 128-bit hashes of (place,
   digest). Equal prefixes have equal keys, and a key is one addition away from that of
   the prefix one turn shorter, so parents need no look-up.
3. Collapse: conversations with the same last key are one weighted sequence, with its
   smallest id and the digest of its list of ends.
4. Leaves: sequences that are a proper prefix of another go, by anti-join.
5. Aggregate: prefixes of distinct sequences only, with their weights, grouped by key.
   A sum over a subtree is a sum over the sequences that pass a node: each node's own
   value is put down to the sequence of its smallest member, which from some depth on is
   the smallest of all its nodes, and is summed up from the deepest turn backwards.

Nothing is collected by conversation or by node: conversations are scanned in order by
`ordered.scan`, which splits one that holds very many turns, and every node value is an
aggregate that combines before the shuffle. Lists of ends are joined into strings of at
most 4,096 ids where they are grouped and read on in order, so the digest of a list with
a third of all ids, sequential as SHA-256 is, takes no more memory than any other.

Keys are 128 bits of two independent hashes over digests: among 10**11 nodes two differ
with the same key with a probability below 10**-16.

Defined results: null roles and texts are empty; turns are ordered by number, null
first, then by digest, so that turns of one number have one order whatever their rows';
rows that repeat are turns of their own; a row without conv_id belongs to no
conversation and is left out; of a negative id, the hundred is counted towards zero;
other columns are not read; no rows give no rows, not even the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import materialized, released
from ledgerloom.operators import ordered

FAMILY, HEADS = 100, 6  # conversations with a common head; heads have fewer turns than this
_CHUNK_BITS = 12
_KEY = ["depth", "high", "low"]
_NO_ENDS = hashlib.sha256(b"").hexdigest()
_PARTS = ("p0", "p1", "p2", "p3")
_SUMS = ("s0", "s1", "s2", "s3")
_HALF = (1 << 32) - 1


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, at (from 1), digest and chars of every turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    told = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
        F.length(text).cast("long").alias("chars"),
    )
    sizes = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"))
    return ordered.scan(told, ["conv_id"], ["turn", "digest"], {"at": ordered.row_number()}, sized_by=sizes).drop("turn")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All conversations, and their turns (conv_id, depth, digest, chars) after rebuilding."""
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    heads = turns.filter((F.col("conv_id") % FAMILY == 0) & (F.col("at") < HEADS)).withColumnRenamed("conv_id", "base")
    sizes = heads.groupBy("base").agg(F.max("at").alias("told"))
    talks = (
        turns.filter("at = 1").select("conv_id", base.alias("base"), head.alias("head")).join(sizes, "base", "left")
        .select("conv_id", "base", "head", F.least("head", F.coalesce("told", F.lit(0))).alias("taken"))
    )
    taken = talks.join(heads, "base").filter("at <= head").select("conv_id", F.col("at").alias("depth"), "digest", "chars")
    own = turns.join(talks.select("conv_id", "head", "taken"), "conv_id").filter("at > head")
    return talks.select("conv_id"), taken.unionByName(
        own.select("conv_id", (F.col("at") - F.col("head") + F.col("taken")).alias("depth"), "digest", "chars")
    )


def _keys(parts: list[Column], high: str, low: str) -> list[Column]:
    halves = [p.bitwiseAND(F.lit(_HALF)) for p in parts]
    return [
        F.shiftleft(halves[0], 32).bitwiseOR(halves[1]).alias(high), F.shiftleft(halves[2], 32).bitwiseOR(halves[3]).alias(low),
    ]


def prefixes(talks: DataFrame, turns: DataFrame, sized_by: DataFrame) -> DataFrame:
    """One row per conversation and depth: key of the prefix, key of the one above, chars."""
    hashes = [F.xxhash64(F.lit(seed), "depth", "digest") for seed in (11, 12)]
    parts = [f(h) for h in hashes for f in (lambda h: h.bitwiseAND(F.lit(_HALF)), lambda h: F.shiftrightunsigned(h, 32))]
    hashed = turns.select("conv_id", "depth", "chars", *[p.alias(name) for p, name in zip(parts, _PARTS, strict=True)])
    sums = {s: ordered.running_sum(p) for s, p in zip(_SUMS, _PARTS, strict=True)}
    run = ordered.scan(hashed, ["conv_id"], ["depth"], sums, sized_by=sized_by)
    here, above = [F.col(s) for s in _SUMS], [F.col(s) - F.col(p) for s, p in zip(_SUMS, _PARTS, strict=True)]
    nothing = [F.lit(0).cast("long").alias(c) for c in ("depth", "chars", "high", "low")]
    no_parent = [F.lit(None).cast("long").alias(c) for c in ("up_high", "up_low")]
    return talks.select("conv_id", *nothing, *no_parent).unionByName(
        run.select("conv_id", F.col("depth").cast("long").alias("depth"), "chars", *_keys(here, "high", "low"), *_keys(above, "up_high", "up_low"))
    )


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted chunks of lists to one row per list, with the digest of the whole."""
    names = [*_KEY, "conv_id", "weight", "ends_sha256"]
    key, first, weight, digest = None, None, 0, hashlib.sha256()
    for batch in batches:
        rows = []
        for *found, least, size, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if found != key:
                if key is not None:
                    rows.append((*key, first, weight, digest.hexdigest()))
                key, first, weight, digest = found, least, 0, hashlib.sha256()
            else:
                digest.update(b",")
            weight += size
            digest.update(ids.encode())
        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], _LISTED)
    if key is not None:
        yield pa.RecordBatch.from_pylist([dict(zip(names, (*key, first, weight, digest.hexdigest()), strict=True))], _LISTED)


_LISTED = pa.schema([*[(c, pa.int64()) for c in (*_KEY, "conv_id", "weight")], ("ends_sha256", pa.string())])


def sequences(paths: DataFrame) -> DataFrame:
    """Identical conversations collapsed: key, smallest conv_id, weight, digest of the ends."""
    last = paths.groupBy("conv_id").agg(F.max(F.struct(*_KEY)).alias("last")).select("conv_id", "last.*")
    chunk = F.shiftright("conv_id", _CHUNK_BITS)
    ids = F.sort_array(F.collect_list("conv_id"))
    chunks = last.groupBy(*_KEY, chunk.alias("chunk")).agg(
        F.min("conv_id").alias("least"), F.count(F.lit(1)).alias("size"),
        F.array_join(F.transform(ids, lambda i: i.cast("string")), ",").alias("ids"),
    )
    return (
        chunks.repartition(*_KEY).sortWithinPartitions(*_KEY, "chunk").select(*_KEY, "least", "size", "ids")
        .mapInArrow(_lists, "depth long, high long, low long, conv_id long, weight long, ends_sha256 string")
    )


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256."""
    scratch: list[str] = []
    turns = materialized(turns_of(conversations), scratch)
    paths = materialized(prefixes(*rebuilt(turns), sized_by=turns.select("conv_id")), scratch)
    whole = materialized(sequences(paths), scratch)
    spread = materialized(
        paths.join(whole.select("conv_id", "weight", F.col("depth").alias("length")), "conv_id"), scratch
    )

    proper = spread.filter("depth < length").select(*_KEY).distinct()
    leaves = whole.join(proper, _KEY, "left_anti").select("conv_id", F.lit(1).cast("long").alias("leaf"))
    # A node's value belongs to its smallest member, whose sequence is the smallest that passes it.
    owned = spread.groupBy(*_KEY).agg(
        F.min("conv_id").alias("conv_id"), ((F.sum("weight") - 1) * F.max("chars")).alias("saved")
    ).select("conv_id", "depth", "saved")
    valued = (
        spread.join(owned, ["conv_id", "depth"], "left").join(leaves, "conv_id", "left")
        .withColumns({"saved": F.coalesce("saved", F.lit(0)), "leaf": F.coalesce("leaf", F.lit(0))})
    )
    summed = ordered.scan(
        valued, ["conv_id"], [ordered.desc("depth")], {"below": ordered.running_sum("saved")}, sized_by=spread.select("conv_id")
    )
    nodes = materialized(
        summed.groupBy(*_KEY).agg(
            F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs"), F.sum("leaf").alias("n_leaves"),
            F.sum("below").alias("saved_tokens"), F.max("up_high").alias("up_high"), F.max("up_low").alias("up_low"),
        ).join(whole.select(*_KEY, "ends_sha256"), _KEY, "left"),
    )
    released(conversations.sparkSession, scratch)

    children = (
        nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up_high").alias("high"), F.col("up_low").alias("low"))
        .agg(F.count(F.lit(1)).alias("n_children"))
    )
    above = nodes.select(
        (F.col("depth") + 1).alias("depth"), F.col("high").alias("up_high"), F.col("low").alias("up_low"),
        F.col("conv_id").alias("parent_conv_id"),
    )
    return (
        nodes.join(children, _KEY, "left").join(above, ["depth", "up_high", "up_low"], "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
            "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_NO_ENDS)).alias("ends_sha256"),
        )
    )
