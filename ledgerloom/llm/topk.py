"""Exact top-k inner products by the three-phase uniform threshold.

Vectors become integers, floor(256 x) per component. A score is the sum of `LISTS`
local scores, one per range of components, and each range is a list of its own that
knows only its part of every vector.

1. Gather: for each query, every list gives its k best local scores per block of
   candidates. The candidates named are scored in full; the k-th best of these is a
   score that the answer reaches at least.
2. Threshold: the cutoff goes out to the lists. A candidate whose score reaches it
   must reach cutoff / LISTS in one list at least, so each list gives all entries that
   do, and together they are sufficient. With a bound of less than cutoff / LISTS for
   the parts not given, candidates that cannot reach the cutoff go.
3. Resolve: the missing parts of what is left are looked up, and exact scores ranked.

Both queries and candidates are packed into blocks of bounded size, and a list meets
each pair of blocks in a task of its own. Vectors that repeat within a block count
k + 1 times at most, those with the smallest ids, since no more can be among the best;
that bounds what one common vector gives.

Defined results: vectors that are null, or hold a null or a component that is not
finite, take no part, nor do rows without vec_id; rows with the same vec_id are one
vector, the smallest; vectors of different lengths do not meet; the empty vector scores
0 with others; ties go to the smaller vec_id; other columns are not read; scores are
64-bit integers; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import materialized

LISTS, K, EVERY = 2, 5, 50
CANDIDATES, QUERIES = 8192, 1024
PACKED = "length int, list int, block long, ids binary, parts binary"
_LEAST = np.iinfo(np.int64).min


def quantized(vectors: DataFrame) -> DataFrame:
    """(vec_id, codes) of the vectors that take part, one row per id."""
    whole = F.forall(
        "embedding",
        lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))),
    )
    codes = F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("long"))
    return (
        vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(whole)
        .select(F.col("vec_id").cast("long").alias("vec_id"), codes.alias("codes"))
        .groupBy("vec_id").agg(F.min("codes").alias("codes"))
    )


def _pack(lists: int, copies: int | None):
    """Rows of one block as matrices, one per list; equal vectors `copies` times at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)).combine_chunks()
        ids = rows["vec_id"].to_numpy()
        width = rows["length"][0].as_py()
        codes = rows["codes"].combine_chunks().flatten().to_numpy().reshape(len(ids), width)
        order = np.argsort(ids, kind="stable")
        ids, codes = ids[order], np.ascontiguousarray(codes[order])
        if copies is not None and width:
            same = pd.Series(codes.view(f"V{8 * width}").ravel().tolist())
            keep = (same.groupby(same).cumcount() < copies).to_numpy()
            ids, codes = ids[keep], codes[keep]
        elif copies is not None:
            ids, codes = ids[:copies], codes[:copies]
        for at, part in enumerate(np.array_split(codes, lists, axis=1)):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([width], pa.int32()), pa.array([at], pa.int32()), rows["block"].combine_chunks().slice(0, 1),
                    pa.array([ids.tobytes()], pa.binary()), pa.array([np.ascontiguousarray(part).tobytes()], pa.binary()),
                ],
                ["length", "list", "block", "ids", "parts"],
            )

    return run


def _packed(codes: DataFrame, size: int, lists: int, copies: int | None) -> tuple[DataFrame, int]:
    """Blocks of `size` rows or so, and how many there are at most of one length."""
    blocks = -(-codes.count() // size) or 1
    dealt = codes.select(
        "vec_id", "codes", F.size("codes").alias("length"),
        F.pmod(F.xxhash64(F.lit(3), "vec_id"), F.lit(blocks)).alias("block"),
    )
    return materialized(dealt.groupBy("length", "block").applyInArrow(_pack(lists, copies), PACKED)), blocks


def _matrix(part: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(part, np.int64).reshape(rows, -1)


def _products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Integer inner products; as floats, which are far faster, where those are exact."""
    most = float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0)) * max(left.shape[1], 1)
    if most < 1 << 52:
        return (left.astype(np.float64) @ right.T.astype(np.float64)).astype(np.int64)
    return left @ right.T


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for row in batch.to_pylist():
            queries, candidates = np.frombuffer(row["query_ids"], np.int64), np.frombuffer(row["ids"], np.int64)
            scores = _products(_matrix(row["query_parts"], len(queries)), _matrix(row["parts"], len(candidates)))
            scores = np.ascontiguousarray(scores)
            yield row, queries, candidates, scores, queries[:, None] != candidates[None, :]


def _entries(row: dict, queries, candidates, scores, chosen) -> pa.RecordBatch:
    q, c = np.nonzero(chosen)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(q), row["list"], np.int32)), pa.array(queries[q]), pa.array(candidates[c]), pa.array(scores[q, c])],
        ["list", "query_id", "vec_id", "part"],
    )


def _gather(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, queries, candidates, scores, others in _tiles(batches):
            local = np.where(others, scores, _LEAST)
            n = min(k, len(candidates))
            if not n:
                continue
            best = np.argpartition(-local.astype(np.float64), n - 1, axis=1)[:, :n]
            chosen = np.zeros_like(others)
            np.put_along_axis(chosen, best, True, axis=1)
            yield _entries(row, queries, candidates, scores, chosen & others)

    return run


def _sufficient(lists: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, queries, candidates, scores, others in _tiles(batches):
            # A score of `cutoff` or more needs a part of ceil(cutoff / lists) or more.
            cutoff = np.frombuffer(row["cutoffs"], np.int64)
            least = np.where(cutoff == _LEAST, _LEAST, -(-cutoff // lists))
            yield _entries(row, queries, candidates, scores, others & (scores >= least[:, None]))

    return run


def _resolved(pairs: DataFrame, codes: DataFrame) -> DataFrame:
    """Exact scores of (query_id, vec_id) pairs."""
    left = codes.select(F.col("vec_id").alias("query_id"), F.col("codes").alias("ours"))
    right = codes.select("vec_id", F.col("codes").alias("theirs"))
    product = F.aggregate(F.zip_with("ours", "theirs", lambda a, b: a * b), F.lit(0).cast("long"), lambda s, x: s + x)
    return pairs.join(right, "vec_id").join(left, "query_id").select("query_id", "vec_id", product.alias("score"))


def _ranked(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _laid(rows: pa.Table) -> pa.Table:
    """The cutoffs of one query block, in the order of its ids."""
    ids = np.frombuffer(rows["ids"][0].as_py(), np.int64)
    known = dict(zip(rows["query_id"].to_pylist(), rows["cutoff"].to_pylist(), strict=True))
    laid = np.array([known.get(i, _LEAST) for i in ids.tolist()], np.int64)
    return pa.table(
        {
            "length": rows["length"].slice(0, 1), "query_block": rows["block"].slice(0, 1),
            "cutoffs": pa.array([laid.tobytes()], pa.binary()),
        }
    )


def nearest(vectors: DataFrame, k: int = K, every: int = EVERY, lists: int = LISTS) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest scores of each row whose vec_id is
    divisible by `every`, against all other rows."""
    codes = materialized(quantized(vectors))
    asked = codes.filter(F.col("vec_id") % every == 0)
    candidates, _ = _packed(codes, CANDIDATES, lists, k + 1)
    queries, blocks = _packed(asked, QUERIES, lists, None)
    sent = candidates.withColumn("query_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    waiting = queries.select(
        "length", "list", F.col("block").alias("query_block"), F.col("ids").alias("query_ids"), F.col("parts").alias("query_parts")
    )
    tiles = sent.join(waiting, ["length", "list", "query_block"])
    entry = "list int, query_id long, vec_id long, part long"

    gathered = tiles.select("list", "ids", "parts", "query_ids", "query_parts").mapInArrow(_gather(k), entry)
    known = materialized(_resolved(gathered.select("query_id", "vec_id").distinct(), codes))
    cutoff = _ranked(known, k).filter(F.col("rank") == k).select("query_id", F.col("score").alias("cutoff"))

    block = F.pmod(F.xxhash64(F.lit(3), "query_id"), F.lit(blocks))
    laid = (
        queries.filter("list = 0").select("length", "block", "ids")
        .join(cutoff.withColumn("block", block), "block", "left").select("length", "block", "ids", "query_id", "cutoff")
        .groupBy("length", "block").applyInArrow(_laid, "length int, query_block long, cutoffs binary")
    )
    cut = tiles.join(laid, ["length", "query_block"]).select("list", "ids", "parts", "query_ids", "query_parts", "cutoffs")
    sufficient = cut.mapInArrow(_sufficient(lists), entry)
    seen = sufficient.groupBy("query_id", "vec_id").agg(F.sum("part").alias("seen"), F.count(F.lit(1)).alias("given"))
    # A part that was not given is below cutoff / lists.
    above = F.expr(f"cutoff div {lists} + IF(cutoff % {lists} > 0, 1, 0)")
    at_most = F.col("seen") + (F.lit(lists) - F.col("given")) * above
    hopeful = seen.join(cutoff, "query_id", "left").filter(F.col("cutoff").isNull() | (at_most >= F.col("cutoff")))
    exact = _resolved(hopeful.select("query_id", "vec_id"), codes)
    return _ranked(exact, k).select("query_id", "rank", "vec_id", "score")

