"""Sum-of-squares packing of whole documents into sequences of fixed length.

Texts become ids, and a document longer than a sequence is cut into full pieces and
a rest. Pieces are dealt by hash into groups of bounded size. Within a group each
piece goes to the open sequence, or opens one, where the sum of the squared counts of
open sequences per gap becomes smallest: gaps stay spread out, so that a piece to come
finds one that it fits. Sequences filled to within `SLACK` are done; pieces of the
others are dealt anew, into fewer groups of the same size, until one group holds the
rest or a round closes less than `WORTH` of its pieces; open sequences are then final,
since pieces that find no partner in one such group find none in the next. Nothing but
lengths takes part in packing, and no group grows with the input.

Defined results: a null text is empty and is one piece, its end id; null or repeated
doc_ids are documents like others; other columns are not read; no rows give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import document_text, materialized
from ledgerloom.llm.tokens import crc32_of_ids, encoder

LENGTH, END = 4096, 1
GROUP = 20_000  # pieces that are packed together, on average; a hash deals them
WORTH = 0.1  # share of its pieces that a round must close for another one to follow
SLACK = 32  # ids a sequence may lack and be done
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut(tokenizer: str, length: int, added: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([END], "<u4").tobytes()
        with encoder(tokenizer, added) as coder:
            for batch in batches:
                names = batch.column(0)
                for first, last, ids, bounds in coder.batches(batch.column(1)):
                    wide = ids.astype("<u4")
                    bounds = bounds - bounds[0]
                    sizes = np.diff(bounds) + 1
                    n = -(-sizes // length)
                    which = np.repeat(np.arange(last - first), n)
                    piece = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                    start = piece * length
                    size = np.minimum(sizes[which] - start, length)
                    crcs = []
                    for at, cut, tail in zip((bounds[which] + start).tolist(), size.tolist(), (start + size == sizes[which]).tolist(), strict=True):
                        crc = crc32_of_ids(wide, at, at + cut - tail)
                        crcs.append(zlib.crc32(end, crc) if tail else crc)
                    yield pa.RecordBatch.from_arrays(
                        [
                            names.slice(first, last - first).take(pa.array(which)), pa.array(piece, pa.int32()),
                            pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crcs, pa.int64()),
                        ],
                        ["doc_id", "piece", "start", "length", "ids_crc32"],
                    )

    return run


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, added: bool = False) -> DataFrame:
    """One row per piece, with the ids of its document before it and the CRC of its own.

    With `added`, strings of added tokens get the ids of these tokens."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), document_text().alias("text"))
    return texts.mapInArrow(_cut(tokenizer, length, added), PIECES)


def sum_of_squares(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece; pieces come longest first.

    `open_at[g]` counts open sequences with gap g. Taking one from gap g to gap g - s
    changes the sum of squares by 2 (open_at[g - s] - open_at[g]) + 2, where a new
    sequence counts as gap `room` with nothing to give up, and gap 0 is closed."""
    open_at = np.zeros(room + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(room + 1)]
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    made = 0
    for item in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[item])
        kept = open_at[: room + 1 - size]  # counts of the gaps that would remain
        change = 2 * (kept - open_at[size:]) + 2
        change[open_at[size:] == 0] = np.iinfo(np.int64).max
        change[-1] = 2 * kept[-1] + 1  # a new sequence
        change[0] -= 1  # a closed sequence counts no more
        left = int(np.argmin(change))
        if left + size == room:
            place, made = made, made + 1
        else:
            place = stacks[left + size].pop()
            open_at[left + size] -= 1
        bins[item], offsets[item] = place, room - left - size
        if left:
            stacks[left].append(place)
            open_at[left] += 1
    return bins, offsets


def _packed(room: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        group = pa.Table.from_batches(parts)
        lengths = group["length"].to_numpy()
        bins, offsets = sum_of_squares(lengths, room)
        fill = np.bincount(bins, weights=lengths).astype(np.int64)
        out = group.select(["uid", "length", "group"]).append_column("bin", pa.array(bins)).append_column(
            "offset", pa.array(offsets)
        ).append_column("fill", pa.array(fill[bins]))
        yield from out.combine_chunks().to_batches()

    return run


def packed(cut: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """Pieces with sequence_id and offset; extra columns of the pieces stay."""
    cut = materialized(cut.withColumn("uid", F.monotonically_increasing_id()))
    schema = "uid long, length long, group long, bin long, offset long, fill long"
    number = lambda turn: F.lit(turn << 56) + F.col("group") * (1 << 24) + F.col("bin")
    rest = cut.filter(F.col("length") < length).select("uid", "length")
    done = [cut.filter(F.col("length") >= length).select("uid", F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    turn, waiting = 1, rest.count()
    while waiting:
        groups = -(-waiting // group)
        dealt = rest.withColumn("group", F.pmod(F.xxhash64(F.lit(turn), "uid"), F.lit(groups)))
        made = materialized(dealt.groupBy("group").applyInArrow(_packed(length), schema))
        is_full = F.col("fill") >= length - SLACK
        left = 0 if groups == 1 else made.filter(~is_full).count()
        if left > (1 - WORTH) * waiting:
            left = 0
        full = is_full if left else F.lit(True)
        done.append(made.filter(full).select("uid", number(turn).alias("sequence_id"), "offset"))
        rest = made.filter(~full).select("uid", "length")
        turn, waiting = turn + 1, left
    placed = done[0]
    for more in done[1:]:
        placed = placed.unionByName(more)
    return cut.join(placed, "uid").drop("uid")
