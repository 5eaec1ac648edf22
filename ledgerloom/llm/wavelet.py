"""Token ids in wavelet matrices, written as one compressed file per shard.

Documents are range-partitioned by id; each partition is sorted and written by its
task as one file of blocks. A block holds the ids of consecutive documents as bit
planes: at each level the ids are split by one bit, zeros first, order kept. The
planes, packed and compressed, are all that is stored of the ids, with the counts that
rank needs. Any id, the number of times an id occurs before a place, and the place of
its k-th occurrence are answered from the block alone.

A block ends with the document that brings it to `BLOCK` ids, so a task holds one
block and one batch of texts however large its partition is. Files are written by
Spark, which commits a task's file once, so a lost executor leaves no half file.

Defined results: a null text is empty and has only the end id; null doc_ids come
first; documents with equal ids are ordered by a hash of their text; other columns are
not read; no rows give no rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import document_text, shuffle_partitions
from ledgerloom.llm.tokens import crc32_of_ids, encoder

BLOCK = 1 << 20
END = 0
MAGIC, STRIDE = b"WMX1", 512  # ids between two stored ranks
_HEAD = struct.Struct("<4sIIB")
FILES = "shard int, block int, n_tokens long, payload binary"


class WaveletMatrix:
    """A sequence of ids below 2**levels as bit planes with rank counts."""

    def __init__(self, size: int, planes: list[np.ndarray], zeros: list[int], ranks: list[np.ndarray]) -> None:
        self.size, self.planes, self.zeros, self.ranks = size, planes, zeros, ranks

    @classmethod
    def of(cls, ids: np.ndarray, levels: int | None = None) -> WaveletMatrix:
        levels = levels or max(1, int(ids.max(initial=0)).bit_length())
        planes, zeros, ranks = [], [], []
        for bit in reversed(range(levels)):
            ones = ((ids >> bit) & 1).astype(bool)
            planes.append(np.packbits(ones))
            low, high = np.flatnonzero(~ones), np.flatnonzero(ones)
            zeros.append(len(low))
            ranks.append(np.searchsorted(high, np.arange(0, len(ids) + 1, STRIDE)).astype("<u4"))
            ids = np.concatenate([ids.take(low), ids.take(high)])
        return cls(len(ids), planes, zeros, ranks)

    def ids(self) -> np.ndarray:
        """The whole sequence, undoing the splits from the last level up."""
        out = np.zeros(self.size, np.uint16)
        for bit, (plane, zeros) in enumerate(zip(reversed(self.planes), reversed(self.zeros), strict=True)):
            ones = np.unpackbits(plane, count=self.size).view(bool)
            out[zeros:] |= np.uint16(1 << bit)
            above = np.empty_like(out)
            above[np.flatnonzero(~ones)] = out[:zeros]
            above[np.flatnonzero(ones)] = out[zeros:]
            out = above
        return out

    def _ones(self, level: int, place: int) -> int:
        """Set bits of a level before a place."""
        from_byte = place // STRIDE * (STRIDE // 8)
        bits = np.unpackbits(self.planes[level][from_byte : place // 8 + 1])[: place - from_byte * 8]
        return int(self.ranks[level][place // STRIDE]) + int(bits.sum())

    def _bit(self, level: int, place: int) -> int:
        return int(self.planes[level][place >> 3]) >> (7 - (place & 7)) & 1

    def access(self, place: int) -> int:
        found = 0
        for level in range(len(self.planes)):
            bit, ones = self._bit(level, place), self._ones(level, place)
            found = found << 1 | bit
            place = self.zeros[level] + ones if bit else place - ones
        return found

    def _range(self, symbol: int, place: int) -> tuple[int, int]:
        begin, end = 0, place
        for level in range(len(self.planes)):
            first, last = self._ones(level, begin), self._ones(level, end)
            if symbol >> (len(self.planes) - 1 - level) & 1:
                begin, end = self.zeros[level] + first, self.zeros[level] + last
            else:
                begin, end = begin - first, end - last
        return begin, end

    def rank(self, symbol: int, place: int) -> int:
        """Occurrences of a symbol before a place."""
        if symbol >> len(self.planes):
            return 0
        begin, end = self._range(symbol, place)
        return end - begin

    def count(self, symbol: int) -> int:
        return self.rank(symbol, self.size)

    def select(self, symbol: int, k: int) -> int:
        """The place of the k-th occurrence, counted from 0."""
        if not 0 <= k < self.count(symbol):
            raise IndexError("no such occurrence")
        place = self._range(symbol, self.size)[0] + k
        for level in reversed(range(len(self.planes))):
            wanted = symbol >> (len(self.planes) - 1 - level) & 1
            bits = np.unpackbits(self.planes[level], count=self.size)
            at = np.flatnonzero(bits == wanted)
            place = int(at[place - self.zeros[level] if wanted else place])
        return place

    def to_bytes(self, docs: np.ndarray, known: np.ndarray, ends: np.ndarray) -> bytes:
        """Header, documents (id, whether it has one, end), ranks, and compressed planes."""
        pack = zstandard.ZstdCompressor(level=1)
        out = [_HEAD.pack(MAGIC, self.size, len(docs), len(self.planes))]
        for part in (docs.astype("<i8").tobytes(), known.astype("u1").tobytes(), ends.astype("<u4").tobytes()):
            packed = pack.compress(part)
            out += [struct.pack("<I", len(packed)), packed]
        for plane, zeros, ranks in zip(self.planes, self.zeros, self.ranks, strict=True):
            packed = pack.compress(ranks.tobytes() + plane.tobytes())
            out += [struct.pack("<II", zeros, len(packed)), packed]
        return b"".join(out)

    @classmethod
    def from_bytes(cls, payload: bytes) -> tuple[WaveletMatrix, np.ndarray, np.ndarray, np.ndarray]:
        """The matrix, and the ids, id marks and ends of its documents."""
        magic, size, _, levels = _HEAD.unpack_from(payload)
        if magic != MAGIC:
            raise ValueError("not a wavelet matrix file")
        unpack, at, parts = zstandard.ZstdDecompressor(), _HEAD.size, []
        for _ in range(3):
            (length,) = struct.unpack_from("<I", payload, at)
            parts.append(unpack.decompress(payload[at + 4 : at + 4 + length]))
            at += 4 + length
        planes, zeros, ranks = [], [], []
        for _ in range(levels):
            zero, length = struct.unpack_from("<II", payload, at)
            raw = unpack.decompress(payload[at + 8 : at + 8 + length])
            at += 8 + length
            split = 4 * (size // STRIDE + 1)
            ranks.append(np.frombuffer(raw[:split], "<u4"))
            planes.append(np.frombuffer(raw[split:], np.uint8))
            zeros.append(zero)
        docs, known, ends = np.frombuffer(parts[0], "<i8"), np.frombuffer(parts[1], "u1"), np.frombuffer(parts[2], "<u4")
        return cls(size, planes, zeros, ranks), docs, known.astype(bool), ends.astype(np.int64)


def _with_ends(ids: np.ndarray, bounds: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with an end id behind each text, and where each text then ends."""
    ends = bounds[1:] - bounds[0] + np.arange(1, len(bounds))
    out = np.empty(len(ids) + len(ends), np.uint16)
    inner = np.ones(len(out), bool)
    inner[ends - 1] = False
    out[inner] = ids
    out[ends - 1] = end
    return out, ends


def _blocks(tokenizer: str, block: int, added: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, number = TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        docs: list = []
        ends: list[np.ndarray] = []
        size = 0

        def written() -> pa.RecordBatch:
            matrix = WaveletMatrix.of(np.concatenate(held))
            known = np.array([d is not None for d in docs])
            numbers = np.array([d or 0 for d in docs], np.int64)
            payload = matrix.to_bytes(numbers, known, np.concatenate(ends))
            row = ([shard], [number], [size], [payload])
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary())
            names = ["shard", "block", "n_tokens", "payload"]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names)

        with encoder(tokenizer, added) as coder:
            for batch in batches:
                names = batch.column(0).to_pylist()
                for first, last, ids, bounds in coder.batches(batch.column(1)):
                    ids, stops = _with_ends(ids, bounds, END)
                    begin = 0
                    while begin < last - first:
                        # Documents up to the one that fills the block.
                        base = int(stops[begin - 1]) if begin else 0
                        to = min(int(np.searchsorted(stops, base + block - size)) + 1, last - first)
                        held.append(ids[base : int(stops[to - 1])])
                        ends.append(stops[begin:to] - base + size)
                        docs += names[first + begin : first + to]
                        size += int(stops[to - 1]) - base
                        begin = to
                        if size >= block:
                            yield written()
                            number, size, held, docs, ends = number + 1, 0, [], [], []
        if docs:
            yield written()

    return run


def written(
    docs: DataFrame, tokenizer: str, path: str, shards: int | None = None, block: int = BLOCK, added: bool = False
) -> DataFrame:
    """Write all documents as wavelet matrix files below `path` and open them.

    With `added`, strings of added tokens get the ids of these tokens."""
    text = document_text()
    ranged = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
        .repartitionByRange(shards or shuffle_partitions(docs), "doc_id")
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
    )
    files = ranged.mapInArrow(_blocks(tokenizer, block, added), FILES)
    files.write.option("compression", "uncompressed").parquet(path)
    return opened(docs.sparkSession, path)


def opened(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILES).parquet(path)


def starts(files: DataFrame) -> DataFrame:
    """Per block, the ids of all documents before it; a row per block meets in one task."""
    before = Window.orderBy("shard", "block").rowsBetween(Window.unboundedPreceding, -1)
    return files.select("shard", "block", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("before"))


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for payload, before in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            matrix, docs, known, ends = WaveletMatrix.from_bytes(payload.as_py())
            ids = matrix.ids().astype("<u4")
            begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            crcs = [crc32_of_ids(ids, b, e) for b, e in zip(begins.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(docs, pa.int64(), mask=~known), pa.array(begins + before, pa.int64()),
                    pa.array(ends - begins, pa.int64()), pa.array(crcs, pa.int64()),
                ],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def documents(files: DataFrame) -> DataFrame:
    """Per document, read back from the files: doc_id, start, n_tokens, ids_crc32."""
    placed = files.join(starts(files), ["shard", "block"]).select("payload", "before")
    return placed.mapInArrow(_documents, "doc_id long, start long, n_tokens long, ids_crc32 long")
