"""Near duplicates by BagMinHash: weighted Jaccard over multisets of word shingles.

A document is the multiset of its shingles of five words. BagMinHash draws, for each
shingle, points in time and weight from Poisson processes: the weight axis is split
into octaves [0, 1), [1, 2), [2, 4), [4, 8) ..., each with a process of its own that
depends on the shingle alone, and a point counts for a document when it lies below
the shingle's multiplicity there. A point falls on one of `REGISTERS` registers, and
a register keeps its earliest point. Two documents agree in a register with a
probability equal to their weighted Jaccard similarity. Points after the time at which
all registers are filled need not be drawn, so that a document costs its shingles plus
about m log m points.

Registers are banded, `ROWS` to a band, in `BANDS` bands: a pair of similarity 0.8 meets in none of the
bands with a probability of 3e-6. Pairs are verified on their whole multisets. All
pairs of a bucket are never listed while they need not be: each bucket has a leader,
the member that shares most large buckets with others, and a document is first compared
with the leader of most of its buckets.
Linked documents become components. Members outside a bucket's largest component are
then compared with members inside, drawn anew for each bucket and turn. Members that are
in different components after that are compared with all of their bucket: packed into
blocks, block against block, by products of matrices within a task, which gives away only
links that join components. So no link that joins two classes is lost but where bands
lose it. Equal texts are one node from the start.

A text is signed as a whole, with some 40 bytes of memory per byte of it; texts share a
part of `PART_BYTES` otherwise.

Defined results: a null text is empty; texts without words are in a class with equal
texts only; a text of fewer than five words is one shingle; words are parted by white
space and control characters of ASCII; null or repeated doc_ids are rows like others,
and a class is named by its smallest doc_id; other columns are not read; no rows give
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import document_text, fresh, keyed, materialized, moved_alike, released
from ledgerloom.llm.tokens import hashes

WORDS, SIMILAR = 5, 0.8
BANDS, ROWS = 24, 4
REGISTERS = BANDS * ROWS
LEADERS = 3
BLOCK, BLOCK_ELEMENTS = 256, 1 << 18  # members and elements of a block in the last comparison, on average
COLUMNS = 8192  # elements that are compared at once
PART_BYTES = 1 << 20  # of texts that are drawn together
_PART = np.uint64(48)
_DOCS = 4096  # documents drawn together at most, with REGISTERS x 8 bytes each
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _weights(n: int) -> np.ndarray:
    return _mixed(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of texts that lie one after another: text, 48-bit hash, multiplicity."""
    gap = data <= 32
    begins, stops = ~gap, ~gap
    begins[1:] &= gap[:-1] | _edges(offsets, len(data))[1:-1]
    stops[:-1] &= gap[1:] | _edges(offsets, len(data))[1:-1]
    first, last = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    words = hashes(data, first, last)
    edge = np.searchsorted(first, offsets)  # words before each text
    count = np.diff(edge)
    made = np.where(count >= WORDS, count - WORDS + 1, np.minimum(count, 1))
    text = np.repeat(np.arange(len(count)), made)
    at = edge[text] + np.arange(len(text)) - np.repeat(np.cumsum(made) - made, made)
    whole = np.zeros(len(text), np.uint64)
    short = count[text] < WORDS
    padded = np.concatenate([words, np.zeros(WORDS, np.uint64)])
    for k, weight in enumerate(_weights(WORDS)):
        part = padded[at + k] * weight
        if short.any():
            part[short & (at + k >= edge[text + 1])] = 0
        whole += part
    both = np.sort(text.astype(np.uint64) << _PART | _mixed(whole) >> np.uint64(16))
    new = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
    return (both[new] >> _PART).astype(np.int64), both[new] & np.uint64((1 << 48) - 1), np.diff(np.append(new, len(both)))


def _edges(offsets: np.ndarray, n: int) -> np.ndarray:
    """Marks at places 0 to n where a text begins or ends."""
    marks = np.zeros(n + 1, bool)
    marks[offsets] = True
    return marks


def bag_min_hash(text: np.ndarray, shingle: np.ndarray, times: np.ndarray, n: int) -> np.ndarray:
    """Signatures of n texts: per register the time of its earliest point, as bits."""
    m = REGISTERS
    weight = np.bincount(text, weights=times, minlength=n)
    with np.errstate(divide="ignore"):
        limit = m * (np.log(m) + 4) / weight
    signature = np.full(n * m, np.iinfo(np.uint64).max, np.uint64)
    octaves = 1 + np.ceil(np.log2(np.maximum(times, 1))).astype(np.int64)
    unit = np.repeat(np.arange(len(text)), octaves)
    octave = np.arange(len(unit)) - np.repeat(np.cumsum(octaves) - octaves, octaves)
    low = np.where(octave > 0, 1 << np.maximum(octave - 1, 0), 0)  # where the octave begins
    seed = _mixed(shingle[unit] * np.uint64(64) + octave.astype(np.uint64))
    of, upto = text[unit], times[unit]
    open_texts = weight > 0
    while open_texts.any():
        here = np.flatnonzero(open_texts[of])
        now = np.zeros(len(here))
        draw = 0
        while len(here):
            drawn = _mixed(seed[here] + _weights(draw + 1)[draw])
            wide = np.maximum(low[here], 1)
            now = now - np.log(((drawn >> np.uint64(11)).astype(np.float64) + 1) / (1 << 53)) / wide
            alive = now <= limit[of[here]]
            here, now, drawn, wide = here[alive], now[alive], drawn[alive], wide[alive]
            other = _mixed(drawn ^ _MIX[0])
            level = low[here] + (other & np.uint64(0xFFFFFFFF)).astype(np.int64) % wide
            holds = level < upto[here]
            slot = of[here] * m + ((other >> np.uint64(32)) % np.uint64(m)).astype(np.int64)
            np.minimum.at(signature, slot[holds], now[holds].view(np.uint64))
            draw += 1
        unfilled = (signature.reshape(n, m) == np.iinfo(np.uint64).max).any(axis=1)
        open_texts &= unfilled
        limit = limit * 2
    return signature.reshape(n, m)


def _bands(signature: np.ndarray) -> np.ndarray:
    cells = signature[:, : BANDS * ROWS].reshape(len(signature), BANDS, ROWS)
    keys = (cells * _weights(ROWS)).sum(axis=2, dtype=np.uint64)
    return _mixed(keys + _weights(BANDS)).view(np.int64)


def _parts(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, one past the last, bytes, bounds) of texts, in parts of bounded size."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        to = int(np.searchsorted(offsets, offsets[at] + PART_BYTES, "left"))
        to = min(max(to, at + 1), at + _DOCS, len(texts))
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, data, bounds in _parts(batch.column("text")):
            n = last - first
            text, shingle, times = shingles(data, bounds)
            weight = np.bincount(text, weights=times, minlength=n).astype(np.int64)
            signature = bag_min_hash(text, shingle, times, n)[weight > 0]
            ends = np.concatenate([[0], np.cumsum(np.where(weight > 0, BANDS, 0))])
            bands = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(_bands(signature).ravel()))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).slice(first, n) for c in ("row_id", "doc_id", "key")], pa.array(weight), bands],
                ["row_id", "doc_id", "key", "weight", "bands"],
            )


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Multisets as sets: the k-th copy of a shingle is an element of its own."""
    for batch in batches:
        for first, last, data, bounds in _parts(batch.column("text")):
            text, shingle, times = shingles(data, bounds)
            copy = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            each = _mixed(np.repeat(shingle, times) + _mixed(copy.astype(np.uint64) + np.uint64(1)))
            ends = np.concatenate([[0], np.cumsum(np.bincount(text, weights=times, minlength=last - first))])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key").slice(first, last - first),
                    pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(each.view(np.int64))),
                ],
                ["key", "elements"],
            )


def _keys(docs: DataFrame) -> DataFrame:
    text = document_text()
    return docs.select(F.unhex(F.md5(text)).alias("key"), text.alias("text"))


def signed(docs: DataFrame, row: str | None = None) -> DataFrame:
    """Written table: row_id, doc_id, key of the text, weight, band keys."""
    text = document_text()
    row_id = F.monotonically_increasing_id() if row is None else F.col(row)
    given = docs.select(
        row_id.alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text)).alias("key"),
        text.alias("text"),
    )
    return materialized(
        given.mapInArrow(_sign, "row_id long, doc_id long, key binary, weight long, bands array<long>")
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node on an edge (one, two), by large and small stars."""
    now = edges.select(F.greatest("one", "two").alias("node"), F.least("one", "two").alias("to")).distinct()
    now, before = materialized(now), None
    while True:
        both = now.unionByName(now.select(F.col("to").alias("node"), F.col("node").alias("to")))
        least = both.groupBy("node").agg(F.least(F.min("to"), F.col("node")).alias("least"))
        large = both.filter("to > node").join(least, "node").select(F.col("to").alias("node"), F.col("least").alias("to"))
        large = materialized(large.filter("node != to").distinct())
        least = large.groupBy("node").agg(F.min("to").alias("least"))
        joined = large.join(least, "node")
        small = joined.select(F.col("to").alias("node"), F.col("least").alias("to")).unionByName(
            least.select("node", F.col("least").alias("to"))
        )
        now = materialized(small.filter("node != to").distinct())
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("node", "to").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    labels = now.groupBy("node").agg(F.min("to").alias("component"))
    roots = now.select(F.col("to").alias("node")).distinct().join(labels.select("node"), "node", "left_anti")
    return materialized(labels.unionByName(roots.select("node", F.col("node").alias("component"))))


def _measured(pairs: DataFrame, elements: DataFrame) -> DataFrame:
    """The pairs (one, two) with the similarity of their multisets."""
    side = lambda name, short: elements.select(
        F.col("node").alias(name), F.col("weight").alias(f"weight_{short}"), F.col("elements").alias(short)
    )
    met = pairs.join(side("one", "a"), "one").join(side("two", "b"), "two")
    common = F.size(F.array_intersect("a", "b"))
    similarity = common / (F.col("weight_a") + F.col("weight_b") - common)
    return materialized(met.select("one", "two", similarity.alias("similarity")))


def links(signatures: DataFrame, docs: DataFrame, similar: float = SIMILAR) -> tuple[DataFrame, DataFrame]:
    """(row_id, node) of every document, and (node, component) of linked nodes.

    A node stands for equal texts and is the smallest row_id of them."""
    nodes = signatures.groupBy("key").agg(F.min("row_id").alias("node"))
    members = materialized(signatures.select("row_id", "doc_id", "key", "weight").join(nodes, "key"))
    of_node = signatures.join(members.filter("row_id = node").select("row_id"), "row_id", "left_semi")
    scratch: list[str] = []
    banded = materialized(of_node.select(F.col("row_id").alias("node"), F.explode("bands").alias("bucket")), scratch)
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    met = materialized(banded.join(shared, "bucket"))
    released(docs.sparkSession, scratch)
    met_nodes = met.groupBy("node").agg(F.sum(F.log2("members")).alias("central"))
    met = materialized(met.select("bucket", "node").join(met_nodes, "node"))

    wanted = members.filter("row_id = node").join(met_nodes.select("node"), "node", "left_semi").select("key", "node", "weight")
    wanted = materialized(wanted)
    texts = _keys(docs).join(moved_alike(wanted.select("key")), "key", "left_semi")
    counted = texts.mapInArrow(_elements, "key binary, elements array<long>")
    elements = materialized(counted.join(wanted, "key").select("node", "weight", "elements").dropDuplicates(["node"]))

    component = materialized(met_nodes.select("node", F.col("node").alias("component")))
    for turn in range(LEADERS + 1):
        tagged = materialized(met.join(component, "node"))
        sizes = tagged.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
        main = sizes.groupBy("bucket").agg(
            F.max(F.struct("n", F.bitwise_not("component").alias("id"))).alias("most"), F.count(F.lit(1)).alias("parts")
        ).filter("parts > 1").select("bucket", F.bitwise_not("most.id").alias("main"))
        shared = materialized(tagged.join(main, "bucket"))
        if shared.isEmpty():
            break
        if turn < LEADERS:
            led = _led(shared.filter("component != main") if turn else shared, _leaders(shared if turn == 0 else shared.filter("component = main"), turn))
            measured = _measured(_one_each(led).select(*_pair("node", "lead")).distinct(), elements)
            found = measured.filter(F.col("similarity") >= similar).select("one", "two")
        else:
            found = _tiled(shared, elements, similar)
        component = _merged(component, found)
    return members, component


def _tiled(shared: DataFrame, elements: DataFrame, similar: float) -> DataFrame:
    """Links that join components among members of buckets with more than one.

    Members outside the main component of any of their buckets are minor, the others
    major. Either kind is packed into blocks, by the largest bucket a member is in, and
    a block of minor members meets each block with which it shares a bucket, once. All
    multisets of two blocks are compared in one task, and only as many links leave it as
    join components there. A multiset thus moves once per block it meets, not per pair."""
    sizes = shared.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"))
    homes = shared.join(sizes, "bucket").groupBy("node").agg(
        F.max(F.struct("size", "bucket")).alias("home"), F.max(F.col("component") != F.col("main")).alias("minor"),
        F.max("component").alias("component"),
    ).select("node", "component", "minor", F.col("home.bucket").alias("home"))
    held = homes.join(elements, "node")
    room = held.groupBy("home", "minor").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)), F.ceil(F.sum("weight") / F.lit(BLOCK_ELEMENTS))).alias("blocks")
    )
    chunk = F.pmod(F.xxhash64(F.lit(7), "node"), "blocks")
    dealt = materialized(
        held.join(room, ["home", "minor"]).withColumn("block", F.xxhash64(F.lit(8), "home", "minor", chunk))
        .select("node", "component", "minor", "block", "weight", "elements")
    )
    # A block has BLOCK members on average. Two blocks whose names collide are one larger block.
    blocks = materialized(
        dealt.groupBy("block").agg(
            F.collect_list("component").alias("components"), F.collect_list("weight").alias("weights"),
            F.flatten(F.collect_list("elements")).alias("elements"),
        )
    )
    places = shared.select("bucket", "node").join(dealt.select("node", "block", "minor"), "node").groupBy("bucket", "block").agg(
        F.max("minor").alias("minor")
    )
    one = places.filter("minor").select("bucket", F.col("block").alias("one"))
    two = places.select("bucket", F.col("block").alias("two"), F.col("minor").alias("also"))
    tiles = one.join(two, "bucket").filter("NOT also OR one <= two").select("one", "two").distinct()
    side = lambda name, short: blocks.select(
        F.col("block").alias(name), *[F.col(c).alias(f"{c}_{short}") for c in ("components", "weights", "elements")]
    )
    compared = tiles.join(side("one", "a"), "one").join(side("two", "b"), "two").drop("one", "two")
    return compared.mapInArrow(_compared(similar), "one long, two long").distinct()


def _compared(similar: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links: list[tuple[int, int]] = []
            for row in range(batch.num_rows):
                sides = []
                for short in "ab":
                    parts = [batch[f"{c}_{short}"][row].values.to_numpy() for c in ("components", "weights", "elements")]
                    sides.append((*parts, np.repeat(np.arange(len(parts[1])), parts[1])))
                links += _joining(*sides, similar)
            yield pa.RecordBatch.from_arrays(
                [pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], ["one", "two"]
            )

    return run


def _joining(left: tuple, right: tuple, similar: float) -> list[tuple[int, int]]:
    """Links between components of two blocks, no more than it takes to join them."""
    common = np.zeros((len(left[0]), len(right[0])), np.float32)
    both = np.intersect1d(left[2], right[2])
    for at in range(0, len(both), COLUMNS):
        columns = both[at : at + COLUMNS]
        matrices = []
        for components, _, elements, member in (left, right):
            place = np.minimum(np.searchsorted(columns, elements), len(columns) - 1)
            hit = columns[place] == elements
            matrix = np.zeros((len(components), len(columns)), np.float32)
            matrix[member[hit], place[hit]] = 1
            matrices.append(matrix)
        common += matrices[0] @ matrices[1].T
    total = left[1][:, None] + right[1][None, :]
    common = common.astype(np.float64)
    near = (common / np.maximum(total - common, 1) >= similar) & (left[0][:, None] != right[0][None, :])
    i, j = np.nonzero(near)
    head: dict[int, int] = {}

    def top(x: int) -> int:
        while head.get(x, x) != x:
            head[x] = head.get(head[x], head[x])
            x = head[x]
        return x

    found = []
    for a, b in set(zip(left[0][i].tolist(), right[0][j].tolist(), strict=True)):
        one, two = top(a), top(b)
        if one != two:
            head[max(one, two)] = min(one, two)
            found.append((a, b))
    return found


def _leaders(able: DataFrame, turn: int) -> DataFrame:
    """A leader per bucket and its component: the most central member first, then any
    member, another one in each bucket and turn."""
    order = F.col("central") if turn == 0 else F.xxhash64("node", "bucket", F.lit(turn)).cast("double")
    first = able.groupBy("bucket").agg(
        F.max(F.struct(order.alias("order"), F.bitwise_not("node").alias("id"), F.col("component").alias("of"))).alias("first")
    )
    return first.select("bucket", F.bitwise_not("first.id").alias("lead"), F.col("first.of").alias("of"))


def _pair(one: str, two: str) -> list[Column]:
    return [F.least(one, two).alias("one"), F.greatest(one, two).alias("two")]


def _led(rows: DataFrame, leading: DataFrame) -> DataFrame:
    """Rows with the leader of their bucket, where it is another document."""
    return rows.join(leading, "bucket").filter("component != of").select("node", "lead")


def _one_each(led: DataFrame) -> DataFrame:
    """One leader per node: the one that leads most of its buckets."""
    often = led.groupBy("node", "lead").agg(F.count(F.lit(1)).alias("n"))
    best = often.groupBy("node").agg(F.max(F.struct("n", F.bitwise_not("lead").alias("id"))).alias("best"))
    return best.select("node", F.bitwise_not("best.id").alias("lead"))


def _merged(component: DataFrame, found: DataFrame) -> DataFrame:
    """Components after the links that were found join some of them."""
    label = lambda side: component.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}"))
    linked = found.join(label("one"), "one").join(label("two"), "two").select(
        F.col("of_one").alias("one"), F.col("of_two").alias("two")
    )
    new = components(linked.filter("one != two")).select(F.col("node").alias("component"), F.col("component").alias("joined"))
    return materialized(
        component.join(new, "component", "left").select("node", F.coalesce("joined", "component").alias("component"))
    )


def near_duplicates(docs: DataFrame, row: str | None = None, similar: float = SIMILAR) -> DataFrame:
    """One row per document: row_id, doc_id, class_id, class_size, kept.

    Classes are joined by links of similarity `similar` or more. The document with the
    smallest doc_id of a class stays, of equal ids the first row."""
    signatures = signed(docs, row)
    members, component = links(signatures, docs, similar)
    placed = materialized(
        members.join(component, "node", "left")
        .select("row_id", "doc_id", F.coalesce("component", "node").alias("component"))
    )
    best = placed.groupBy("component").agg(
        F.count(F.lit(1)).alias("class_size"),
        F.max(F.struct(F.bitwise_not("doc_id").alias("id"), F.bitwise_not("row_id").alias("row"))).alias("best"),
    )
    return placed.join(best, "component").select(
        "row_id", "doc_id", F.bitwise_not("best.id").alias("class_id"), "class_size",
        (F.col("row_id") == F.bitwise_not("best.row")).alias("kept"),
    )


def without_near_copies(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """One document of each class, with its own columns."""
    row = fresh(docs, "row_id")
    copy = keyed(docs, row)
    kept = materialized(near_duplicates(copy, row, similar).filter("kept").select(F.col("row_id").alias(row)))
    return copy.join(moved_alike(kept), row, "left_semi").drop(row)
