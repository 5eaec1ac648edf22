"""Ranked lexical search by pipelined term partitioning.

Terms are dealt to owners, one stage each. Documents are numbered within blocks, items
within bundles, and a bundle visits every block of documents: for each (bundle, block) a
set of sparse accumulators, (item, documents, scores), goes from one owner's stage to the
next. A stage is a cogroup of the accumulators with the owner's postings of the block: it
adds integer contributions, nothing else. The last stage has the document ids too and
gives each item's best documents of the block, which one window ranks in the end.

Owners are bands of term weight, rarest terms first. What the later owners can still add
to an item is known from the largest contribution of each term, so an accumulator that
cannot reach the k-th best of its own block any more is left out on the way: exact, with
ties kept, and what travels stays near k per item and block.

Bounds: a block is `BLOCK` documents at most and a bundle `BUNDLE` items, so a group holds
at most BLOCK x BUNDLE scores of 8 bytes, however common its terms are and however many
rows one source has. An owner's part of the queries, which its tasks read, is cut by a
hash of the term into as many stages as it takes to stay near `ENTRIES` entries each.
Postings are counted where texts are read, one row per document and distinct term, and
only those of asked terms are kept; that join is left to measured sizes and to adaptive
execution.

Texts are cut into terms as bytes, since all bytes of characters from U+0080 on belong to
terms; a long text is counted in pieces that end between terms.

Defined results: a null text has no terms; a document or item without terms is not ranked;
rows with one item_id are one item, its terms taken together, and null is an item like
any other; documents are rows, also where doc_ids repeat or are null (null sorts first);
equal scores go by doc_id, then by row; other columns are not read; no documents or no
items give no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import materialized, numbered, released

K, OWNERS = 20, 4
BLOCK_BITS, BUNDLE_BITS = 12, 8
BLOCK, BUNDLE = 1 << BLOCK_BITS, 1 << BUNDLE_BITS
ENTRIES = 250_000  # of (item, term) that the tasks of one stage hold
PIECE = 1 << 20
CHAINED = 8  # stages between two written tables
_DOC_ID = -1  # the term of rows that carry a document id
_STATE = "bundle long, block long, slot short, places binary, scores binary, rest long"
_BEST = "item long, doc_id long, row long, score long"


def _table() -> bytes:
    """Bytes to what they are in a term: letters lower-cased, separators a space."""
    out = bytearray(range(256))
    for b in range(128):
        out[b] = ord(chr(b).lower()) if chr(b).isalnum() else 32
    return bytes(out)


_BYTES = _table()


def term_counts(text: bytes, piece: int = PIECE) -> Counter:
    """How often each term stands in a text."""
    counts: Counter = Counter()
    at = 0
    while at < len(text):
        plain = text[at : at + piece].translate(_BYTES)
        if at + piece < len(text):
            cut = plain.rfind(b" ")
            while cut < 0:  # a term longer than a piece
                more = text[at + len(plain) : at + len(plain) + piece].translate(_BYTES)
                if not more:
                    break
                plain, cut = plain + more, (len(plain) + more.rfind(b" ") if b" " in more else -1)
            plain = plain[: cut + 1] if cut >= 0 else plain
        counts.update(plain.split())
        at += len(plain)
    return counts


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, id, text) to (row, id, n, term, tf): one row per term, and one with an empty term."""
    for batch in batches:
        texts = batch["text"].cast(pa.binary())
        for begin in range(0, batch.num_rows, 256):
            owner, sizes, terms, tfs = [], [], [], []
            for at in range(begin, min(begin + 256, batch.num_rows)):
                counts = term_counts(texts[at].as_py() or b"")
                owner.append(np.full(len(counts) + 1, at, np.int64))
                sizes.append(np.full(len(counts) + 1, sum(counts.values()), np.int64))
                terms += [b"", *counts]
                tfs += [0, *counts.values()]
            of = pa.array(np.concatenate(owner))
            yield pa.RecordBatch.from_arrays(
                [
                    batch["row"].take(of), batch["id"].take(of), pa.array(np.concatenate(sizes)),
                    pa.array(terms, pa.binary()).cast(pa.string()), pa.array(tfs, pa.int64()),
                ],
                ["row", "id", "n", "term", "tf"],
            )


def counted(rows: DataFrame, key: str) -> DataFrame:
    """row, id, n, term, tf of every row; the row with the empty term stands for the text itself."""
    return (
        rows.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("id"), F.col("text").cast("string").alias("text"))
        .mapInArrow(_counted, "row long, id long, n long, term string, tf long")
    )


def _asked(items: DataFrame, scratch: list[str]) -> tuple[DataFrame, DataFrame]:
    """Numbered items (item, item_id), and their terms (item, term, times)."""
    counts = materialized(counted(items, "item_id").filter("tf > 0").groupBy("id", "term").agg(F.sum("tf").alias("times")), scratch)
    ids = materialized(numbered(counts.select(F.col("id").alias("item_id")).distinct(), [], ["item_id"], "item"), scratch)
    terms = counts.join(ids, F.col("id").eqNullSafe(F.col("item_id"))).select("item", "term", "times")
    return ids, materialized(terms, scratch)


def _weight(docs: int, df: Column) -> Column:
    return F.floor(1000 * F.log(F.lit(2.0 * docs + 2) / (2 * df + 1).cast("double"))).cast("long")


class _Queries:
    """One owner's part of the queries: by term, the items that ask for it."""

    def __init__(self, entries: list) -> None:
        rows = np.array([tuple(e) for e in entries], np.int64).reshape(len(entries), 4)
        rows = rows[np.argsort(rows[:, 0], kind="stable")]
        self.items, self.gains, self.rests = rows[:, 1], rows[:, 2], rows[:, 3]
        self.terms, self.firsts = np.unique(rows[:, 0], return_index=True)
        self.ends = np.append(self.firsts[1:], len(rows))

    def of(self, bundle: int, term: int) -> slice | np.ndarray:
        at = np.searchsorted(self.terms, term)
        if at == len(self.terms) or self.terms[at] != term:
            return np.zeros(0, np.int64)
        where = np.arange(self.firsts[at], self.ends[at])
        return where[self.items[where] >> BUNDLE_BITS == bundle]


def _added(queries, left: pa.Table, right: pa.Table) -> tuple:
    """Scores of a bundle on a block, what may still be added per item, ids by place, and the key."""
    known = left if left.num_rows else right
    bundle, block = known["bundle"][0].as_py(), known["block"][0].as_py()
    scores, rest = {}, {}
    for slot, places, parts, more in zip(*(left[c].to_pylist() for c in ("slot", "places", "scores", "rest")), strict=True):
        scores[slot] = np.zeros(BLOCK, np.int64)
        scores[slot][np.frombuffer(places, np.uint16)] = np.frombuffer(parts, np.int64)
        rest[slot] = more
    terms, places, parts = (right[c].to_numpy() for c in ("term_id", "place", "part"))
    order = np.argsort(terms, kind="stable")
    terms, places, parts = terms[order], places[order], parts[order]
    ids = None
    starts = np.flatnonzero(np.append(True, terms[1:] != terms[:-1])) if len(terms) else np.zeros(0, np.int64)
    for begin, end in zip(starts, np.append(starts[1:], len(terms)), strict=True):
        if terms[begin] == _DOC_ID:
            ids = (places[begin:end], parts[begin:end], right["known"].to_numpy(zero_copy_only=False)[order[begin:end]])
            continue
        for at in queries.value.of(bundle, terms[begin]):
            slot = int(queries.value.items[at]) & (BUNDLE - 1)
            if slot not in scores:
                scores[slot] = np.zeros(BLOCK, np.int64)
            # A document has one posting per term, so places do not repeat here.
            scores[slot][places[begin:end]] += queries.value.gains[at] * parts[begin:end]
            rest[slot] = int(queries.value.rests[at])
    return bundle, block, scores, rest, ids


def _stage(queries, k: int):
    """Accumulators on to the next owner."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        bundle, block, scores, rest, _ = _added(queries, left, right)
        rows = []
        for slot, values in scores.items():
            reached = np.flatnonzero(values)
            if len(reached) > k:
                least = np.partition(values[reached], -k)[-k]
                reached = reached[values[reached] + rest[slot] >= least]
            if len(reached):
                rows.append((bundle, block, slot, reached.astype(np.uint16).tobytes(), values[reached].tobytes(), rest[slot]))
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        kinds = [pa.int64(), pa.int64(), pa.int16(), pa.binary(), pa.binary(), pa.int64()]
        return pa.Table.from_arrays(
            [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], ["bundle", "block", "slot", "places", "scores", "rest"]
        )

    return run


def _last(queries, k: int):
    """The owner that comes last has document ids as well and gives the best of the block."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        bundle, block, scores, _, ids = _added(queries, left, right)
        out = []
        if ids is not None:
            doc_ids, known = np.zeros(BLOCK, np.int64), np.zeros(BLOCK, bool)
            doc_ids[ids[0]], known[ids[0]] = ids[1], ids[2]
            for slot, values in scores.items():
                reached = np.flatnonzero(values > 0)
                best = reached[np.lexsort((reached, doc_ids[reached], known[reached], -values[reached]))][:k]
                item = bundle << BUNDLE_BITS | slot
                out.append((np.full(len(best), item), doc_ids[best], ~known[best], best + (block << BLOCK_BITS), values[best]))
        item, doc, unknown, row, score = (np.concatenate(c) for c in zip(*out, strict=True)) if out else [np.zeros(0, np.int64)] * 5
        return pa.Table.from_arrays(
            [pa.array(item), pa.array(doc, mask=unknown.astype(bool)), pa.array(row), pa.array(score)], ["item", "doc_id", "row", "score"]
        )

    return run


def search(docs: DataFrame, items: DataFrame, k: int = K, owners: int = OWNERS, entries: int = ENTRIES) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item, with scores above 0."""
    spark, scratch = docs.sparkSession, []
    named, wanted = _asked(items, scratch)
    # The empty term stands for a document itself; everyone asks for it.
    vocabulary = materialized(
        wanted.select("term").distinct().select("term", F.monotonically_increasing_id().alias("term_id"))
        .unionByName(spark.range(1).select(F.lit("").alias("term"), F.lit(_DOC_ID).cast("long").alias("term_id"))),
        scratch,
    )
    postings = materialized(counted(docs, "doc_id").join(vocabulary, "term").select("row", "id", "n", "term_id", "tf"), scratch)

    sizes = postings.filter(F.col("term_id") == _DOC_ID).agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("length")).first()
    total, length = sizes["docs"] or 0, max(sizes["length"] or 0, 1)
    m = f"(100 - 25 + (25 * n * {total}) div {length})"
    parts = postings.withColumn("part", F.expr(f"(1000000000 * tf) div (1000 * tf + 12 * {m})"))
    # What an entry adds at most, then the owner of each term: a band of weights, cut where it is large.
    found = (
        parts.filter(F.col("term_id") != _DOC_ID).groupBy("term_id").agg(F.count(F.lit(1)).alias("df"), F.max("part").alias("most"))
        .withColumn("weight", _weight(total, F.col("df")))
    )
    top = int(1000 * np.log(2.0 * total + 2)) + 1
    band = F.greatest(F.lit(0), F.least(F.lit(owners - 1), F.expr(f"({top} - weight) * {owners} div {top}")))
    entry = materialized(
        wanted.join(vocabulary, "term").join(found, "term_id").filter("weight > 0")
        .select("item", "term_id", (F.col("times") * F.col("weight")).alias("gain"), "most", band.cast("int").alias("band")),
        scratch,
    )
    cuts = {r["band"]: -(-r["n"] // entries) for r in entry.groupBy("band").agg(F.count(F.lit(1)).alias("n")).collect()}
    stages = [(b, c) for b in range(owners) for c in range(cuts.get(b, 0))]
    cut = F.lit(0)
    for b, n in cuts.items():
        cut = F.when(F.col("band") == b, F.pmod(F.xxhash64(F.lit(5), "term_id"), F.lit(n)).cast("int")).otherwise(cut)
    number = F.lit(-1)
    for at, (b, c) in enumerate(stages):
        number = F.when((F.col("band") == b) & (cut == c), F.lit(at)).otherwise(number)
    later = Window.partitionBy("item").orderBy(F.col("stage").desc()).rowsBetween(Window.unboundedPreceding, -1)
    staged = entry.withColumn("stage", number)
    rests = (
        staged.groupBy("item", "stage").agg(F.sum(F.col("gain") * F.col("most")).alias("most"))
        .select("item", "stage", F.coalesce(F.sum("most").over(later), F.lit(0)).alias("rest"))
    )
    asked = materialized(staged.drop("most").join(rests, ["item", "stage"]), scratch)
    bundles = asked.select("stage", "term_id", F.shiftright("item", BUNDLE_BITS).alias("bundle")).distinct()
    block, place = F.shiftright("row", BLOCK_BITS).alias("block"), F.col("row").bitwiseAND(F.lit(BLOCK - 1)).cast("int").alias("place")
    laid = materialized(
        parts.join(bundles, "term_id").select("stage", "bundle", block, place, "term_id", "part", F.lit(True).alias("known")), scratch, by="stage"
    )
    ids = laid.select("bundle", "block").distinct().join(
        postings.filter(F.col("term_id") == _DOC_ID).select(block, place, "term_id", "id"), "block"
    ).select("bundle", "block", "place", "term_id", F.coalesce("id", F.lit(0)).alias("part"), F.col("id").isNotNull().alias("known"))

    state, best = spark.createDataFrame([], _STATE), spark.createDataFrame([], _BEST)
    for at in range(len(stages)):
        # Bounded: about `entries` rows of four longs.
        queries = spark.sparkContext.broadcast(_Queries(asked.filter(F.col("stage") == at).select("term_id", "item", "gain", "rest").collect()))
        held = laid.filter(F.col("stage") == at).drop("stage")
        if at + 1 == len(stages):
            held = held.unionByName(ids)
        both = state.groupBy("bundle", "block").cogroup(held.groupBy("bundle", "block"))
        if at + 1 == len(stages):
            best = both.applyInArrow(_last(queries, k), _BEST)
        else:
            state = both.applyInArrow(_stage(queries, k), _STATE)
            if at % CHAINED == CHAINED - 1:
                state = materialized(state, scratch)
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first(), "row")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    chosen = materialized(ranked.join(named, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    released(spark, scratch)
    return chosen
