"""Toxicity by weak supervision.

Many voters look at a text: single words, word beginnings, and patterns. Those of the
lexicon are mined from labelled documents; each fires or stays silent, none is trusted.
Voters that fire on the same documents beyond what their class explains are correlated
and count as one. A generative label model then estimates, by expectation maximisation
and without taking any label as the truth (the label column is one more voter), how
often each voter fires in toxic and in clean documents, and so the probability that a
document is toxic. A linear classifier on the voters is trained on these posteriors,
and scores every whole text.

Only training looks at labels, and only at documents that are not held out, of which
at most about `SAMPLE` are drawn by a hash. Only voters that fired, as numbers, and one
vote per drawn document come to the driver. Scores read words of the text alone.

Defined results: a null text is empty and scores like any text in which no voter
fires; documents without label are scored and not trained on; a doc_id that is
labelled twice is toxic if one label says so; a null doc_id is not held out; repeated
rows score alike; other columns are not read; without labels the fixed lexicon votes
alone; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import document_text, fresh, materialized, uniform
from ledgerloom.llm.near_dedup import _parts
from ledgerloom.llm.tokens import hashes

SAMPLE = 20_000  # labelled documents that are drawn for training, about
VOTERS, SUPPORT, LIFT = 400, 5, 8.0
BEGINNINGS = (4, 5, 6)  # letters of word beginnings that may become voters
THRESHOLD = 0.7
CORRELATED = 0.5
# Insults that vote in any case.
LEXICON = ("idiot", "idiots", "moron", "stupid", "loser", "scum", "worthless", "pathetic", "disgusting", "bastard", "imbecile")
# Manners of writing.
PATTERNS = (r"!{3,}", r"\b[A-Z]{5,}\b", r"(?i)\byou are an?\b", r"(?i)\bshut up\b", r"(?i)\bi hate\b")
_BREAK = r"[^a-z\x{80}-\x{10FFFF}]+"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


@dataclass(frozen=True)
class Model:
    """Voters with their weights: words, beginnings, patterns, in this order."""

    words: tuple[str, ...]
    beginnings: tuple[str, ...]
    weights: tuple[float, ...]
    bias: float


def _signs(text: Column) -> Column:
    """Words and word beginnings of a text, each once; beginnings end with a star."""
    words = F.array_distinct(F.split(F.lower(text), _BREAK))
    starts = [_starts(words, n) for n in BEGINNINGS]
    return F.array_distinct(F.concat(F.filter(words, lambda w: F.length(w) > 1), *starts))


def _starts(words: Column, n: int) -> Column:
    return F.transform(F.filter(words, lambda w: F.length(w) > n), lambda w: F.concat(F.substring(w, 1, n), F.lit("*")))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Written table: toxic, text of labelled documents that are not held out."""
    marked = (
        labels.filter(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    )
    n = marked.count()
    share = min(1.0, sample / n) if n else 0.0
    drawn = lambda: uniform("doc_id", seed=10) < F.lit(share)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), document_text().alias("text"))
    # Both sides draw by the same hash, so the texts of other documents never move.
    drawn_texts = texts.filter(~held_out(F.col("doc_id"))).filter(drawn())
    return materialized(drawn_texts.join(marked.filter(drawn()), "doc_id").select("toxic", "text"))


def mined(rows: DataFrame, voters: int = VOTERS) -> list[str]:
    """Words and beginnings that are more frequent in toxic documents, the best first."""
    totals = rows.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    n, toxic = totals[0], totals[1] or 0
    if not toxic or toxic == n:
        return []
    counted = rows.select("toxic", F.explode(_signs(F.col("text"))).alias("sign")).groupBy("sign").agg(
        F.sum("toxic").alias("hits"), F.count(F.lit(1)).alias("n")
    )
    lift = (F.col("hits") / F.lit(float(toxic))) / ((F.col("n") - F.col("hits") + 0.5) / F.lit(float(n - toxic)))
    best = counted.filter(F.col("hits") >= SUPPORT).withColumn("lift", lift).filter(F.col("lift") >= LIFT)
    found = best.orderBy((F.col("hits") * F.log("lift")).desc(), "sign").limit(voters).select("sign").collect()
    return [r["sign"] for r in found]


class _Lookup:
    """Finds which voters fire in lower-case texts that lie one after another."""

    def __init__(self, words: tuple[str, ...], beginnings: tuple[str, ...]) -> None:
        whole = [(w.encode(), i) for i, w in enumerate(words)]
        first = [(b.encode(), len(words) + i) for i, b in enumerate(beginnings)]
        self.whole = self._table(whole)
        self.first = {n: self._table([x for x in first if len(x[0]) == n]) for n in sorted({len(b) for b, _ in first})}

    @staticmethod
    def _table(voters: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ends = np.cumsum([len(w) for w, _ in voters], dtype=np.int64)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
        data = np.frombuffer(b"".join(w for w, _ in voters), np.uint8)
        keys = hashes(data, starts, ends) if len(ends) else np.zeros(0, np.uint64)
        order = np.argsort(keys)
        seen = np.zeros(1 << 16, bool)
        seen[(keys & np.uint64(0xFFFF)).astype(np.int64)] = True
        return keys[order], np.array([i for _, i in voters], np.int64)[order], seen

    @staticmethod
    def _find(table: tuple, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, names, seen = table
        if not len(keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        got = hashes(data, starts, ends)
        maybe = np.flatnonzero(seen[(got & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(keys, got[maybe]), len(keys) - 1)
        hit = keys[at] == got[maybe]
        return maybe[hit], names[at[hit]]

    def fired(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, voter) pairs, each once."""
        letter = (data >= 128) | ((data >= 97) & (data <= 122))
        begins, stops = letter.copy(), letter.copy()
        edge = np.zeros(len(data) + 1, bool)
        edge[bounds] = True
        begins[1:] &= ~letter[:-1] | edge[1:-1]
        stops[:-1] &= ~letter[1:] | edge[1:-1]
        starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        found = [self._find(self.whole, data, starts, ends)]
        for n, table in self.first.items():
            longer = np.flatnonzero(ends - starts > n)
            at, names = self._find(table, data, starts[longer], starts[longer] + n)
            found.append((longer[at], names))
        word, voter = (np.concatenate(x) for x in zip(*found, strict=True))
        text = np.searchsorted(bounds, starts[word], "right") - 1
        pairs = np.unique(text << 32 | voter)
        return pairs >> 32, pairs & 0xFFFFFFFF


def _votes(words: tuple[str, ...], beginnings: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = _Lookup(words, beginnings)
        for batch in batches:
            for first, last, data, bounds in _parts(batch.column("lower")):
                text, voter = lookup.fired(data, bounds)
                ends = np.searchsorted(text, np.arange(last - first + 1))
                votes = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(voter, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).slice(first, last - first) for c in ("doc_id", "toxic", "manners")], votes],
                    ["doc_id", "toxic", "manners", "votes"],
                )

    return run


def voted(rows: DataFrame, words: tuple[str, ...], beginnings: tuple[str, ...]) -> DataFrame:
    """doc_id, toxic, and the voters that fire: lexicon voters and patterns."""
    text = F.col("text")
    manners = F.array(*[text.rlike(p) for p in PATTERNS])
    given = rows.select("doc_id", "toxic", manners.alias("manners"), F.lower(text).alias("lower"))
    return given.mapInArrow(
        _votes(words, beginnings), "doc_id long, toxic int, manners array<boolean>, votes array<int>"
    )


def _clusters(votes: np.ndarray, post: np.ndarray) -> np.ndarray:
    """A cluster per voter: voters correlated within the clean or the toxic class share one."""
    n = votes.shape[1]
    label = np.arange(n)
    for weight in (post, 1 - post):
        total = max(weight.sum(), 1e-9)
        mean = (weight @ votes) / total
        both = (votes * weight[:, None]).T @ votes / total
        deviation = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
        linked = (both - np.outer(mean, mean)) / np.outer(deviation, deviation) > CORRELATED
        for i, j in zip(*np.nonzero(np.triu(linked, 1)), strict=True):
            label[label == label[j]] = label[i]
    return np.unique(label, return_inverse=True)[1]


def label_model(votes: np.ndarray, toxic: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Posterior probability of each document to be toxic."""
    post = np.where(toxic > 0, 0.9, 0.02)
    groups = _clusters(votes, post)
    merged = np.zeros((len(votes), groups.max(initial=-1) + 1), np.float64)
    for voter, group in enumerate(groups):
        merged[:, group] = np.maximum(merged[:, group], votes[:, voter])
    merged = np.column_stack([merged, toxic > 0])
    for _ in range(rounds):
        prior = np.clip(post.mean(), 1e-4, 1 - 1e-4)
        fires = [np.clip((w @ merged + 0.1) / (w.sum() + 1.0), 1e-5, 1 - 1e-5) for w in (1 - post, post)]
        odds = np.log(prior / (1 - prior)) + merged @ np.log(fires[1] / fires[0]) + (1 - merged) @ np.log(
            (1 - fires[1]) / (1 - fires[0])
        )
        post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return post


def linear(votes: np.ndarray, target: np.ndarray, penalty: float = 0.05, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model on soft targets, by Newton's method."""
    x = np.column_stack([votes, np.ones(len(votes))])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(ridge), x.T @ (target - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    rows = training_rows(docs, labels, sample)
    signs = mined(rows)
    words = tuple(dict.fromkeys([s for s in signs if not s.endswith("*")] + list(LEXICON)))
    beginnings = tuple(s[:-1] for s in signs if s.endswith("*"))
    drawn = voted(rows.withColumn("doc_id", F.lit(0).cast("long")), words, beginnings)
    found = drawn.select(F.col("toxic").cast("int").alias("toxic"), "manners", "votes").collect()
    n = len(words) + len(beginnings)
    votes = np.zeros((len(found), n + len(PATTERNS)), np.float64)
    toxic = np.zeros(len(found))
    for i, row in enumerate(found):
        votes[i, row["votes"]] = 1
        votes[i, n:] = row["manners"]
        toxic[i] = row["toxic"]
    if not toxic.any():  # nothing to learn from: the fixed lexicon speaks
        return Model(words, beginnings, tuple([4.0] * n + [0.0] * len(PATTERNS)), -3.0)
    weights, bias = linear(votes, label_model(votes, toxic))
    return Model(words, beginnings, tuple(weights.tolist()), bias)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).alias("toxic"), document_text().alias("text")
    )
    found = voted(texts, model.words, model.beginnings)
    n = len(model.words) + len(model.beginnings)
    table = F.array(*[F.lit(w) for w in model.weights])
    odds = F.aggregate("votes", F.lit(model.bias), lambda s, v: s + F.element_at(table, v + 1))
    for i in range(len(PATTERNS)):
        odds = odds + F.when(F.element_at("manners", i + 1), F.lit(model.weights[n + i])).otherwise(F.lit(0.0))
    score = 1 / (1 + F.exp(-odds))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int")
    )


def _kept(model: Model, names: list[str], lower: str, manners: str):
    n = len(model.words) + len(model.beginnings)
    weights = np.array(model.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = _Lookup(model.words, model.beginnings)
        for batch in batches:
            for first, last, data, bounds in _parts(batch.column(lower)):
                text, voter = lookup.fired(data, bounds)
                part = batch.slice(first, last - first)
                ways = np.array(part.column(manners).to_pylist(), np.float64).reshape(last - first, -1)
                odds = model.bias + np.bincount(text, weights=weights[voter], minlength=last - first) + ways @ weights[n:]
                fine = 1 / (1 + np.exp(-odds)) < THRESHOLD
                yield pa.RecordBatch.from_arrays([part.column(c).filter(pa.array(fine)) for c in names], names)

    return run


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that score below the threshold, with their own columns, unmoved."""
    lower, manners = fresh(docs, "lower"), fresh(docs, "manners")
    text = document_text()
    seen = docs.withColumns({lower: F.lower(text), manners: F.array(*[text.rlike(p) for p in PATTERNS])})
    return seen.mapInArrow(_kept(model, docs.columns, lower, manners), docs.schema)
