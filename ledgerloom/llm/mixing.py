"""Mixing sources, languages and topics to target token weights by raking.

Token counts are summed per cell (source, language, topic). Iterative proportional
fitting scales the cells to each margin's target in turn until all margins agree.
A cell's calibrated multiplier is its fitted weight over its share of tokens; a document
is kept `expected` = budget x multiplier times on average: as many times as that is
whole, and once more by lot for the fraction. Mass above one is thus carried by copies
and not cut off, so that the expected tokens meet the budget and every margin at once.
How often a document is kept depends on its id and text and on the cells alone, so a
rerun keeps the same.

Only the first sum reads documents, and it combines before the shuffle, so that a
source with a third of all rows is no hot key. Everything iterative runs on cells,
as a table; the driver sees the largest deviation and a few sums.

Defined results: null source, language or topic is a value of its own; a document
without words has no tokens and the probability of its cell; rows that repeat are
treated alike; targets that no document matches are left out and the rest scaled up;
no rows give no rows. Where no table of weights meets all margins, fitting stops after
`ROUNDS` and the last margin raked holds.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import document_text, fresh, materialized, uniform

MARGINS = ("source", "lang", "topic")
TEMPER = 0.5  # a margin's default target is its token share to this power
BUDGET = 0.5  # share of all tokens to keep
CLOSE, ROUNDS, STEP = 1e-6, 60, 4
CELLS = 100_000


def topic(text: Column) -> Column:
    """A coarse topic where none is given: figures, lists, notes, articles or books."""
    digits = F.length(text) - F.length(F.translate(text, "0123456789", ""))
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    size = F.length(text)
    return (
        F.when(size == 0, "empty").when(digits * 20 > size, "figures").when(lines * 60 > size, "lists")
        .when(size < 800, "notes").when(size < 8000, "articles").otherwise("books")
    )


def tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+")).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """One small row per document: id, margins, tokens, and the lot it draws."""
    text = document_text()
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", topic(text).alias("topic"),
        tokens(text).alias("n_tokens"), uniform("doc_id", text, seed=5).alias("lot"),
    )


def _targets(cells: DataFrame, margin: str, wanted: Mapping[str, float] | None) -> DataFrame:
    """Cells with the share their value of `margin` should have."""
    per = Window.partitionBy(margin)
    if wanted is None:
        raw = F.pow(F.sum("cell_tokens").over(per).cast("double"), F.lit(TEMPER))
    else:
        raw = F.lit(0.0)
        for value, share in wanted.items():
            raw = F.when(F.col(margin).eqNullSafe(F.lit(value)), F.lit(float(share))).otherwise(raw)
    return cells.withColumn(f"raw_{margin}", raw)


def _laid(cells: DataFrame) -> DataFrame:
    """The cells in partitions of about CELLS rows. Windows over one partition need
    no exchange, so that few cells take one task per round and many are dealt out."""
    return cells.coalesce(1 + cells.count() // CELLS)


def raked(cells: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None) -> DataFrame:
    """Cells (margins, cell_tokens) with `weight`, which sums to one and meets the targets."""
    targets = targets or {}
    cells = cells.filter("cell_tokens > 0")
    for margin in MARGINS:
        cells = _targets(cells, margin, targets.get(margin))
    for margin in MARGINS:
        cells = cells.filter(F.col(f"raw_{margin}") > 0)
    cells = _laid(materialized(cells))
    total = cells.agg(F.sum("cell_tokens")).first()[0] or 1
    # Each value of a margin counts once in the sum of its targets.
    for margin in MARGINS:
        sums = cells.groupBy(margin).agg(F.max(f"raw_{margin}").alias("raw")).agg(F.sum("raw")).first()[0] or 1.0
        cells = cells.withColumn(f"target_{margin}", F.col(f"raw_{margin}") / F.lit(float(sums))).drop(f"raw_{margin}")
    fitted = cells.withColumn("weight", F.col("cell_tokens") / F.lit(float(total)))
    for _ in range(ROUNDS // STEP):
        for _ in range(STEP):
            for margin in MARGINS:
                now = F.sum("weight").over(Window.partitionBy(margin))
                fitted = fitted.withColumn("weight", F.col("weight") * F.col(f"target_{margin}") / now)
        fitted = _laid(materialized(fitted))
        off = fitted
        for margin in MARGINS:
            now = F.sum("weight").over(Window.partitionBy(margin))
            off = off.withColumn(f"off_{margin}", F.abs(now / F.col(f"target_{margin}") - 1))
        worst = off.agg(F.max(F.greatest(*[f"off_{m}" for m in MARGINS]))).first()[0]
        if worst is None or worst < CLOSE:
            break
    return fitted.drop(*[f"target_{m}" for m in MARGINS])


def calibrated(
    rows: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, budget: float = BUDGET
) -> DataFrame:
    """Per cell: weight, multiplier, copies expected, and the probability of at least one."""
    cells = materialized(rows.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("cell_tokens")))
    total = cells.agg(F.sum("cell_tokens")).first()[0] or 1
    fitted = raked(cells, targets).withColumn("multiplier", F.col("weight") * F.lit(float(total)) / F.col("cell_tokens"))
    # Weights sum to one, so that the budget is the scale at which tokens meet it.
    fitted = materialized(fitted).withColumn("expected", F.lit(float(budget)) * F.col("multiplier"))
    return fitted.withColumn("probability", F.least(F.lit(1.0), "expected"))


def _copies(lot: Column, expected: Column) -> Column:
    """How often a document is kept: its whole copies, and one more by lot."""
    return (F.floor(expected) + (lot < expected - F.floor(expected)).cast("long")).cast("int")


def _joined(rows: DataFrame, cells: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Every row with the figures of its cell; null margins match each other."""
    marked = cells.select(*[F.col(m).alias(f"cell_{m}") for m in MARGINS], "multiplier", "expected", "probability")
    same = F.lit(True)
    for m in MARGINS:
        same = same & F.col(names[m]).eqNullSafe(F.col(f"cell_{m}"))
    return rows.join(marked, same, "left").drop(*[f"cell_{m}" for m in MARGINS])


def mixed(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, budget: float = BUDGET) -> DataFrame:
    """One row per document: doc_id, source, lang, topic, n_tokens, weight, probability, kept, copies.

    `weight` is what the document adds to the mix: its share of its cell's weight.
    `copies` says how often it is kept. A cell without tokens or without a target has
    weight, probability and copies zero."""
    rows = materialized(measured(docs))
    found = _joined(rows, calibrated(rows, targets, budget), {m: m for m in MARGINS})
    copies = _copies(F.col("lot"), F.coalesce("expected", F.lit(0.0)))
    total = F.lit(float(rows.agg(F.sum("n_tokens")).first()[0] or 1))
    return found.select(
        "doc_id", *MARGINS, "n_tokens", (F.coalesce("multiplier", F.lit(0.0)) * F.col("n_tokens") / total).alias("weight"),
        F.coalesce("probability", F.lit(0.0)).alias("probability"), (copies > 0).alias("kept"), copies.alias("copies"),
    )


def sampled(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, budget: float = BUDGET) -> DataFrame:
    """The documents the mix keeps, each as often as it is kept, with their own columns."""
    cells = materialized(calibrated(measured(docs).drop("lot"), targets, budget).select(*MARGINS, "expected"))
    label, expected, copy = fresh(docs, "topic"), fresh(docs, "mix_expected"), fresh(docs, "mix_copy")
    text = document_text()
    marked = cells.select(*[F.col(m).alias(fresh(docs, f"cell_{m}")) for m in MARGINS], F.col("expected").alias(expected))
    same = F.lit(True)
    for m, name in zip(MARGINS, ("source", "lang", label), strict=True):
        same = same & F.col(name).eqNullSafe(F.col(fresh(docs, f"cell_{m}")))
    joined = docs.withColumn(label, topic(text)).join(marked, same)
    copies = _copies(uniform(F.col("doc_id").cast("long"), text, seed=5), F.col(expected))
    return joined.withColumn(copy, F.explode(F.array_repeat(F.lit(0), copies))).select(*docs.columns)
