import itertools
from collections import Counter

import numpy as np
import pytest

from ledgerloom.llm import mixing


def _cells(spark, table):
    rows = [(f"s{i}", f"l{j}", f"t{k}", int(v)) for (i, j, k), v in np.ndenumerate(table)]
    return spark.createDataFrame(rows, "source string, lang string, topic string, cell_tokens long")


def test_raking_equals_proportional_fitting(spark):
    table = np.random.default_rng(3).integers(1, 500, (4, 3, 2)).astype(float)
    weights = table / table.sum()
    for _ in range(200):
        for axis in range(3):
            others = tuple(a for a in range(3) if a != axis)
            target = table.sum(axis=others) ** mixing.TEMPER
            target /= target.sum()
            shape = [1, 1, 1]
            shape[axis] = -1
            weights *= (target / weights.sum(axis=others)).reshape(shape)
    found = {(r["source"], r["lang"], r["topic"]): r["weight"] for r in mixing.raked(_cells(spark, table)).collect()}
    for i, j, k in itertools.product(range(4), range(3), range(2)):
        assert found[f"s{i}", f"l{j}", f"t{k}"] == pytest.approx(weights[i, j, k], rel=1e-4)


def test_given_targets_and_null_margins(documents):
    rows = [(i, "w " * (10 + i % 7), None if i % 5 == 0 else "en", "big" if i % 3 else None) for i in range(300)]
    targets = {"source": {"big": 0.3, None: 0.7}}
    cells = mixing.calibrated(mixing.measured(documents(rows)), targets).collect()
    share = sum(r["weight"] for r in cells if r["source"] is None)
    assert share == pytest.approx(0.7, abs=1e-5) and sum(r["weight"] for r in cells) == pytest.approx(1)
    assert all(0 <= r["probability"] <= 1 for r in cells)


def test_budget_and_repeatable_sample(documents):
    rows = [(i, "word " * (5 + i % 11), "en" if i % 4 else "de", f"s{i % 3}") for i in range(2000)]
    docs = documents(rows)
    first, again = mixing.mixed(docs).collect(), mixing.mixed(docs.repartition(7)).collect()
    kept = {r["doc_id"] for r in first if r["kept"]}
    assert kept == {r["doc_id"] for r in again if r["kept"]}
    tokens = sum(r["n_tokens"] for r in first)
    assert sum(r["n_tokens"] * r["probability"] for r in first) == pytest.approx(mixing.BUDGET * tokens, rel=1e-6)
    assert sum(r["n_tokens"] for r in first if r["kept"]) == pytest.approx(mixing.BUDGET * tokens, rel=0.1)
    sampled = mixing.sampled(docs)
    assert sampled.columns == docs.columns and {r["doc_id"] for r in sampled.collect()} == kept


def test_empty_texts_ties_and_no_rows(documents):
    found = mixing.mixed(documents([(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "c")])).collect()
    assert len(found) == 5 and len({(r["probability"], r["kept"]) for r in found if r["doc_id"] == 3}) == 1
    assert mixing.mixed(documents([])).count() == 0 and mixing.sampled(documents([])).count() == 0
    assert mixing.mixed(documents([(1, ""), (2, None)])).filter("kept").count() == 0


def test_kept_tokens_meet_margins_above_probability_one(documents):
    rare = [(5000 + i, "word " * (5 + i % 11), "is", f"s{i % 2}") for i in range(44)]
    rows = [(i, "word " * (5 + i % 11), "en", f"s{i % 3}") for i in range(4400)] + rare
    docs = documents(rows)
    found = mixing.mixed(docs).collect()
    assert max(r["copies"] for r in found) > 1 and all(r["kept"] == (r["copies"] > 0) for r in found)
    total = sum(r["n_tokens"] for r in found)
    kept = sum(r["n_tokens"] * r["copies"] for r in found)
    assert kept == pytest.approx(mixing.BUDGET * total, rel=0.05)
    for margin in mixing.MARGINS:
        for value in {r[margin] for r in found}:
            aim = sum(r["weight"] for r in found if r[margin] == value)
            share = sum(r["n_tokens"] * r["copies"] for r in found if r[margin] == value) / kept
            assert share == pytest.approx(aim, rel=0.06), (margin, value)
    copies = Counter(r["doc_id"] for r in mixing.sampled(docs).collect())
    assert copies == Counter({r["doc_id"]: r["copies"] for r in found if r["kept"]})
