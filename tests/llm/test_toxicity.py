import random
import zlib

import numpy as np
import pytest

from ledgerloom.llm import toxicity

CLEAN = [f"{a}{b}" for a in ("win", "sol", "mar", "tel", "nov") for b in ("ter", "ar", "ine", "ling", "el")]
TOXIC = ["grubbish", "snarkle", "vilefolk"]


def _corpus(n, seed=1):
    rnd = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        toxic = rnd.random() < 0.2
        words = [rnd.choice(CLEAN) for _ in range(rnd.randint(20, 80))]
        if toxic:
            for _ in range(3):
                words[rnd.randrange(len(words))] = rnd.choice(TOXIC) + rnd.choice(["", "er", "s"])
        rows.append((i, " ".join(words).capitalize() + "."))
        labels.append((i, 1, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def model(spark, documents):
    rows, labels = _corpus(1500)
    return toxicity.trained(documents(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_held_out_accuracy(spark, documents, model):
    rows, labels = _corpus(1500)
    truth = {i: t for i, _, t in labels}
    found = toxicity.scored(documents(rows), model).collect()
    assert len(found) == len(rows) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in found)
    held = [r for r in found if r["held_out"]]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97
    assert all((r["score"] >= 0.7) == bool(r["predicted"]) and 0 <= r["score"] <= 1 for r in found)
    kept = toxicity.without_toxic(documents(rows), model)
    assert kept.columns == documents(rows).columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in found if not r["predicted"]}


def test_held_out_labels_change_nothing(spark, documents, model):
    rows, labels = _corpus(1500)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in labels]
    assert toxicity.trained(documents(rows), spark.createDataFrame(flipped, "doc_id long, quality int, toxic int")) == model


def test_odd_rows(documents, model):
    rows = [(1, None), (2, ""), (3, "x" * 100000), (4, "grubbish " * 50), (4, "grubbish " * 50), (None, "snarkle vilefolk grubbish")]
    found = toxicity.scored(documents(rows), model).collect()
    assert len(found) == 6 and [r["predicted"] for r in found if r["doc_id"] in (1, 2, 3)] == [0, 0, 0]
    assert [r["predicted"] for r in found if r["doc_id"] == 4] == [1, 1] and not [r for r in found if r["doc_id"] is None][0]["held_out"]
    assert toxicity.scored(documents([]), model).count() == 0


def test_without_labels(spark, documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bare = toxicity.trained(documents([(1, "fine")]), none)
    found = {r["doc_id"]: r["predicted"] for r in toxicity.scored(documents([(1, "fine words"), (2, "you idiot")]), bare).collect()}
    assert found == {1: 0, 2: 1}


def test_label_model_does_not_take_noise_for_truth():
    rng = np.random.default_rng(0)
    truth = rng.random(3000) < 0.2
    votes = np.column_stack([(rng.random(3000) < np.where(truth, 0.6, 0.02)) for _ in range(6)]).astype(float)
    labels = np.where(rng.random(3000) < 0.1, ~truth, truth).astype(float)
    post = toxicity.label_model(votes, labels)
    assert ((post > 0.5) == truth).mean() > 0.97 > (labels == truth).mean()


def test_voters_that_fire_together_count_as_one():
    rng = np.random.default_rng(0)
    one, two = (rng.random(2000) < 0.3).astype(float), (rng.random(2000) < 0.3).astype(float)
    groups = toxicity._clusters(np.column_stack([one, one, two]), np.full(2000, 0.5))
    assert groups[0] == groups[1] != groups[2]
