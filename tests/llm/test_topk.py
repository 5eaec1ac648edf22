import numpy as np
import pytest

from ledgerloom.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, codes string, block string"


def _brute(rows, k, every):
    fine = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            codes = [int(np.floor(256.0 * float(np.float32(x)))) for x in v]
            fine[i] = min(fine.get(i, codes), codes)
    out = set()
    for q, c in fine.items():
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(c, o, strict=True)), i) for i, o in fine.items() if i != q and len(o) == len(c))
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])}
    return out


def _found(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA)
    return {tuple(r) for r in topk.nearest(df, **kw).select("query_id", "rank", "vec_id", "score").collect()}


@pytest.mark.parametrize("lists", [1, 2, 3])
def test_equals_brute_force(spark, monkeypatch, lists):
    monkeypatch.setattr(topk, "CANDIDATES", 40)
    monkeypatch.setattr(topk, "QUERIES", 3)
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, [1.0] * 6) for i in range(60)]  # copies: ties go to small ids
    rows += [(2000, None), (2001, [None] * 6), (2002, [float("nan")] * 6), (2050, [float("inf")] * 6), (None, [1.0] * 6)]
    rows += [(3000, [0.5, 1.0]), (3001, [-2.0, 1.0]), (3050, []), (3051, []), (7, [9.0] * 6), (1000, [1.0] * 6)]
    assert _found(spark, rows, k=5, every=50, lists=lists) == _brute(rows, 5, 50)


def test_fewer_rows_than_asked_and_none(spark):
    rows = [(0, [1.0, -1.0]), (1, [0.0, 0.0]), (50, [-3.0, 2.5])]
    assert _found(spark, rows) == _brute(rows, 5, 50)
    assert _found(spark, []) == set() and _found(spark, [(0, [1.0])]) == set()
