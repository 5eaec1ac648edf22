"""Ranked search against a plain scorer that looks at every document for every item."""

import math
import random
import re
from collections import Counter

import pytest

from ledgerloom.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
ITEMS = "item_id long, text string"


def terms(text):
    return Counter(TERM.findall(re.sub("[A-Z]", lambda c: c[0].lower(), text or "")))


def plain(docs, items, k):
    counts = [(doc_id, terms(text)) for doc_id, text in docs]
    docs_n, length = sum(1 for _, c in counts if c), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, Counter()).update(terms(text))
    out = []
    for item, want in asked.items():
        scores = []
        for row, (doc_id, have) in enumerate(counts):
            m = 75 + (25 * sum(have.values()) * docs_n) // max(length, 1)
            score = sum(
                times * math.floor(1000 * math.log((2 * docs_n + 2) / (2 * df[t] + 1))) * (1000000000 * have[t] // (1000 * have[t] + 12 * m))
                for t, times in want.items() if have[t]
            )
            if score > 0:
                scores.append((-score, doc_id is not None, doc_id or 0, row))
        for rank, (score, known, doc_id, _) in enumerate(sorted(scores)[:k], 1):
            out.append((item, rank, doc_id if known else None, -score))
    return out


def texts(n, seed, most=40):
    draw = random.Random(seed)
    words = ["the", "The", "of", "éclair", "ÉCLAIR", "日本", "x1", "a-b", "zz_z", *(f"w{i}" for i in range(60))]
    return [" ".join(draw.choices(words, k=draw.randrange(most))) + draw.choice(["", ".", "\n"]) for _ in range(n)]


def check(spark, docs, items, k=20, **kw):
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS row", "2 AS term", "3 AS n", "4 AS block")
    asked = spark.createDataFrame(items, ITEMS).selectExpr("*", "1 AS item", "2 AS stage", "3 AS doc_id")
    found = [tuple(r) for r in lexical.search(frame.repartition(3, "doc_id"), asked, k, **kw).collect()]
    assert sorted(found, key=repr) == sorted(plain(docs, items, k), key=repr)


def test_equals_a_plain_scorer(spark):
    docs = list(enumerate([None, "", " .,", *texts(300, 1)]))
    check(spark, docs, list(enumerate([*texts(12, 2, 25), None, "", "nowhere", "the the THE of"])), k=5)


def test_small_blocks_bundles_and_stages_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(lexical, "CHAINED", 2)
    docs, items = list(enumerate(texts(200, 3))), list(enumerate(texts(300, 4, 6)))
    check(spark, docs, items, k=3, owners=3, entries=150)


@pytest.mark.parametrize(
    ("docs", "items"),
    [
        ([], [(1, "a")]), ([(1, "a")], []), ([(1, None), (2, "")], [(1, "a"), (2, None)]),
        ([(i, "same words here") for i in range(60)] + [(3, "same"), (None, "same words"), (None, "words")], [(1, "same words"), (1, "here"), (None, "words")]),
    ],
)
def test_edges(spark, docs, items):
    check(spark, docs, items)


def test_hot_ties_go_by_doc_id(spark):
    docs = [(9999 - i, "copy of one text") for i in range(6000)] + [(10_000 + i, f"other text {i}") for i in range(3000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    found = lexical.search(frame, spark.createDataFrame([(1, "one text")], ITEMS)).orderBy("rank").collect()
    assert [r["doc_id"] for r in found] == list(range(4000, 4020))


def test_long_texts_are_counted_in_pieces():
    text = ("Ab é" * 700 + " " + "y" * 9000 + " c.D ").encode() * 3
    whole = terms(text.decode())
    for piece in (1, 7, 64, 5000, 1 << 20):
        assert {t.decode(): n for t, n in lexical.term_counts(text, piece).items()} == whole
    assert lexical.term_counts(b"") == {}


def test_very_long_document(spark):
    check(spark, [(1, "alpha beta " * 200_000), (2, "alpha gamma"), (3, "beta " * 9)], [(1, "alpha gamma beta")])
