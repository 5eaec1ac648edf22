import collections
import itertools
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import near_dedup


def _bag(text):
    words = [w for w in re.split(r"[\x00-\x20]+", text or "") if w]
    if len(words) < 5:
        return collections.Counter([tuple(words)]) if words else collections.Counter()
    return collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def _similarity(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def classes(rows):
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    bags = [_bag(t) for _, t in rows]
    for i, j in itertools.combinations(range(len(rows)), 2):
        same = (rows[i][1] or "") == (rows[j][1] or "")
        if same or (bags[i] and bags[j] and _similarity(bags[i], bags[j]) >= 0.8):
            root[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    return sorted(tuple(sorted(g, key=str)) for g in groups.values())


def _rows():
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    rows, at = [], 0
    for size in (3, 5, 30, 120, 400):
        for _ in range(4):
            base = [rnd.choice(words) for _ in range(size)]
            for edits in (0, 0, 1, 3, 9):
                text = list(base)
                for _ in range(edits):
                    text[rnd.randrange(size)] = "edited"
                rows.append((at, " ".join(text)))
                at += 1
    line = "the same five words again " * 50
    rows += [(at, line), (at + 1, line * 2), (at + 2, line + "once more"), (at + 3, None), (at + 4, ""), (at + 5, " \n"), (at + 6, "é ü")]
    # A chain around one centre: copies that are near the centre, not near each other.
    centre = [f"c{i}" for i in range(300)]
    for i in range(40):
        text = list(centre)
        for j in range(5):
            text[(i * 7 + j * 60) % 300] = f"x{i}"
        rows.append((at + 100 + i, " ".join(text)))
    rows.append((at + 300, " ".join(centre)))
    return rows


def test_classes_equal_brute_force(documents):
    rows = _rows()
    found = near_dedup.near_duplicates(documents(rows)).collect()
    groups = collections.defaultdict(list)
    for r in found:
        groups[r["class_id"]].append(r["doc_id"])
    assert sorted(tuple(sorted(g, key=str)) for g in groups.values()) == classes(rows)
    assert all(r["class_size"] == len(groups[r["class_id"]]) and r["class_id"] == min(groups[r["class_id"]]) for r in found)
    assert sum(r["kept"] for r in found) == len(groups)
    kept = near_dedup.without_near_copies(documents(rows))
    assert {r["doc_id"] for r in kept.collect()} == set(groups) and kept.columns == documents(rows).columns


def test_nulls_repeats_and_no_rows(documents):
    found = near_dedup.near_duplicates(documents([(None, "a b c"), (None, "a b c"), (5, "a b c"), (5, "z")])).collect()
    assert sorted((r["class_size"], r["kept"]) for r in found) == [(1, True), (3, False), (3, False), (3, True)]
    assert near_dedup.near_duplicates(documents([])).count() == 0


def test_signatures_agree_as_often_as_multisets_are_similar():
    rnd, share = random.Random(1), []
    for _ in range(60):
        base = collections.Counter({f"s{i}": rnd.choice([1, 1, 1, 2, 3, 9]) for i in range(60)})
        other = collections.Counter({k: (v if rnd.random() < 0.7 else rnd.choice([1, 4])) for k, v in base.items()})
        both = []
        for bag in (base, other):
            hashed = sorted((hash(k) & ((1 << 48) - 1), v) for k, v in bag.items())
            shingle = np.array([h for h, _ in hashed], np.uint64)
            both.append(near_dedup.bag_min_hash(np.zeros(len(hashed), np.int64), shingle, np.array([v for _, v in hashed]), 1)[0])
        share.append((both[0] == both[1]).mean() - _similarity(base, other))
    assert abs(np.mean(share)) < 0.02  # unbiased


def test_components_of_stars_and_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201)]
    found = dict(near_dedup.components(spark.createDataFrame(edges, "one long, two long")).collect())
    assert {found[i] for i in range(41)} == {0} and {found[i] for i in range(100, 130)} == {100} and found[201] == 200


def test_shingles_stay_within_their_text():
    texts = pa.array(["a b c d e f", "", "a", "a b c d e", "  a b\nc d e "], pa.large_string())
    (_, _, data, bounds), = near_dedup._parts(texts)
    text, shingle, times = near_dedup.shingles(data, bounds)
    assert text.tolist() == [0, 0, 2, 3, 4] and times.tolist() == [1] * 5
    assert shingle[3] == shingle[4] and shingle[3] in shingle[:2]


def test_two_blocks_are_joined_as_pairs_would_be():
    rng = np.random.default_rng(5)
    families = [rng.choice(1 << 40, 60, replace=False) for _ in range(4)]

    def side(n, first):
        sets = [np.unique(np.where(rng.random(60) < rng.choice([0.02, 0.1, 0.3]), rng.integers(0, 1 << 40, 60), families[k % 4])) for k in range(n)]
        weights = np.array([len(s) for s in sets])
        return sets, (np.arange(first, first + n), weights, np.concatenate(sets), np.repeat(np.arange(n), weights))

    ones, left = side(30, 0)
    twos, right = side(40, 100)
    pairs = {(i, 100 + j) for i, a in enumerate(ones) for j, b in enumerate(twos) if len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.8}
    assert len(pairs) > 20

    def classes(links):
        of = {}
        for a, b in sorted(links):
            one, two = of.setdefault(a, {a}), of.setdefault(b, {b})
            if one is not two:
                one |= two
                of.update(dict.fromkeys(two, one))
        return {frozenset(c) for c in of.values()}

    for columns in (near_dedup.COLUMNS, 7):
        near_dedup.COLUMNS, kept = columns, near_dedup.COLUMNS
        links = near_dedup._joining(left, right, 0.8)
        near_dedup.COLUMNS = kept
        assert set(links) <= pairs and classes(links) == classes(pairs)
        assert len(links) == len({x for p in pairs for x in p}) - len(classes(pairs))


def test_no_class_of_the_given_documents_is_lost(spark):
    """Measured against all pairs that share a shingle: recall is whole on this table."""
    folder = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(folder):
        pytest.skip("no test tables here")
    docs = spark.read.parquet(folder)
    bags = {r.doc_id: _bag(r.text) for r in docs.select("doc_id", "text").collect()}
    holders = collections.defaultdict(list)
    for doc, bag in bags.items():
        for shingle in bag:
            holders[shingle].append(doc)
    pairs = {p for held in holders.values() if len(held) > 1 for p in itertools.combinations(sorted(held), 2)}
    linked = {(a, b) for a, b in pairs if _similarity(bags[a], bags[b]) >= 0.8}
    found = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs).collect()}
    assert len(linked) > 50 and all(found[a] == found[b] for a, b in linked)
    # Nor is anything joined that no chain of links joins.
    root = {doc: doc for doc in bags}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        root[max(top(a), top(b))] = min(top(a), top(b))
    wordless = [doc for doc, bag in bags.items() if not bag]
    assert all(found[doc] == top(doc) for doc in bags if doc not in wordless)
