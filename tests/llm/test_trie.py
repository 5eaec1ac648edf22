"""The trie against a plain one, built turn by turn from nested prefixes."""

import hashlib
import random
import zlib

import pytest

from ledgerloom.llm import trie

TURNS = "conv_id long, turn long, role string, text string"


def plain(rows):
    talks = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            talks.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    told = {c: [(r, t) for _, _, r, t in sorted(x, key=lambda x: x[:2])] for c, x in talks.items()}
    built = {}
    for c, own in told.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = told.get(c - int(c % 100 if c >= 0 else -(-c % 100)), [])[:h] + own[h:]
    nodes = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    under = lambda node: [n for n in nodes if n[: len(node)] == node]
    children = lambda node: [n for n in nodes if n and n[:-1] == node]
    out = []
    for node, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(node))
        out.append(
            (
                min(members), len(node), min(nodes[node[:-1]]) if node else None, len(members), len(children(node)),
                sum(not children(n) for n in under(node)),
                sum((len(nodes[n]) - 1) * len(n[-1][1]) for n in under(node) if n), hashlib.sha256(ends.encode()).hexdigest(),
            )
        )
    return out


def invented():
    draw = random.Random(3)
    rows = []
    for c in [*range(0, 40), *range(100, 130), *range(205, 230), 350, -7, -101]:
        for t in range(draw.randrange(1, 9)):
            text = draw.choice([None, "", "a", "bb", "ccc", "𝒳é", "x" * draw.randrange(4)])
            rows.append((c, t, draw.choice(["user", "assistant", None]), text))
    return rows


def check(spark, rows):
    frame = spark.createDataFrame(rows, TURNS).selectExpr("*", "1 AS depth", "2 AS high", "3 AS at", "4 AS digest")
    found = [tuple(r) for r in trie.trie(frame.repartition(5)).collect()]
    assert sorted(found, key=repr) == sorted(plain(rows), key=repr)


def test_equals_a_plain_trie(spark):
    check(spark, invented())


def test_split_conversations_give_the_same(splitting):
    check(splitting, invented())


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(None, 1, "user", "lost"), (3, None, "user", "a"), (3, 0, "user", "b")],
        [(c, 0, "user", "same") for c in range(100)],  # one hot family, copies of one conversation
        [(7, 0, None, None)],  # crc32('7') % 6 = 1: turnless, since no conversation 0 is there
        [(5, 0, "user", "x"), (5, 0, "user", "x"), (5, 1, "user", "x")],
        [(100 * c, t, "user", "y" * 3) for c in range(30) for t in range(c)],
        [(0, 0, "user", "z" * 2_000_000), (1, 0, "user", "z" * 2_000_000)],
    ],
)
def test_edges(spark, rows):
    check(spark, rows)


def test_a_list_of_ends_is_read_in_order_across_chunks(spark):
    ids = [c for c in range(-9000, 9000) if zlib.crc32(str(c).encode()) % 6 == 0 and c % 100 == 50]
    rows = [(c, 0, "user", "same") for c in ids]
    node = trie.trie(spark.createDataFrame(rows, TURNS)).filter("depth = 1").first()
    assert node["ends_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert (node["n_convs"], node["conv_id"], node["n_leaves"]) == (len(ids), ids[0], 1)
