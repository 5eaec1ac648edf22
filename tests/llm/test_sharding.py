import zlib
from collections import Counter

from ledgerloom.llm import sharding


def test_even_shards_that_keep_copies_together(documents):
    rows = [(i, f"text {i // 4}") for i in range(400)] + [(1000 + i, "hot") for i in range(250)] + [(2000 + i, f"lone {i}") for i in range(61)]
    placed = sharding.sharded(documents(rows))
    found = placed.collect()
    counts = Counter(r["shard"] for r in found)
    assert sorted(counts) == list(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    for shard, n in counts.items():
        assert sorted(r["slot"] for r in found if r["shard"] == shard) == list(range(n))
    texts = dict(rows)
    assert all(r["size"] == len(texts[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) for r in found)
    whole = sum(len({r["shard"] for r in found if texts[r["doc_id"]] == f"text {i}"}) == 1 for i in range(100))
    assert whole >= 90
    hot = Counter(r["shard"] for r in found if texts[r["doc_id"]] == "hot")
    assert sum(sorted(hot.values())[-5:]) >= 200  # three shards would do if they held nothing else
    links = sharding.cut_links(placed).first()
    assert links["cut"] < 0.85 * links["links"]
    assert {r["law"] for r in found} == {"rows"} and all(r["grown_shard"] is None for r in found)


def test_nulls_repeats_and_few_rows(documents):
    found = sharding.sharded(documents([(None, None), (1, ""), (1, ""), (2, "é")])).collect()
    assert sorted((r["size"], r["text_crc32"]) for r in found) == [(1, 0), (1, 0), (1, 0), (3, zlib.crc32("é".encode()))]
    assert max(Counter(r["shard"] for r in found).values()) <= 1
    assert sharding.sharded(documents([])).count() == 0
