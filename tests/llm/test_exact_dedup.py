import hashlib
import re

from ledgerloom.llm import exact_dedup


def _expected(rows):
    normal = {i: re.sub(r"[\x20\x09-\x0D]", "", t or "") for i, (_, t) in enumerate(rows)}
    groups = {}
    for i, n in normal.items():
        groups.setdefault(n, []).append(i)
    out = []
    for n, members in groups.items():
        rank = lambda i: (-len(rows[i][1] or ""), rows[i][0] is None, rows[i][0] or 0)
        best = min(members, key=rank)
        for i in members:
            out.append((rows[i][0], rows[best][0], len(members), hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=str)


def _found(df):
    return sorted([(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in df.collect()], key=str)


ROWS = [
    (1, "a b"), (2, "ab "), (3, "a\tb\n"), (4, None), (5, ""), (6, " \r\n"), (7, "ab "), (8, "abcdefgh" * 9),
    (9, "abcdefgh" * 8 + "abcdefgx"), (10, "abcdefgh" * 9), (11, "é" * 7), (12, "é" * 6 + "e"), (None, "a b"), (None, "lone"),
    (13, "same"), (13, "same"), (13, "other"), (14, "x" * 33), (15, "x" * 34), (16, "\U0001f600" * 5), (-3, "same"),
]


def test_names_tell_texts_apart(documents):
    for block in (1, 4, 4096):
        assert _found(exact_dedup.duplicates(documents(ROWS), block=block)) == _expected(ROWS)


def test_one_row_of_each_group_stays(documents):
    docs = documents(ROWS)
    found = exact_dedup.duplicates(docs, block=4).collect()
    assert sum(r["kept"] for r in found) == len({r["text_sha256"] for r in found})
    kept = exact_dedup.without_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len({r["text_sha256"] for r in found})


def test_no_rows(documents):
    assert exact_dedup.duplicates(documents([])).count() == 0
    assert exact_dedup.without_copies(documents([])).count() == 0


def test_blocks_that_share_a_hash_are_named_again(documents, monkeypatch):
    from pyspark.sql import functions as F

    seeds = []

    def poor(blocks, seed):
        seeds.append(seed)
        good = F.transform(F.col(blocks), lambda b: F.xxhash64(F.lit(seed), b))
        return F.transform(F.col(blocks), lambda b: F.lit(7).cast("long")) if seed == 0 else good

    monkeypatch.setattr(exact_dedup, "_hashes", poor)
    assert _found(exact_dedup.duplicates(documents(ROWS), block=4)) == _expected(ROWS)
    assert seeds == [0, 1]


def test_main_path_has_no_python(documents):
    plan = exact_dedup.duplicates(documents(ROWS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
