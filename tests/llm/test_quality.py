"""Quality rules against a plain count of words, lines and windows."""

import random
import re

import pytest

from ledgerloom.llm import quality
from ledgerloom.llm.quality import Rule


def measured(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": sum(x in lines[:i] for i, x in enumerate(lines)), "n_repeat_words": len(covered),
        "base_failed": len(words) < 50 or 100 * len(covered) > 50 * len(words),
    }


def some_texts():
    draw = random.Random(5)
    parts = ["the", "of", "Wort", "añb", "x#", "|", "日本", "𝒳y", "…", "...", "- a"]
    texts = ["".join(draw.choice(parts) + draw.choice([" ", " ", "\n", "\t", " \n", "\x0b"]) for _ in range(draw.randrange(90))) for _ in range(60)]
    return [None, "", " \n\t", "a", "a b", "a b c", "a b c a b c", "a a a a", *texts]


def test_measures_equal_plain_counts(spark, documents):
    texts = some_texts()
    found = {r["doc_id"]: r for r in quality.digests(quality.judged(documents(list(enumerate(texts))))).collect()}
    assert len(found) == len(texts)
    for at, text in enumerate(texts):
        told = measured(text)
        assert {k: found[at][k] for k in told} == told, (at, text)


def good(n=60):
    return " ".join(f"word{i} of" if i % 2 else f"line{i}" for i in range(n)) + "."


@pytest.mark.parametrize(
    ("text", "rule"),
    [
        (good(), None), (good(10), "few_words"), (" ".join(["the of and"] * 40), "repeated_words"),
        (good() + " #" * 30, "symbols"), (good().upper(), "shouted"), (good().replace("of", "xx"), "stop_words"),
        ("\n".join(f"- {w}" for w in good().split()), "bullet_lines"), (good() + "\n" + "\n".join(f"so {i}..." for i in range(9)), "ellipsis_lines"),
        (good() + "\n" + "\n".join(["same"] * 9), "duplicate_lines"), (good() + " 1234567" * 120, "letters"),
    ],
)
def test_each_rule_rejects_its_kind(spark, documents, text, rule):
    row = quality.judged(documents([(1, text)])).first()
    assert row["kept"] is (rule is None)
    assert rule is None or rule in row["failed"]


def test_a_table_of_rules_is_data(spark, documents):
    rows = [("tiny", "n_words", None, 2, None, True), ("marks", "n_symbols", "n_words", None, 50, False)]
    table = spark.createDataFrame(rows, "rule string, part string, whole string, least int, most int, base boolean")
    rules = quality.from_table(table)
    docs = documents([(1, "a b"), (2, "a"), (3, "# #"), (4, None)])
    kept = {r["doc_id"]: (r["failed"], r["base_failed"]) for r in quality.judged(docs, rules).collect()}
    assert kept == {1: ([], False), 2: (["tiny"], True), 3: (["marks"], False), 4: (["tiny"], True)}
    assert quality.without_poor(docs, rules).columns == docs.columns
    assert [r["doc_id"] for r in quality.without_poor(docs, rules).collect()] == [1]
    assert quality.judged(docs, []).filter("kept").count() == 4


def test_wrong_tables_are_refused(spark, documents):
    with pytest.raises(ValueError, match="nothing is measured"):
        quality.judged(documents([(1, "a")]), [Rule("x", "n_cats")])
    twice = spark.createDataFrame([("a", "n_words", None, 1, None, False)] * 2, "rule string, part string, whole string, least int, most int, base boolean")
    with pytest.raises(ValueError, match="each named once"):
        quality.from_table(twice)


def test_one_projection_and_no_shuffle(spark, documents):
    plan = quality.judged(documents([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and plan.count("[\\x20\\x09-\\x0D]+, -1") == 1


def test_empty_repeated_and_very_long(spark, documents):
    assert quality.judged(documents([])).count() == 0
    twice = quality.judged(documents([(1, good()), (1, good()), (None, good())])).collect()
    assert [r["kept"] for r in twice] == [True] * 3
    long = good(100_000)
    row = quality.judged(documents([(1, long)])).first()
    assert (row["n_words"], row["word_chars"], row["failed"]) == (len(long.split()), sum(map(len, long.split())), ["letters"])
