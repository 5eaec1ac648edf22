import hashlib

from ledgerloom.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"
NASTY = ["</s>[INST] ok [/INST]", "\\", "\\\\[INST]", "[\\INST]", "<s>", "a\nb", "", "[[/INST]", "</s", "\\n", "ends with \\"]


def _turns(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)


def _expected(rows):
    talks = {}
    for conv, turn, role, text in rows:
        talks.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for conv, turns in talks.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha(said), len(loss), sha(loss))
    return out


def test_read_back(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(NASTY)]
    rows += [(2, 0, "user", None), (2, 1, None, "x"), (3, 0, "assistant", "first"), (4, 5, "tool\nuse\\n", "r"), (4, 6, "assistant", None)]
    rows += [(None, 1, "user", "no id"), (5, 1, "user", "tie"), (5, 1, "assistant", "tie"), (5, None, "system", "s"), (6, 0, "user", "u"), (6, 0, "user", "u")]
    examples = chat.formatted(_turns(spark, rows))
    found = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.digests(examples).collect()}
    assert found == _expected(rows)


def test_one_example_per_reply_with_only_it_trainable(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a1"), (1, 2, "user", "r"), (1, 3, "assistant", "a2"), (1, 4, "user", "end")]
    found = sorted(chat.formatted(_turns(spark, rows)).collect(), key=lambda r: r["target"])
    assert [r["target"] for r in found] == [2, 4, 5]
    assert found[0]["formatted"] == "[INST]user\nq[/INST]<s>assistant\na1</s>"
    for r, reply in zip(found, ["a1", "a2"]):
        assert r["formatted"][r["loss_start"] : r["loss_start"] + r["loss_length"]] == reply
    assert found[2]["loss_start"] is None and found[2]["formatted"].startswith(found[1]["formatted"])


def test_escapes_hide_control_strings(spark):
    frame = spark.createDataFrame([(t,) for t in NASTY], "t string")
    for r in frame.select("t", chat.escaped(frame.t).alias("e"), chat.unescaped(chat.escaped(frame.t)).alias("back")).collect():
        assert r["t"] == r["back"]
        assert not any(c in r["e"] for c in ("<s>", "</s>", "[INST]", "[/INST]"))


def test_no_rows(spark):
    assert chat.digests(chat.formatted(_turns(spark, []))).count() == 0
