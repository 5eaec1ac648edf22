"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context,
and only its own text is trainable. Turns after the last reply are no target; they
come as one example without a trainable part, so that no turn is lost.

A turn prints as `[INST]role`, line feed, text, `[/INST]`, a reply as `<s>role`, line
feed, text, `</s>`. Inside texts a backslash is doubled and a control string gets a
backslash after its first character, so no control string can appear in one, and
taking away each backslash that stands before a character gives the text back.

An example holds its whole context, so one conversation meets in one task and its
output grows with the square of its turns; that is what this format is. Conversations
are the unit of distribution, and a common conversation is many small groups.

Defined results: a null text or role is empty; a null conv_id is one conversation;
turns with equal numbers, null ones first, are ordered by role and text; rows that
repeat are turns of their own; other columns are not read; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTROL = r"(\\|[<\[](?=/?s>|/?INST\]))"  # a backslash, or the first character of a control string
ENDS = r"\[/INST\]|</s>"


def escaped(text: Column) -> Column:
    """`[INST]` becomes `[\\INST]`; a backslash becomes two."""
    doubled = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(doubled, r"([<\[])(?=/?s>|/?INST\])", r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _role(role: Column) -> Column:
    """Roles end at a line feed, so one inside gets a backslash and the letter n."""
    return F.regexp_replace(escaped(role), "\n", r"\\n")


def _printed(turn: Column) -> Column:
    reply = turn["role"] == "assistant"
    body = F.concat(_role(turn["role"]), F.lit("\n"), escaped(turn["text"]))
    return F.when(reply, F.concat(F.lit("<s>"), body, F.lit("</s>"))).otherwise(
        F.concat(F.lit("[INST]"), body, F.lit("[/INST]"))
    )


def formatted(turns: DataFrame) -> DataFrame:
    """Examples: conv_id, target, formatted, loss_start and loss_length in code points.

    `target` counts turns from 1. An example that trains nothing has a null mask."""
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    talks = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    printed = talks.select(
        "conv_id", F.transform("turns", _printed).alias("parts"), F.transform("turns", lambda t: t["role"]).alias("roles")
    )
    targets = F.filter(
        F.sequence(F.lit(1), F.size("parts")),
        lambda i: (F.element_at("roles", i) == "assistant") | (i == F.size("parts")),
    )
    each = printed.select("conv_id", "parts", "roles", F.explode(targets).alias("target"))
    part, reply = F.element_at("parts", F.col("target")), F.element_at("roles", F.col("target")) == "assistant"
    context = F.array_join(F.slice("parts", F.lit(1), F.col("target") - 1), "")
    mark = len("<s>assistant\n")
    return each.select(
        "conv_id", "target", F.concat(context, part).alias("formatted"),
        F.when(reply, F.length(context) + mark).cast("long").alias("loss_start"),
        F.when(reply, F.length(part) - mark - len("</s>")).cast("long").alias("loss_length"),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """Examples with the turns in them and the text under the mask."""
    chunks = F.filter(F.split("formatted", ENDS, -1), lambda c: c != "")
    body = lambda c: F.regexp_replace(c, r"^(?:\[INST\]|<s>)", "")
    role = lambda c: F.substring_index(body(c), "\n", 1)
    plain = lambda c: unescaped(F.regexp_replace(role(c), r"(?<!\\)((?:\\\\)*)\\n", "$1\n"))
    text = lambda c: unescaped(F.substring(body(c), F.length(role(c)) + 2, F.length(c)))
    return examples.withColumns(
        {
            "turns": F.transform(chunks, lambda c: F.struct(plain(c).alias("role"), text(c).alias("text"))),
            "loss_text": unescaped(F.substring("formatted", F.col("loss_start") + 1, F.col("loss_length"))),
        }
    )


def digests(examples: DataFrame) -> DataFrame:
    """One row per conversation, from what its examples say when read back."""
    read = read_back(examples).select(
        "conv_id", "target", F.length("formatted").cast("long").alias("chars"), "loss_text",
        F.when(F.col("target") == F.max("target").over(_whole()), F.col("turns")).alias("turns"),
    )
    talks = read.groupBy("conv_id").agg(
        F.first("turns", ignorenulls=True).alias("turns"), F.sum("chars").alias("formatted_chars"),
        F.sort_array(F.collect_list(F.when(F.col("loss_text").isNotNull(), F.struct("target", "loss_text")))).alias("loss"),
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    trained = F.array_join(F.transform("loss", lambda x: x["loss_text"]), "")
    return talks.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(trained).cast("long").alias("loss_chars"), F.sha2(trained, 256).alias("loss_sha256"), "formatted_chars",
    )


def _whole():
    from pyspark.sql import Window

    return Window.partitionBy("conv_id")
