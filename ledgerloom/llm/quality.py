"""Quality rules: a threshold table compiled into one projection.

A rule names a measured number, what it is a share of (nothing, or another measured
number), and the least and most that pass, in percent of the whole. `compiled` turns
a table of rules into one expression per document: the text is cut into words and lines
once, everything is measured from these, and every rule becomes a comparison of whole
numbers. There is no user function, no shuffle and no second read; rules may also come
from a table of their own (`from_table`), so that thresholds can be changed as data.

Words are maximal runs of characters outside [\\x20\\x09-\\x0D]; lines are parted by line
feeds, and only lines with a word count. Windows of three words are compared as texts,
not as hashes: they are sorted within the row and a window that equals a neighbour is
found twice. Time is n log n in the words of a text; memory is that of its words and
windows as separate strings, some thirty times the text, so 1 MB is nothing and a text
of 100 MB wants gigabytes in its task.

Defined results: a null text has no words, lines or symbols and fails the word rule; so
do empty texts; a share of nothing (no lines, no words) passes; documents are judged
alone, so repeated rows, null ids and ties change nothing; other columns are not read
and may have any name; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import document_text

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]+"  # all that is no symbol

# Frequent function words of four languages.
STOP_WORDS = (
    "the of and to a in is that it for was on with as be by this are at from or an not have which "
    "der die und den von zu das mit sich des ein auf für ist im nicht dem eine als auch es "
    "de la le et les du un une que pour est par qui dans avec sur pas au ce il "
    "el en y los se del las por con no su una para al lo como"
).split()
_SPELLED = sorted({spelled for w in STOP_WORDS for spelled in (w, w.capitalize(), w.upper())})


@dataclass(frozen=True)
class Rule:
    """`part`, or its share of `whole`, between `least` and `most` percent.

    Without a whole the bounds are plain numbers. A `base` rule belongs to the fixed
    floor that no other table may lift."""

    name: str
    part: str
    whole: str | None = None
    least: int | None = None
    most: int | None = None
    base: bool = False


# The floor, then lengths, symbols, stop words and lines, after published rules for web text.
RULES: tuple[Rule, ...] = (
    Rule("few_words", "n_words", None, least=50, base=True),
    Rule("repeated_words", "n_repeat_words", "n_words", most=50, base=True),
    Rule("many_words", "n_words", None, most=10_000_000),
    Rule("word_length", "word_chars", "n_words", least=300, most=1000),
    Rule("symbols", "n_symbols", "n_words", most=10),
    Rule("shouted", "n_capitals", "n_letters", most=30),
    Rule("letters", "n_letters", "word_chars", least=60),
    Rule("stop_words", "n_stop_words", "n_words", least=5),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", most=50),
    Rule("duplicate_line_chars", "dup_line_chars", "line_chars", most=20),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", most=90),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", most=30),
)


def from_table(rules: DataFrame) -> list[Rule]:
    """Rules from rows of (rule, part, whole, least, most, base), one per named rule.

    A threshold table is a page of settings: no more rows than `MOST_RULES` are taken."""
    rows = rules.select("rule", "part", "whole", "least", "most", "base").orderBy("rule").limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES or len({r["rule"] for r in rows}) < len(rows):
        raise ValueError(f"a threshold table has up to {MOST_RULES} rules, each named once")
    return [Rule(r["rule"], r["part"], r["whole"], r["least"], r["most"], bool(r["base"])) for r in rows]


MOST_RULES = 1000


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often it is named."""
    return F.transform(F.array(value), body)[0]


def _count(items: Column, test: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(items, test)).cast("long")


def _repeated(words: Column) -> Column:
    """Words in windows of three that are found twice or more.

    Where all windows have hashes of their own there are none; only other texts are
    looked at closely."""
    firsts = F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0)))
    hashes = F.transform(firsts, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    windows = F.transform(
        firsts, lambda w, i: F.struct(F.concat_ws(" ", w, F.get(words, i + 1), F.get(words, i + 2)).alias("window"), i.alias("at"))
    )

    def places(ordered: Column) -> Column:
        same = lambda x, i: x["window"] == F.get(ordered, i)["window"]
        twice = F.transform(
            ordered, lambda x, i: F.when(F.coalesce(same(x, i - 1), F.lit(False)) | F.coalesce(same(x, i + 1), F.lit(False)), x["at"])
        )
        return F.filter(twice, lambda at: at.isNotNull())

    covered = F.flatten(F.transform(_bound(F.sort_array(windows), places), lambda at: F.array(at, at + 1, at + 2)))
    alone = F.size(F.array_distinct(hashes)) == F.size(firsts)
    return F.when(alone, F.lit(0)).otherwise(F.size(F.array_distinct(covered))).cast("long")


def _measures(cut: Column) -> dict[str, Column]:
    """Every number that a rule may name, from a text with its words and lines."""
    text, words, lines = cut["text"], cut["words"], cut["lines"]
    chars = lambda lines: F.aggregate(lines, F.lit(0).cast("long"), lambda n, line: n + F.length(line))
    distinct = F.array_distinct(lines)
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.regexp_replace(text, SPACES, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(text, SYMBOLS, "")).cast("long"),
        "n_letters": (F.length(text) - F.length(F.regexp_replace(text, r"\p{L}+", ""))).cast("long"),
        "n_capitals": F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).cast("long"),
        "n_stop_words": _count(words, lambda w: w.isin(_SPELLED)),
        "n_repeat_words": _repeated(words),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(distinct)).cast("long"),
        "line_chars": chars(lines),
        "dup_line_chars": chars(lines) - chars(distinct),
        "n_bullet_lines": _count(lines, lambda x: x.rlike(r"^\s*[-*•‣◦]")),
        "n_ellipsis_lines": _count(lines, lambda x: x.rlike(r"(\.\.\.|…)\s*$")),
    }


MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_letters", "n_capitals", "n_stop_words", "n_repeat_words",
    "n_lines", "n_dup_lines", "line_chars", "dup_line_chars", "n_bullet_lines", "n_ellipsis_lines",
)


def _broken(rule: Rule, measured: Column) -> Column:
    """Whether a rule is broken; never null."""
    for name in (rule.part, rule.whole):
        if name is not None and name not in MEASURES:
            raise ValueError(f"rule {rule.name}: nothing is measured as {name}")
    value = measured[rule.part] if rule.whole is None else measured[rule.part] * 100
    unit = F.lit(1).cast("long") if rule.whole is None else measured[rule.whole]
    tests = [F.lit(False)]
    if rule.least is not None:
        tests.append(value < unit * F.lit(rule.least))
    if rule.most is not None:
        tests.append(value > unit * F.lit(rule.most))
    broken = tests[0]
    for test in tests[1:]:
        broken = broken | test
    return broken


def compiled(text: Column, rules: Sequence[Rule] = RULES) -> Column:
    """One struct per text: all measures, `failed` (names of broken rules), `base_failed`, `kept`."""
    words = F.filter(F.split(text, SPACES, -1), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def judged(m: Column) -> Column:
        none = F.array().cast("array<string>")
        named = F.array(*[F.when(_broken(r, m), F.lit(r.name)) for r in rules]) if rules else none
        floor = F.lit(False)
        for rule in rules:
            if rule.base:
                floor = floor | _broken(rule, m)
        failed = F.filter(named, lambda name: name.isNotNull())
        return F.struct(*[m[name].alias(name) for name in MEASURES], failed.alias("failed"), floor.alias("base_failed"))

    measured = _bound(
        F.struct(text.alias("text"), words.alias("words"), lines.alias("lines")),
        lambda cut: F.struct(*[value.alias(name) for name, value in _measures(cut).items()]),
    )
    return _bound(measured, judged)


def judged(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """doc_id, every measure, `failed`, `base_failed` and `kept`, one row per document."""
    one = docs.select(F.col("doc_id").cast("long").alias("doc_id"), compiled(document_text(), rules).alias("judged"))
    return one.select("doc_id", "judged.*").withColumn("kept", F.size("failed") == 0)


def without_poor(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The documents that break no rule, with their own columns."""
    return docs.filter(F.size(compiled(document_text(), rules)["failed"]) == 0)


def digests(judgements: DataFrame) -> DataFrame:
    return judgements.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
