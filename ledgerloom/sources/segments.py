"""Cutting statement text into records, inside the row that holds the text.

A statement is one row and its lines are an array, so nothing is shuffled until
the records have come out of it, and documents spread over all tasks."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Test = Callable[[Column], Column]


# A text row is below 2 GB and a line with its break takes two characters.
ALL_LINES = 1 << 30


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once, however often it is named.

    Without this, an expression named inside a lambda is computed again for every
    element. It is the end step of an aggregate over nothing, which, unlike an array
    of one, copies neither the value nor the result."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda held, _: held, use)


# What `\s` stands for.
BLANKS = " \t\n\x0b\f\r"
# The same within a line. A plain list of characters is looked up in one step.
BLANK = r"[ \t\x0B\f\r]"


def strip(line: Column) -> Column:
    return F.trim(line, F.lit(BLANKS))


def plain(text: Column) -> Column:
    """The text as stripped lines, the empty ones left out."""
    return F.regexp_replace(strip(text), rf"{BLANK}*\n\s*", "\n")


def split_lines(text: Column) -> Column:
    """Lines of a text that is `plain`."""
    return let(text, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, "\n")))


def lines_of(text: Column) -> Column:
    """Stripped lines, the empty ones left out: two passes over the text, none per line."""
    return split_lines(plain(text))


OTHER = 0


def told_apart(lines: Column, *patterns: str) -> Column:
    """Lines as structs of `kind` and `line`, each looked at once.

    The kind is the number, from 1, of the first pattern that fits, or `OTHER`. Records
    are then told from kinds alone, which are compared as numbers however often."""

    def kind(line: Column) -> Column:
        chosen = F.lit(OTHER)
        for number, pattern in reversed(list(enumerate(patterns, 1))):
            chosen = F.when(line.rlike(pattern), F.lit(number)).otherwise(chosen)
        return F.struct(chosen.alias("kind"), line.alias("line"))

    return F.transform(lines, kind)


def texts_of(told: Column) -> Column:
    return F.transform(told, lambda t: t["line"])


def after(lines: Column, position: Column) -> Column:
    """Lines after a 1-based position."""
    return F.slice(lines, position + 1, F.lit(ALL_LINES))


def until(lines: Column, test: Test) -> Column:
    """Lines before the first that passes."""

    def cut(ls: Column) -> Column:
        found = F.array_position(F.transform(ls, test), True)
        return let(found, lambda at: F.when(at > 0, F.slice(ls, 1, (at - 1).cast("int"))).otherwise(ls))

    return let(lines, cut)


def since(lines: Column, test: Test) -> Column:
    """Lines after the first that passes; none when no line does."""

    def cut(ls: Column) -> Column:
        found = F.array_position(F.transform(ls, test), True)
        nothing = F.array().cast("array<string>")
        return let(found, lambda at: F.when(at > 0, after(ls, at.cast("int"))).otherwise(nothing))

    return let(lines, cut)


def body(lines: Column, start: Test, stop: Test, skip: Test) -> Column:
    """The table's lines: after the start line, before the stop line, without
    the headings that page breaks repeat inside it."""
    inside = until(since(lines, start), lambda line: ~start(line) & stop(line))
    return F.filter(inside, lambda line: ~start(line) & ~skip(line))


def places(lines: Column, test: Test) -> Column:
    """1-based positions of the lines that pass."""
    return F.filter(F.transform(lines, lambda line, i: F.when(test(line), i + 1)), lambda i: i.isNotNull())


def blocks(lines: Column, begins: Test) -> Column:
    """Arrays of lines (or of lines told apart), each from one that begins a record up to the next."""

    def cut(ls: Column) -> Column:
        return let(
            places(ls, begins),
            lambda found: F.transform(
                found, lambda at, n: F.slice(ls, at, F.coalesce(F.get(found, n + 1), F.size(ls) + 1) - at)
            ),
        )

    return let(lines, cut)


def tail(lines: Column) -> Column:
    return after(lines, F.lit(1))


def last(array: Column) -> Column:
    """Last element, null when there is none."""
    return let(array, lambda a: F.get(a, F.size(a) - 1))


def matching(lines: Column, pattern: str) -> Column:
    return F.filter(lines, lambda line: line.rlike(pattern))


def not_matching(lines: Column, pattern: str) -> Column:
    return F.filter(lines, lambda line: ~line.rlike(pattern))


def joined(lines: Column) -> Column:
    """Lines as one text, null when there are none."""
    return let(lines, lambda ls: F.when(F.size(ls) > 0, F.array_join(ls, " ")))


def extract(text: Column, pattern: str, group: int = 1) -> Column:
    """A regex group, null when the pattern is not found or the group is empty."""
    return let(F.regexp_extract(text, pattern, group), lambda found: F.when(found != "", found))


# Records cut by patterns over a whole text, which is looked through natively, instead of
# line by line in lambdas. Such a text is `listed`, its patterns are of whole lines, and
# none may run over a line's end: BLANK stands for `\s` there, ANY for what a dot passes in a
# line on its own. With LINES, a dot itself passes all of a line.
ANY = r"[^\n\r\x85\u2028\u2029]"
# What `$` lets pass at the end of a line on its own.
END = r"[\x85\u2028\u2029]?$"
LINES = "(?md)"
REST = "(?s:.*)"


def listed(text: Column) -> Column:
    """The text as stripped lines, each with its break, the empty ones left out.

    No line ends in a blank, so blanks before a break are free to mark lines with."""
    return F.concat(plain(text), F.lit("\n"))


def exactly(*values: str) -> str:
    return "(?:" + "|".join(map(re.escape, values)) + ")"


def beginning(*values: str) -> str:
    return exactly(*values) + ".*"


def holding(*values: str) -> str:
    return ".*" + beginning(*values)


def body_text(text: Column, start: str, stop: str, skip: str | None = None) -> Column:
    """As `body`, of a listed text and with patterns of lines."""
    inside = F.regexp_extract(text, rf"{LINES}^{start}\n({REST})", 1)
    before = F.get(F.split(inside, rf"{LINES}^(?!{start}$){stop}$", 2), 0)
    left_out = start if skip is None else f"{start}|{skip}"
    return F.regexp_replace(before, rf"{LINES}^(?:{left_out})\n", "")


def block_texts(text: Column, begins: str) -> Column:
    """As `blocks`, of a listed text: texts, each from a line that begins a record up to the next."""
    parts = F.split(text, rf"{LINES}^(?={begins})")
    return F.filter(parts, lambda part: part.rlike(rf"{LINES}\A{begins}"))


def first_line(block: Column) -> Column:
    return F.substring_index(block, "\n", 1)


def joined_text(lines: Column) -> Column:
    """Lines of a listed text as one, null when there are none."""
    return let(F.rtrim(F.replace(lines, F.lit("\n"), F.lit(" "))), lambda words: F.when(words != "", words))


def one_of(*values: str) -> Test:
    return lambda line: line.isin(*values)


def contains_any(*values: str) -> Test:
    def test(line: Column) -> Column:
        found = F.lit(False)
        for value in values:
            found = found | line.contains(value)
        return found

    return test


def starts_with_any(*values: str) -> Test:
    def test(line: Column) -> Column:
        found = F.lit(False)
        for value in values:
            found = found | line.startswith(value)
        return found

    return test


def either(*tests: Test) -> Test:
    def test(line: Column) -> Column:
        found = F.lit(False)
        for t in tests:
            found = found | t(line)
        return found

    return test


def begins_with(pattern: str) -> Test:
    return lambda line: line.rlike(pattern)


def record(record_type: str | Column, fields: Sequence[tuple[str, Column]], wrapper: Column | None = None) -> Column:
    """One parsed record: its kind, its payload as text, and its wrapper."""
    kind = F.lit(record_type) if isinstance(record_type, str) else record_type
    pairs: list[Column] = []
    for key, value in fields:
        pairs += [F.lit(key), value.cast("string")]
    return F.struct(
        kind.alias("record_type"),
        F.create_map(*pairs).alias("raw_data"),
        (F.lit(None).cast("string") if wrapper is None else wrapper).alias("wrapper"),
    )
