"""Personal data by base patterns and information-theoretic sanitisation.

Four kinds are found by pattern: email addresses, IP addresses, card numbers that
pass Luhn, phone numbers. Each distinct value is an entity to protect. Words that
stand in the same documents may give it away: with n(c), n(t), n(c, t) the documents
that hold the entity, the term, and both, the term tells

    pmi = log2(n(c, t) N / (n(c) n(t)))   of the   ic = log2(N / n(c))

bits that the entity is worth. A term with pmi >= `DISCLOSES` x ic, in at least
`SUPPORT` documents with the entity, gets a span of kind `term` wherever it stands, in
documents without the entity too, and is generalised like the rest. Terms are words of
four letters or more that touch no span of the four kinds.

Counts are over all documents and whole texts: a document names each of its words and
entities once, and counts are combined before the shuffle, so neither a common word nor
an entity in a third of all rows is a hot key. Entities in fewer than `SUPPORT`
documents can have no term and name no pairs. Texts are read from a written copy; only
words of documents that hold a term to hide are laid out by place.

Patterns start only where a match can start and take runs whole, and places come from
sums over chunks of matches, so that time is near linear in the text however many spans
it holds; a term is looked up by a join of words, not by a pattern. Defined results: a null text is empty and has no spans; null or
repeated doc_ids are rows like others; other columns are not read; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import document_text, fresh, keyed, materialized

SUPPORT, DISCLOSES = 3, 0.9
KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    # A run of digits with single spaces or hyphens between, taken whole, of 14 to 19 digits.
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_HINTS = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[ -]?[0-9]){13}"),
    "phone": lambda t: t.rlike(r"\+[0-9]"),
}
LETTERS = 4  # of a term, at least


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    each = F.transform(F.split(F.reverse(digits), ""), lambda d: F.when(d == "", 0).otherwise(d.cast("int")))
    doubled = F.transform(each, lambda d, i: F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


_HOLDS = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: F.forall(F.split(v, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")),
    "card": lambda v: luhn(_digits(v)),
    "phone": lambda v: F.length(_digits(v)).between(10, 15),
}


CHUNK = 256


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often it is named."""
    return F.transform(F.array(value), body)[0]


def _running(values: Column, fold: Callable[[Column, Column], Column]) -> Column:
    """The fold (from 0) of all values before each, and of all, in one array more.

    An array can only be grown by copying it, so values are folded in chunks of `CHUNK`
    and the chunks' totals in turn: n x CHUNK + (n / CHUNK)^2 steps for n values."""
    grow = lambda xs: F.aggregate(xs, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(fold(F.element_at(a, -1), x))))
    starts = F.sequence(F.lit(0), F.greatest(F.size(values) - 1, F.lit(0)), F.lit(CHUNK))
    local = F.transform(starts, lambda at: grow(F.slice(values, at + 1, F.lit(CHUNK))))

    def joined(parts: Column) -> Column:
        before = grow(F.transform(parts, lambda p: F.element_at(p, -1)))
        shifted = F.zip_with(
            parts, F.slice(before, F.lit(1), F.size(parts)),
            lambda p, b: F.transform(F.slice(p, F.lit(1), F.size(p) - 1), lambda x: fold(b, x)),
        )
        return F.concat(F.flatten(shifted), F.array(F.element_at(before, -1)))

    return _bound(local, joined)


def located(text: Column, pattern: str) -> Column:
    """All matches as structs (start, end, value), in code points from 0."""
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps"))

    def placed(cut: Column) -> Column:
        found = cut["found"]
        steps = F.zip_with(F.slice(cut["gaps"], F.lit(1), F.size(found)), found, lambda g, m: F.length(g) + F.length(m))
        return _bound(
            _running(steps, lambda a, x: a + x),
            lambda begins: F.transform(
                found,
                lambda m, i: F.struct(
                    (F.get(begins, i) + F.length(F.get(cut["gaps"], i))).alias("start"),
                    (F.get(begins, i) + F.length(F.get(cut["gaps"], i)) + F.length(m)).alias("end"), m.alias("value"),
                ),
            ),
        )

    return _bound(both, placed)


def base_spans(text: Column) -> Column:
    """Structs (start, order, end, kind, value) of the four kinds, sorted by place."""
    empty = F.array().cast("array<struct<start:int,order:int,end:int,kind:string,value:string>>")
    kinds = [F.when(_HINTS[kind](text), _of_kind(text, kind)).otherwise(empty) for kind in KINDS]
    return F.array_sort(F.concat(*kinds))


def _of_kind(text: Column, kind: str) -> Column:
    held = F.filter(located(text, PATTERNS[kind]), lambda m: _HOLDS[kind](m["value"]))
    return F.transform(
        held,
        lambda m: F.struct(
            m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("order"), m["end"].alias("end"),
            F.lit(kind).alias("kind"), m["value"].alias("value"),
        ),
    )


def _filled(value: Column) -> Column:
    """As many control characters as a value has characters: U+0001 for letters, U+0000 for others."""
    return F.regexp_replace(F.regexp_replace(value, r"\p{L}", "\x01"), r"[^\x01]", "\x00")


def masked(text: Column) -> Column:
    """The text, code point for code point, with filled stretches where data of the four
    kinds stand. Kinds are filled one after another, each by one cut of the text."""
    plain = F.translate(text, "\0\1", "  ")
    for kind in KINDS:
        plain = _bound(plain, _masking(kind))
    return plain


def _masking(kind: str) -> Callable[[Column], Column]:
    return lambda text: F.when(_HINTS[kind](text), _masked_kind(text, kind)).otherwise(text)


def _masked_kind(text: Column, kind: str) -> Column:
    both = F.struct(
        F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)).alias("found"), F.split(text, PATTERNS[kind], -1).alias("gaps")
    )
    hide = lambda m: F.when(_HOLDS[kind](m), _filled(m)).otherwise(m)
    return _bound(
        both, lambda cut: F.array_join(F.zip_with(cut["gaps"], F.transform(cut["found"], hide), lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")
    )


def _forms(text: Column) -> Column:
    """The distinct words that touch no data of the four kinds, as they are written."""
    words = F.array_distinct(F.split(masked(text), r"[^\p{L}\x00\x01]+"))
    return F.filter(words, lambda w: (F.length(w) >= LETTERS) & ~w.rlike(r"[\x00\x01]"))


def _terms(text: Column) -> Column:
    return F.array_distinct(F.transform(_forms(text), lambda w: F.lower(w)))


def found(docs: DataFrame, row: str | None = None) -> DataFrame:
    """Written table: row_id, doc_id, text, spans, for every document."""
    if row is None:
        row = fresh(docs, "row_id")
        docs = docs.withColumn(row, F.monotonically_increasing_id())
    text = document_text()
    return materialized(docs.select(
        F.col(row).alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"),
        base_spans(text).alias("spans"),
    ))


def term_counts(base: DataFrame) -> DataFrame:
    """Documents per term, over whole texts of all documents."""
    return base.select(F.explode(_terms(F.col("text"))).alias("term")).groupBy("term").agg(
        F.count(F.lit(1)).alias("n_term")
    )


def disclosing(base: DataFrame, support: int = SUPPORT, discloses: float = DISCLOSES) -> DataFrame:
    """(entity, term, pmi, ic) of the terms that tell too much of an entity."""
    n = base.count()
    named = F.array_distinct(F.transform("spans", lambda s: F.concat(s["kind"], F.lit(":"), F.lower(s["value"]))))
    entities = materialized(
        base.select(F.explode(named).alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
        .filter(F.col("n_entity") >= support)
    )
    held = (
        base.select("row_id", F.explode(named).alias("entity")).join(entities, "entity", "left_semi")
        .groupBy("row_id").agg(F.collect_list("entity").alias("entities"))
    )
    pairs = (
        base.filter(F.size("spans") > 0).join(held, "row_id")
        .select("entities", F.explode(_terms(F.col("text"))).alias("term"))
        .select(F.explode("entities").alias("entity"), "term")
        .groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_both")).filter(F.col("n_both") >= support)
    )
    told = pairs.join(entities, "entity").join(term_counts(base), "term")
    pmi = F.log2(F.col("n_both") * F.lit(float(n)) / (F.col("n_entity") * F.col("n_term")))
    ic = F.log2(F.lit(float(n)) / F.col("n_entity"))
    return told.select("entity", "term", pmi.alias("pmi"), ic.alias("ic")).filter(
        (F.col("ic") > 0) & (F.col("pmi") >= F.lit(discloses) * F.col("ic"))
    )


def detected(
    docs: DataFrame, row: str | None = None, support: int = SUPPORT, discloses: float = DISCLOSES
) -> DataFrame:
    """One row per document: row_id, doc_id, spans with kinds email, ip, card, phone and term."""
    base = found(docs, row)
    told = materialized(disclosing(base, support, discloses).select("term").distinct())
    holding = materialized(
        base.select("row_id", F.explode(_terms(F.col("text"))).alias("term")).join(told, "term", "left_semi").select("row_id").distinct()
    )
    # Words of the documents that hold such a term, with their places; a word that data cut is none.
    words = base.join(holding, "row_id", "left_semi").select(
        "row_id", F.explode(located(masked(F.col("text")), r"(?<![\p{L}\x01])\p{L}++(?!\x01)")).alias("word")
    ).filter(F.length("word.value") >= LETTERS)
    term = F.struct(
        F.col("word.start").alias("start"), F.lit(len(KINDS)).alias("order"), F.col("word.end").alias("end"),
        F.lit("term").alias("kind"), F.col("term").alias("value"),
    )
    hits = words.withColumn("term", F.lower("word.value")).join(told, "term", "left_semi").groupBy("row_id").agg(
        F.collect_list(term).alias("terms")
    )
    added = F.when(F.col("terms").isNull(), F.col("spans")).otherwise(F.concat("spans", "terms"))
    return base.select("row_id", "doc_id", "spans").join(hits, "row_id", "left").select(
        "row_id", "doc_id", F.array_sort(added).alias("spans")
    )


def _written(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def digests(detections: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda s: s["kind"] != "term")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in KINDS]
    return detections.select(
        "doc_id", *counts, F.sha2(_written(base), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans")
    )


def sanitized(docs: DataFrame, support: int = SUPPORT, discloses: float = DISCLOSES) -> DataFrame:
    """The documents with every span generalised to its kind, as in `[EMAIL]`.

    Where spans overlap, the one that starts first hides the whole stretch."""
    row, spans = fresh(docs, "row_id"), fresh(docs, "pii_spans")
    copy = keyed(docs, row)
    hits = detected(copy, row, support, discloses).filter(F.size("spans") > 0)
    joined = copy.join(hits.select(F.col("row_id").alias(row), F.col("spans").alias(spans)), row, "left")
    cleaned = F.when(F.col(spans).isNull(), F.col("text")).otherwise(_bound(F.col(spans), lambda found: _rewritten(document_text(), found)))
    return joined.select(*[cleaned.alias(c) if c == "text" else F.col(c) for c in docs.columns])


PIECE = 4096


def _rewritten(text: Column, spans: Column) -> Column:
    """The text with every stretch of spans replaced; spans come sorted.

    A place in a string is found by walking there, so the text is cut into pieces first
    and every stretch between spans is put together from the pieces it lies in."""
    ends = _running(F.transform(spans, lambda s: s["end"]), lambda a, x: F.greatest(a, x))
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))

    def between(cut: Column, begin: Column, end: Column) -> Column:
        numbers = F.sequence(F.floor(begin / PIECE).cast("int"), F.floor((end - 1) / PIECE).cast("int"))
        part = lambda k: F.substring(
            F.get(cut, k), F.greatest(begin - k * PIECE, F.lit(0)) + 1, F.least(end - k * PIECE, F.lit(PIECE)) - F.greatest(begin - k * PIECE, F.lit(0))
        )
        return F.when(begin < end, F.array_join(F.transform(numbers, part), "")).otherwise(F.lit(""))

    def made(at: Column) -> Column:
        known, cut = at["ends"], at["pieces"]
        out = F.transform(
            spans,
            lambda s, i: F.when(
                s["start"] >= F.get(known, i), F.concat(between(cut, F.get(known, i), s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
            ).otherwise(F.lit("")),
        )
        return F.concat(F.array_join(out, ""), between(cut, F.element_at(known, -1), at["length"]))

    return _bound(F.struct(ends.alias("ends"), pieces.alias("pieces"), F.length(text).alias("length")), made)
