"""Duplicate removal within and across sources, with full provenance.

Tiers, in order:

1. *Fingerprint.* Every row gets a content fingerprint and an occurrence number
   within (source, fingerprint) over the whole input, hence its canonical id.
2. *Overlap.* Two statements of one (account, source) whose periods overlap
   report the same rows. The k-th copy of a fingerprint in one statement stands
   for the k-th copy in the other; the row of the statement with the later
   (period end, ingestion id) is kept.
3. *Drift.* Rows of two overlapping statements that agree in all but the date,
   at most three days apart, and are the only such leftovers on both sides.
4. *Cross-source.* For declared source pairs, the k-th row of the other source
   per (account, date, amount) gives way to the k-th row of the preferred one.

The tiers are set operations, so the result does not depend on row order. With
two statements this is what walking the pairs one after another gives. With
three or more overlapping statements, walking the pairs lets one row absorb a
different copy in every step and ends with too few rows; here the result keeps
as many copies as the statement with the most of them.

Tier 2 needs no pairs at all. Within (source, fingerprint, k) there is one row
per statement; a row is eligible when its date is within three days of its own
period, and for eligible rows "some later statement with this row overlaps mine"
is the same as "the smallest period start among the later statements is not
after my period end". Sorted by period end downwards, that is a running minimum,
and every unbroken stretch has one survivor: its first row.

Tier 3 finds pairs of statements that hold survivors a few days apart: after tier 2 at
most sqrt(2 * rows) statements can still hold survivors of one fingerprint around one
date, so joining neighbouring dates stays linear in the rows. What such a pair has left
over in the window it shares is told from running counts at the two ends of the window,
so that no row is ever joined to a pair. Neither tier gathers a group in one place.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import keys as K
from ledgerloom.operators.ordered import desc, hot_keys, last_known, min_before, part, previous, row_number, running_sum, scan
from ledgerloom.registries import DRIFT_TOLERANCE_DAYS, MATCH_POLICIES, MatchPolicy
from ledgerloom.session import materialized

ID = "silver_transaction_id"
# Copies of a row share at least these, and finding hot copies by them needs
# neither the description nor a hash.
COPY_KEYS = ("source_type", "account_id", "transaction_date", "amount_minor")
HELPERS = (
    "_ts", "_fingerprint", "_loose", "_sort_key", "_occurrence", "_eligible", "_rank", "_reach", "_survivor",
)


def _days(n: int) -> Column:
    return F.expr(f"INTERVAL '{n}' DAY")


def with_match_keys(transactions: DataFrame) -> DataFrame:
    return transactions.withColumns(
        {
            "_ts": K.moment("transaction_date"),
            "_fingerprint": K.fingerprint("account_id", "transaction_date", "amount_minor", "description"),
            "_loose": K.loose_fingerprint("account_id", "amount_minor", "description"),
            "_sort_key": F.coalesce(
                F.col("statement_period_to").cast("timestamp_ntz"), F.col("upload_timestamp").cast("timestamp_ntz")
            ),
        }
    )


def number_occurrences(keyed: DataFrame, split: bool | None = None) -> DataFrame:
    """Tier 1: occurrence number and canonical id."""
    numbered = scan(
        keyed,
        ["source_type", "_fingerprint"],
        ["_sort_key", "line_number", "ingestion_id", "bronze_record_id"],
        {"_occurrence": row_number()},
        split=split,
    )
    return numbered.withColumn(ID, K.canonical_id("source_type", "_fingerprint", "_occurrence"))


def mark_overlaps(
    numbered: DataFrame, tolerance: int = DRIFT_TOLERANCE_DAYS, split: bool | None = None
) -> DataFrame:
    """Tier 2: `_survivor` is the id of the row that stands for this one, null
    where the row stands for itself."""
    start = F.col("statement_period_from").cast("timestamp_ntz")
    end = F.col("statement_period_to").cast("timestamp_ntz")
    eligible = F.coalesce(
        (F.col("_ts") >= start - _days(tolerance)) & (F.col("_ts") <= end + _days(tolerance)) & (start <= end),
        F.lit(False),
    )
    ranked = scan(
        numbered.withColumn("_eligible", eligible),
        ["source_type", "_fingerprint", "_eligible", "ingestion_id"],
        ["line_number", "bronze_record_id"],
        {"_rank": row_number()},
        split=split,
    )
    group = ["source_type", "_fingerprint", "_eligible", "_rank"]
    order = [desc("statement_period_to"), desc("ingestion_id"), "bronze_record_id"]
    reached = scan(ranked, group, order, {"_reach": min_before("statement_period_from")}, split=split)
    stands = ~F.col("_eligible") | F.col("_reach").isNull() | (F.col("_reach") > F.col("statement_period_to"))
    headed = scan(
        reached.withColumn("_head", F.when(stands, F.col(ID))), group, order, {"_heads": last_known("_head")},
        split=split,
    )
    return headed.withColumn("_survivor", F.when(~stands, F.col("_heads"))).drop("_head", "_heads")


def mark_duplicates(transactions: DataFrame, tolerance: int = DRIFT_TOLERANCE_DAYS) -> DataFrame:
    """Tiers 1 and 2. Four windows, one shuffle: all of them partition by at
    least (source, fingerprint). Hot copies are looked for once, and go through
    the same steps apart from the rest."""
    hot = hot_keys(transactions, COPY_KEYS)
    keyed = with_match_keys(transactions)
    if not hot:
        return mark_overlaps(number_occurrences(keyed, False), tolerance, False)
    cold, warm = part(keyed, COPY_KEYS, hot)
    return mark_overlaps(number_occurrences(cold, False), tolerance, False).unionByName(
        mark_overlaps(number_occurrences(warm, True), tolerance, True)
    )


def drift_edges(marked: DataFrame, tolerance: int = DRIFT_TOLERANCE_DAYS) -> DataFrame:
    """Tier 3: (absorbed, survivor) ids of date-shifted duplicates."""
    place = ["source_type", "account_id", "_loose"]
    period = ["statement_period_from", "statement_period_to"]
    rows = marked.filter("_eligible").select(
        *place, "_fingerprint", "_ts", "ingestion_id", *period, "_rank", ID, "_survivor"
    )
    # Only survivors with another survivor close by can take part: few, as a rule.
    order = ["_ts", "_fingerprint", "ingestion_id", "_rank"]
    alive = rows.filter("_survivor IS NULL").drop("_survivor", ID)
    looked = scan(alive, place, order, {"_before": previous("_ts")}, sized_by=rows)
    looked = scan(looked, place, [desc(o) for o in order], {"_after": previous("_ts")}, sized_by=rows)
    beside = (F.col("_before") >= F.col("_ts") - _days(tolerance)) | (F.col("_after") <= F.col("_ts") + _days(tolerance))
    width = tolerance + 1
    slot = F.floor(F.datediff(F.col("_ts").cast("date"), F.lit("1970-01-01").cast("date")) / width)
    alive = materialized(
        looked.filter(beside).select(*place, "_fingerprint", "_ts", "ingestion_id", *period, slot.alias("slot")).distinct()
    )
    near = alive.withColumn("slot", F.explode(F.array(F.col("slot") - 1, F.col("slot"), F.col("slot") + 1)))
    a, b = alive.alias("a"), near.alias("b")
    lo = F.greatest("a.statement_period_from", "b.statement_period_from")
    hi = F.least("a.statement_period_to", "b.statement_period_to")
    in_window = [
        F.col(f"{s}._ts").between(lo.cast("timestamp_ntz") - _days(tolerance), hi.cast("timestamp_ntz") + _days(tolerance))
        for s in "ab"
    ]
    later = (F.col("b.statement_period_to") > F.col("a.statement_period_to")) | (
        (F.col("b.statement_period_to") == F.col("a.statement_period_to"))
        & (F.col("b.ingestion_id") > F.col("a.ingestion_id"))
    )
    close = F.col("a._ts").between(F.col("b._ts") - _days(tolerance), F.col("b._ts") + _days(tolerance))
    pairs = (
        a.join(
            b,
            [*[F.col(f"a.{c}") == F.col(f"b.{c}") for c in [*place, "slot"]], later, lo <= hi, close,
             F.col("a._fingerprint") != F.col("b._fingerprint"), *in_window],
        )
        .select(
            *[F.col(f"a.{c}").alias(c) for c in place],
            F.col("a.ingestion_id").alias("low"), F.col("b.ingestion_id").alias("high"),
            F.col("b.statement_period_to").alias("high_to"), lo.alias("lo"), hi.alias("hi"),
        )
        .distinct()
    )
    pairs = materialized(pairs)
    statements = pairs.select(*place, F.explode(F.array("low", "high")).alias("ingestion_id")).distinct()
    near = materialized(
        rows.join(statements, [*place, "ingestion_id"], "left_semi").select(*place, "ingestion_id", "_ts", ID, "_survivor")
    )
    clear = _leftovers(near, pairs, place, tolerance).filter("low_left = 1 AND high_left = 1")
    # The one leftover of a side is what its hashes sum up to.
    standing = near.filter("_survivor IS NULL").withColumn("code", F.xxhash64(ID))
    for side, name in (("low", "absorbed"), ("high", "survivor")):
        of_side = standing.select(
            *place, F.col("ingestion_id").alias(side), F.col("code").alias(f"{side}_code"), F.col(ID).alias(name),
            F.col("_ts").alias(f"{side}_ts"),
        )
        clear = clear.join(of_side, [*place, side, f"{side}_code"])
    shifted = clear.filter(F.col("low_ts").between(F.col("high_ts") - _days(tolerance), F.col("high_ts") + _days(tolerance)))
    return shifted.groupBy("absorbed").agg(F.max_by("survivor", F.struct("high_to", "high")).alias("survivor"))


def _leftovers(near: DataFrame, pairs: DataFrame, place: list[str], tolerance: int) -> DataFrame:
    """Per pair of statements, how many rows of each the other does not hold within the
    window they share, and the hashes of these rows summed up.

    Rows of a pair are never looked at. After tier 2 the k-th copy of the earlier
    statement is gone wherever the later one has a k-th copy, so what the earlier one has
    left is what survives of it, and what the later one has left is what survives of it
    less the copies that stand for rows of the earlier. Both are counts by (statement,
    moment) and by (statement, statement of the survivor, moment): running sums, of which
    a pair takes differences at the ends of its window."""
    mask = F.lit((1 << 32) - 1)
    halves = lambda c: (F.shiftrightunsigned(F.xxhash64(c), 32).alias("upper"), F.xxhash64(c).bitwiseAND(mask).alias("lower"))
    own = near.filter("_survivor IS NULL").select(
        *place, F.col("ingestion_id").alias("of"), F.lit(None).cast("string").alias("for"), "_ts", *halves(ID)
    )
    heads = near.filter("_survivor IS NULL").select(F.col(ID).alias("_survivor"), F.col("ingestion_id").alias("for"))
    taken = near.filter("_survivor IS NOT NULL").join(heads, "_survivor").select(
        *place, F.col("ingestion_id").alias("of"), "for", "_ts", *halves("_survivor")
    )
    none = lambda kind: F.lit(None).cast(kind)
    counts = (
        own.unionByName(taken).groupBy(*place, "of", "for", "_ts")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("upper").alias("upper"), F.sum("lower").alias("lower"))
        .withColumns({"rank": F.lit(1), "side": none("string"), "sign": none("int")})
    )
    pair = ["low", "high", "high_to", "lo", "hi"]
    begin = F.col("lo").cast("timestamp_ntz") - _days(tolerance)
    end = F.col("hi").cast("timestamp_ntz") + _days(tolerance)

    def ends(side: str, of: str, held_for: Column, sign: int) -> list[Column]:
        named = [F.lit(side).alias("side"), F.col(of).alias("of"), held_for.alias("for")]
        return [
            F.struct(*named, begin.alias("_ts"), F.lit(0).alias("rank"), F.lit(-sign).alias("sign")),
            F.struct(*named, end.alias("_ts"), F.lit(2).alias("rank"), F.lit(sign).alias("sign")),
        ]

    nobody = none("string")
    asked = F.array(*ends("low", "low", nobody, 1), *ends("high", "high", nobody, 1), *ends("high", "low", F.col("high"), -1))
    zero = F.lit(0).cast("long")
    points = pairs.select(*place, *pair, F.inline(asked)).withColumns({"n": zero, "upper": zero, "lower": zero})
    split = bool(hot_keys(near, [*place, "ingestion_id"]))
    summed = scan(
        counts.unionByName(points, allowMissingColumns=True), [*place, "of", "for"], ["_ts", "rank", "side", "low", "high", "lo", "hi"],
        {f"{c}_so_far": running_sum(c) for c in ("n", "upper", "lower")}, split=split,
    )

    def total(side: str, column: str) -> Column:
        return F.sum(F.when(F.col("side") == side, F.col("sign") * F.col(f"{column}_so_far")))

    return (
        summed.filter("rank <> 1").groupBy(*place, *pair)
        .agg(*[total(s, c).alias(f"{s}_{c}") for s in ("low", "high") for c in ("n", "upper", "lower")])
        .select(
            *place, "low", "high", "high_to", F.col("low_n").alias("low_left"), F.col("high_n").alias("high_left"),
            *[
                F.when(F.col(f"{s}_n") == 1, F.shiftleft(f"{s}_upper", 32).bitwiseOR(F.col(f"{s}_lower"))).alias(f"{s}_code")
                for s in ("low", "high")
            ],
        )
    )


def _cross_keys() -> list[str]:
    return ["account_id", "transaction_date", "amount_minor"]


def mark_cross_source(canonical: DataFrame, policy: MatchPolicy) -> DataFrame:
    """Tier 4 for one policy: `_cross` is the id of the preferred row that
    stands for this one. Only the two named sources are shuffled."""
    named = F.col("source_type").isin(policy.preferred, policy.other)
    # Dealt by the shared keys, both windows find their rows in place: one shuffle.
    ranked = scan(
        canonical.filter(named).repartition(*_cross_keys()), [*_cross_keys(), "source_type"], ["_fingerprint", "_occurrence"],
        {"_k": row_number()}, sized_by=canonical.filter(named),
    )
    # At most one row per side shares (key, k), so this window is never hot.
    facing = Window.partitionBy(*_cross_keys(), "_k")
    preferred = F.max(F.when(F.col("source_type") == policy.preferred, F.col(ID))).over(facing)
    whole_key = F.lit(True)
    for name in _cross_keys():
        whole_key = whole_key & F.col(name).isNotNull()
    paired = ranked.withColumn(
        "_cross", F.when((F.col("source_type") == policy.other) & whole_key, preferred)
    )
    rest = canonical.filter(~named).withColumn("_cross", F.lit(None).cast("string"))
    return rest.unionByName(paired.drop("_k"))


@dataclass(frozen=True)
class Matched:
    """Surviving transactions, and which Bronze rows each of them stands for. Either
    is planned when it is first asked for."""

    marked: DataFrame
    edges: DataFrame
    policies: Sequence[MatchPolicy]

    @cached_property
    def transactions(self) -> DataFrame:
        return survivors(self.marked, self.edges, self.policies)

    @cached_property
    def sources(self) -> DataFrame:
        return provenance(self.marked, self.edges, self.policies)


def resolve_chains(edges: DataFrame) -> DataFrame:
    """Point every absorbed id at its last survivor (a -> b -> c gives a -> c).

    Each round doubles the reach, so a chain of n takes log2(n) rounds."""
    while True:
        onward = edges.select(F.col("absorbed").alias("survivor"), F.col("survivor").alias("_next"))
        if edges.join(onward, "survivor", "left_semi").isEmpty():
            return edges
        edges = materialized(
            edges.join(onward, "survivor", "left").select(
                "absorbed", F.coalesce("_next", "survivor").alias("survivor")
            )
        )


def overlap_survivors(marked: DataFrame) -> DataFrame:
    return marked.filter(F.col("_survivor").isNull())


def survivors(marked: DataFrame, edges: DataFrame, policies: Sequence[MatchPolicy] = MATCH_POLICIES) -> DataFrame:
    """Rows that no tier absorbed, in the input's columns plus the id."""
    rows = overlap_survivors(marked).join(edges.select(F.col("absorbed").alias(ID)), ID, "left_anti")
    for policy in policies:
        rows = mark_cross_source(rows, policy).filter(F.col("_cross").isNull()).drop("_cross")
    return rows.drop(*HELPERS)


def match_transactions(
    transactions: DataFrame, policies: Sequence[MatchPolicy] = MATCH_POLICIES, tolerance: int = DRIFT_TOLERANCE_DAYS
) -> Matched:
    """All tiers. The rows after tier 2, and the few tier-3 edges, are written
    once; both results read them from there, and provenance runs only where asked for."""
    marked = materialized(mark_duplicates(transactions, tolerance))
    edges = materialized(drift_edges(marked, tolerance))
    return Matched(marked, edges, policies)


def provenance(marked: DataFrame, edges: DataFrame, policies: Sequence[MatchPolicy] = MATCH_POLICIES) -> DataFrame:
    """Canonical id -> every Bronze row it stands for, and by which rule.

    A row that was absorbed keeps its own `fingerprint` entry, pointed at its
    final survivor, and gains one that names the tier which absorbed it."""
    chains = resolve_chains(edges)
    drift = chains.select(F.col("absorbed").alias("_target"), F.col("survivor").alias("_drifted"))
    rows = (
        marked.withColumn("_target", F.coalesce("_survivor", ID))
        .join(drift, "_target", "left")
        .withColumn("_final", F.coalesce("_drifted", "_target"))
    )
    own = F.col("_survivor").isNull()
    policies_of = [
        F.lit("fingerprint"),
        F.when(~own, F.concat(F.lit("overlap-window("), "source_type", F.lit(")"))),
        F.when(own & F.col("_drifted").isNotNull(), F.concat(F.lit("overlap-window-date-shifted("), "source_type", F.lit(")"))),
    ]
    # Stage by stage, a policy's losers are dropped before the next policy runs.
    standing = overlap_survivors(marked).join(chains.select(F.col("absorbed").alias(ID)), ID, "left_anti")
    for i, policy in enumerate(policies):
        crossed = mark_cross_source(standing, policy)
        lost = crossed.filter(F.col("_cross").isNotNull()).select(F.col(ID).alias("_final"), "_cross")
        # Only survivors of the other source can be lost, and an id begins with its source.
        may_lose = F.coalesce(F.col("_final").startswith(f"{policy.other}:"), F.lit(False))
        rows = rows.filter(may_lose).join(lost, "_final", "left").unionByName(
            rows.filter(~may_lose).withColumn("_cross", F.lit(None).cast("string"))
        )
        took = (F.col(ID) == F.col("_final")) & F.col("_cross").isNotNull()
        rows = rows.withColumn(f"_took_{i}", took).withColumn("_final", F.coalesce("_cross", "_final")).drop("_cross")
        policies_of.append(F.when(F.col(f"_took_{i}"), F.lit(f"cross-source({policy.preferred}-preferred)")))
        standing = crossed.filter(F.col("_cross").isNull()).drop("_cross")
    return rows.select(
        F.col("_final").alias(ID),
        "bronze_record_id", "ingestion_id", "source_type",
        F.explode(F.array_compact(F.array(*policies_of))).alias("match_policy"),
    ).distinct()
