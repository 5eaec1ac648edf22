"""Duplicate removal, by scenario and against a pairwise model of the rules."""

import datetime as dt
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ledgerloom.operators import matching as X
from ledgerloom.operators import ordered
from ledgerloom.registries import MatchPolicy

SCHEMA = (
    "account_id string, transaction_date date, amount_minor bigint, description string, source_type string, "
    "bronze_record_id string, bronze_source_key string, ingestion_id string, upload_timestamp timestamp_ntz, "
    "statement_period_from date, statement_period_to date, line_number int, currency string"
)
UPLOAD = dt.datetime(2024, 6, 1)
POLICY = (MatchPolicy(preferred="stmt", other="exp"),)


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n - 1)


def row(ingestion, n, amount=-100, text="SHOP", source="exp", period=None, line=1, account="a"):
    start, end = (day(period[0]), day(period[1])) if period else (None, None)
    return (account, day(n), amount, text, source, f"{ingestion}/{line}", "k", ingestion, UPLOAD, start, end, line, "GBP")


def match(spark, rows, policies=POLICY):
    matched = X.match_transactions(spark.createDataFrame(rows, SCHEMA), policies)
    return matched.transactions.collect(), matched.sources.collect()


def kept(rows):
    return sorted(r.bronze_record_id for r in rows)


def test_repeats_in_one_source_are_kept(spark):
    rows, sources = match(spark, [row("i", 5, line=1), row("i", 5, line=2)])
    assert [r.silver_transaction_id[-2:] for r in sorted(rows, key=lambda r: r.line_number)] == ["_1", "_2"]
    assert len(sources) == 2


def test_partial_period_covered_again(spark):
    part, full = (1, 15), (1, 31)
    rows, sources = match(
        spark,
        [row("p", 5, period=part), row("f", 5, period=full), row("f", 20, text="LATER", period=full, line=2)],
    )
    assert kept(rows) == ["f/1", "f/2"]
    assert sorted((s.bronze_record_id, s.match_policy) for s in sources) == [
        ("f/1", "fingerprint"), ("f/2", "fingerprint"), ("p/1", "fingerprint"), ("p/1", "overlap-window(exp)"),
    ]


def test_counts_differ_inside_the_overlap(spark):
    rows, _ = match(spark, [row("p", 5, period=(1, 15)), row("f", 5, period=(1, 31)), row("f", 5, period=(1, 31), line=2)])
    assert len(rows) == 2


def test_three_overlapping_statements_keep_the_largest_count(spark):
    rows, _ = match(
        spark,
        [row("a", 5, period=(1, 10), line=i) for i in (1, 2, 3)] + [row("b", 5, period=(1, 20)), row("c", 5, period=(1, 31))],
    )
    assert len(rows) == 3


def test_no_overlap_no_collapse(spark):
    rows, _ = match(spark, [row("p", 10, period=(1, 10)), row("f", 10, period=(11, 31))])
    assert len(rows) == 2


def test_undeclared_periods_never_collapse(spark):
    rows, _ = match(spark, [row("p", 5), row("f", 5)])
    assert len(rows) == 2


def test_shifted_dates(spark):
    both = [row("p", 10, period=(1, 15)), row("f", 12, period=(1, 31))]
    rows, sources = match(spark, both)
    assert kept(rows) == ["f/1"]
    assert "overlap-window-date-shifted(exp)" in {s.match_policy for s in sources}
    assert len(match(spark, [row("p", 3, period=(1, 15)), row("f", 10, period=(1, 31))])[0]) == 2
    ambiguous = [row("p", 10, period=(1, 15)), row("p", 11, period=(1, 15), line=2),
                 row("f", 12, period=(1, 31)), row("f", 13, period=(1, 31), line=2)]
    assert len(match(spark, ambiguous)[0]) == 4


def test_a_copy_already_matched_is_no_candidate(spark):
    rows, _ = match(
        spark,
        [row("p", 10, period=(1, 20)), row("p", 12, period=(1, 20), line=2),
         row("f", 10, period=(1, 31)), row("f", 10, period=(1, 31), line=2)],
    )
    assert kept(rows) == ["f/1", "f/2"]


def test_chains_of_shifts_end_at_the_last_survivor(spark):
    rows, sources = match(
        spark, [row("a", 10, period=(1, 20)), row("b", 12, period=(1, 25)), row("c", 14, period=(1, 31))]
    )
    assert kept(rows) == ["c/1"]
    assert {s.silver_transaction_id for s in sources} == {rows[0].silver_transaction_id}


def test_cross_source_keeps_the_preferred(spark):
    rows, sources = match(
        spark,
        [row("e", 5, text="X", line=1), row("e", 5, text="Y", line=2), row("e", 5, text="Z", line=3),
         row("s", 5, text="P", source="stmt", line=1), row("s", 5, text="Q", source="stmt", line=2)],
    )
    assert sorted(r.source_type for r in rows) == ["exp", "stmt", "stmt"]
    assert sum(s.match_policy == "cross-source(stmt-preferred)" for s in sources) == 2


# --- a model: compare every pair of rows --------------------------------------


def model(rows):
    """Tiers 2 and 3 over pairs of statements, straight from their wording."""
    rows = [dict(zip([c.split()[0] for c in SCHEMA.split(", ")], r)) for r in rows]
    three = dt.timedelta(days=3)
    for r in rows:
        r["fp"] = (r["source_type"], r["account_id"], r["amount_minor"], r["description"], r["transaction_date"])
        r["loose"] = r["fp"][:4]
        r["place"] = (r["statement_period_to"], r["ingestion_id"])
    for r in rows:
        r["k"] = sum(o["fp"] == r["fp"] and o["ingestion_id"] == r["ingestion_id"] and o["line_number"] <= r["line_number"] for o in rows)

    def window(a, b):
        lo = max(a["statement_period_from"], b["statement_period_from"])
        hi = min(a["statement_period_to"], b["statement_period_to"])
        return (lo - three, hi + three) if lo <= hi else None

    def inside(r, w):
        return w[0] <= r["transaction_date"] <= w[1]

    gone = set()
    for a in rows:
        for b in rows:
            if a["fp"] == b["fp"] and a["k"] == b["k"] and b["place"] > a["place"]:
                w = window(a, b)
                if w and inside(a, w):
                    gone.add(a["bronze_record_id"])
    left = [r for r in rows if r["bronze_record_id"] not in gone]
    drifted = set()
    statements = {(r["source_type"], r["account_id"], r["ingestion_id"]): r for r in rows}
    for (sa, aa, ia), a in statements.items():
        for (sb, ab, ib), b in statements.items():
            if (sa, aa) != (sb, ab) or not b["place"] > a["place"] or not window(a, b):
                continue
            w = window(a, b)
            lows = [r for r in left if r["ingestion_id"] == ia and r["fp"][:2] == (sa, aa) and inside(r, w)]
            taken = {(r["fp"], r["k"]) for r in rows if r["ingestion_id"] == ia}
            highs = [r for r in left if r["ingestion_id"] == ib and r["fp"][:2] == (sa, aa) and inside(r, w) and (r["fp"], r["k"]) not in taken]
            for loose in {r["loose"] for r in lows}:
                mine = [r for r in lows if r["loose"] == loose]
                theirs = [r for r in highs if r["loose"] == loose]
                if len(mine) == len(theirs) == 1 and abs(mine[0]["transaction_date"] - theirs[0]["transaction_date"]) <= three:
                    drifted.add(mine[0]["bronze_record_id"])
    return sorted(r["bronze_record_id"] for r in left if r["bronze_record_id"] not in drifted)


def invented(seed, many=60):
    pick = random.Random(seed)
    periods = {f"i{n}": sorted(pick.sample(range(1, 40), 2)) for n in range(6)}
    rows = []
    for n in range(many):
        ingestion = pick.choice(list(periods))
        a, b = periods[ingestion]
        rows.append(
            row(ingestion, pick.randint(max(a - 4, 1), b + 4), amount=pick.choice([-100, -100, -200]),
                text=pick.choice(["S", "S", "T"]), period=(a, b), line=n)
        )
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_against_the_model(spark, seed):
    rows = invented(seed)
    found, sources = match(spark, rows, ())
    assert kept(found) == model(rows)
    ids = {r.silver_transaction_id for r in found}
    assert {s.silver_transaction_id for s in sources} == ids
    assert {s.bronze_record_id for s in sources} == {r[5] for r in rows}


def test_row_order_does_not_matter(spark):
    rows = invented(11)
    shuffled = rows[:]
    random.Random(1).shuffle(shuffled)
    assert sorted(map(tuple, match(spark, rows)[1])) == sorted(map(tuple, match(spark, shuffled)[1]))


def test_hot_copies_take_the_split_path(splitting):
    rows = invented(5) + [row("h", 5, period=(1, 20), line=100 + i) for i in range(30)] + [
        row("g", 5, period=(1, 30), line=200 + i) for i in range(25)
    ]
    split, split_sources = match(splitting, rows)
    splitting.conf.set(ordered.MIN_BYTES, str(1 << 60))
    plain, plain_sources = match(splitting, rows)
    assert sorted(map(tuple, split)) == sorted(map(tuple, plain))
    assert sorted(map(tuple, split_sources)) == sorted(map(tuple, plain_sources))
    assert kept(plain) == model(rows)


def test_one_shuffle_for_the_first_two_tiers(spark):
    marked = X.mark_duplicates(spark.createDataFrame(invented(3), SCHEMA))
    plan = marked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(st.lists(st.tuples(st.integers(1, 30), st.integers(0, 20)), min_size=1, max_size=8))
def test_islands_equal_pairwise_overlap(spans):
    """The running minimum drops what comparing each pair of periods drops."""
    periods = sorted({(a + length, a) for a, length in spans}, reverse=True)
    pairwise = [any(start <= p[0] for _, start in periods[:i]) for i, p in enumerate(periods)]
    lowest, running = None, []
    for end, start in periods:
        running.append(lowest is not None and lowest <= end)
        lowest = start if lowest is None else min(lowest, start)
    assert running == pairwise
