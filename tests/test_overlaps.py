"""Overlapping statements: the sweep against looking at every pair and every day."""

import datetime as dt
import random

import pytest

from ledgerloom.operators import overlaps as O

SCHEMA = "account_id string, source_type string, ingestion_id string, statement_period_from date, statement_period_to date"


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def invented(seed, n=60):
    pick = random.Random(seed)
    rows = []
    for i in range(n):
        start = pick.randrange(60)
        rows.append((f"a{i % 3}", "s", f"i{i}", day(start), day(start + pick.choice([0, 0, 3, 9, 30]))))
    return rows + [("a0", "s", "back", day(9), day(3)), ("a0", "s", "none", None, day(3)), (None, "s", "lost", day(1), day(2)), ("a0", "t", "other", day(0), day(60))]


def spans(rows):
    return [r for r in rows if r[0] and r[3] and r[4] and r[3] <= r[4]]


def pairs(rows):
    found = set()
    for a in spans(rows):
        for b in spans(rows):
            lo, hi = max(a[3], b[3]), min(a[4], b[4])
            if a[:2] == b[:2] and a[2] < b[2] and lo <= hi:
                found.add((*a[:2], a[2], b[2], lo, hi))
    return found


@pytest.mark.parametrize("seed", range(2))
def test_pairs_stretches_and_members(spark, seed):
    check(spark, invented(seed))


def test_a_hot_account_gives_the_same(splitting):
    check(splitting, invented(7))


def test_nothing_and_copies(spark):
    check(spark, [])
    check(spark, [("a", "s", f"i{n}", day(1), day(5)) for n in range(12)])


def check(spark, rows):
    # Several rows per statement, as in a table of transactions.
    frame = spark.createDataFrame(rows * 2, SCHEMA)
    assert {tuple(r) for r in O.find_overlapping_ingestions(frame).collect()} == pairs(rows)
    listed = O.find_overlapping_ingestions(frame).count()
    assert listed == len(pairs(rows))
    stretches = O.overlap_stretches(frame).collect()
    for r in stretches:
        for at in (r.stretch_from, r.stretch_to):
            assert r.members == sum(s[:2] == (r.account_id, r.source_type) and s[3] <= at <= s[4] for s in spans(rows))
    covered = {(r.account_id, r.source_type, r.stretch_from + dt.timedelta(days=k)) for r in stretches for k in range((r.stretch_to - r.stretch_from).days + 1)}
    wanted = {(a, s, day(n)) for a, s in {r[:2] for r in spans(rows)} for n in range(100) if sum(x[:2] == (a, s) and x[3] <= day(n) <= x[4] for x in spans(rows)) > 1}
    assert covered == wanted
    # A stretch is held by exactly the statements whose run of stretches includes it.
    members = O.overlap_members(frame).collect()
    assert len(members) == len(spans(rows))
    for r in stretches:
        inside = [m for m in members if m[:2] == r[:2] and m.first_stretch <= r.stretch <= m.last_stretch]
        assert len(inside) == r.members and all(m.period_from <= r.stretch_from <= r.stretch_to <= m.period_to for m in inside)


def test_membership_is_linear(spark):
    """Three hundred statements that all overlap make stretches, not forty thousand pairs."""
    frame = spark.createDataFrame([("a", "s", f"i{n}", day(n), day(1000 + n)) for n in range(300)], SCHEMA)
    assert O.overlap_stretches(frame).count() == 597 and O.overlap_members(frame).count() == 300
    assert O.find_overlapping_ingestions(frame).count() == 300 * 299 // 2
