"""Everything that is declared rather than computed, in one place."""

from __future__ import annotations

from dataclasses import dataclass

# Source types and what each of them carries.
CSV_SOURCES = ("monzo",)
TEXT_SOURCES = (
    "kroo", "natwest-transactions", "natwest-statement", "firstdirect", "amex",
    "vanguard-pdf", "monzo-pdf", "chase", "monzo-flex",
)
LEDGER_SOURCES = (
    "kroo", "amex", "firstdirect", "natwest-statement", "monzo-pdf", "chase", "monzo-flex",
)
PERIOD_SOURCES = TEXT_SOURCES
ANCHORED_SOURCES = (
    "amex", "firstdirect", "natwest-statement", "kroo", "chase", "monzo-flex", "monzo-pdf", "vanguard-pdf",
)
ACCOUNT_TYPES = ("current", "credit", "investment", "savings")

# Statements that print their newest line first.
NEWEST_FIRST_SOURCES = ("monzo-pdf", "monzo-flex")

# How a closing balance moves with signed amounts (+1 with, -1 against).
ROLLFORWARD_SIGN = {"amex": -1, "firstdirect": -1, "chase": 1, "natwest-statement": 1}

# Tolerances, in days.
GAP_TOLERANCE_DAYS = 3
DRIFT_TOLERANCE_DAYS = 3


@dataclass(frozen=True)
class MatchPolicy:
    """Two sources that report the same transactions, and whose row to keep."""

    preferred: str
    other: str


@dataclass(frozen=True)
class DerivedAnchor:
    """A source without balances, the source whose balance it rolls on from,
    and the sign its amounts move that balance with."""

    dependent: str
    anchor: str
    sign: int = 1


MATCH_POLICIES = (MatchPolicy(preferred="natwest-statement", other="natwest-transactions"),)
DERIVED_ANCHORS = (DerivedAnchor(dependent="natwest-transactions", anchor="natwest-statement", sign=1),)
