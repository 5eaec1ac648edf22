import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources.statements import detect_layouts, parse_statements
from tests import samples


def texts(spark, pairs):
    rows = [(name, f"{name}.pdf", text) for name, text in pairs]
    return spark.createDataFrame(rows, "ingestion_id string, filename string, text string").withColumns(
        {
            "raw_artifact_path": F.col("filename"),
            "upload_timestamp": F.lit("2026-07-10 09:00:00").cast("timestamp_ntz"),
        }
    )


@pytest.fixture(scope="module")
def parsed(spark):
    rows = parse_statements(detect_layouts(texts(spark, samples.ALL.items()))).collect()
    by_source = {}
    for row in sorted(rows, key=lambda r: (r.source_type, r.line_number)):
        by_source.setdefault(row.source_type, []).append(row)
    return by_source


def told(rows, *keys, kind="transaction"):
    return [tuple(r.raw_data.get(k) for k in keys) for r in rows if r.record_type == kind]


def test_every_sample_is_recognised_as_itself(spark):
    found = detect_layouts(texts(spark, samples.ALL.items())).collect()
    assert all(r.layout == r.ingestion_id and r.detection == "matched" for r in found)


def test_detection_statuses(spark):
    both = samples.KROO + samples.CHASE
    found = {
        r.ingestion_id: (r.layout, r.detection)
        for r in detect_layouts(texts(spark, [("both", both), ("none", "x" * 80), ("short", "Kroo Current Account")])).collect()
    }
    assert found == {"both": (None, "ambiguous"), "none": (None, "unrecognised"), "short": (None, "unrecognised")}


def test_kroo(parsed):
    rows = parsed["kroo"]
    assert told(rows, "date", "description", "amount_minor", "balance_minor") == [
        ("02 June 2026", "Card payment to Corner Shop", "-1250", "8750"),
        ("05 June 2026", "From Employer Ltd Salary June", "100000", "108750"),
        ("11 June 2026", "Payment to Landlord", "-50000", "58750"),
    ]
    assert rows[0].statement_period_from == dt.date(2026, 6, 1)
    assert (rows[0].reconciliation_expected_opening_minor, rows[0].reconciliation_expected_closing_minor) == (10000, 58750)
    assert all(r.reconciliation_matches for r in rows)


def test_natwest_transactions(parsed):
    assert told(parsed["natwest-transactions"], "date", "description", "amount_minor") == [
        ("28 Dec 2025", "CORNER SHOP Debit card transaction", "-720"),
        ("3 Jan 2026", "FRIEND", "2000"),
        ("6 Jan 2026", "REFUND", "300"),
    ]
    assert parsed["natwest-transactions"][0].reconciliation_check is None


def test_natwest_statement(parsed):
    rows = parsed["natwest-statement"]
    assert told(rows, "date", "description", "amount_minor", "balance_minor") == [
        ("20 NOV 2025", "CORNER SHOP ROAD NAME", "-1000", "49000"),
        ("20 NOV 2025", "BAKERY", "-500", "48500"),
        ("2 JAN 2026", "REFUND", "1500", "50000"),
        ("10 FEB 2026", "RENT", "-3000", "47000"),
    ]
    assert [r.line_number for r in rows] == [1, 2, 3, 4]
    assert rows[0].reconciliation_expected_opening_minor == 50000 and rows[0].reconciliation_matches


def test_firstdirect(parsed):
    rows = parsed["firstdirect"]
    assert told(rows, "date", "description", "amount_minor", "balance_minor") == [
        ("08 Apr 26", "GROCER TOWN", "-3250", "13250"),
        ("12 Apr 26", "PAYMENT THANK YOU", "5000", "8250"),
    ]
    assert rows[0].statement_period_from == dt.date(2026, 4, 5)
    assert rows[0].reconciliation_matches


def test_amex(parsed):
    rows = parsed["amex"]
    assert told(rows, "date", "description", "amount_minor", "balance_minor") == [
        ("21 Dec 2025", "GROCER 55 TOWN", "-1500", "11500"),
        ("03 Jan 2026", "PAYMENT RECEIVED", "6000", "5500"),
        ("05 Jan 2026", "BOOK SHOP", "-4500", "10000"),
        ("04 Jan 2026", "INSTALMENT PLAN", "3000", "7000"),
        ("19 Jan 2026", "INSTALMENT PLAN FEE", "-500", "11000"),
    ]
    assert told(rows, "plan_total", "plan_lifetime_fee", "due_this_month_plan", "instalment_progress", "as_of_date",
                kind="plan_it_instalment") == [("300.00", "9.00", "35.00", "1 OF 3", "19 Jan 2026")]
    assert rows[0].reconciliation_expected_closing_minor == 11500
    assert rows[0].reconciliation_derived_closing_minor == 11000
    assert rows[0].reconciliation_matches is False


def test_vanguard(parsed):
    rows = parsed["vanguard-pdf"]
    assert told(rows, "wrapper", "fund_name", "quantity_text", "unit_price_minor", "total_value_minor", kind="holding") == [
        ("ISA", "World Fund Acc", "10.00", "10000", "100000"),
        ("ISA", "Cash account", "-", None, "1000"),
        ("Personal Pension", "Cash account", "-", None, "2500"),
    ]
    assert told(rows, "date", "description", "amount_minor", "cash_balance_minor") == [
        ("02/04/2026", "Regular payment", "25000", "26000"),
        ("03/04/2026", "Bought World Fund", "-25000", "1000"),
    ]
    verdicts = {r.reconciliation_check: r.reconciliation_matches for r in rows}
    assert verdicts == {
        "vanguard_account_summary_isa": True, "vanguard_account_summary_personal_pension": False,
    }
    assert len({r.account_identifier for r in rows}) == 2


def test_monzo_pdf(parsed):
    rows = parsed["monzo-pdf"]
    assert told(rows, "date", "description", "amount_minor", "balance_minor") == [
        ("29/06/2026", "Coffee Reference: x", "-500", "5500"), ("28/06/2026", "Friend", "1000", "6000"),
    ]
    assert rows[0].reconciliation_matches and rows[0].reconciliation_expected_opening_minor is None


def test_chase(parsed):
    rows = parsed["chase"]
    assert told(rows, "description", "amount_minor", "balance_minor") == [("Wages Payment", "2000", "3000"), ("Shop", "-500", "2500")]
    assert rows[0].reconciliation_matches


def test_flex(parsed):
    rows = parsed["monzo-flex"]
    assert told(rows, "description", "amount_minor", "balance_minor") == [
        ("Shoes Amount: EUR 12.00. Conversion rate: 1.146245.", "-2500", "9500"), ("Payment", "1000", "7000"),
    ]
    assert rows[0].account_identifier is None and rows[0].reconciliation_expected_opening_minor == 8000


def test_repeated_rows_of_a_file_get_distinct_keys(spark):
    text = samples.CHASE.replace("06 Jun 2026\nShop\n-£5.00\n£25.00\n", "06 Jun 2026\nShop\n-£5.00\n£25.00\n" * 3)
    rows = parse_statements(detect_layouts(texts(spark, [("c", text)]))).orderBy("line_number").collect()
    keys = [r.bronze_source_key for r in rows]
    assert len(set(keys)) == 4 and keys[2] == keys[1] + "_dup1" and keys[3] == keys[1] + "_dup2"
