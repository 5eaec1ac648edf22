"""Scalar functions, corner by corner."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import dates as D
from ledgerloom.functions import keys as K
from ledgerloom.functions import money as M


def values(spark, made, inputs, schema="x string"):
    df = spark.createDataFrame([(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(inputs)], "i int, " + schema)
    return [r.made for r in df.withColumn("made", made).orderBy("i").collect()]


MONEY = {
    "£1,234.56": 123456, "-£47.22": -4722, "0.00": 0, "12.00CR": 1200, "10.5": 1050, "10": None, "10,50": None, "-": None,
    "1 000.00": 0, "10.00.50": 1000, "€10.00": 1000, "1.239": 123, "-1.239": -123, "not money": None, "": None, None: None,
    "  +5.10 ": 510, "paid 3.20 today": 320,
}


def test_money_parsing(spark):
    assert values(spark, M.try_parse_money("x"), list(MONEY)) == list(MONEY.values())
    assert values(spark, M.try_parse_money("x", "JPY"), ["1,200.00"]) == [1200]
    assert values(spark, M.try_parse_money("x", "XXX"), ["1.00"]) == [None]


def test_strict_parsing_fails_the_query(spark):
    with pytest.raises(Exception, match="no exact amount in: nothing"):
        values(spark, M.parse_money("x"), ["nothing"])


def test_money_printing(spark):
    assert values(spark, M.format_minor("x"), [123456, -1234, 0], "x bigint") == ["£1,234.56", "£-12.34", "£0.00"]
    assert values(spark, M.format_minor("x", "USD"), [5], "x bigint") == ["USD 0.05"]
    assert values(spark, M.format_minor("x", "JPY"), [12345], "x bigint") == ["JPY 12,345"]
    assert values(spark, M.format_signed_minor("x"), [100, -100, 0], "x bigint") == ["+£1.00", "-£1.00", "+£0.00"]
    assert [str(v) for v in values(spark, M.minor_to_decimal("x"), [-5], "x bigint")] == ["-0.05"]


def test_date_formats(spark):
    at = lambda *parts: dt.datetime(*parts)
    assert values(spark, D.parse_date("x", D.DAY_FULL_MONTH_YEAR), ["02 June 2026", "nonsense", None]) == [at(2026, 6, 2), None, None]
    assert values(spark, D.parse_date("x", D.DAY_MONTH_YEAR), ["14 FEB 2026", "31 Feb 2026"]) == [at(2026, 2, 14), None]
    assert values(spark, D.parse_date("x", D.DAY_MONTH_SHORT_YEAR), ["05 Jan 99", "05 Jan 26", "05 Jan 68"]) == [
        at(1999, 1, 5), at(2026, 1, 5), at(2068, 1, 5)]
    assert values(spark, D.parse_date("x", D.MONTH_DAY_YEAR), ["Apr 12 2026"]) == [at(2026, 4, 12)]
    assert values(spark, D.parse_date("x"), ["2026-03-05T10:00:00Z", "2026-03-05T10:00:00+02:00", "2026-03-05"]) == [
        at(2026, 3, 5, 10), at(2026, 3, 5, 10), at(2026, 3, 5)]


def test_years_that_are_not_printed(spark):
    made = D.infer_year("x", "ref")
    cases = [("15 Jan", dt.date(2026, 1, 10)), ("28 Dec", dt.date(2026, 1, 10)), ("20 Jan", dt.date(2026, 1, 10)),
             ("29 Feb", dt.date(2025, 3, 1)), ("29 Feb", dt.date(2026, 3, 1)), ("x", dt.date(2026, 3, 1)), ("1 Jan", None)]
    assert [v and v.date() for v in values(spark, made, cases, "x string, ref date")] == [
        dt.date(2026, 1, 15), dt.date(2025, 12, 28), dt.date(2025, 1, 20), dt.date(2024, 2, 29), None, None, None]
    period = D.year_in_period("x", F.lit("2025-12-20").cast("date"), F.lit("2026-01-19").cast("date"))
    assert values(spark, period, ["28 Dec", "3 Jan", "17 Dec", "16 Dec", "22 Jan", "23 Jan"]) == [
        "28 Dec 2025", "3 Jan 2026", "17 Dec 2025", None, "22 Jan 2026", None]


def test_descriptions_and_keys(spark):
    assert values(spark, K.normalize_description("x"), ["  Joe's  café-£5 ", "we'll", "don't", "a\tb"]) == [
        "JOE S CAF 5", "WE WILL", "DO NOT", "A B"]
    same = values(spark, K.mask_identifier("x"), ["12 34 ab", "1234AB"])
    assert same[0] == same[1] and len(same[0]) == 12
    keys = values(
        spark, K.transaction_source_key("p", "d", "x", "n", "a"),
        [("15 May 2026", "A long shop name", 5000, "acc"), ("15/05/2026", "A long shop name", -5000, "acc"),
         ("15 May 2026", "A long shop other", 5000, None)],
        "d string, x string, n bigint, a string",
    )
    assert keys[0].startswith("p_acc_15May2026_A_long_sho_5000_") and keys[1].startswith("p_acc_15052026_A_long_sho_-5000_")
    assert keys[2].startswith("p_15May2026_") and len({k[-8:] for k in keys}) == 3
    assert values(spark, K.slug("x"), ["Personal Pension (A)"]) == ["personal_pension_a"]
