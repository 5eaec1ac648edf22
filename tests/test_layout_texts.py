"""Records are cut by patterns over a whole text, not by lambdas over its lines."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources.layouts import LAYOUTS

BY_NAME = {layout.source_type: layout for layout in LAYOUTS}


def records(spark, name, *printed):
    rows = spark.createDataFrame([(text,) for text in printed], "text string")
    dates = F.struct(F.lit("2024-01-01").cast("date").alias("from"), F.lit("2024-01-31").cast("date").alias("to"))
    return rows.select(BY_NAME[name].records(F.col("text"), dates).alias("records"))


def lambdas(df):
    return df._jdf.queryExecution().analyzed().toString().count("lambdafunction(")


def told(df, *keys):
    return [[tuple(r.raw_data[k] for k in keys) for r in row.records] for row in df.collect()]


# Before: 46, 41 and 34.
@pytest.mark.parametrize("name, most", [("natwest-statement", 20), ("firstdirect", 20), ("chase", 10)])
def test_few_lambdas_read_a_text(spark, name, most):
    assert lambdas(records(spark, name, "x")) <= most


def test_statement_rows_carry_the_last_date_before_them(spark):
    found = records(
        spark, "natwest-statement", "1 JAN\n2 JAN\nShop\n 1.00\t\n3 JAN\n2.00\nDate\nA\tb\n\n3.00\n4.00\nInterest\n(variable)\n5.00", "", " \n"
    )
    assert told(found, "date", "description", "balance_minor") == [
        [("2 JAN", "Shop", "100"), ("3 JAN", "A\tb", "400"), (None, "Interest (variable)", "500")], [], []
    ]


def test_a_card_row_ends_at_its_first_figure(spark):
    found = records(spark, "firstdirect", "Transaction Date\n1 Feb 24 £9.00\nshop\n£x\n£ 3.00 CR\nmore\n4.00\nOutstanding Balance\n1 Feb 24\ny\n1")
    assert told(found, "date", "description", "amount_minor") == [[("1 Feb 24", "shop", "300")]]


def test_pages_without_instalments_are_not_cut_into_lines(spark):
    plan = records(spark, "amex", "x")._jdf.queryExecution().analyzed().toString()
    assert "contains(" in plan.lower()


def test_a_credit_is_marked_by_the_line_after_it(spark):
    row = "Jan 3  Jan 4 shop {}\n"
    found = records(spark, "amex", row.format("1.00") + "CR\n" + row.format("2.00") + "\n\nx CR\n" + row.format("3.00") + row.format("4.00") + "\fCR")
    assert told(found, "date", "amount_minor") == [[("3 Jan 2024", "100"), ("3 Jan 2024", "200"), ("3 Jan 2024", "-300"), ("3 Jan 2024", "-400")]]


def test_a_row_has_exactly_its_numbers(spark):
    found = records(spark, "chase", "Balance\nearly\n1 Jan 2024\nPage 2\nshop\n-£1.00\nby night\n£5.00\n2 Jan 2024\nx\n£1.00\nSome useful information")
    assert told(found, "description", "amount_minor", "balance_minor") == [[("shop by night", "-100", "500")]]
