"""What reading a statement costs: passes over a text that the plan holds."""

from pyspark.sql import functions as F

from ledgerloom.functions.money import try_parse_money
from ledgerloom.sources import layouts as L
from ledgerloom.sources import segments as G
from ledgerloom.sources.statements import parse_layout


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def texts(spark):
    return spark.range(1).select(
        F.col("id").cast("string").alias("ingestion_id"), F.lit("f").alias("filename"), F.lit("in/f").alias("raw_artifact_path"),
        F.concat(F.lit(" a \n\n b\t\n"), "id").alias("text"), F.lit(None).cast("timestamp_ntz").alias("upload_timestamp"),
    )


def test_a_text_is_made_plain_once(spark):
    lines = texts(spark).select(G.lines_of(F.col("text")).alias("lines"))
    assert plan_of(lines).count("regexp_replace") == 1
    assert lines.first().lines == ["a", "b", "0"]
    blank = spark.range(3).select(G.lines_of(F.element_at(F.array(F.lit(" \n\t\x0b\f\r"), F.lit(""), F.lit("x")), (F.col("id") + 1).cast("int"))).alias("l"))
    assert [r.l for r in blank.collect()] == [[], [], ["x"]]


def test_sections_are_cut_once_for_records_and_totals(spark):
    vanguard = next(lay for lay in L.LAYOUTS if lay.source_type == "vanguard-pdf")
    plan = plan_of(parse_layout(texts(spark), vanguard))
    assert plan.count(L.PAGE_HEAD) == 1


def test_an_amount_drops_marks_in_one_pass(spark):
    shown = ["£1,234.50CR", "12.30cr", " -£5.00\n", "-", "Cr", "£", None, "paid 1,000.25 today"]
    found = spark.createDataFrame([(s,) for s in shown], "s string").select(try_parse_money("s").alias("m"))
    assert plan_of(found).count("regexp_replace") == 1
    assert [r.m for r in found.collect()] == [123450, 1230, -500, None, None, None, None, 100025]


def test_statements_of_all_layouts_come_from_one_read_of_the_events(spark, monkeypatch):
    from ledgerloom.workload import statements as T

    reads = []
    numbered = T.numbered_events
    monkeypatch.setattr(T, "numbered_events", lambda *a: reads.append(a) or numbered(*a))
    names = [lay.source_type for lay in L.LAYOUTS]
    made = T.texts_by_layout(spark, "/root/testdata/sf0.001", names)
    assert len(reads) == 1
    for name in names:
        alone = T.statement_texts(spark, "/root/testdata/sf0.001", name).select("text")
        together = made.filter(F.col("printed_as") == name).select("text")
        assert alone.exceptAll(together).isEmpty() and together.exceptAll(alone).isEmpty()
