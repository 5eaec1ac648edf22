"""Statement files that arrive packed, many to a Parquet file."""

import datetime as dt

from ledgerloom.session import SCRATCH
from ledgerloom.sources.files import FILE_SCHEMA
from ledgerloom.sources.lake import Lake
from ledgerloom.streaming.ingest import ingest_stream
from ledgerloom.workload import stored
from tests.test_end_to_end import NATWEST, SCENARIO


def pack(spark, folder, **texts):
    seen = dt.datetime(2026, 6, 1)
    rows = [(f"in/{name}.txt", seen, len(text), bytearray(text, "utf-8")) for name, text in texts.items()]
    spark.createDataFrame(rows, FILE_SCHEMA).write.mode("append").parquet(folder)


def test_packed_statements_are_each_taken_once(spark, tmp_path):
    lake, folder = Lake(spark, str(tmp_path / "lake")), str(tmp_path / "in")
    pack(spark, folder, one=SCENARIO["s1"], copy=SCENARIO["s1"])
    for turn in ("first", "again"):
        ingest_stream(lake, folder, str(tmp_path / turn), layouts=NATWEST[:1], packed=True).awaitTermination()
    pack(spark, folder, late_copy=SCENARIO["s1"], two=SCENARIO["s2"], junk="z" * 60)
    ingest_stream(lake, folder, str(tmp_path / "first"), layouts=NATWEST[:1], packed=True).awaitTermination()
    assert lake.bronze().count() == 2
    found = {(r.original_filename, r.status, r.record_count) for r in lake.manifest().collect()}
    assert found == {("copy.txt", "complete", 1), ("two.txt", "complete", 1), ("junk.txt", "parse_failed", None)}


def test_landed_files_do_not_grow_with_the_statements(spark, tmp_path):
    spark.conf.set(SCRATCH, str(tmp_path))
    try:
        row = stored.stream_ingest(spark, "/root/testdata/sf0.001").first()
    finally:
        spark.conf.unset(SCRATCH)
    landed = [p for p in (tmp_path / "ledgerloom").glob("in-*/**/*") if p.is_file() and p.suffix in (".parquet", ".txt")]
    assert row.files > 10 * len(landed)
    assert row.records == row.stored == 1000
