import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import keys as K
from ledgerloom.operators import balances as B
from ledgerloom.operators.accounts import UnmappedAccountsError
from ledgerloom.operators.reconcile import ReconciliationMismatchError
from ledgerloom.plans.rebuild import ingest_rows, ingest_texts, rebuild
from ledgerloom.sources.csv_export import read_exports
from ledgerloom.sources.files import read_texts
from ledgerloom.sources.lake import Lake, StaleBuildError, with_override
from ledgerloom.sources.layouts import LAYOUTS
from ledgerloom.sources.registry import entry, read_registry
from ledgerloom.streaming.ingest import ingest_stream
from tests import samples

BY_NAME = {lay.source_type: lay for lay in LAYOUTS}
NATWEST = (BY_NAME["natwest-statement"], BY_NAME["natwest-transactions"])


def put(folder, **texts):
    folder.mkdir(parents=True, exist_ok=True)
    for name, text in texts.items():
        (folder / f"{name}.txt").write_text(text, encoding="utf-8")
    return str(folder)


def statement(start, end, opening, closing, *rows):
    head = samples.NATWEST_STATEMENT.split("Period Covered")[0]
    lines = [f"Period Covered\n{start} to {end}\nPrevious Balance\n£{opening}\nNew Balance\n£{closing}", "Date\nDescription",
             f"{start[:6]}\nBROUGHT FORWARD\n{opening}"]
    return head + "\n".join([*lines, *rows]) + "\n"


def export(start, end, *rows):
    return "NatWest\n*****678 · 11-22-33\nFrom  {}  To  {}\nYour transactions\n{}\n".format(start, end, "\n".join(rows))


SCENARIO = {
    "s1": statement("14 NOV 2025", "13 FEB 2026", "800.00", "1,000.00", "20 JAN\nWAGES\n200.00\n1,000.00"),
    "e1": export("13/02/2026", "13/05/2026", "10 Mar\nCARD TO GROCER\n-£50.00"),
    "s2": statement("14 FEB 2026", "13 MAY 2026", "1,000.00", "950.00", "10 MAR\nGROCER\n50.00\n950.00"),
    "e2": export("26/04/2026", "26/07/2026", "20 Jul\nGYM\n-£30.00"),
}


def register(spark, lake):
    full = "12345678_11-22-33"
    masked = "*****678_11-22-33"
    ids = spark.createDataFrame([(full,), (masked,)], "raw string").select(
        F.lit("identifier").alias("kind"), K.mask_identifier("raw").alias("key"), F.lit("acc").alias("account_id"),
        F.lit("Main").alias("display_name"), F.lit("current").alias("account_type"),
    )
    lake.register(ids)


@pytest.fixture(scope="module")
def scenario(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("lake")
    lake = Lake(spark, str(root / "lake"))
    folder = put(root / "in", **SCENARIO)
    with_copies = ingest_texts(lake, read_texts(spark, folder), NATWEST)
    assert {r.status for r in with_copies.collect()} == {"complete"}
    with pytest.raises(UnmappedAccountsError, match="natwest"):
        rebuild(lake)
    assert lake.current_build_id() is None
    register(spark, lake)
    rebuild(lake)
    return lake, folder


def test_statements_and_exports_become_one_history(scenario):
    lake, _ = scenario
    rows = lake.silver("transactions").orderBy("transaction_date").collect()
    assert [(r.description, r.amount_minor, r.source_type) for r in rows] == [
        ("WAGES", 20000, "natwest-statement"), ("GROCER", -5000, "natwest-statement"), ("GYM", -3000, "natwest-transactions"),
    ]
    ledger = lake.silver("account_ledger").orderBy("as_of_date").collect()
    assert [(r.balance_minor, r.balance_source) for r in ledger] == [(100000, "printed"), (95000, "printed"), (92000, "derived")]
    (balance,) = B.current_balances(lake.silver("account_ledger")).collect()
    assert (balance.balance_minor, balance.as_of_date) == (92000, dt.date(2026, 7, 26))
    assert B.net_worth(lake.silver("account_ledger"), lake.silver("holdings"), lake.silver("accounts")).head()[0] == 92000


def test_provenance_and_checks(scenario):
    lake, _ = scenario
    sources, rows = lake.silver("transaction_sources"), lake.silver("transactions")
    assert sources.join(rows, "silver_transaction_id", "left_anti").isEmpty()
    policies = {r.match_policy: r["count"] for r in sources.groupBy("match_policy").count().collect()}
    assert policies == {"fingerprint": 4, "cross-source(natwest-statement-preferred)": 1}
    log = {(r.check_type, r.matches): r["count"] for r in lake.silver("reconciliation_log").groupBy("check_type", "matches").count().collect()}
    assert log == {("bronze_self_check", True): 2, ("continuity", True): 1, ("silver_rollforward", True): 2}


def test_ingesting_again_changes_nothing(scenario, spark):
    lake, folder = scenario
    before = lake.bronze().count()
    assert ingest_texts(lake, read_texts(spark, folder), NATWEST).count() == 0
    assert lake.bronze().count() == before
    ids = sorted(r[0] for r in lake.silver("transactions").select("silver_transaction_id").collect())
    rebuild(lake)
    assert ids == sorted(r[0] for r in lake.silver("transactions").select("silver_transaction_id").collect())
    assert lake.builds().count() == 2
    assert lake.builds().head().row_counts["transactions"] == 3


def test_sql_surface(scenario):
    lake, _ = scenario
    spent = lake.query("SELECT sum(-amount_minor) AS s FROM transactions WHERE amount_minor < :limit", limit=0).head()
    assert spent.s == 8000
    assert "bronze_natwest_statement" in lake.refresh_views()
    assert lake.query("SELECT count(*) AS n FROM bronze_natwest_transactions").head().n == 2


def test_a_missing_build_is_an_error(scenario, spark):
    lake, _ = scenario
    row = lake.builds().limit(1).withColumns(
        {"build_id": F.lit("gone"), "built_at": F.col("built_at") + F.expr("INTERVAL '1' DAY")}
    )
    other = Lake(spark, lake.root + "-broken")
    row.write.parquet(other.root + "/builds")
    with pytest.raises(StaleBuildError):
        other.silver("transactions")


def test_quarantine_override_and_strict_gate(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    wrong = SCENARIO["s2"].replace("New Balance\n£950.00", "New Balance\n£951.00")
    ingest_texts(lake, read_texts(spark, put(tmp_path / "in", s1=SCENARIO["s1"], s2=wrong)), NATWEST[:1])
    register(spark, lake)
    with pytest.raises(ReconciliationMismatchError, match="bronze_self_check"):
        rebuild(lake, strict=True)
    assert lake.current_build_id() is None
    rebuild(lake)
    assert lake.silver("transactions").count() == 1
    assert lake.silver("excluded_ingestions").head().reason == "reconciliation mismatch, no allow override"
    bad = lake.manifest().filter("NOT reconciliation_matches").head().ingestion_id
    lake.write_manifest(with_override(lake.manifest(), bad[:12]))
    rebuild(lake)
    assert lake.silver("transactions").count() == 2


def test_streaming_ingest_takes_each_content_once(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    folder = put(tmp_path / "in", one=SCENARIO["s1"], copy=SCENARIO["s1"])
    for _ in range(2):
        ingest_stream(lake, folder, str(tmp_path / "state"), layouts=NATWEST[:1]).awaitTermination()
    put(tmp_path / "in", late_copy=SCENARIO["s1"], two=SCENARIO["s2"], junk="z" * 60)
    ingest_stream(lake, folder, str(tmp_path / "state"), layouts=NATWEST[:1]).awaitTermination()
    assert lake.bronze().count() == 2
    assert {(r.status, r.record_count) for r in lake.manifest().collect()} == {("complete", 1), ("parse_failed", None)}


def test_csv_exports_of_both_kinds(spark, tmp_path):
    folder = tmp_path / "csv"
    folder.mkdir()
    full = (
        "﻿Transaction ID,Date,Time,Type,Name,Emoji,Category,Amount,Currency,Local Amount,Local Currency,Notes,Receipt,Description\n"
        'tx1,02/03/2026,09:30:00,Card,"Shop, the ""big"" one",,Food,-4.50,GBP,,,"two\nlines",,x\n'
        ",,,,,,,,,,,,,\n"
        "tx2,03/03/2026,,Card,,,Food,10.00,,,,,,Refund\n"
    )
    (folder / "full.csv").write_text(full, encoding="utf-8")
    (folder / "again.csv").write_text(full, encoding="utf-8")
    (folder / "search.csv").write_text(
        "id,created,title,subtitle,amount,currency,categories\ns1,2026-03-05T10:00:00Z,,Sub,-1.00,GBP,eating\n", encoding="utf-8"
    )
    (folder / "other.csv").write_text("a,b\n1,2\n", encoding="utf-8")
    rows = read_exports(spark, str(folder)).orderBy("bronze_source_key").collect()
    assert [(r.bronze_source_key, r.line_number, r.raw_data["amount_minor"]) for r in rows] == [
        ("monzo_txn_s1", 2, "-100"), ("monzo_txn_tx1", 2, "-450"), ("monzo_txn_tx2", 4, "1000"),
    ]
    lake = Lake(spark, str(tmp_path / "lake"))
    ingest_rows(lake, read_exports(spark, str(folder)))
    ingest_rows(lake, read_exports(spark, str(folder)))
    assert lake.bronze().count() == 3
    lake.register(entry(spark, "source_type", "monzo", "acc", "Card", "current"))
    rebuild(lake)
    made = lake.silver("transactions").orderBy("transaction_date").collect()
    assert [(str(r.transaction_date), r.description, r.category, r.bank_transaction_id) for r in made] == [
        ("2026-03-02 09:30:00", 'Shop, the "big" one', "Food", "tx1"),
        ("2026-03-03 00:00:00", "Refund", "Food", "tx2"),
        ("2026-03-05 10:00:00", "Sub", "eating", "s1"),
    ]


def test_registry_file(spark, tmp_path):
    path = tmp_path / "map.json"
    path.write_text(json.dumps({
        "identifiers": {"aa": {"account_id": "x", "display_name": "X", "account_type": "credit"},
                        "bb": {"account_id": "x", "display_name": "Y", "account_type": "credit"}},
        "source_type_fallback": {"monzo": {"account_id": "x", "display_name": "Z", "account_type": "current"}},
    }))
    from ledgerloom.operators.accounts import accounts_table

    (row,) = accounts_table(read_registry(spark, str(path))).collect()
    assert (row.display_name, row.account_identifiers, row.source_types) == ("X", ["aa", "bb"], ["monzo"])
    lake = Lake(spark, str(tmp_path / "lake"))
    lake.register(entry(spark, "identifier", "aa", "x", "Old", "credit"))
    lake.register(entry(spark, "identifier", "aa", "y", "New", "credit"))
    assert [(r.account_id, r.display_name) for r in lake.registry().collect()] == [("y", "New")]


def test_an_ingest_cut_off_before_its_manifest_adds_nothing_twice(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    texts = read_texts(spark, put(tmp_path / "in", s1=SCENARIO["s1"]))
    ingest_texts(lake, texts, NATWEST[:1])
    # As if the second manifest row had never been written.
    broken = Lake(spark, str(tmp_path / "broken"))
    lake.bronze().write.partitionBy("source_type").parquet(broken.root + "/bronze")
    lake.manifest_log().filter("status = 'archived'").write.parquet(broken.root + "/manifests")
    ingest_texts(broken, texts, NATWEST[:1])
    assert broken.bronze().count() == lake.bronze().count() == 1
    assert broken.manifest().head().status == "complete"


def test_every_unmapped_account_is_in_the_written_listing(spark):
    from ledgerloom import schemas
    from ledgerloom.operators.accounts import require_mapped

    rows = spark.range(1500).selectExpr("'kroo' AS source_type", "concat('id', id) AS account_identifier", "'transaction' AS record_type")
    empty = spark.createDataFrame([], schemas.REGISTRY)
    with pytest.raises(UnmappedAccountsError, match="1500 unmapped, all in ") as error:
        require_mapped(schemas.conform(rows, schemas.BRONZE), empty)
    path = str(error.value).split("all in ")[1].split(";")[0]
    assert spark.read.parquet(path).count() == 1500


def test_an_export_of_seventy_columns_is_read_whole(spark, tmp_path):
    names = ["id", "created", "title", "subtitle", "amount", "currency", "categories", *[f"extra{i}" for i in range(63)]]
    cells = ["t1", "2026-01-01", "Shop", "", "-1.00", "GBP", "food", *[f"v{i}" for i in range(63)]]
    (tmp_path / "wide.csv").write_text(",".join(names) + "\n" + ",".join(cells) + "\n", encoding="utf-8")
    row = read_exports(spark, str(tmp_path)).head()
    assert row.raw_data["extra62"] == "v62" and row.raw_data["amount_minor"] == "-100"


def test_views_follow_new_files_other_lakes_and_sessions(spark, tmp_path):
    def bronze(lake, *names):
        folder = put(tmp_path / names[0], **{n: SCENARIO[n] for n in names})
        ingest_texts(lake, read_texts(spark, folder), NATWEST)

    count = "SELECT count(*) AS n FROM bronze_natwest_statement"
    one, two = Lake(spark, str(tmp_path / "one")), Lake(spark, str(tmp_path / "two"))
    bronze(one, "s1")
    before = one.query(count).head().n
    bronze(one, "s2", "e1")
    assert before > 0 and one.query(count).head().n > before
    bronze(two, "e2")
    with pytest.raises(Exception, match="TABLE_OR_VIEW_NOT_FOUND"):
        two.query(count)
    other = Lake(spark.newSession(), one.root)
    assert other.query(count).head().n == one.query(count).head().n > before


def test_ingest_reads_files_once(spark, tmp_path):
    texts = read_texts(spark, put(tmp_path / "in", a=SCENARIO["s1"], b=SCENARIO["s1"]))
    plan = texts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan binaryFile") == 1
    lake = Lake(spark, str(tmp_path / "lake"))
    assert ingest_texts(lake, texts, NATWEST).count() == 1
