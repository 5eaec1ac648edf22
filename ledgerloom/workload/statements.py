"""Statement texts made from the events table, for the layouts to read back.

An account's events are cut into blocks of 500 event ids, so a text has at most
500 rows however many events one user has."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.session import materialized
from ledgerloom.workload import views as W

BLOCK = 500


def numbered_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events with their statement, their place in it and a rising balance."""
    block = F.floor(F.col("event_id") / BLOCK).cast("string")
    rows = W.events(spark, folder).select(
        F.concat_ws("-", F.col("user_id").cast("string"), block).alias("ingestion_id"),
        "user_id", "event_id", "description",
        F.col("transaction_date").alias("d"),
        F.abs("amount_minor").alias("size"),
        (F.col("amount_minor") < 0).alias("out"),
        "amount_minor",
    )
    within = Window.partitionBy("ingestion_id").orderBy("event_id")
    return rows.withColumns(
        {
            "seq": F.row_number().over(within),
            "run": F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
            "earlier": F.lag("d").over(within),
        }
    )


def pounds(minor: Column) -> Column:
    return F.format_number((minor / F.lit(100)).cast("decimal(18,2)"), 2)


def _lines(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _row(layout: str) -> Column:
    """An event as a row of `layout`."""
    d, size, run, out = (F.col(c) for c in ("d", "size", "run", "out"))
    desc, sign = F.col("description"), F.when(out, "-").otherwise("")
    dated = F.date_format(d, "d MMM")
    return {
        "kroo": _lines(F.date_format(d, "dd MMMM yyyy"), "\n", F.when(out, "Payment to ").otherwise("From "), desc,
                       "\n£", pounds(size), "\n£", pounds(run), "\n"),
        "natwest-transactions": _lines(dated, "\n", desc, "\n", F.when(out, "-").otherwise("+"), "£", pounds(size), "\n"),
        "natwest-statement": _lines(
            F.when(d.eqNullSafe(F.col("earlier")), "").otherwise(F.concat(F.upper(dated), F.lit("\n"))),
            desc, "\n", pounds(size), "\n", pounds(run), "\n"),
        "firstdirect": _lines(F.date_format(d, "dd MMM yy"), "\n", desc, "\n", pounds(size), F.when(out, "").otherwise("CR"), "\n"),
        "amex": _lines(F.date_format(d, "MMM d"), "   ", F.date_format(d, "MMM d"), "   ", desc, "   ", pounds(size),
                       F.when(out, "\n").otherwise("\nCR\n")),
        "vanguard-pdf": _lines(F.date_format(d, "dd/MM/yyyy"), "\n", desc, "\n", sign, "£", pounds(size), "\n£", pounds(run), "\n"),
        "monzo-pdf": _lines(F.date_format(d, "dd/MM/yyyy"), "\n", desc, "\n", sign, pounds(size), "\n", pounds(run), "\n"),
        "chase": _lines(F.date_format(d, "dd MMM yyyy"), "\n", desc, "\n", F.when(out, "-").otherwise("+"), "£", pounds(size),
                        "\n£", pounds(run), "\n"),
        "monzo-flex": _lines(F.date_format(d, "dd/MM/yyyy"), "\n", desc, "\n", pounds(F.when(out, size).otherwise(0)), "\n",
                             pounds(F.when(out, 0).otherwise(size)), "\n", pounds(run), "\n"),
    }[layout]


def _whole(layout: str, rows: Column, held: Column) -> Column:
    """A statement of `layout` around its rows."""
    user, total = F.col("user_id").cast("string"), F.col("total")
    wrong = F.when(F.col("user_id") % 7 == 0, 1).otherwise(0)
    return {
        "kroo": _lines("Kroo Current Account\nSort code: 11-22-33\nAccount number: ", user,
                       "\nTotal opening balance\n£ 10.00\nAccount transactions\n1 January 2024 to 31 January 2024\nDate\nDescription\n",
                       rows, "Closing balance\n£ ", pounds(total + wrong), "\n"),
        "natwest-transactions": _lines("NatWest\n*****", user, " · 11-22-33\nFrom  01/01/2024  To  31/01/2024\nYour transactions\n", rows,
                                       "Downloaded from the web\n"),
        "natwest-statement": _lines("Account Name\nAccount No\nSort Code\nPage No\nA PERSON\n", F.lpad(user, 8, "0"),
                                    "\n11-22-33\nPeriod Covered\n1 JAN 2024 to 31 JAN 2024\nPrevious Balance\n£0.00\nNew Balance\n£",
                                    pounds(total + wrong), "\nDate\nDescription\n1 JAN\nBROUGHT FORWARD\n0.00\n", rows, "RETSTMT\n"),
        "firstdirect": _lines("first direct Credit Card\n4000 1111 2222 ", F.lpad(user, 4, "0"),
                              "\nStatement Date 05 February 2024\nPrevious Balance\n0.00\nNew Balance\n", pounds(F.abs("net")),
                              "\nYour Transaction Details\n", rows, "Outstanding Balance\n"),
        "amex": _lines("American Express Credit Card\nxxxx-xxxxxx-", F.lpad(user, 5, "0"),
                       "\nFrom  1 January to 31 January 2024\nPrevious Closing Balance  Closing Balance\n\n£100.00 - £0.00 + £0.00 = £",
                       pounds(F.abs("net")), "\n\n", rows),
        "vanguard-pdf": _lines("Vanguard Statement\nA Person\nAccount number: VG", user,
                               "\nYour Vanguard account summary\nProduct\nValue on 31 January 2024\nISA\n£", pounds(total + wrong),
                               "\nAccount total\n£", pounds(total), "\nYour ISA investments at 31 January 2024\nDescription\n", held,
                               "Activity from 1 January 2024 to 31 January 2024 for your ISA\nCash amount\n", rows),
        "monzo-pdf": _lines("Monzo Personal Account statement\n01/01/2024 - 31/01/2024\n£", pounds(total),
                            "\nPersonal Account balance\n(GBP) Balance\n", rows, "Sort code: 11-22-33\nAccount number: ", user,
                            "\nPot statement\n"),
        "chase": _lines("Chase Account statement\nJ.P. Morgan Europe Limited\nAccount number: ", user,
                        "\nSort code: 44-55-66\n01 January 2024 - 31 January 2024\nOpening balance\n£0.00\nClosing balance\n£",
                        pounds(F.abs("net")), "\nBalance\n", rows, "Some useful information\n"),
        "monzo-flex": _lines("Flex statement\n01/01/2024 - 31/01/2024\n£5.00\nBalance at start\n£", pounds(total),
                             "\nBalance at end\nBalance\n", rows, "This is legally prescribed\n"),
    }[layout]


def _printed(spark: SparkSession, folder: str, layouts: Sequence[str]) -> DataFrame:
    """All statements, with a column of text per layout: events are read, numbered and
    gathered once for all of them."""
    size, desc = F.col("size"), F.col("description")
    pieces = {name: _row(name) for name in layouts}
    if "vanguard-pdf" in layouts:
        pieces["held"] = _lines(desc, "\n1.00\n£", pounds(size), "\n£", pounds(size), "\n")
    # At most BLOCK rows per statement.
    gathered = (
        numbered_events(spark, folder)
        .select("ingestion_id", "user_id", "size", "amount_minor", F.struct("seq", *[c.alias(n) for n, c in pieces.items()]).alias("line"))
        .groupBy("ingestion_id", "user_id")
        .agg(F.sort_array(F.collect_list("line")).alias("lines"), F.sum("size").alias("total"), F.sum("amount_minor").alias("net"))
    )

    def joined(name: str) -> Column:
        return F.array_join(F.col(f"lines.{name}"), "")

    held = joined("held") if "held" in pieces else F.lit("")
    return gathered.select("ingestion_id", *[_whole(name, joined(f"`{name}`"), held).alias(name) for name in layouts])


def texts_by_layout(spark: SparkSession, folder: str, layouts: Sequence[str]) -> DataFrame:
    """Statements of several layouts as (printed_as, text), stored and spread out."""
    printed = F.array(*[F.struct(F.lit(n).alias("printed_as"), F.col(f"`{n}`").alias("text")) for n in layouts])
    rows = _printed(spark, folder, layouts).select(F.inline(printed))
    return materialized(rows)


def statement_texts(spark: SparkSession, folder: str, layout: str) -> DataFrame:
    """One text per statement, printed the way `layout` prints."""
    texts = _printed(spark, folder, [layout])
    # Stored and spread out, as statements are: reading them is work per text,
    # which their few bytes do not show.
    return materialized(texts.select(
        "ingestion_id",
        F.concat("ingestion_id", F.lit(".txt")).alias("filename"),
        F.concat(F.lit("in/"), "ingestion_id").alias("raw_artifact_path"),
        F.col(f"`{layout}`").alias("text"),
        F.lit("2024-02-01 00:00:00").cast("timestamp_ntz").alias("upload_timestamp"),
    ).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "ingestion_id"))


def printed_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Raw rows of every source, dates printed as each source prints them."""
    d, kind = F.col("transaction_date"), F.col("event_id") % 11
    sources = ("monzo", "monzo", "kroo", "natwest-transactions", "natwest-statement", "firstdirect", "amex",
               "vanguard-pdf", "monzo-pdf", "chase", "monzo-flex")
    dates = {2: "dd MMMM yyyy", 3: "d MMM", 4: "d MMM yyyy", 5: "dd MMM yy", 6: "d MMM yyyy", 7: "dd/MM/yyyy",
             8: "dd/MM/yyyy", 9: "dd MMM yyyy", 10: "dd/MM/yyyy"}
    printed = F.lit(None).cast("string")
    for n, fmt in dates.items():
        printed = F.when(kind == n, F.date_format(d, fmt)).otherwise(printed)
    printed = F.when(kind == 4, F.upper(printed)).otherwise(printed)
    minor = F.when(F.col("event_id") % 13 != 0, F.col("amount_minor").cast("string"))
    own = F.create_map(
        F.lit("date"), printed, F.lit("description"), F.col("description"), F.lit("amount_minor"), minor,
        F.lit("balance_minor"), F.col("event_id").cast("string"),
    )
    full = F.create_map(
        F.lit("Transaction ID"), F.concat(F.lit(" tx"), "event_id"), F.lit("Date"), F.date_format(d, "dd/MM/yyyy"),
        F.lit("Time"), F.lit("08:15:30"), F.lit("Name"), F.lit(""), F.lit("Description"), F.col("description"),
        F.lit("Category"), F.lit("food"), F.lit("Currency"), F.lit("EUR"), F.lit("amount_minor"), minor,
    )
    search = F.create_map(
        F.lit("id"), F.concat(F.lit("s"), "event_id"), F.lit("created"), F.concat(d.cast("string"), F.lit("T10:00:00Z")),
        F.lit("title"), F.col("description"), F.lit("categories"), F.lit("c"), F.lit("amount_minor"), minor,
    )
    source = F.get(F.array(*[F.lit(s) for s in sources]), kind.cast("int"))
    return W.events(spark, folder).select(
        F.concat(F.lit("r"), "event_id").alias("bronze_record_id"), F.concat(F.lit("k"), "event_id").alias("bronze_source_key"),
        F.lit("i").alias("ingestion_id"), source.alias("source_type"), "account_id", F.lit("transaction").alias("record_type"),
        F.when(kind == 0, full).when(kind == 1, search).otherwise(own).alias("raw_data"),
        F.lit("2024-02-01 00:00:00").cast("timestamp_ntz").alias("upload_timestamp"),
        F.lit(None).cast("date").alias("statement_period_from"), F.lit(None).cast("date").alias("statement_period_to"),
        F.col("event_id").cast("int").alias("line_number"),
        F.when(F.col("event_id") % 3 == 0, F.lit(None)).otherwise(F.col("event_id") % 3 == 1).alias("reconciliation_matches"),
    )


def snapshot_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Holdings and instalment plans as raw rows, from line items."""
    price = W.cents("l_extendedprice")
    plan = F.col("l_linenumber") % 2 == 0
    shipped = F.col("l_shipdate").cast("date")
    holding = F.create_map(
        F.lit("fund_name"), F.concat(F.lit("Fund "), "l_partkey"), F.lit("quantity_text"),
        F.when(F.col("l_returnflag") == "A", "-").otherwise(F.col("l_quantity").cast("int").cast("string")),
        F.lit("total_value_minor"), price.cast("string"),
        F.lit("as_of_date"), F.when(F.col("l_returnflag") != "R", F.date_format(shipped, "d MMMM yyyy")),
    )
    instalment = F.create_map(
        F.lit("description"), F.concat(F.lit("Plan "), "l_partkey"), F.lit("start_date"), F.date_format(shipped, "MMM d yyyy"),
        F.lit("plan_total"), F.format_number((price / F.lit(100)).cast("decimal(18,2)"), 2),
        F.lit("due_this_month_plan"), F.when(F.col("l_returnflag") == "A", "n/a").otherwise("12.34"),
        F.lit("remaining_balance_minor"), F.lit("77"), F.lit("instalment_progress"), F.lit("1 OF 3"),
        F.lit("as_of_date"), F.date_format(shipped, "dd MMM yyyy"),
    )
    return W.table(spark, folder, "lineitem").select(
        F.lit(None).cast("string").alias("bronze_record_id"),
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("bronze_source_key"),
        F.concat(F.lit("f"), F.col("l_suppkey").cast("string")).alias("ingestion_id"),
        F.when(plan, "amex").otherwise("vanguard-pdf").alias("source_type"),
        F.concat(F.lit("acc_"), "l_suppkey").alias("account_id"),
        F.when(plan, "plan_it_instalment").otherwise("holding").alias("record_type"),
        F.when(plan, instalment).otherwise(holding).alias("raw_data"),
        F.lit("2024-02-01 00:00:00").cast("timestamp_ntz").alias("upload_timestamp"),
    )
