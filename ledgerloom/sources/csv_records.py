"""Records of CSV files whose quoted fields may hold line breaks, read by all tasks.

A line alone does not tell whether it begins a record; that depends on whether a quote is
open before it. But what a line does to that state is a function of two values, told
from the line itself, and such functions compose in any grouping. Each split of a file
therefore works out, for a quote open at its start and for none, how it ends and how
many records begin in it; the few rows of all splits are folded in file order; then every
split knows its start, and every line the number of its record. Only records that run
over several lines are put together by a shuffle of their own.

The state is kept as the last line that fixes it (whatever came before) and the number of
lines since that turn it around, so a prefix of functions is a running sum and a
last known value.

A quote opens a field where the field begins and closes at the next quote that is not
doubled; elsewhere it is a character like any other. Line breaks of all kinds read as a
line feed, empty lines outside quotes are no records, and a quote that is never closed
takes the rest of its file into one record, as it does for any reader.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.ordered import last_known, previous, running_sum, scan
from ledgerloom.session import materialized

_SPLIT = ["path", "begin"]
_OUT, _IN, _CLOSED = 0, 1, 2  # no quote open, one open, none but the last one closed a field


def _ends_open(line: Column, start: int) -> Column:
    """Whether a quote is open after the line, when `start` is the state before it."""

    def on(state: Column, part: Column) -> Column:
        text, first = part["text"], part["first"]
        field_begins = text.endswith(",") | ((text == "") & (first | (state["now"] == _CLOSED)))
        opened = F.when(field_begins, F.lit(_IN)).otherwise(F.lit(_OUT))
        return F.struct(F.when(state["now"] == _IN, F.lit(_CLOSED)).otherwise(opened).alias("now"))

    parts = F.transform(F.split(line, '"', -1), lambda s, i: F.struct(s.alias("text"), (i == 0).alias("first")))
    # One part before each quote; what follows the last quote changes nothing.
    quotes = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return F.aggregate(quotes, F.struct(F.lit(start).alias("now")), on, lambda s: s["now"] == _IN)


def physical_lines(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """Lines with their file, the byte at which their split begins, and their order within it."""
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(folder)
    return read.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("begin"),
        F.col("_metadata.file_modification_time").cast("timestamp_ntz").alias("upload_timestamp"),
        F.monotonically_increasing_id().alias("place"), F.col("value"),
    )


def _told(lines: DataFrame) -> DataFrame:
    """Lines with their state before and after, and the records begun so far, for both starts of their split."""
    plain = ~F.col("value").contains('"')
    cut = lines.withColumns(
        {
            "if_out": F.when(plain, F.lit(False)).otherwise(_ends_open(F.col("value"), _OUT)),
            "if_in": F.when(plain, F.lit(True)).otherwise(_ends_open(F.col("value"), _IN)),
        }
    ).withColumn("turn", (F.col("if_out") & ~F.col("if_in")).cast("int"))
    # Splits are bounded, so these keys are never hot.
    turned = scan(cut, _SPLIT, ["place"], {"turns": running_sum("turn")}, split=False)
    fixed = F.when(F.col("if_out") == F.col("if_in"), (F.col("if_out").cast("long") + F.col("turns")) % 2)
    after = scan(turned.withColumn("fixed", fixed), _SPLIT, ["place"], {"base": last_known("fixed")}, split=False)
    ends = {
        f"after_{s}": (F.coalesce("base", F.lit(s)) + F.col("turns")) % 2 == 1 for s in (0, 1)
    }
    before = scan(
        after.withColumns(ends), _SPLIT, ["place"], {f"before_{s}": previous(f"after_{s}") for s in (0, 1)}, split=False
    ).withColumns({f"before_{s}": F.coalesce(f"before_{s}", F.lit(bool(s))) for s in (0, 1)})
    begun = before.withColumns({f"starts_{s}": (~F.col(f"before_{s}") & (F.col("value") != "")).cast("int") for s in (0, 1)})
    return scan(begun, _SPLIT, ["place"], {f"records_{s}": running_sum(f"starts_{s}") for s in (0, 1)}, split=False).select(
        *_SPLIT, "upload_timestamp", "place", "value", *[f"{c}_{s}" for c in ("before", "after", "records") for s in (0, 1)]
    )


def _starts(told: DataFrame) -> DataFrame:
    """Per split: whether a quote is open where it begins, and how many records began before it."""
    ends = told.groupBy(*_SPLIT).agg(
        *[F.max_by(f"{c}_{s}", "place").alias(f"{c}_{s}") for c in ("after", "records") for s in (0, 1)]
    ).withColumn("turn", (F.col("after_0") & ~F.col("after_1")).cast("int"))
    turned = scan(ends, ["path"], ["begin"], {"turns": running_sum("turn")})
    fixed = F.when(F.col("after_0") == F.col("after_1"), (F.col("after_0").cast("long") + F.col("turns")) % 2)
    known = scan(turned.withColumn("fixed", fixed), ["path"], ["begin"], {"base": last_known("fixed")})
    state = known.withColumn("ends_in", (F.coalesce("base", F.lit(0)) + F.col("turns")) % 2 == 1)
    opened = scan(state, ["path"], ["begin"], {"inside": previous("ends_in")}).withColumn(
        "inside", F.coalesce("inside", F.lit(False))
    )
    own = opened.withColumn("own", F.when(F.col("inside"), F.col("records_1")).otherwise(F.col("records_0")))
    return scan(own, ["path"], ["begin"], {"upto": running_sum("own")}).select(
        *_SPLIT, "inside", (F.col("upto") - F.col("own")).alias("earlier")
    )


def csv_records(spark: SparkSession, folder: str, glob: str = "*.csv") -> DataFrame:
    """path, upload_timestamp, number (from 1 within the file) and text of every record."""
    told = materialized(_told(physical_lines(spark, folder, glob)))
    starts = _starts(told)
    pick = lambda c: F.when(F.col("inside"), F.col(f"{c}_1")).otherwise(F.col(f"{c}_0"))
    lines = told.join(starts, _SPLIT).select(
        *_SPLIT, "upload_timestamp", "place", "value", (pick("records") + F.col("earlier")).alias("number"),
        pick("before").alias("goes_on"), pick("after").alias("open"),
    ).filter("goes_on OR value != ''")
    alone = ~F.col("goes_on") & ~F.col("open")
    whole = lines.filter(alone).select("path", "upload_timestamp", "number", F.col("value").alias("text"))
    parts = F.sort_array(F.collect_list(F.struct("begin", "place", "value")))
    joined = lines.filter(~alone).groupBy("path", "number").agg(
        F.first("upload_timestamp").alias("upload_timestamp"), F.array_join(F.transform(parts, lambda p: p["value"]), "\n").alias("text")
    )
    return whole.unionByName(joined)


def cells(text: Column, width: int) -> Column:
    """The first `width` fields of a record as an array."""
    names = [f"c{i}" for i in range(width)]
    options = {"escape": '"', "quote": '"', "mode": "PERMISSIVE", "maxCharsPerColumn": "-1", "maxColumns": str(max(20480, width))}
    read = F.from_csv(text, ", ".join(f"{n} string" for n in names), options)
    # One struct, named once, however many fields are taken from it.
    return F.get(F.transform(F.array(read), lambda r: F.array(*[r[n] for n in names])), 0)
