"""Statement layouts: what each prints, declared as column expressions.

The markers, labels and patterns below are fixed values of the printed forms."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions import dates as D
from ledgerloom.functions.keys import slug
from ledgerloom.functions.money import try_parse_money
from ledgerloom.sources import segments as G

MIN_TEXT = 50
CONFIDENCE = 0.95
AMBIGUITY = 0.05

RECORDS = "array<struct<record_type:string,raw_data:map<string,string>,wrapper:string>>"


def _no_identifier(text: Column) -> Column:
    return F.lit(None).cast("string")


def _no_anchor(text: Column) -> Column:
    return F.lit(None).cast("long")


@dataclass(frozen=True)
class Layout:
    """How to recognise and read one printed form.

    `records` takes the text, or what `sections` cuts it into, and the period (a struct
    of two dates), and gives an array of records. `derived` says how the closing balance follows from them:
    the `last` or `first` printed balance, the opening balance `plus` or `minus`
    the amounts, or None where nothing is checked."""

    source_type: str
    prefix: str
    matches: Callable[[Column], Column]
    records: Callable[[Column, Column], Column]
    period: Callable[[Column], Column]
    identifier: Callable[[Column], Column] = _no_identifier
    opening: Callable[[Column], Column] = _no_anchor
    closing: Callable[[Column], Column] = _no_anchor
    check_name: str | None = None
    derived: str | None = None
    # Balance left to compute after the records are out: "liability" rolls the
    # opening balance on, "delta" takes amounts from neighbouring balances.
    running: str | None = None
    adjustment: Callable[[Column], Column] = field(default=_no_anchor)
    snapshot_prefix: str = ""
    sections: Callable[[Column], Column] | None = None
    parser_version: str = "2"


def _has(*needles: str) -> Callable[[Column], Column]:
    def test(text: Column) -> Column:
        found = F.lit(True)
        for needle in needles:
            found = found & text.contains(needle)
        return found

    return test


def _span(start: Column, end: Column) -> Column:
    dates = F.struct(start.cast("date").alias("from"), end.cast("date").alias("to"))
    return G.let(dates, lambda p: F.when(p["from"].isNotNull() & p["to"].isNotNull(), p))


def _period(pattern: str, fmt: str) -> Callable[[Column], Column]:
    def read(text: Column) -> Column:
        return _span(
            D.try_format(_one_space(G.extract(text, pattern, 1)), fmt),
            D.try_format(_one_space(G.extract(text, pattern, 2)), fmt),
        )

    return read


def _one_space(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", " ")


def _amount(pattern: str) -> Callable[[Column], Column]:
    return lambda text: try_parse_money(G.extract(text, pattern, 1))


def _pair(first: str, second: str) -> Callable[[Column], Column]:
    """Two parts that identify an account together, null unless both are there."""
    return lambda text: F.concat(G.extract(text, first), F.lit("_"), G.extract(text, second))


def _kept(records: Column, needed: str = "amount_minor") -> Column:
    return F.filter(records, lambda r: r["raw_data"][needed].isNotNull())


def _dated(day_month: Column, period: Column) -> Column:
    """The date with its year where the period tells it."""
    return F.coalesce(D.year_in_period(day_month, period["from"], period["to"]), day_month)


SORT_CODE = r"Sort code:\s*([\d-]+)"
ACCOUNT_NUMBER = r"Account number:\s*(\d+)"
LONG_DATES = r"(\d{1,2}\s+[A-Za-z]+\s+\d{4})"
SLASHED_SPAN = r"(?m)^[ \t]*(\d{2}/\d{2}/\d{4})\s*-\s*(\d{2}/\d{2}/\d{4})[ \t]*$"


# --- kroo ----------------------------------------------------------------------

# Words that tell the direction of a row with one amount.
OUT_WORDS = r"\bpayment out\b|\bfaster payment out\b|\bsent to\b|\bsent\b|\b out\b"
IN_WORDS = r"\bfrom\b|\bdeposit\b|\binterest\b|\bsalary\b|\bpaid in\b|\bcredit\b|\bpayment in\b"


def _kroo(text: Column, period: Column) -> Column:
    lines = G.body(
        G.lines_of(text),
        start=G.contains_any("Account transactions"),
        stop=G.contains_any("Closing balance", "If something doesn't look right"),
        skip=G.one_of("Date", "Description", "Out", "In", "Balance", "Page"),
    )

    def amount(amounts: Column, lowered: Column) -> Column:
        # A credit says so, and says nothing of money going out; all else is a debit.
        first, second = F.get(amounts, 0), F.get(amounts, 1)
        by_words = F.when(lowered.rlike(IN_WORDS) & ~lowered.rlike(OUT_WORDS), first).otherwise(-first)
        return F.when(F.size(amounts) == 2, by_words).when(F.size(amounts) > 2, second - first)

    def read(block: Column) -> Column:
        rest = G.tail(block)
        printed = F.transform(
            G.matching(rest, "£"),
            lambda line: try_parse_money(F.concat(F.lit("£"), G.extract(line, r"£\s*([0-9,]+\.?\d*)"))),
        )

        def made(amounts: Column, description: Column) -> Column:
            moved = G.let(F.lower(description), lambda lowered: amount(amounts, lowered))
            return G.record(
                "transaction",
                [("date", G.extract(F.get(block, 0), r"^(\d{2}\s+\w+\s+\d{4})")), ("description", description),
                 ("amount_minor", F.when(description.isNotNull(), moved)),
                 ("balance_minor", F.get(amounts, F.size(amounts) - 1))],
            )

        return G.let(
            F.filter(printed, lambda a: a.isNotNull()),
            lambda amounts: G.let(G.joined(G.not_matching(rest, "£")), lambda words: made(amounts, words)),
        )

    return _kept(F.transform(G.blocks(lines, G.begins_with(r"^\d{2}\s+\w+\s+\d{4}")), read))


# --- natwest-transactions --------------------------------------------------------


def _natwest_transactions(text: Column, period: Column) -> Column:
    lines = G.body(
        G.lines_of(text),
        start=G.contains_any("Your transactions", "Transaction details"),
        stop=G.contains_any("Downloaded from", "National Westminster"),
        skip=G.one_of("Date", "Description", "Type", "Paid in", "Paid out"),
    )
    amount_line = G.begins_with(r"^[-+]?£")

    def read(block: Column) -> Column:
        rest = G.tail(block)
        pattern = r"([-+])?£\s*([0-9,]+\.?\d*)"

        def made(printed: Column, description: Column) -> Column:
            figure = G.extract(printed, pattern, 2)
            amount = try_parse_money(F.concat(F.regexp_extract(printed, pattern, 1), F.lit("£"), figure))
            date = G.extract(F.get(block, 0), r"^(\d{1,2}\s+\w{3})")
            return G.record(
                "transaction",
                [("date", G.let(date, lambda d: _dated(d, period))), ("description", description),
                 ("amount_minor", F.when(description.isNotNull(), amount)), ("amount_text", figure)],
            )

        return G.let(
            F.get(F.filter(rest, amount_line), 0),
            lambda printed: G.let(G.joined(G.until(rest, amount_line)), lambda words: made(printed, words)),
        )

    return _kept(F.transform(G.blocks(lines, G.begins_with(r"^\d{1,2}\s+\w{3}")), read))


# --- natwest-statement -----------------------------------------------------------

STATEMENT_HEADINGS = ("Date", "Description", "Paid In(£)", "Withdrawn(£)", "Balance(£)")
STATEMENT_FOOTERS = ("Interest (variable)", "RETSTMT")
STATEMENT_DATE = rf"\d{{1,2}}{G.BLANK}+[A-Z]{{3}}(?:{G.BLANK}+\d{{4}})?{G.END}"
STATEMENT_NUMBER = rf"[\d,]+\.\d{{2}}{G.END}"
BROUGHT_FORWARD = "BROUGHT FORWARD"


def _natwest_statement(text: Column, period: Column) -> Column:
    """Rows of words followed by numbers, the last of which is the balance. A date
    is printed once a day: each row carries the date lines just before it, and the
    rest is filled in, and amounts are taken, once the rows are out."""

    # A tab before the break marks a date, a space marks a number.
    lines = F.regexp_replace(G.listed(text), rf"{G.LINES}^({STATEMENT_DATE})", "$1\t")
    told = F.regexp_replace(lines, rf"{G.LINES}^({STATEMENT_NUMBER})", "$1 ")

    def made(row: Column, date: Column) -> Column:
        words = F.regexp_replace(row, rf"{G.LINES}^[\d,].*+(?<=[ \t])\n", "")
        named = F.regexp_replace(words, rf"\G{G.exactly(*STATEMENT_HEADINGS)}\n", "")
        to_date = F.regexp_replace(row, rf"{G.LINES}^\d.*+(?<=\t)\n{G.REST}", "")
        number = G.extract(to_date, rf"{G.LINES}^([\d,].*+)(?<= )\n\z", 1)

        def with_words(named: Column, description: Column) -> Column:
            balance = F.when(description.isNotNull(), try_parse_money(number))
            return G.record(
                F.when(G.starts_with_any(*STATEMENT_FOOTERS)(named), "footer").otherwise("transaction"),
                [("date", date), ("description", description), ("amount_minor", F.lit(None)), ("balance_minor", balance)],
            )

        return G.let(named, lambda n: G.let(G.joined_text(n), lambda words: with_words(n, words)))

    def read(parts: Column, part: Column, i: Column) -> Column:
        # What comes before the first words is no row, but its date counts.
        is_row = (i > 0) | part.rlike(r"(?d)\A.*+(?<=\S)\n")
        dates = F.regexp_extract_all(F.get(parts, i - 1), F.lit(rf"{G.LINES}^(\d.*+)(?<=\t)\n"), F.lit(1))
        return F.when(is_row, made(part, F.rtrim(G.last(dates), F.lit("\t"))))

    def rows(parts: Column) -> Column:
        return F.filter(F.transform(parts, lambda part, i: read(parts, part, i)), lambda r: r.isNotNull())

    # A row begins with the first words after a date or number.
    return _until_footer(G.let(F.split(told, r"(?d)(?<=[ \t]\n)(?=.*+(?<=\S)\n)"), rows))


def _until_footer(records: Column) -> Column:
    def cut(rs: Column) -> Column:
        at = F.array_position(F.transform(rs, lambda r: r["record_type"] == "footer"), True)
        return G.let(at, lambda a: F.when(a > 0, F.slice(rs, 1, (a - 1).cast("int"))).otherwise(rs))

    return G.let(records, cut)


# --- firstdirect -----------------------------------------------------------------


def _firstdirect(text: Column, period: Column) -> Column:
    lines = G.body_text(
        G.listed(text),
        start=G.holding("Your Transaction Details", "Transaction Date"),
        stop=G.holding("Outstanding Balance", "Summary Of Interest"),
        skip=G.exactly("Received By Us", "Transaction Date", "Details", "Amount"),
    )
    bare, pounds = r"^[0-9,]+\.?\d*(CR)?$", r"£\s*([0-9,]+\.?\d*)\s*(CR)?"
    # Lines that hold one of the two.
    figure_line = rf"(?:[0-9,]+\.?\d*(?:CR)?{G.END}|.*£{G.BLANK}*[0-9,].*$)"

    def read(block: Column) -> Column:
        def made(printed: Column, description: Column) -> Column:
            is_bare = printed.rlike(bare)
            figure = F.when(is_bare, F.nullif(F.replace(printed, F.lit("CR"), F.lit("")), F.lit(""))).otherwise(
                G.extract(printed, pounds, 1)
            )
            credit = F.when(is_bare, printed.endswith("CR")).otherwise(F.regexp_extract(printed, pounds, 2) == "CR")

            def with_figure(figure: Column) -> Column:
                parsed = try_parse_money(figure) * F.when(credit, 1).otherwise(-1)
                return G.record(
                    "transaction",
                    [("date", G.extract(block, r"^(\d{1,2}\s+\w{3}\s+\d{2})")), ("description", description),
                     ("amount_minor", F.when(description.isNotNull(), parsed)), ("amount_text", figure)],
                )

            return G.let(figure, with_figure)

        def parted(rest: Column) -> Column:
            printed = G.extract(rest, rf"{G.LINES}^({figure_line})", 1)
            words = G.joined_text(
                F.regexp_replace(rest, rf"{G.LINES}^(?:{figure_line}{G.REST}|.*£.*\n)", "")
            )
            return G.let(printed, lambda p: G.let(words, lambda w: made(p, w)))

        return G.let(F.regexp_replace(block, r"(?d)\A.*\n", ""), parted)

    begins = rf"\d{{1,2}}{G.BLANK}+\w{{3}}{G.BLANK}+\d{{2}}"
    return _kept(F.transform(G.block_texts(lines, begins), read))


def _month_before(text: Column) -> Column:
    """Only the statement date is printed; statements are a month apart."""
    end = D.try_format(_one_space(G.extract(text, r"Statement Date\s+" + LONG_DATES)), D.DAY_FULL_MONTH_YEAR)
    return _span(F.add_months(end.cast("date"), -1), end)


# --- amex ------------------------------------------------------------------------

AMEX_ROW = r"^([A-Z][a-z]{2}\s+\d{1,2})\s+[A-Z][a-z]{2}\s+\d{1,2}\s+(.+?)\s+([\d,]+\.\d{2})$"
AMEX_SINGLE_DATE_ROW = r"^([A-Z][a-z]{2}\s+\d{1,2})\s+(.+?)\s+([\d,]+\.\d{2})$"
AMEX_ROW_LINE = (
    rf"[A-Z][a-z]{{2}}{G.BLANK}+\d{{1,2}}{G.BLANK}+[A-Z][a-z]{{2}}{G.BLANK}+\d{{1,2}}"
    rf"{G.BLANK}+{G.ANY}+?{G.BLANK}+[\d,]+\.\d{{2}}"
)
AMEX_PLAN_WORDS = "Plan It Instalments"
AMEX_PLAN = r"^([A-Z][a-z]{2}\s+\d{1,2}\s+\d{4})\s+(.+)$"
AMEX_PLAN_VALUES = (
    r"^([\d,]+\.\d{2})\s+([\d,]+\.\d{2})\s+([\d,]+\.\d{2})\s+([\d,]+\.\d{2})\s+([\d,]+\.\d{2})\s+(\d+\s+OF\s+\d+)$"
)
AMEX_PLAN_FEE = r"^([\d,]+\.\d{2})$"
AMEX_SUMMARY = r"(?s)Previous Closing Balance.*?Closing Balance\s*\n+((?:[^\n]*£[^\n]*\n)+)"
PLAN_FEE = "INSTALMENT PLAN FEE"


def _amex_period(text: Column) -> Column:
    """The year is printed on the closing date only."""
    pattern = r"From\s+(\d{1,2}\s+[A-Za-z]+)\s+to\s+(\d{1,2}\s+[A-Za-z]+)\s+(\d{4})"
    first, last, year = (_one_space(G.extract(text, pattern, i)) for i in (1, 2, 3))
    printed = F.struct(
        # A leap year, so that a 29 February can be read before its year is known.
        D.try_format(F.concat(first, F.lit(" 2000")), D.DAY_FULL_MONTH_YEAR).alias("placed"),
        D.try_format(F.concat_ws(" ", last, year), D.DAY_FULL_MONTH_YEAR).alias("end"),
    )

    def with_year(p: Column) -> Column:
        placed, end = p["placed"], p["end"]
        from_year = F.year(end) - (F.month(placed) > F.month(end)).cast("int")
        zero = F.lit(0)
        return _span(
            F.try_make_timestamp_ntz(from_year, F.month(placed), F.dayofmonth(placed), zero, zero, zero), end
        )

    return G.let(printed, with_year)


def _amex(text: Column, period: Column) -> Column:
    closing_date = F.date_format(period["to"], "dd MMM yyyy")

    def swapped(month_day: Column) -> Column:
        turned = F.regexp_replace(month_day, r"^(\S+)\s+(\S+)$", "$2 $1")
        return G.let(turned, lambda d: _dated(d, period))

    def row(line: Column, pattern: str, sign: Column) -> Column:
        def with_figure(figure: Column) -> Column:
            return G.record(
                "transaction",
                [("date", swapped(G.extract(line, pattern, 1))), ("description", G.extract(line, pattern, 2)),
                 ("amount_minor", try_parse_money(figure) * sign), ("amount_text", figure)],
            )

        return G.let(G.extract(line, pattern, 3), with_figure)

    def spending(page: Column) -> Column:
        # A tab before the break marks a row that a CR line follows.
        credited = F.regexp_replace(page, rf"{G.LINES}^({AMEX_ROW_LINE}{G.END})(?=\n(?:.* )?CR$)", "$1\t")
        printed = F.regexp_extract_all(credited, F.lit(rf"{G.LINES}^{AMEX_ROW_LINE}{G.END[:-1]}\t?$"), F.lit(0))

        def read(line: Column) -> Column:
            sign = F.when(line.endswith("\t"), 1).otherwise(-1)
            return G.let(F.rtrim(line, F.lit("\t")), lambda told: row(told, AMEX_ROW, sign))

        return F.transform(printed, read)

    def section(lines: Column, title: str, total: str) -> Column:
        return G.until(G.since(lines, lambda line: line == title), lambda line: line.startswith(total))

    def created(lines: Column) -> Column:
        rows = section(lines, "New Plan It Instalments Created", "Total of New Plan It Instalments Created")
        return F.transform(G.matching(rows, AMEX_SINGLE_DATE_ROW), lambda r: row(r, AMEX_SINGLE_DATE_ROW, F.lit(1)))

    def fees(lines: Column) -> Column:
        rows = section(lines, "New Plan It Instalments and Fees", "Total of New Instalment Plans and Fees")
        charged = F.filter(
            G.matching(rows, AMEX_SINGLE_DATE_ROW), lambda r: F.regexp_extract(r, AMEX_SINGLE_DATE_ROW, 2) == PLAN_FEE
        )
        return F.transform(charged, lambda r: row(r, AMEX_SINGLE_DATE_ROW, F.lit(-1)))

    def plans(lines: Column) -> Column:
        return G.let(section(lines, "Plan It Instalments Summary", "Total"), plan_rows)

    def plan_rows(rows: Column) -> Column:
        def read(line: Column, i: Column) -> Column:
            values, fee = F.get(rows, i + 1), F.get(rows, i + 2)
            is_plan = line.rlike(AMEX_PLAN) & values.rlike(AMEX_PLAN_VALUES) & fee.rlike(AMEX_PLAN_FEE)
            return F.when(
                is_plan,
                G.record(
                    "plan_it_instalment",
                    [("start_date", G.extract(line, AMEX_PLAN, 1)), ("description", G.extract(line, AMEX_PLAN, 2)),
                     ("plan_total", G.extract(values, AMEX_PLAN_VALUES, 1)),
                     ("plan_lifetime_fee", fee),
                     ("remaining_balance", G.extract(values, AMEX_PLAN_VALUES, 2)),
                     ("due_this_month_plan", G.extract(values, AMEX_PLAN_VALUES, 3)),
                     ("due_this_month_fee", G.extract(values, AMEX_PLAN_VALUES, 4)),
                     ("due_this_month_total", G.extract(values, AMEX_PLAN_VALUES, 5)),
                     ("instalment_progress", G.extract(values, AMEX_PLAN_VALUES, 6)),
                     ("as_of_date", closing_date)],
                ),
            )

        return F.filter(F.transform(rows, read), lambda r: r.isNotNull())

    def instalments(page: Column) -> Column:
        return G.let(G.split_lines(F.rtrim(page, F.lit("\n"))), lambda p: F.concat(created(p), fees(p), plans(p)))

    def read(page: Column) -> Column:
        # Few pages have instalments, and a look for the words costs less than their lines.
        planned = F.when(page.contains(AMEX_PLAN_WORDS), instalments(page))
        return F.concat(spending(page), F.coalesce(planned, F.array().cast(RECORDS)))

    return F.flatten(F.transform(F.split(text, "\f"), lambda page: G.let(G.listed(page), read)))


def _amex_figures(text: Column) -> Column:
    """Amounts of the summary box: 4 of them, or 5 with instalments due."""
    box = F.regexp_extract(F.get(F.split(text, "\f"), 0), AMEX_SUMMARY, 1)
    figures = F.regexp_extract_all(box, F.lit(r"£\s*([\d,]+\.\d{2})"), 1)
    return G.let(figures, lambda f: F.when(F.size(f).isin(4, 5), f))


def _instalments_due(text: Column) -> Column:
    return G.let(_amex_figures(text), lambda f: F.when(F.size(f) == 5, try_parse_money(F.get(f, 3))))


# --- vanguard-pdf ----------------------------------------------------------------

WRAPPER = r"^Your (.+) investments at (.+)$"
SUMMARY_TITLE = "Your Vanguard account summary"
HOLDING_HEADINGS = ("Description", "Quantity", "Price", "Value")
HOLDING_VALUE = r"^-$|^£[\d,]+\.\d{2}$|^\d+\.\d{2}$"
SUMMARY_VALUE = r"^£[\d,]+\.\d{2}$"
ACTIVITY_NOISE = (
    "The transaction date is the date we carried out the activity.",
    "Transaction date Transaction details",
    "Cash amount",
    "Cash balance",
)
ACTIVITY_DATE = r"^\d{2}/\d{2}/\d{4}$"
ACTIVITY_AMOUNT = r"^[-+]?£[\d,]+\.\d{2}$"
PAGE_HEAD = r"(?m)(?:^(?!Account number:|Page \d)[^\n]*\n)?^Account number:[ \t]*[A-Z0-9]+(?:\n|\z)(?:Page \d+ of \d+(?:\n|\z))?"
FOOT_WORDS = "Issued by Vanguard Asset Management"
PAGE_FOOT = rf"(?m)^{FOOT_WORDS}[\s\S]*?(?:EC4N 8AF\.[^\n]*(?:\n|\z)|\z)"


def _without_page_furniture(text: Column) -> Column:
    def without_feet(plain: Column) -> Column:
        # Most texts are one page, and a look for the words costs less than the pattern.
        return F.when(plain.contains(FOOT_WORDS), F.regexp_replace(plain, PAGE_FOOT, "")).otherwise(plain)

    return F.split(F.regexp_replace(G.let(G.plain(text), without_feet), PAGE_HEAD, ""), "\n")


def _chunks(lines: Column, pattern: str, width: Column) -> Column:
    """Rows of `width` values each, with the words since the row before."""

    value_kind = 1

    def chunk(ls: Column, at: Column, n: Column) -> Column:
        begin = F.when(n == 1, F.lit(0)).otherwise(F.get(at, (n - 1) * width - 1))
        end = F.get(at, n * width - 1)
        return G.let(
            F.slice(ls, begin + 1, end - begin),
            lambda rows: F.struct(
                F.coalesce(G.joined(G.texts_of(F.filter(rows, lambda t: t["kind"] == G.OTHER))), F.lit("")).alias("words"),
                G.texts_of(F.filter(rows, lambda t: t["kind"] == value_kind)).alias("values"),
            ),
        )

    def rows(ls: Column, at: Column) -> Column:
        count = F.floor(F.size(at) / F.greatest(width, F.lit(1))).cast("int")
        numbers = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
        return F.transform(numbers, lambda n: chunk(ls, at, n))

    return G.let(
        G.told_apart(lines, pattern), lambda ls: G.let(G.places(ls, lambda t: t["kind"] == value_kind), lambda at: rows(ls, at))
    )


def _sections(text: Column) -> Column:
    """Holdings and activity sections, each a block whose first line is its title."""
    starts = G.either(
        G.begins_with(WRAPPER), G.starts_with_any("Activity from"), G.one_of(SUMMARY_TITLE)
    )
    return G.blocks(_without_page_furniture(text), starts)


def _vanguard(sections: Column, period: Column) -> Column:
    empty = F.array().cast(RECORDS)
    date_kind, amount_kind = 1, 2

    def holdings(rest: Column, wrapper: Column, as_of: Column) -> Column:
        def table(lines: Column) -> Column:
            first = F.array_position(F.transform(lines, lambda line: ~line.isin(*HOLDING_HEADINGS)), True)
            return G.let(first, lambda at: F.when(at > 0, G.after(lines, (at - 1).cast("int"))))

        def holding(chunk: Column) -> Column:
            values = chunk["values"]

            def minor(i: int) -> Column:
                return F.when(F.get(values, i) != "-", try_parse_money(F.get(values, i)))

            return G.record(
                "holding",
                [("wrapper", wrapper), ("fund_name", chunk["words"]), ("quantity_text", F.get(values, 0)),
                 ("unit_price_minor", minor(1)), ("total_value_minor", minor(2)), ("as_of_date", as_of)],
                wrapper,
            )

        return F.coalesce(F.transform(_chunks(G.let(rest, table), HOLDING_VALUE, F.lit(3)), holding), empty)

    def activities(rest: Column, wrapper: Column) -> Column:
        listed = F.filter(G.until(rest, G.starts_with_any("Your ")), lambda line: ~line.isin(*ACTIVITY_NOISE))

        def activity(block: Column) -> Column:
            def made(amounts: Column, description: Column) -> Column:
                return G.record(
                    "transaction",
                    [("date", F.get(block, 0)["line"]), ("description", description),
                     ("amount_minor", F.when(description.isNotNull(), try_parse_money(F.get(amounts, 0)))),
                     ("cash_balance_minor", try_parse_money(F.get(amounts, 1)))],
                    wrapper,
                )

            def parted(rest: Column) -> Column:
                words = G.joined(G.texts_of(F.filter(rest, lambda t: t["kind"] != amount_kind)))
                amounts = G.texts_of(F.filter(rest, lambda t: t["kind"] == amount_kind))
                return G.let(amounts, lambda a: G.let(words, lambda w: made(a, w)))

            return G.let(G.tail(block), parted)

        told = G.told_apart(listed, ACTIVITY_DATE, ACTIVITY_AMOUNT)
        return _kept(F.transform(G.blocks(told, lambda t: t["kind"] == date_kind), activity))

    def read(sections: Column, section: Column, n: Column) -> Column:
        # The wrapper whose holdings were printed last, also for its activity.
        titles = F.transform(F.slice(sections, 1, n + 1), lambda s: F.get(s, 0))
        wrapper = G.strip(F.regexp_extract(G.last(G.matching(titles, WRAPPER)), WRAPPER, 1))

        def by_title(title: Column, held_in: Column) -> Column:
            held = G.let(
                G.strip(F.regexp_extract(title, WRAPPER, 2)), lambda as_of: holdings(G.tail(section), held_in, as_of)
            )
            return (
                F.when(title.rlike(WRAPPER), held)
                .when(title.startswith("Activity from") & held_in.isNotNull(), activities(G.tail(section), held_in))
                .otherwise(empty)
            )

        return G.let(wrapper, lambda w: G.let(F.get(section, 0), lambda title: by_title(title, w)))

    return F.flatten(F.transform(sections, lambda s, n: read(sections, s, n)))


def wrapper_totals(sections: Column) -> Column:
    """Printed closing value per wrapper, from the summary on the first page."""
    none = F.array().cast("array<struct<wrapper:string,closing_minor:bigint>>")
    summary = F.get(F.filter(sections, lambda s: F.get(s, 0) == SUMMARY_TITLE), 0)

    def totals(rest: Column, columns: Column) -> Column:
        rows = G.until(G.after(rest, columns + 1), lambda line: line == "Account total")
        pairs = F.transform(
            _chunks(rows, SUMMARY_VALUE, columns),
            lambda c: F.struct(c["words"].alias("wrapper"), try_parse_money(G.last(c["values"])).alias("closing_minor")),
        )
        return F.when((F.get(rest, 0) == "Product") & (columns > 0), pairs).otherwise(none)

    def table(rest: Column) -> Column:
        columns = F.size(G.until(G.tail(rest), lambda line: ~line.rlike(r"^Value on (.+)$")))
        return G.let(columns, lambda n: totals(rest, n))

    return F.coalesce(G.let(summary, lambda s: F.when(s.isNotNull(), G.let(G.tail(s), table))), none)


# --- monzo-pdf, chase, monzo-flex ------------------------------------------------


def _monzo_pdf(text: Column, period: Column) -> Column:
    lines = G.body_text(
        G.listed(text),
        start=G.exactly("(GBP) Balance"),
        stop=G.beginning("Pot statement", "Monzo Bank Limited"),
        skip=G.beginning("Sort code:", "Account number:", "BIC:", "IBAN:"),
    )
    return _numbered_rows(lines, r"\d{2}/\d{2}/\d{4}", r"-?[\d,]+\.\d{2}", 2, lambda n: (n(0), n(1)))


def _chase(text: Column, period: Column) -> Column:
    lines = G.body_text(
        G.listed(text),
        start=G.exactly("Balance"),
        stop=G.beginning("Some useful information"),
        skip="|".join(
            (
                G.exactly("Date", "Transaction details", "Amount"),
                G.beginning("Account number:", "Sort code:", "Page "),
            )
        ),
    )
    date = rf"\d{{1,2}}{G.BLANK}+[A-Za-z]{{3}}{G.BLANK}+\d{{4}}"
    return _numbered_rows(lines, date, r"[+-]?£[\d,]+\.\d{2}", 2, lambda n: (n(0), n(1)))


def _monzo_flex(text: Column, period: Column) -> Column:
    lines = G.body_text(G.listed(text), start=G.exactly("Balance"), stop=G.holding("legally prescribed"))
    return _numbered_rows(
        lines, r"\d{2}/\d{2}/\d{4}", r"-?[\d,]+\.\d{2}", 3, lambda n: (n(1) - n(0), n(2))
    )


def _numbered_rows(
    lines: Column, date: str, number: str, count: int,
    figures: Callable[[Callable[[int], Column]], tuple[Column, Column]],
) -> Column:
    """Rows with a date line, words, and exactly `count` number lines."""

    number_line = rf"^{number}{G.END}"

    def read(block: Column) -> Column:
        def made(numbers: Column, description: Column) -> Column:
            whole = description.isNotNull() & (F.size(numbers) == count)
            amount, balance = figures(lambda i: F.when(whole, try_parse_money(F.get(numbers, i))))
            return G.record(
                "transaction",
                [("date", G.first_line(block)), ("description", description), ("amount_minor", amount),
                 ("balance_minor", balance)],
            )

        numbers = F.regexp_extract_all(block, F.lit(f"{G.LINES}{number_line}"), F.lit(0))
        words = G.joined_text(F.regexp_replace(block, rf"{G.LINES}\A.*\n|{number_line}\n", ""))
        return G.let(numbers, lambda n: G.let(words, lambda w: made(n, w)))

    return _kept(F.transform(G.block_texts(lines, rf"{date}{G.END}"), read))


LAYOUTS: tuple[Layout, ...] = (
    Layout(
        "kroo", "kroo_txn", _has("Kroo Current Account"), _kroo,
        _period(r"(?m)^[ \t]*" + LONG_DATES + r"\s+to\s+" + LONG_DATES + r"[ \t]*$", D.DAY_FULL_MONTH_YEAR),
        identifier=_pair(SORT_CODE, ACCOUNT_NUMBER),
        opening=_amount(r"Total opening balance\s*\n\s*£\s*([\d,]+\.\d{2})"),
        closing=_amount(r"Closing balance\s*\n\s*£\s*([\d,]+\.\d{2})"),
        check_name="kroo_closing_balance", derived="last",
    ),
    Layout(
        "natwest-transactions", "natwest_transactions_txn", _has("NatWest", "Your transactions"), _natwest_transactions,
        _period(r"From\s+(\d{2}/\d{2}/\d{4})\s+To\s+(\d{2}/\d{2}/\d{4})", D.SLASHED),
        identifier=_pair(r"(\*+\d+)\s*·\s*[\d-]+", r"\*+\d+\s*·\s*([\d-]+)"),
    ),
    Layout(
        "natwest-statement", "natwest_statement_txn", _has("BROUGHT FORWARD", "Previous Balance"), _natwest_statement,
        _period(r"Period Covered\s*\n\s*(\d{1,2}\s+[A-Z]{3}\s+\d{4})\s+to\s+(\d{1,2}\s+[A-Z]{3}\s+\d{4})", D.DAY_MONTH_YEAR),
        identifier=_pair(
            r"(?s)Account No\s*\n\s*Sort Code\s*\n\s*Page No\s*\n\s*.+?\n\s*(\d{6,10})\s*\n\s*\d{2}-\d{2}-\d{2}",
            r"(?s)Account No\s*\n\s*Sort Code\s*\n\s*Page No\s*\n\s*.+?\n\s*\d{6,10}\s*\n\s*(\d{2}-\d{2}-\d{2})",
        ),
        opening=_amount(r"Previous Balance\s*\n\s*£([\d,]+\.\d{2})"),
        closing=_amount(r"New Balance\s*\n\s*£([\d,]+\.\d{2})"),
        check_name="natwest_statement_new_balance", derived="last", running="delta",
    ),
    Layout(
        "firstdirect", "firstdirect_txn",
        # A text is put in lower case only where the cheaper looks pass.
        lambda text: (text.contains("Your Transaction Details") | text.contains("Credit Card"))
        & F.lower(text).contains("first direct"),
        _firstdirect, _month_before,
        identifier=lambda text: G.extract(text, r"\b(\d{4}\s\d{4}\s\d{4}\s\d{4})\b"),
        opening=_amount(r"Previous Balance\s*\n\s*([\d,]+\.\d{2})"),
        closing=_amount(r"New Balance\s*\n\s*([\d,]+\.\d{2})"),
        check_name="first_direct_new_balance", derived="minus", running="liability",
    ),
    Layout(
        "amex", "amex_txn",
        lambda text: text.contains("American Express")
        & (text.contains("Preferred Rewards") | text.contains("Credit Card")),
        _amex, _amex_period,
        identifier=lambda text: G.extract(text, r"[xX]{4}-[xX]{6}-\d+", 0),
        opening=lambda text: try_parse_money(F.get(_amex_figures(text), 0)),
        closing=lambda text: try_parse_money(G.last(_amex_figures(text))),
        check_name="amex_closing_balance", derived="minus", running="liability", adjustment=_instalments_due,
        snapshot_prefix="amex_planit",
    ),
    Layout(
        "vanguard-pdf", "vanguard_txn", _has("Vanguard", "Statement", "Activity"), _vanguard,
        _period(r"(?m)^[ \t]*Activity from " + LONG_DATES + r" to " + LONG_DATES, D.DAY_FULL_MONTH_YEAR),
        identifier=lambda text: G.extract(text, r"Account number:\s*([A-Z0-9]+)"),
        snapshot_prefix="vanguard_holding", sections=_sections,
    ),
    Layout(
        "monzo-pdf", "monzo_pdf_txn", _has("Personal Account statement", "Monzo"), _monzo_pdf,
        _period(SLASHED_SPAN, D.SLASHED), identifier=_pair(SORT_CODE, ACCOUNT_NUMBER),
        closing=_amount(r"£\s*([\d,]+\.\d{2})\s*\n\s*Personal Account balance\b"),
        check_name="monzo_pdf_personal_account_balance", derived="first",
    ),
    Layout(
        "chase", "chase_txn",
        lambda text: text.contains("J.P. Morgan Europe Limited")
        & (text.contains("Account statement") | text.contains("Chase Saver statement")),
        _chase,
        _period(r"(?m)^[ \t]*" + LONG_DATES + r"\s*-\s*" + LONG_DATES + r"[ \t]*$", D.DAY_FULL_MONTH_YEAR),
        identifier=_pair(ACCOUNT_NUMBER, SORT_CODE),
        opening=_amount(r"Opening balance\s*\n\s*£\s*([\d,]+\.\d{2})"),
        closing=_amount(r"Closing balance\s*\n\s*£\s*([\d,]+\.\d{2})"),
        check_name="chase_closing_balance", derived="plus",
    ),
    Layout(
        "monzo-flex", "monzo_flex_txn", _has("Flex statement", "Balance at end"), _monzo_flex,
        _period(SLASHED_SPAN, D.SLASHED),
        opening=_amount(r"£\s*([\d,]+\.\d{2})\s*\n\s*Balance at start\b"),
        closing=_amount(r"£\s*([\d,]+\.\d{2})\s*\n\s*Balance at end\b"),
        check_name="monzo_flex_balance_at_end", derived="first",
    ),
)


def wrapper_check_name(wrapper: Column) -> Column:
    return F.concat(F.lit("vanguard_account_summary_"), slug(wrapper))
