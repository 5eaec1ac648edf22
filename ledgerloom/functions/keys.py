"""Content keys: every identity is a hash of what the row says."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _text(value: Column | str) -> Column:
    return F.coalesce(_column(value).cast("string"), F.lit(""))


def normalize_description(text: Column | str) -> Column:
    """Upper case, letters digits and single spaces only."""
    upper = F.replace(F.upper(_column(text)), F.lit("£"), F.lit(""))
    spelled = F.replace(F.replace(upper, F.lit("'LL"), F.lit(" WILL")), F.lit("N'T"), F.lit(" NOT"))
    return F.trim(F.regexp_replace(spelled, "[^A-Z0-9]+", " "))


def moment(value: Column | str) -> Column:
    return _column(value).cast("timestamp_ntz")


def fingerprint(account: Column | str, date: Column | str, amount: Column | str, description: Column | str) -> Column:
    """What a transaction says, without which source said it."""
    return F.sha2(
        F.concat_ws(
            "|",
            _text(account),
            moment(date).cast("string"),
            _text(amount),
            normalize_description(description),
        ),
        256,
    )


def loose_fingerprint(account: Column | str, amount: Column | str, description: Column | str) -> Column:
    """The fingerprint without its date."""
    return F.sha2(F.concat_ws("|", _text(account), _text(amount), normalize_description(description)), 256)


def canonical_id(source_type: Column | str, content: Column | str, occurrence: Column | str) -> Column:
    return F.concat(_column(source_type), F.lit(":"), _column(content), F.lit("_"), _column(occurrence).cast("string"))


def mask_identifier(raw: Column | str) -> Column:
    """Twelve hex digits that stand for an account number."""
    return F.substring(F.sha2(F.upper(F.regexp_replace(_column(raw), r"\s+", "")), 256), 1, 12)


def bronze_record_id(ingestion: Column | str, record_type: Column | str, ordinal: Column | str) -> Column:
    return F.sha2(F.concat_ws(":", _column(ingestion), _column(record_type), _column(ordinal).cast("string")), 256)


def readable_slug(text: Column | str, limit: int = 10) -> Column:
    trimmed = F.regexp_replace(_text(text), r"^\s+|\s+$", "")
    return F.substring(F.regexp_replace(trimmed, r"\s+", "_"), 1, limit)


def _date_digits(text: Column | str) -> Column:
    return F.regexp_replace(_text(text), r"[\s/]", "")


def _account_part(account: Column | str | None) -> Column:
    if account is None:
        return F.lit("")
    return F.coalesce(F.concat(F.nullif(_column(account), F.lit("")), F.lit("_")), F.lit(""))


def transaction_source_key(
    prefix: str | Column,
    date: Column | str,
    description: Column | str,
    amount: Column | str,
    account: Column | str | None = None,
) -> Column:
    digest = F.substring(F.sha2(F.concat_ws("|", _text(description), _text(amount)), 256), 1, 8)
    head = F.lit(prefix) if isinstance(prefix, str) else prefix
    return F.concat(
        head, F.lit("_"), _account_part(account), _date_digits(date), F.lit("_"),
        readable_slug(description), F.lit("_"), _text(amount), F.lit("_"), digest,
    )


def snapshot_source_key(
    prefix: str | Column,
    label: Column | str,
    as_of: Column | str,
    account: Column | str | None = None,
    extra: Column | str | None = None,
) -> Column:
    digest = F.substring(F.sha2(_text(label), 256), 1, 8)
    head = F.lit(prefix) if isinstance(prefix, str) else prefix
    extra_part = F.lit("")
    if extra is not None:
        extra_part = F.when(_text(extra) == "", "").otherwise(F.concat(_date_digits(extra), F.lit("_")))
    return F.concat(
        head, F.lit("_"), _account_part(account), extra_part, readable_slug(label, 15), F.lit("_"),
        _date_digits(as_of), F.lit("_"), digest,
    )


def slug(text: Column | str) -> Column:
    """Lower-case words joined by underscores."""
    return F.regexp_replace(F.regexp_replace(F.lower(_column(text)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def view_name(text: str) -> str:
    """A source type as part of a SQL name."""
    return "".join(ch if ch.isalnum() else "_" for ch in text.lower())
