"""Strict readers for numbers, booleans and times written as text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed pattern: date, 'T', time, optional fraction, zone.
RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}([.,]\d+)?(Z|[+-]\d{2}:\d{2})$"


def parse_rfc3339(text: Column) -> Column:
    """Timestamp, or NULL where the text is not RFC 3339."""
    return F.when(text.rlike(RFC3339), F.try_to_timestamp(F.regexp_replace(text, ",", ".")))


def from_millis(value: Column) -> Column:
    return F.timestamp_millis(value)


def format_rfc3339(ts: Column) -> Column:
    """Whole seconds, UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def format_rfc3339_nano(ts: Column) -> Column:
    """Fraction without trailing zeros, UTC."""
    digits = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.regexp_replace(digits, r"\.?0+$", ""), F.lit("Z"))


def parse_http_date(text: Column) -> Column:
    """The three date forms HTTP allows: fixed length, two-digit year, and the one without a zone."""
    fixed = F.when(
        text.rlike(r"^\w{3}, \d{2} \w{3} \d{4} \d{2}:\d{2}:\d{2} GMT$"),
        F.try_to_timestamp(F.substring(text, 6, 20), F.lit("dd MMM yyyy HH:mm:ss")),
    )
    day = F.regexp_extract(text, r"^\w+, (\d{2}-\w{3}-\d{2} \d{2}:\d{2}:\d{2}) GMT$", 1)
    short = F.try_to_timestamp(F.when(day != "", day), F.lit("dd-MMM-yy HH:mm:ss"))
    short = F.when(F.year(short) >= 2069, short - F.expr("INTERVAL 100 YEARS")).otherwise(short)
    plain = F.regexp_extract(text, r"^\w{3} (\w{3} [ \d]\d \d{2}:\d{2}:\d{2} \d{4})$", 1)
    plain = F.try_to_timestamp(F.regexp_replace(F.when(plain != "", plain), " +", " "), F.lit("MMM d HH:mm:ss yyyy"))
    return F.coalesce(fixed, short, plain)


def parse_integer(text: Column) -> Column:
    return F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint"))


def parse_float(text: Column) -> Column:
    return F.when(text.rlike(r"^\S+$"), text.try_cast("double"))


def parse_boolean(text: Column) -> Column:
    # The spellings the captured headers may use.
    return F.when(text.isin("1", "t", "T", "TRUE", "true", "True"), F.lit(True)).when(
        text.isin("0", "f", "F", "FALSE", "false", "False"), F.lit(False)
    )


def blank_to_null(text: Column) -> Column:
    return F.when(text != "", text)


def get_ci(values: Column, name: str) -> Column:
    """Map lookup that ignores the case of the key; the value comes back trimmed."""
    hits = F.filter(F.map_entries(values), lambda e: F.lower(e["key"]) == name.lower())
    return F.trim(F.get(hits, 0)["value"])
