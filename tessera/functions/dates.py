"""Dates and times; timestamps count as UTC."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(ts: Column) -> Column:
    """Microseconds since the epoch, with or without a zone."""
    return F.unix_micros(ts.cast("timestamp"))


def duration_minutes(start: Column, end: Column) -> Column:
    """Minutes to two places; 0 where either is missing or the order is wrong."""
    minutes = (micros(end) - micros(start)) / 60_000_000
    return F.coalesce(F.greatest(F.lit(0.0), F.bround(minutes, 2)), F.lit(0.0))


def month_start(ts: Column) -> Column:
    return F.trunc(ts, "MM")


def next_month(ts: Column) -> Column:
    return F.add_months(F.trunc(ts, "MM"), 1)


def lenient_iso(text: Column) -> Column:
    """A timestamp, or null where the text is none."""
    return F.try_to_timestamp(text)


def from_epoch(seconds: Column) -> Column:
    """UTC timestamp of epoch seconds; null for null and 0."""
    return F.timestamp_seconds(F.nullif(seconds, F.lit(0)))


def fresh(ts: Column, as_of: Column, most_days: int) -> Column:
    """Age in whole days between 0 and ``most_days``."""
    days = F.floor((micros(as_of) - micros(ts)) / 86_400_000_000)
    return F.coalesce((days >= 0) & (days <= most_days), F.lit(False))
