"""Timestamps of evidence, UTC throughout; what cannot be parsed is null and never fails a job."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of time fields, in order of preference.
TIME_FIELDS = ("@timestamp", "timestamp", "ts", "datetime", "event_time", "time", "CreatedTime", "EventTime", "date")


def time_field(columns: list[str]) -> str | None:
    """The field that holds the time, by preference."""
    return next((c for c in TIME_FIELDS if c in columns), None)


def epoch_scale(value: Column) -> Column:
    """A number as seconds, milliseconds or microseconds since 1970, by its magnitude."""
    x = value.cast("double")
    micros = F.when(x > 1e15, x).when(x > 1e12, x * 1000).otherwise(x * 1000000)
    return F.timestamp_micros(F.round(micros).cast("long"))


def parse_time(text: Column, zone: str = "UTC") -> Column:
    """ISO text (naive text in `zone`) or a number as text."""
    plain = F.trim(text)
    naive = F.to_utc_timestamp(plain.try_cast("timestamp_ntz").cast("timestamp"), zone)
    aware = plain.rlike(r"(?:Z|[+-]\d{2}:?\d{2})$") & plain.contains(":")
    return F.when(plain.rlike(r"^-?\d+(?:\.\d+)?$"), epoch_scale(plain.try_cast("double"))).when(aware, plain.try_cast("timestamp")).otherwise(naive)


def access_log_time(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit("dd/MMM/yyyy:HH:mm:ss Z"))


def within(ts: Column, start: str | None, end: str | None) -> Column:
    """Ingest filter, inclusive; rows without a time are kept."""
    good = F.lit(True)
    if start:
        good = good & (ts >= F.lit(start).cast("timestamp"))
    if end:
        good = good & (ts <= F.lit(end).cast("timestamp"))
    return ts.isNull() | good
