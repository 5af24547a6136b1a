"""F10 duration text and F29 metric log text as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairlake.functions.util import col


def utc_instant(df, column: str) -> Column:
    """``column`` as an instant (TIMESTAMP), reading a TIMESTAMP_NTZ value as
    UTC wall-clock time whatever the session time zone is (a plain cast would
    apply the session zone)."""
    if df.schema[column].dataType.typeName() == "timestamp_ntz":
        text = F.concat(F.date_format(F.col(column), "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("Z"))
        return F.to_timestamp(text, "yyyy-MM-dd HH:mm:ss.SSSSSSX")
    return F.col(column).cast("timestamp")


def epoch_seconds(df, column: str) -> Column:
    """Whole seconds since 1970-01-01 UTC (NTZ values read as UTC)."""
    return F.unix_seconds(utc_instant(df, column))


def _seconds(x) -> Column:
    return F.rint(col(x).cast("double")).cast("long")


def format_time(seconds) -> Column:
    """``12s`` / ``3m 04s`` / ``2h 03m 04s`` / ``1d 02h 03m`` (half-even rounding)."""
    s = _seconds(seconds)
    return (F.when(s < 60, F.format_string("%ds", s))
            .when(s < 3600, F.format_string("%dm %02ds", F.floor(s / 60), s % 60))
            .when(s < 86400, F.format_string("%dh %02dm %02ds", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60))
            .otherwise(F.format_string("%dd %02dh %02dm", F.floor(s / 86400), F.floor(s / 3600) % 24,
                                       F.floor(s / 60) % 60)))


def format_time_brief(seconds) -> Column:
    """Two units at most: ``12s`` / ``3m 04s`` / ``2h 03m`` / ``1d 02h``."""
    s = _seconds(seconds)
    return (F.when(s < 60, F.format_string("%ds", s))
            .when(s < 3600, F.format_string("%dm %02ds", F.floor(s / 60), s % 60))
            .when(s < 86400, F.format_string("%dh %02dm", F.floor(s / 3600), F.floor(s / 60) % 60))
            .otherwise(F.format_string("%dd %02dh", F.floor(s / 86400), F.floor(s / 3600) % 24)))


def log_metric_text(metrics) -> Column:
    """``key: value`` pairs with 6 decimals joined by ', ' from an array of
    struct(key, value) (in the given order)."""
    return F.array_join(F.transform(col(metrics), lambda m: F.format_string("%s: %.6f", m["key"], m["value"])),
                        ", ")
