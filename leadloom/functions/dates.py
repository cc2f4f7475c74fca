"""Dates and times in UTC, as column expressions. The current time is always a parameter."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def moment(now: datetime | str) -> Column:
    return F.lit(str(now)).cast("timestamp")


def overnight(ts: Column) -> Column:
    return F.hour(ts).between(0, 5)


def epoch_date(seconds: Column) -> Column:
    return F.to_date(F.timestamp_seconds(seconds))


def age_hours(ts: Column, now: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(ts)) / F.lit(3.6e9)


def posting_date(x: Column) -> Column:
    """ISO texts stay; numbers of seconds after 1e9 become ISO texts; others stay."""
    seconds = x.try_cast("double")
    iso = F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return F.when(F.contains(x, F.lit("T")), x).when(seconds > 1e9, iso).otherwise(x)
