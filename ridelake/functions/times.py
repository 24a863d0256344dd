"""Moments in milliseconds as text, in UTC whatever the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utc(ms: str) -> Column:
    """A column of milliseconds as a timestamp without zone."""
    return F.expr(f"TIMESTAMP_NTZ'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast({ms} AS decimal(18, 3)) / 1000)")


def rfc3339(ms: str) -> Column:
    return F.date_format(utc(ms), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def hour(ms: str) -> Column:
    """The hour that names a trip file: ``2024-01-31T17``."""
    return F.date_format(utc(ms), "yyyy-MM-dd'T'HH")
