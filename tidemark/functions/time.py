"""Times as milliseconds, and range predicates that Parquet scans can use."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EPOCH = dt.datetime(1970, 1, 1)


def milliseconds(df: DataFrame, name: str) -> Column:
    """A time column as milliseconds since 1970, rounded down. Times without zone are read in the session's zone (use UTC)."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_millis(F.col(f"`{name}`").cast("timestamp"))
    return F.col(f"`{name}`").cast("bigint")


def _bound(kind: T.DataType, ms: int) -> Column:
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        text = (_EPOCH + dt.timedelta(milliseconds=ms)).isoformat(sep=" ", timespec="milliseconds")
        return F.expr(f"TIMESTAMP_NTZ '{text}'" if isinstance(kind, T.TimestampNTZType) else f"TIMESTAMP '{text}'")
    return F.lit(ms)


def in_range(df: DataFrame, name: str, start_ms: int, end_ms: int) -> Column | None:
    """``start_ms <= time <= end_ms`` on the raw column, so that scans prune by it; 0 or less leaves a side open."""
    kind, tests = df.schema[name].dataType, []
    if start_ms > 0:
        tests.append(F.col(f"`{name}`") >= _bound(kind, start_ms))
    if end_ms > 0:
        tests.append(F.col(f"`{name}`") < _bound(kind, end_ms + 1))
    if not tests:
        return None
    return tests[0] if len(tests) == 1 else tests[0] & tests[1]
