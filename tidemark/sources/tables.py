"""Parquet datasets as measurements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession

from ..plans.binding import SeriesBinding


def bind_parquet(spark: SparkSession, path: str, measurement: str, ts_col: str, *, tags: Sequence[str] = (), fields: Sequence[str] = (), seq: Sequence[str] = ()) -> SeriesBinding:
    """A Parquet dataset bound as a measurement; scans read the columns and row groups that a query needs."""
    return SeriesBinding(spark.read.parquet(path), measurement, ts_col, tags, fields, seq)
