"""Last write wins: of the points of a series at one time, the last written counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import Points


def last_writes(points: Points) -> Points:
    """One point for each series, time and field; rows that differ only in when they were written become one.

    Without a write order the rows are unique already. Series keys of fields differ only in the field's name, so the
    first field's key groups them all.
    """
    if not points.has_seq:
        return points
    fields = range(len(points.kinds))
    keys = ["ts_ms", *(["k0"] if points.has_series else [])]
    values = [F.max_by(f"v{i}", F.when(F.col(f"v{i}").isNotNull(), F.col("seq"))).alias(f"v{i}") for i in fields]
    others = [F.max(f"k{i}").alias(f"k{i}") for i in fields if i] if points.has_series else []
    df = points.dealt().groupBy(*keys).agg(*values, *others)
    return Points(df, points.kinds, False, points.has_series)


def newest(df: DataFrame, keys: list[str], seq: list[str]) -> DataFrame:
    """The row of each key that comes last by ``seq``, whole, by one aggregate."""
    rest = [c for c in df.columns if c not in keys]
    row = F.max_by(F.struct(*rest), F.struct(*seq)).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, "_row.*").select(*df.columns)
