"""Tumbling windows anchored at each field's first selected point, with one aggregate.

The anchors of all fields come from one aggregate of one row, which is joined back by broadcast. A row belongs to the
window of each field that has a value in it; where fields share an anchor that is one window, so the row isn't
repeated. Windows without points don't appear.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import aggregate
from .dedup import last_writes
from .filters import Points

if TYPE_CHECKING:
    from ..plans.query import Query


def anchors(points: Points) -> DataFrame:
    """One row: a0.., the time of the first point of each field."""
    return points.df.agg(*(F.min(F.when(F.col(f"v{i}").isNotNull(), F.col("ts_ms"))).alias(f"a{i}") for i in range(len(points.kinds))))


def rolled_up(points: Points, fields: list[str], query: Query) -> DataFrame:
    """(ts_ms, v0.., n0..): a row for each window start, the aggregates and numbers of points."""
    width, every = int(query.rollup_interval), range(len(fields))
    first = anchors(points)
    rows = last_writes(points)
    df = rows.df.join(F.broadcast(first))
    starts = [F.when(F.col(f"v{i}").isNotNull(), F.expr(f"a{i} + ((ts_ms - a{i}) div {width}L) * {width}L")).alias(f"w{i}") for i in every]
    df = df.select("*", *starts)
    if len(fields) == 1:
        df = df.withColumn("_window", F.col("w0"))
    else:
        df = df.withColumn("_window", F.explode(F.array_distinct(F.array_compact(F.array(*(f"w{i}" for i in every))))))
    inside = [F.when(F.col(f"w{i}") == F.col("_window"), F.col(f"v{i}")) for i in every]
    values = [aggregate(query.method, rows.kinds[i], inside[i], rows.order(i, "ts_ms")).alias(f"v{i}") for i in every]
    counts = [F.count(inside[i]).alias(f"n{i}") for i in every]
    return df.groupBy(F.col("_window").alias("ts_ms")).agg(*values, *counts)
