"""Alignment of fields on time, limits for each field, and the order of results.

All fields of a query share rows or are aggregated by time in one grouping, so that lining them up takes one shuffle,
not a join for each field.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.aggregates import typed_zero
from .filters import Points

#: Limits up to this many rows are found for all fields at once: a task's window keeps no more rows of a field (rank limit).
HELD_TIMES = 10_000


def raw(points: Points, fields: list[str]) -> DataFrame:
    """One row for each time at which a field has a point: (ts_ms, v0.., n0..).

    Of the points of a field at one time, that of the last series by key counts, and of its writes the last: both are
    the greatest in one order, so one aggregate settles them.
    """
    values = [F.max_by(f"v{i}", F.when(F.col(f"v{i}").isNotNull(), points.order(i))).alias(f"v{i}") for i in range(len(fields))]
    here = [F.count(f"v{i}").alias(f"n{i}") for i in range(len(fields))]
    return points.dealt().groupBy("ts_ms").agg(*values, *here)


def limited(found: DataFrame, fields: list[str], limit: int) -> DataFrame:
    """The first ``limit`` rows by time of each field, lined up again.

    One field: a top-k, merged without a global sort. Several: one aggregate gives each field's last time within its limit
    (of its least times, ``limit`` at most are held for a field), which is joined back as one row.
    """
    if len(fields) == 1:
        return found.filter("n0 > 0").orderBy("ts_ms").limit(limit)
    every = range(len(fields))
    if limit > HELD_TIMES:
        tops = [found.filter(f"n{i} > 0").select("ts_ms").orderBy("ts_ms").limit(limit).agg(F.max("ts_ms").alias(f"last{i}")) for i in every]
        last = reduce(DataFrame.crossJoin, tops)  # each is one row
    else:
        times = found.select(F.explode(F.array_compact(F.array(*(F.when(F.col(f"n{i}") > 0, F.struct(F.lit(i).alias("i"), "ts_ms")) for i in every)))).alias("_x")).select("_x.*")
        first = times.withColumn("_place", F.row_number().over(Window.partitionBy("i").orderBy("ts_ms"))).filter(F.col("_place") <= limit)
        last = first.agg(*(F.max(F.when(F.col("i") == i, F.col("ts_ms"))).alias(f"last{i}") for i in every))
    here = [F.col("ts_ms") <= F.col(f"last{i}") for i in every]
    rows = found.join(F.broadcast(last)).filter(reduce(or_, (h & (F.col(f"n{i}") > 0) for i, h in enumerate(here))))
    values = [F.when(h, F.col(f"v{i}")).alias(f"v{i}") for i, h in enumerate(here)]
    return rows.select("ts_ms", *values, *(F.when(h, F.col(f"n{i}")).otherwise(0).alias(f"n{i}") for i, h in enumerate(here)))


def finished(found: DataFrame, fields: list[str], *, zero_fill: bool) -> DataFrame:
    """The fields under their names, ascending by time; null cells as zeros of their type where asked for."""

    def cell(i: int):
        value = F.col(f"v{i}")
        return F.coalesce(value, typed_zero(found.schema[f"v{i}"].dataType.simpleString())) if zero_fill else value

    return found.select("ts_ms", *(cell(i).alias(f) for i, f in enumerate(fields))).orderBy("ts_ms")
