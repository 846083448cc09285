"""Rollup aggregates by method and field type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.query import Aggregate

#: What a missing cell becomes under zero_fill.
_ZEROS = {"double": 0.0, "bigint": 0, "int": 0, "boolean": False, "string": ""}


def typed_zero(kind: str) -> Column:
    return F.lit(_ZEROS[kind])


def _number(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def aggregate(method: Aggregate, kind: str, value: Column, order: Column) -> Column:
    """The aggregate of a field of type ``kind``; ``order`` ranks its points for LAST.

    Doubles: NaN never is a minimum or maximum. Longs: averages are rounded as (2 sum + n) / 2n towards zero. Booleans:
    and, or, majority; sums count what is true. Strings: only COUNT and LAST say something; MIN and MAX are null, AVG
    and SUM 0.0.
    """
    if method in (Aggregate.NONE, Aggregate.SUM):
        method = Aggregate.SUM
    if method is Aggregate.COUNT:
        return F.count(value)
    if method is Aggregate.LAST:
        return F.max_by(value, F.when(value.isNotNull(), order))
    if kind == "string":
        return F.max(F.lit(None).cast("double")) if method in (Aggregate.MIN, Aggregate.MAX) else F.max(F.when(value.isNotNull(), F.lit(0.0)))
    if kind == "boolean":
        truth = value.cast("bigint")
        return {
            Aggregate.MIN: F.bool_and(value),
            Aggregate.MAX: F.bool_or(value),
            Aggregate.AVG: F.avg(truth) > 0.5,
            Aggregate.SUM: F.sum(truth),
        }[method]
    if kind == "bigint":
        n = F.count(value)
        total = F.sum(value.cast("decimal(19,0)"))  # sums of longs may be beyond longs, averages never are
        rounded = F.when(n > 0, F.call_function("div", 2 * total + n, (2 * F.greatest(n, F.lit(1))).cast("decimal(20,0)")))
        return {Aggregate.MIN: F.min(value), Aggregate.MAX: F.max(value), Aggregate.AVG: rounded, Aggregate.SUM: F.sum(value)}[method]
    return {Aggregate.MIN: F.min(_number(value)), Aggregate.MAX: F.max(_number(value)), Aggregate.AVG: F.avg(value), Aggregate.SUM: F.sum(value)}[method]
