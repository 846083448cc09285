"""From a query over a binding to one lazy DataFrame: (ts_ms, a column for each field), ascending by ts_ms."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import align, filters, rollup
from .binding import SeriesBinding
from .query import Query


def resolved_fields(query: Query, binding: SeriesBinding) -> list[str]:
    """The fields that the query returns: those asked for that exist, or all in the binding's order."""
    if not query.fields:
        return list(binding.field_cols)
    return [f for f in query.fields if f in set(binding.field_cols)]


def plan(query: Query, binding: SeriesBinding) -> DataFrame:
    """The query's result. Another measurement, or no field that exists, gives no rows and only ts_ms."""
    fields = resolved_fields(query, binding)
    known = query.measurement == binding.measurement and fields
    if not known:
        return binding.df.sparkSession.createDataFrame([], "ts_ms bigint")
    rows = filters.selected(binding, fields, query)
    found = rollup.rolled_up(rows, fields, query) if query.rollup_interval else align.raw(rows, fields)
    if query.limit:
        found = align.limited(found, fields, query.limit)
    return align.finished(found, fields, zero_fill=query.zero_fill)
