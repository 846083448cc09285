"""Selection of a query's points: tags, range and fields, all before the first shuffle."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.time import in_range

if TYPE_CHECKING:
    from ..plans.binding import SeriesBinding
    from ..plans.query import Query


@dataclass(frozen=True)
class Points:
    """Selected rows: ``ts_ms``, ``v0..`` a value column for each field, ``k0..`` its series key, ``seq`` the write order (or none)."""

    df: DataFrame
    kinds: tuple[str, ...]
    has_seq: bool
    has_series: bool
    tasks: int = 0

    def dealt(self) -> DataFrame:
        """The rows by time and series over ``tasks`` tasks; their aggregate by these then takes no further shuffle."""
        return self.df.repartition(self.tasks, "ts_ms", *(["k0"] if self.has_series else [])) if self.tasks else self.df

    def order(self, i: int, *first: str) -> Column:
        """A total order of the i-th field's points: ``first``, then series, then writes."""
        parts = [F.col(c) for c in first] + ([F.col(f"k{i}")] if self.has_series else []) + ([F.col("seq")] if self.has_seq else [])
        return F.struct(*(parts or [F.lit(0)]))


def tag_test(binding: SeriesBinding, tags: tuple[tuple[str, str], ...]) -> Column | None:
    """All equalities; a tag that the measurement doesn't have matches nothing."""
    tests = [binding.tag(k) == v if binding.has_tag(k) else F.lit(False) for k, v in tags]
    return reduce(and_, tests) if tests else None


def selected(binding: SeriesBinding, fields: list[str], query: Query) -> Points:
    """The points of ``fields`` that the query's tags and range let through; columns nothing needs are not read."""
    df = binding.df
    for test in (tag_test(binding, query.tags), in_range(df, binding.ts_col, query.start_ms, query.end_ms)):
        df = df if test is None else df.filter(test)
    if query.start_ms > 0 and query.end_ms > 0 and query.start_ms > query.end_ms:
        df = df.filter(F.lit(False))
    df = df.filter(reduce(or_, [F.col(f"`{f}`").isNotNull() for f in fields]) & F.col(f"`{binding.ts_col}`").isNotNull())
    has_series = bool(binding.tag_cols or binding.series_col or binding.tag_map)
    columns = [binding.ts_ms().alias("ts_ms"), *(binding.value(f).alias(f"v{i}") for i, f in enumerate(fields))]
    if has_series:
        columns += [binding.series_key(f).alias(f"k{i}") for i, f in enumerate(fields)]
    if binding.seq_cols:
        columns.append(F.struct(*binding.seq()).alias("seq"))
    return Points(df.select(*columns), tuple(map(binding.field_type, fields)), bool(binding.seq_cols), has_series, binding.tasks)
