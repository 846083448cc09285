"""What a set of bindings holds: measurements, fields, tags, times."""

from __future__ import annotations

from functools import reduce
from operator import add
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from ..plans.binding import SeriesBinding


def measurements(spark: SparkSession, bindings: list[SeriesBinding]) -> DataFrame:
    """(measurement): the distinct names."""
    return spark.createDataFrame([(n,) for n in dict.fromkeys(b.measurement for b in bindings)], "measurement string")


def fields(binding: SeriesBinding) -> DataFrame:
    """(field, type) in the binding's order."""
    rows = [(f, binding.field_type(f)) for f in binding.field_cols]
    return binding.df.sparkSession.createDataFrame(rows, "field string, type string")


def tags(binding: SeriesBinding) -> DataFrame:
    """(key, value): the distinct tag pairs. Rows are reduced to distinct tag sets before they are unfolded."""
    if binding.tag_map:
        pairs = binding.df.select(F.explode(F.map_entries(binding.tag_map)).alias("_p")).select("_p.*")
        return pairs.distinct()
    if not binding.tag_cols:
        return binding.df.sparkSession.createDataFrame([], "key string, value string")
    sets = binding.df.select(*(binding.tag(k).alias(k) for k in binding.tag_cols)).distinct()
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), F.col(f"`{k}`").alias("value")) for k in binding.tag_cols))
    return sets.select(F.explode(pairs).alias("_p")).select("_p.*").filter("value IS NOT NULL").distinct()


def timestamp_range(binding: SeriesBinding) -> DataFrame:
    """One row (min_ms, max_ms, points): points are counted for each field."""
    ms = binding.ts_ms()
    points = reduce(add, [F.count(f"`{f}`") for f in binding.field_cols], F.lit(0).cast("bigint"))
    return binding.df.agg(F.min(ms).alias("min_ms"), F.max(ms).alias("max_ms"), points.alias("points"))
