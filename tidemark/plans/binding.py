"""Any DataFrame as a measurement: tags, typed fields and millisecond times."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.time import milliseconds

#: Field types by what columns hold.
FIELD_TYPES = {
    T.DoubleType: "double", T.FloatType: "double", T.LongType: "bigint", T.IntegerType: "bigint",
    T.ShortType: "bigint", T.ByteType: "bigint", T.BooleanType: "boolean", T.StringType: "string",
}


@dataclass(frozen=True)
class SeriesBinding:
    """A DataFrame read as a measurement.

    ``ts_col`` holds milliseconds (long) or a timestamp with or without zone. ``seq_cols`` order writes: of the rows of
    a series at one time the last counts; without them rows are taken to be unique. ``series_col`` names a column with
    the series' key where there is one; else the key is the MD5 of measurement and tags. ``tag_map`` names a map column
    that holds the tags instead of ``tag_cols``. ``tasks``: over how many tasks rows are dealt before any are aggregated, where
    Spark's splits would hold too many of them; 0 leaves them as they are read.
    """

    df: DataFrame
    measurement: str
    ts_col: str
    tag_cols: Sequence[str] = ()
    field_cols: Sequence[str] = ()
    seq_cols: Sequence[str] = ()
    series_col: str | None = None
    tag_map: str | None = None
    tasks: int = 0

    def __post_init__(self) -> None:
        if not self.measurement:
            raise ValueError("a measurement needs a name")
        for name in self.field_cols:
            self.field_type(name)

    def field_type(self, name: str) -> str:
        kind = FIELD_TYPES.get(type(self.df.schema[name].dataType))
        if kind is None:
            raise ValueError(f"field {name} is {self.df.schema[name].dataType.simpleString()}: double, bigint, boolean or string are supported")
        return kind

    def value(self, name: str) -> Column:
        return F.col(f"`{name}`").cast(self.field_type(name))

    def ts_ms(self) -> Column:
        return milliseconds(self.df, self.ts_col)

    def has_tag(self, key: str) -> bool:
        return self.tag_map is not None or key in self.tag_cols

    def tag(self, key: str) -> Column:
        return F.col(self.tag_map)[key] if self.tag_map else F.col(f"`{key}`").cast("string")

    def series_key(self, name: str) -> Column:
        """The key that orders the series of one field."""
        if self.series_col:
            return F.col(self.series_col)
        if not self.tag_cols:
            return F.lit("")
        parts = [F.lit(self.measurement)]
        for key in self.tag_cols:
            parts += [F.lit(key), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))]
        return F.md5(F.concat_ws(":", *parts, F.lit(name)).cast("binary"))

    def seq(self) -> list[Column]:
        return [F.col(f"`{c}`") for c in self.seq_cols]
