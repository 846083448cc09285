"""The public face: one object with the operations of an embedded time-series database, on a Spark session."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark.sql import DataFrame, Row, SparkSession

from .plans.query import Query, parse_query_string
from .sources.store import Store

#: Defaults of expiration: share of the capacity from which it acts, share that it frees.
EXPIRE_AT, EXPIRE_SHARE = 0.5, 0.05


class Engine:
    """A database at ``root``. Results are lazy DataFrames; changes take effect when the call returns."""

    def __init__(self, spark: SparkSession, root: str, *, capacity_bytes: int = 1 << 40):
        self.spark = spark
        self.store = Store(spark, root, capacity_bytes=capacity_bytes)
        self._pool: ThreadPoolExecutor | None = None

    def init(self) -> bool:
        """Open; opening again changes nothing. From now on inserts that fill a level start its compaction in the background."""
        if self._pool is None:
            self._pool = ThreadPoolExecutor(1, thread_name_prefix="compaction")
            self.store.on_full = self.compact
        return True

    def deinit(self) -> None:
        """Wait for a running compaction and close."""
        if self._pool:
            self._pool.shutdown(wait=True)
        self._pool = self.store.on_full = None

    # writing
    def insert(self, measurement: str, points: DataFrame | Sequence[Mapping], *, schema: str | None = None, ts_col: str = "ts_ms", tags: Mapping[str, str] | None = None, tag_cols: Sequence[str] = (), fields: Sequence[str] | None = None) -> bool:
        """Append points from a DataFrame, or from rows with a schema. No rows is success."""
        if not isinstance(points, DataFrame):
            if not points:
                return True
            # one partition keeps the rows' order, by which later ones win
            points = self.spark.createDataFrame([Row(**r) for r in points] if schema is None else points, schema).coalesce(1)
        return self.store.insert(measurement, points, ts_col=ts_col, tags=tags, tag_cols=tag_cols, fields=fields)

    def set_chunk_size(self, n: int) -> None:
        self.store.set_chunk_size(n)

    def clear_all(self) -> bool:
        return self.store.clear_all()

    # reading
    def query(self, query: Query) -> DataFrame:
        return self.store.query(query)

    def query_string(self, text: str, **settings) -> DataFrame:
        return self.store.query(parse_query_string(text, **settings))

    # maintenance
    def compact(self) -> Future:
        """Compact in the background."""
        self.init()
        return self._pool.submit(self.store.compact)

    def compact_sync(self) -> bool:
        return self.store.compact()

    def compact_force_sync(self) -> bool:
        return self.store.compact(force=True)

    def expire(self) -> int:
        return self.store.expire(EXPIRE_AT, EXPIRE_SHARE)

    def delete_measurement(self, measurement: str) -> bool:
        return self.store.delete_measurement(measurement)

    def delete_measurement_and_field(self, measurement: str, field: str) -> bool:
        return self.store.delete_field(measurement, field)

    # catalogue
    def get_measurements(self) -> DataFrame:
        return self.store.measurements()

    def get_fields_for_measurement(self, measurement: str) -> DataFrame:
        return self.store.fields(measurement)

    def get_tags_for_measurement(self, measurement: str) -> DataFrame:
        return self.store.tags(measurement)

    def get_timestamp_range(self, measurement: str) -> DataFrame:
        return self.store.timestamp_range(measurement)

    def get_usage_summary(self) -> dict:
        return self.store.usage_summary()
