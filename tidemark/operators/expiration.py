"""Which records go when space runs short."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: At most so many of the oldest records go in one run.
OLDEST = 25
#: Bytes that a record has besides its points; of its column header; of each point.
RECORD_HEADER, COLUMN_HEADER, POINT = 37, 8, 16


def record_bytes(n: str):
    """Bytes of a record of ``n`` points."""
    return F.lit(RECORD_HEADER + COLUMN_HEADER) + POINT * F.col(n)


def expired(records: DataFrame, target: float, start: str = "start_ms", size: str = "bytes", tie: str = "record_id") -> DataFrame:
    """The records to delete: oldest first among the 25 oldest, until their sizes reach ``target``.

    The window sees at most 25 rows.
    """
    oldest = records.orderBy(start, tie).limit(OLDEST)
    before = F.sum(size).over(Window.orderBy(start, tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(size)
    return oldest.withColumn("_before", before).filter(F.col("_before") < target).drop("_before")
