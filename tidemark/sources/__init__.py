"""Where points live: Parquet files bound as measurements, and the mutable Parquet store."""

from .store import Store
from .tables import bind_parquet

__all__ = ["Store", "bind_parquet"]
