"""Query descriptors, bindings of DataFrames as measurements, and the planner that turns one over the other into a DataFrame."""

from .binding import SeriesBinding
from .planner import plan
from .query import Aggregate, Query, parse_query_string

__all__ = ["Aggregate", "Query", "SeriesBinding", "parse_query_string", "plan"]
