"""Time-series analytics on Spark DataFrames."""

from .plans import Aggregate, Query, SeriesBinding, parse_query_string, plan

__all__ = ["Aggregate", "Query", "SeriesBinding", "parse_query_string", "plan"]
