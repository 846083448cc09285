"""Column functions: milliseconds, range bounds, typed aggregates."""

from .aggregates import aggregate, typed_zero
from .time import in_range, milliseconds

__all__ = ["aggregate", "in_range", "milliseconds", "typed_zero"]
