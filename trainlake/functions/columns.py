"""Column arguments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(col: Column | str) -> Column:
    """A column given by name or as an expression."""
    return F.col(col) if isinstance(col, str) else col
