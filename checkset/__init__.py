"""Queries over the test tables with an equivalent SQL text for each."""

from checkset import (  # noqa: F401  (the modules register their queries)
    job_checks,
    join_checks,
    key_checks,
    metric_checks,
    quality_checks,
    shape_checks,
    source_checks,
    text_checks,
    value_checks,
)
from checkset.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
