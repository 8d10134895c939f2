"""Spark-native lakehouse operators for training logs and similar event data."""

from trainlake.session import apply_defaults, cut_lineage, get_session

__all__ = ["apply_defaults", "cut_lineage", "get_session"]
