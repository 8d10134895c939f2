"""Incremental loads, as a batch with a high-water mark and as a stream."""
