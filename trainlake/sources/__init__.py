"""Readers, writers and the high-water-mark state."""
