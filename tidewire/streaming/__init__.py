"""Incremental forms of the daily tables."""
