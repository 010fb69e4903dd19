"""Readers, guards, merges and sinks."""
