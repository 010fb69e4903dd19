"""Composed panels and the registered queries."""
