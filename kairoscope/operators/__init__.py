"""Operators over time-course tables."""
