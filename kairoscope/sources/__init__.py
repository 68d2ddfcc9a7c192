"""Readers, and the driver's tables seen as time-course data."""
