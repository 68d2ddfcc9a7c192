"""kairoscope: a PySpark-native engine for replicated time-course data."""

__version__ = "0.1.0"
