"""Measurements that arrive as a stream."""
