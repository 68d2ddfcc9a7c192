"""Operators on training text; nothing outside this subpackage imports it."""
