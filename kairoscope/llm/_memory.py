"""Memory that a Python process has freed goes back to the machine."""

from __future__ import annotations

import ctypes
import time

import pyarrow as pa

EVERY = 0.5
_last = 0.0


def give_back(every: float = EVERY) -> None:
    """Hand freed pages back, every half second at most: workers live on from stage to stage and would keep the most that any batch took."""
    global _last
    now = time.monotonic()
    if now - _last < every:
        return
    _last = now
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
