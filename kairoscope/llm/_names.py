"""Column names that a table doesn't have yet."""

from __future__ import annotations

from pyspark.sql import DataFrame


def fresh(frame: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores behind it as it takes not to be a column of ``frame`` (in any case)."""
    held, out = {c.lower() for c in frame.columns}, []
    for name in names:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out
