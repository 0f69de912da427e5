"""Counts taken by Spark while it writes something else."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import Column


def observe(rows: DataFrame, **counts: Column) -> tuple[DataFrame, Observation]:
    seen = Observation()
    return rows.observe(seen, *[c.alias(name) for name, c in counts.items()]), seen


def counted(seen: Observation) -> dict[str, int]:
    """What was seen, once the rows were written. A plan that was found to have no rows before it ran has seen nothing: {}."""
    row = seen._jo.getRow()
    return dict(seen.get) if row.length() else {}
