"""Rectangle predicates on ``[x0, y0, x1, y1]`` arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _extent(low: Column, high: Column) -> Column:
    return F.greatest(F.lit(0.0), high - low)


def covered_fraction(first: Column, second: Column) -> Column:
    """Share of ``first`` covered by ``second``; 0 when either is missing or degenerate."""
    a = [F.get(first, F.lit(i)) for i in range(4)]
    b = [F.get(second, F.lit(i)) for i in range(4)]
    area = _extent(a[0], a[2]) * _extent(a[1], a[3])
    shared = _extent(F.greatest(a[0], b[0]), F.least(a[2], b[2])) * _extent(
        F.greatest(a[1], b[1]), F.least(a[3], b[3])
    )
    proper = (F.size(first) == 4) & (F.size(second) == 4) & (area > 0)
    return F.coalesce(F.when(proper, shared / area), F.lit(0.0))


def covered_by_any(box: Column, regions: Column, at_least: float) -> Column:
    """True when some region covers the box by at least the given share."""
    return F.coalesce(
        F.exists(regions, lambda r: covered_fraction(box, r) >= at_least), F.lit(False)
    )
