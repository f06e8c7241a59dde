"""Small column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact_sum(col: Column | str, scale: int = 9) -> Column:
    """Sum in decimal, to nine places: the result does not depend on how the rows were partitioned. Holds values below 10^19."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.sum(c.cast(f"decimal(28,{scale})")), F.lit(0)).cast("double")


def ratio(top: Column, bottom: Column, default: float | None = 0.0) -> Column:
    """top / bottom with a default for an empty or zero denominator."""
    out = F.try_divide(top.cast("double"), bottom.cast("double"))
    return out if default is None else F.coalesce(out, F.lit(default))


def falsy(col: str, default: Column) -> Column:
    """Empty string and NULL both give the default."""
    return F.coalesce(F.nullif(F.col(col), F.lit("")), default)


def seconds_between(later: Column, earlier: Column) -> Column:
    return F.timestamp_diff("SECOND", earlier, later)
