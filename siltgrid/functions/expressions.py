"""Column expressions shared by queries and operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def decibels(power: Column, floor: float = 1e-12) -> Column:
    """10 log10 of a power; null where it is not positive."""
    return F.when(power > 0, 10 * F.log10(F.greatest(power, F.lit(floor))))


def close(a: Column, b: Column, absolute: float, relative: float) -> Column:
    return F.abs(a - b) <= absolute + relative * F.abs(b)


def flags(*conditions: Column) -> Column:
    """An integer with bit k set where condition k holds."""
    out = F.lit(0)
    for k, c in enumerate(conditions):
        out = out + F.when(c, 1 << k).otherwise(0)
    return out


def slant(sigma: Column, incidence_degrees: Column) -> Column:
    """Gamma from sigma nought."""
    return sigma / F.cos(F.radians(incidence_degrees))
