"""Angles in degrees as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def separation(a: Column, b: Column) -> Column:
    """The smaller angle between two directions, 0 to 180."""
    turn = F.pmod(a - b, F.lit(360.0))
    return F.least(turn, 360.0 - turn)


def wrapped(step: Column) -> Column:
    """A change of direction, from -180 up to but without 180."""
    return F.pmod(step + 180.0, F.lit(360.0)) - 180.0


def heading(east: Column, north: Column) -> Column:
    """The direction of a mean vector (mean sine, mean cosine), 0 to 360."""
    return F.pmod(F.degrees(F.atan2(east, north)), F.lit(360.0))


def deviation(resultant: Column) -> Column:
    """The circular standard deviation that belongs to a mean vector's length."""
    return F.degrees(F.sqrt(-2.0 * F.ln(F.greatest(F.lit(1e-12), F.least(F.lit(1.0), resultant)))))
