"""Humidity and wind as column expressions; temperatures in kelvin, pressures in pascal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def saturation_pressure(t: Column) -> Column:
    """Saturation vapour pressure over water."""
    return 611.2 * F.exp(17.67 * (t - 273.15) / (t - 29.65))


def specific_humidity(vapour: Column, pressure: Column) -> Column:
    """Specific humidity from vapour pressure."""
    return 0.622 * vapour / (pressure - 0.378 * vapour)


def humidity_from_dewpoint(dewpoint: Column, pressure: Column) -> Column:
    """Specific humidity from the dew point."""
    return specific_humidity(saturation_pressure(dewpoint), pressure)


def humidity_from_relative(relative: Column, t: Column, pressure: Column) -> Column:
    """Specific humidity from relative humidity in percent."""
    return specific_humidity(relative / 100.0 * saturation_pressure(t), pressure)


def relative_humidity(q: Column, t: Column, pressure: Column) -> Column:
    """Relative humidity in percent, from 0 to 100."""
    vapour = q * pressure / (0.622 + 0.378 * q)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 * vapour / saturation_pressure(t)))


def wind_speed(u: Column, v: Column) -> Column:
    """Wind speed from its components."""
    return F.sqrt(u * u + v * v)


def wind_from(u: Column, v: Column) -> Column:
    """The direction that the wind comes from."""
    return F.pmod(270.0 - F.degrees(F.atan2(v, u)), F.lit(360.0))


def components(speed: Column, direction: Column) -> tuple[Column, Column]:
    """The wind's components from its speed and direction."""
    angle = F.radians(direction)
    return -speed * F.sin(angle), -speed * F.cos(angle)
