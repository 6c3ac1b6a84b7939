"""Sunrise and sunset (UTC) from the published sunrise equation, as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the sunrise equation (degrees, days).
ANOMALY_0, ANOMALY_RATE = 357.5291, 0.98560028
CENTRE_1, CENTRE_2, CENTRE_3 = 1.9148, 0.02, 0.0003
PERIHELION, OBLIQUITY = 102.9372, 23.4397
TRANSIT_OFFSET, TRANSIT_SIN_M, TRANSIT_SIN_2L = 0.0009, 0.0053, -0.0069
HORIZON = -0.833
UNIX_DAY_OF_J2000 = 10957.5  # noon, 1 January 2000

POLAR_DAY, POLAR_NIGHT = "day", "night"


def sun_times(date: Column, latitude: Column, longitude: Column) -> dict[str, Column]:
    """Columns ``sunrise``, ``sunset`` (timestamps) and ``polar`` for a date and place.

    Where the sun does not cross the horizon both times are null and ``polar``
    says whether it stays up ("day") or down ("night").
    """
    rad = F.radians
    phi, west = rad(latitude), -rad(longitude)
    turn = F.lit(2 * math.pi)
    # days count from noon of 1 January 2000; whole dates map to their own noon
    days = F.unix_date(date) - F.lit(10957.0)
    cycle = F.round(days - TRANSIT_OFFSET - west / turn)
    approx = F.lit(TRANSIT_OFFSET) + west / turn + cycle
    m = rad(F.lit(ANOMALY_0) + F.lit(ANOMALY_RATE) * approx)
    centre = rad(CENTRE_1 * F.sin(m) + CENTRE_2 * F.sin(2 * m) + CENTRE_3 * F.sin(3 * m))
    lon = m + centre + rad(F.lit(PERIHELION)) + F.lit(math.pi)
    decl = F.asin(F.sin(lon) * F.sin(rad(F.lit(OBLIQUITY))))
    wobble = TRANSIT_SIN_M * F.sin(m) + TRANSIT_SIN_2L * F.sin(2 * lon)
    noon = approx + wobble
    ratio = (F.sin(rad(F.lit(HORIZON))) - F.sin(phi) * F.sin(decl)) / (F.cos(phi) * F.cos(decl))
    crosses = (ratio >= -1) & (ratio <= 1)
    angle = F.when(crosses, F.acos(ratio))
    down = F.lit(TRANSIT_OFFSET) + (angle + west) / turn + cycle + wobble
    up = 2 * noon - down
    return {
        "sunrise": _timestamp(up),
        "sunset": _timestamp(down),
        "polar": F.when(ratio > 1, POLAR_NIGHT).when(ratio < -1, POLAR_DAY),
    }


def _timestamp(days: Column) -> Column:
    return F.timestamp_seconds(F.floor((days + F.lit(UNIX_DAY_OF_J2000)) * F.lit(86400.0)))
