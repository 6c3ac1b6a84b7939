"""Sun times per deployment and day, and the night flag."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nidalytics.functions.scalars import to_number
from nidalytics.functions.solar import POLAR_NIGHT, sun_times


def parse_coords(deployments: DataFrame) -> DataFrame:
    """Latitude and longitude as numbers, null when blank or unparseable."""
    return deployments.withColumns({c: to_number(F.col(c)) for c in ("latitude", "longitude")})


def sun_table(df: DataFrame, time: str, deployments: DataFrame, keys: Sequence[str] = ("deployment_id",)) -> DataFrame:
    """One row per key and UTC date of the data that has coordinates."""
    keys = list(keys)
    days = df.where(F.col(time).isNotNull()).select(*keys, F.to_date(F.col(time)).alias("date")).distinct()
    places = deployments.select(*keys, "latitude", "longitude").where(
        F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    )
    located = days.join(places, keys)
    return located.select(
        *keys,
        "date",
        *[c.alias(n) for n, c in sun_times(F.col("date"), F.col("latitude"), F.col("longitude")).items()],
    )


def mark_night(
    df: DataFrame,
    time: str,
    sun: DataFrame,
    keys: Sequence[str] = ("deployment_id",),
    out: str = "is_night",
    neighbours: bool = False,
) -> DataFrame:
    """Night is before sunrise or after sunset of the UTC date.

    Without coordinates nothing is night; in polar day nothing is, in polar night
    everything is. The join is on (key, date), which spreads a long deployment.
    Far from Greenwich daylight spans UTC midnight; ``neighbours`` also accepts the
    daylight of the day before and the day after.
    """
    t = F.col(time)
    if neighbours:
        sun = _with_neighbours(sun, list(keys))
        is_day = F.exists("windows", lambda w: t.between(w["sunrise"], w["sunset"]))
    else:
        is_day = t.between(F.col("sunrise"), F.col("sunset"))
    joined = df.withColumn("date", F.to_date(t)).join(sun, [*keys, "date"], "left")
    night = F.when(F.col("polar") == POLAR_NIGHT, True).otherwise(~F.coalesce(is_day, F.lit(True)))
    return joined.withColumn(out, t.isNotNull() & night).select(*[c for c in df.columns if c != out], out)


def _with_neighbours(sun: DataFrame, keys: list[str]) -> DataFrame:
    """Per date the daylight windows of that date and of the dates beside it (three at most)."""
    window = F.when(F.col("sunrise").isNotNull(), F.struct("sunrise", "sunset"))
    near = sun.withColumn("_for", F.explode(F.sequence(F.date_sub("date", 1), F.date_add("date", 1))))
    near = near.groupBy(*keys, F.col("_for").alias("date")).agg(F.collect_list(window).alias("windows"))
    return sun.select(*keys, "date", "polar").join(near, [*keys, "date"]).withColumn(
        "windows", F.when(F.size("windows") > 0, F.col("windows"))
    )
