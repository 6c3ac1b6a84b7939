"""Feeds of the report views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nidalytics.functions.scalars import sentence_case, title_case
from nidalytics.operators.classify import ABSENT, PRESENT, UNCERTAIN
from nidalytics.operators.clean import boot_times
from nidalytics.operators.correct import inside_trim
from nidalytics.plans.ordered import BLOCK, Ordering, running

MAX_POINTS = 8000
MINUTE = "yyyy-MM-dd HH:mm"


def downsample(df: DataFrame, o: Ordering, max_points: int = MAX_POINTS) -> DataFrame:
    """Evenly spaced rows per key, first and last included; short series are unchanged.

    Row j of the sample is row round(1 + j (n-1) / (max-1)), halves to even, of the
    series. Whether a row is in the sample is decided from its own number, so the
    wanted numbers need not be listed or joined.
    """
    if max_points < 2:
        raise ValueError("max_points must be at least 2")
    numbered = running(df, o, position="_pos").drop(BLOCK)
    totals = df.groupBy(*o.keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > max_points)
    joined = numbered.join(totals, list(o.keys), "left")
    step = (F.col("_n") - 1) / F.lit(float(max_points - 1))
    nearest = F.round((F.col("_pos") - 1) / step)
    hit = F.lit(False)
    for j in (nearest - 1, nearest, nearest + 1):
        hit = hit | (j.between(0, max_points - 1) & (F.bround(1 + j * step) == F.col("_pos")))
    return joined.where(F.col("_n").isNull() | hit).select(*[c for c in df.columns if c != BLOCK])


def overview_series(df: DataFrame, o: Ordering, value: str = "tof_smooth_r", max_points: int = MAX_POINTS) -> DataFrame:
    """Valid smoothed readings, sampled for display."""
    valid = df.where(~F.col("flag_tof_invalid") & F.col(o.time).isNotNull() & F.col(value).isNotNull())
    return downsample(valid.select(*o.row_id, value), o, max_points)


def overview_intervals(bout_table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Absent and uncertain bouts as intervals to shade."""
    return bout_table.where(
        F.col("state_corrected").isin(ABSENT, UNCERTAIN) & F.col("bout_start").isNotNull()
    ).select(*keys, F.col("bout_start").alias("from"), F.col("bout_end").alias("to"), F.col("state_corrected").alias("state"))


def reboot_events(log: DataFrame, keys: Sequence[str], time: str = "timestamp", event: str = "event") -> DataFrame:
    return boot_times(log, time, event).select(*keys, time)


def state_label(state: Column, in_trim: Column) -> Column:
    return F.when(in_trim, title_case(F.coalesce(state, F.lit("unclassified")))).otherwise("Outside trim")


def day_points(
    df: DataFrame,
    o: Ordering,
    deployments: DataFrame,
    date: Column | None = None,
    value: str = "tof_smooth_r",
    state: str = "state_corrected",
    max_points: int | None = MAX_POINTS,
) -> DataFrame:
    """Valid points with a display label, sampled per day; one day, or every day."""
    t = F.col(o.time)
    rows = df.where(~F.col("flag_tof_invalid") & F.col(value).isNotNull() & t.isNotNull())
    rows = rows.withColumn("date", F.to_date(t))
    if date is not None:
        rows = rows.where(F.col("date") == date)
    bounds = deployments.select(*o.keys, "trim_start", "trim_end")
    labelled = rows.join(bounds, list(o.keys), "left").withColumn(
        "state_label", state_label(F.col(state), inside_trim(t))
    )
    points = labelled.select(*o.row_id, "date", value, "state_label")
    return downsample(points, o.within("date"), max_points) if max_points else points


def climate_series(
    dht: DataFrame, o: Ordering, inside: str, outside: str, max_points: int = MAX_POINTS
) -> DataFrame:
    """One pair of climate channels, where the inside channel is present, sampled."""
    rows = dht.where(F.col(inside).isNotNull() & F.col(o.time).isNotNull())
    return downsample(rows.select(*dict.fromkeys([*o.row_id, inside, outside])), o, max_points)


def bout_report(bout_table: DataFrame, keys: Sequence[str], digits: int | None = 1) -> DataFrame:
    minutes = F.col("bout_duration") / 60
    mean = F.col("mean_tof_mm")
    return bout_table.select(
        *keys,
        F.col("bout_id").cast("int").alias("bout_id"),
        title_case(F.col("state_corrected")).alias("state"),
        F.date_format("bout_start", MINUTE).alias("start"),
        F.date_format("bout_end", MINUTE).alias("end"),
        (minutes if digits is None else F.round(minutes, digits)).alias("duration_min"),
        F.col("n_readings").cast("int").alias("n_readings"),
        (mean if digits is None else F.round(mean, digits)).alias("mean_tof_mm"),
        "flag_short",
    )


def bout_timeline(bout_table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bouts with a numeric level per state and a hover text."""
    s = F.col("state_corrected")
    minutes = F.regexp_replace(F.format_string("%.1f", F.col("bout_duration") / 60), r"\.0$", "")
    return bout_table.where(s.isNotNull()).select(
        *keys,
        "bout_id",
        "bout_start",
        "bout_end",
        F.when(s == PRESENT, 0).when(s == UNCERTAIN, 1).when(s == ABSENT, 2).alias("state_y"),
        F.concat(
            title_case(s),
            F.lit("<br>"),
            F.date_format("bout_start", "HH:mm"),
            F.lit(" – "),
            F.date_format("bout_end", "HH:mm"),
            F.lit("<br>"),
            minutes,
            F.lit(" min"),
        ).alias("hover_text"),
    )


def transitions(bout_table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct bout starts except the first bout's."""
    return bout_table.where(F.col("bout_id") > 1).select(*keys, F.col("bout_start").alias("transition")).distinct()


def device_report(device: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Device summary as Metric / Value rows."""
    stamps = [f.name for f in device.schema.fields if f.dataType.typeName().startswith("timestamp")]
    values = [c for c in device.columns if c not in keys]
    text = device.select(
        *keys,
        *[
            (F.date_format(c, MINUTE) if c in stamps else F.col(c).cast("string")).alias(c)
            for c in values
        ],
    )
    pairs = F.array(*[F.struct(F.lit(c).alias("Metric"), F.col(c).alias("Value")) for c in values])
    long = text.select(*keys, F.inline(pairs))
    return long.withColumn("Metric", sentence_case(F.col("Metric")))


def day_report(day: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The day table's display columns; sun columns when present."""
    wanted = [
        "date", "sunrise", "sunset", "day_length_h", "first_off_start", "last_off_end", "prop_on_nest",
        "prop_off_nest", "prop_uncertain", "n_on_bouts", "n_off_bouts", "mean_on_bout_min", "mean_off_bout_min",
    ]
    return day.select(*keys, *[c for c in wanted if c in day.columns])
