"""Daily and deployment summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nidalytics.functions.solar import POLAR_DAY, POLAR_NIGHT
from nidalytics.operators.classify import ABSENT, PRESENT, UNCERTAIN
from nidalytics.operators.clean import BOOT_EVENT, DOWNTIME_SEC
from nidalytics.plans.ordered import micros

DAY_SEC = 86400.0


def in_daylight(time: Column) -> Column:
    """Between sunrise and sunset (inclusive); always in polar day, never in polar night."""
    return F.coalesce(time.between(F.col("sunrise"), F.col("sunset")), F.col("polar") == POLAR_DAY, F.lit(False))


def active_bouts(bout_table: DataFrame, sun: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bouts that start in the daylight of their UTC start date."""
    keys = list(keys)
    dated = bout_table.withColumn("date", F.to_date("bout_start"))
    joined = dated.join(sun.select(*keys, "date", "sunrise", "sunset", "polar"), [*keys, "date"])
    return joined.where(in_daylight(F.col("bout_start"))).select(*bout_table.columns, "date")


def split_at_midnight(bout_table: DataFrame) -> DataFrame:
    """Cut bouts at UTC midnights, so that each piece counts on its own day."""
    day = F.explode(F.sequence(F.to_date("bout_start"), F.to_date("bout_end")))
    pieces = bout_table.withColumn("_day", day).withColumns(
        {
            "_start": F.greatest("bout_start", F.col("_day").cast("timestamp")),
            "_end": F.least("bout_end", F.date_add("_day", 1).cast("timestamp")),
        }
    )
    # a bout that ends at midnight has nothing on the next day
    real = (F.col("_start") < F.col("_end")) | (F.col("_start") == F.col("bout_start"))
    return (
        pieces.where(real)
        .withColumns(
            {
                "bout_start": F.col("_start"),
                "bout_end": F.col("_end"),
                "bout_duration": (micros("_end") - micros("_start")) / F.lit(1e6),
            }
        )
        .select(*bout_table.columns)
    )


def _dated(bout_table: DataFrame) -> DataFrame:
    return bout_table if "date" in bout_table.columns else bout_table.withColumn("date", F.to_date("bout_start"))


def _state_aggregates(state: str, name: str, counted: Column) -> list[Column]:
    of = F.col("state_corrected") == state
    return [
        F.count_if(of & counted).alias(f"n_{name}_bouts"),
        F.coalesce(F.sum(F.when(of, F.col("bout_duration"))), F.lit(0.0)).alias(f"sum_{name}_sec"),
        F.coalesce(F.sum(F.when(of & counted, F.col("bout_duration"))), F.lit(0.0)).alias(f"_counted_{name}_sec"),
    ]


def _off_aggregates() -> list[Column]:
    off = F.col("state_corrected") == ABSENT
    return [
        F.date_format(F.min(F.when(off, F.col("bout_start"))), "HH:mm").alias("first_off_start"),
        F.date_format(F.max(F.when(off, F.col("bout_end"))), "HH:mm").alias("last_off_end"),
    ]


def state_day_stats(bout_table: DataFrame, keys: Sequence[str], exclude_short: bool = False) -> DataFrame:
    """Bouts and summed seconds per day and state, in one aggregation."""
    counted = ~F.col("flag_short") if exclude_short else F.lit(True)
    aggs = [
        a
        for state, name in ((PRESENT, "on"), (ABSENT, "off"), (UNCERTAIN, "unc"))
        for a in _state_aggregates(state, name, counted)
    ]
    stats = _dated(bout_table).groupBy(*keys, "date").agg(*aggs, *_off_aggregates())
    return stats


def off_times(bout_table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First start and last end of absence per day, as HH:MM."""
    off = _dated(bout_table).where(F.col("state_corrected") == ABSENT)
    return off.groupBy(*keys, "date").agg(*_off_aggregates())


def day_spine(df: DataFrame, keys: Sequence[str], time: str, state: str = "state_corrected") -> DataFrame:
    """Dates that have a classified reading."""
    classified = df.where(F.col(state).isNotNull() & F.col(time).isNotNull())
    return classified.select(*keys, F.to_date(F.col(time)).alias("date")).distinct()


def day_summary(
    df: DataFrame,
    bout_table: DataFrame,
    keys: Sequence[str],
    time: str,
    sun: DataFrame | None = None,
    state: str = "state_corrected",
    exclude_short: bool = False,
    by_midnight: bool = False,
    digits: tuple[int, int] | None = (3, 1),
) -> DataFrame:
    """Daily activity from bouts.

    With ``sun`` only bouts that start in daylight count and day length is the
    denominator, otherwise the whole 24 hours. Deployments missing from ``sun``
    use 24 hours, as does polar day. Polar night has no active day: its length is
    0, nothing counts and the shares are null. Bouts count whole on their start date unless ``by_midnight``.
    ``digits`` rounds proportions and mean minutes (None keeps them raw).
    """
    keys = list(keys)
    at = [*keys, "date"]
    table = split_at_midnight(bout_table) if by_midnight else bout_table
    table = _dated(table)
    days = day_spine(df, keys, time, state)
    if sun is not None:
        sun = sun.select(*at, "sunrise", "sunset", "polar")
        table = table.join(sun, at, "left")
        no_sun = F.col("sunrise").isNull() & F.col("polar").isNull()
        table = table.where(in_daylight(F.col("bout_start")) | no_sun)
        days = days.join(sun, at, "left")
    stats = state_day_stats(table, keys, exclude_short)
    joined = days.join(stats, at, "left")
    sums = [c for c in stats.columns if c.startswith(("n_", "sum_", "_counted_"))]
    joined = joined.fillna(0, sums)
    if sun is not None:
        hours = F.round((micros("sunset") - micros("sunrise")) / F.lit(3.6e9), 2)
        hours = F.when(F.col("polar") == POLAR_NIGHT, 0.0).when(F.col("sunrise").isNull(), 24.0).otherwise(hours)
    else:
        hours = F.lit(24.0)

    def shorten(c: Column, d: int) -> Column:
        return F.round(c, d) if digits else c

    p, m = digits or (0, 0)
    joined = joined.withColumn("day_length_h", hours)
    seconds = F.nullif(F.col("day_length_h") * 3600, F.lit(0.0))

    def mean_minutes(name: str) -> Column:
        n = F.col(f"n_{name}_bouts")
        return F.when(n > 0, shorten(F.col(f"_counted_{name}_sec") / 60 / n, m))

    sun_cols = [F.date_format(c, "HH:mm").alias(c) for c in ("sunrise", "sunset")] if sun is not None else []
    return joined.select(
        *at,
        *sun_cols,
        "day_length_h",
        "first_off_start",
        "last_off_end",
        shorten(F.col("sum_on_sec") / seconds, p).alias("prop_on_nest"),
        shorten(F.col("sum_off_sec") / seconds, p).alias("prop_off_nest"),
        shorten(F.col("sum_unc_sec") / seconds, p).alias("prop_uncertain"),
        F.col("n_on_bouts").cast("int").alias("n_on_bouts"),
        F.col("n_off_bouts").cast("int").alias("n_off_bouts"),
        mean_minutes("on").alias("mean_on_bout_min"),
        mean_minutes("off").alias("mean_off_bout_min"),
    )


def day_summary_readings(
    df: DataFrame,
    bout_table: DataFrame,
    keys: Sequence[str],
    time: str,
    interval: Column,
    state: str = "state_corrected",
) -> DataFrame:
    """Older daily summary: readings times sampling interval; short off-bouts do not count."""
    at = [*keys, "date"]
    s = F.col(state)
    rows = df.where(s.isNotNull()).withColumns({"date": F.to_date(F.col(time)), "_dt": interval})
    daily = rows.groupBy(*at).agg(
        (F.count(F.lit(1)) * F.first("_dt")).alias("total_valid_sec"),
        (F.count_if(s == PRESENT) * F.first("_dt")).alias("on_nest_sec"),
        (F.count_if(s == ABSENT) * F.first("_dt")).alias("off_nest_sec"),
        (F.count_if(s == UNCERTAIN) * F.first("_dt")).alias("uncertain_sec"),
    )
    off = _dated(bout_table).where((F.col("state_corrected") == ABSENT) & ~F.col("flag_short"))
    off = off.groupBy(*at).agg(
        F.count(F.lit(1)).alias("n_off_bouts"), F.avg(F.col("bout_duration") / 60).alias("mean_off_bout_min")
    )
    return (
        daily.withColumn("pct_day_on_nest", F.col("on_nest_sec") / DAY_SEC * 100)
        .join(off, at, "left")
        .fillna(0, ["n_off_bouts"])
    )


def active_day_pct(
    df: DataFrame, sun: DataFrame, keys: Sequence[str], time: str, state: str = "state_corrected"
) -> DataFrame:
    """Share of daylight readings of each day that are present, in percent; in polar day of all readings."""
    at = [*keys, "date"]
    rows = df.where(F.col(state).isNotNull()).withColumn("date", F.to_date(F.col(time)))
    lit = rows.join(sun.select(*at, "sunrise", "sunset", "polar"), at).where(in_daylight(F.col(time)))
    return lit.groupBy(*at).agg(
        F.count(F.lit(1)).alias("n_active"),
        (F.count_if(F.col(state) == PRESENT) / F.count(F.lit(1)) * 100).alias("pct_active_on_nest"),
    )


def device_summary(
    tof: DataFrame,
    dht: DataFrame | None,
    log: DataFrame | None,
    deployments: DataFrame | None,
    keys: Sequence[str],
    time: str = "timestamp",
    rounded: bool = True,
) -> DataFrame:
    """Deployment health: span, sessions, reboots, downtime and reading counts."""
    keys = list(keys)
    n = F.count(F.lit(1))
    # whole microseconds, so that the sum does not depend on the order of the rows
    gap = F.round(F.col("dt_sec") * 1e6).cast("long")
    down = F.coalesce(F.sum(F.when(F.col("dt_sec") > DOWNTIME_SEC, gap)), F.lit(0))
    t = micros(time)
    # sessions are numbered upwards, but a session without readings leaves a hole
    per_session = tof.groupBy(*keys, "session_id").agg(
        F.min(time).alias("_first"),
        F.max(time).alias("_last"),
        n.alias("_n"),
        down.alias("_down"),
        F.count_if("flag_tof_invalid").alias("_invalid"),
        F.count_if("flag_ema_warmup").alias("_warmup"),
    )
    out = per_session.groupBy(*keys).agg(
        F.min("_first").alias("first_timestamp"),
        F.max("_last").alias("last_timestamp"),
        F.count("session_id").cast("int").alias("n_sessions"),
        (F.sum("_down") / F.lit(60e6)).alias("total_downtime_min"),
        F.sum("_n").alias("n_tof_total"),
        F.sum("_invalid").alias("n_tof_invalid"),
        F.sum("_warmup").alias("n_tof_warmup"),
    )
    days = (micros("last_timestamp") - micros("first_timestamp")) / F.lit(DAY_SEC * 1e6)
    out = out.withColumns(
        {
            "span_days": days,
            "pct_downtime": F.try_divide(F.col("total_downtime_min"), days * 1440) * 100,
            "pct_tof_invalid": F.col("n_tof_invalid") / F.col("n_tof_total") * 100,
        }
    )
    if log is not None:
        boots = F.count_if(F.coalesce(F.lower(F.trim("event")) == BOOT_EVENT, F.lit(False)))
        out = out.join(log.groupBy(*keys).agg((boots - 1).cast("int").alias("n_reboots")), keys, "left")
    else:
        out = out.withColumn("n_reboots", F.lit(None).cast("int"))
    if dht is not None:
        bad = dht.groupBy(*keys).agg(
            F.count_if("flag_dht_bad").alias("n_dht_bad"),
            (F.count_if("flag_dht_bad") / n * 100).alias("pct_dht_bad"),
        )
        out = out.join(bad, keys, "left")
    else:
        out = out.withColumns({"n_dht_bad": F.lit(None).cast("long"), "pct_dht_bad": F.lit(None).cast("double")})
    about: list[str] = []
    if deployments is not None:
        about = [c for c in ("device_id", "nestbox", "species") if c in deployments.columns]
        out = out.join(deployments.select(*keys, *about), keys, "left")
    if rounded:
        places = {"span_days": 2, "total_downtime_min": 1, "pct_downtime": 2, "pct_tof_invalid": 2, "pct_dht_bad": 2}
        out = out.withColumns({c: F.round(c, d) for c, d in places.items()})
    return out.select(
        *keys,
        *about,
        "first_timestamp",
        "last_timestamp",
        "span_days",
        "n_sessions",
        "n_reboots",
        "total_downtime_min",
        "pct_downtime",
        "n_tof_total",
        "n_tof_invalid",
        "pct_tof_invalid",
        "n_tof_warmup",
        "n_dht_bad",
        "pct_dht_bad",
    )


def adjacent_days(days: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Previous and next date with data; a key has one row per calendar day at most."""
    w = Window.partitionBy(*keys).orderBy("date")
    return days.select(*keys, "date", F.lag("date").over(w).alias("prev_date"), F.lead("date").over(w).alias("next_date"))
