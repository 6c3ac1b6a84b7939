"""Timestamp repair, reading flags, sessions and gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nidalytics.functions.scalars import blank_to_null, infer_year, window_bound
from nidalytics.plans.ordered import BLOCK, Ordering, micros, running, steps

# Readings the distance sensor reports when it has no echo.
SENTINELS = (-1.0, 8190.0)
BOOT_EVENT = "start"
WARMUP_ROWS = 20
LARGE_GAP_MIN = 120.0
DOWNTIME_SEC = 300.0


def resolve_year(
    deployments: DataFrame,
    override: DataFrame | None = None,
    date_col: str = "deployment_date",
    keys: Sequence[str] = ("deployment_id",),
    allowed: tuple[int, int] | None = None,
) -> DataFrame:
    """Add ``recording_year``: an explicit year, else the year of the deployment date.

    ``override`` has the key columns and ``year``; ``allowed`` limits explicit
    years. Rows left null belong in quarantine (:func:`missing_year`).
    """
    year = infer_year(F.col(date_col))
    if override is not None:
        given = override.select(*keys, F.col("year").cast("int").alias("_given"))
        deployments = deployments.join(given, list(keys), "left")
        explicit = F.col("_given")
        if allowed:
            explicit = F.when(explicit.between(*allowed), explicit)
        year = F.coalesce(explicit, year)
    return deployments.withColumn("recording_year", year.cast("int")).drop("_given")


def missing_year(deployments: DataFrame, source_col: str) -> DataFrame:
    """Quarantine rows for deployments whose recording year is unknown."""
    return deployments.where(F.col("recording_year").isNull()).select(
        F.col(source_col).alias("source_file"),
        F.lit("recording_year_needed").alias("reason"),
        F.lit(None).cast("string").alias("raw"),
    )


def deployment_window(deployments: DataFrame, year_col: str | None = None) -> DataFrame:
    """Add ``trim_start`` and ``trim_end`` from the deployment and retrieval date and time."""
    year = F.col(year_col) if year_col else None
    return deployments.withColumn(
        "trim_start", window_bound(F.col("deployment_date"), F.col("deployment_time"), year)
    ).withColumn("trim_end", window_bound(F.col("retrieval_date"), F.col("retrieval_time"), year))


def attach_year(
    df: DataFrame, o: Ordering, text: str, year: Column, out: str = "timestamp"
) -> DataFrame:
    """Timestamps from ``MM-DD HH:MM:SS`` text (one-digit months and days too) in file order.

    Whenever the month falls by more than six from one row to the next, that row
    and all later ones belong to the following year. ``o`` orders rows as they
    stand in the file. The year is settled before the text is parsed, so 29
    February after a crossing into a leap year is kept.
    """
    month = F.regexp_extract(F.trim(F.col(text)), r"^(\d{1,2})-\d{1,2} ", 1).try_cast("int")
    month = F.when(month.between(1, 12), month)
    counted = steps(df, o, month, lambda prev, cur: cur - prev < -6, {"_crossings": lambda m: F.lit(True)})
    stamp = F.concat_ws("-", (year + F.col("_crossings")).cast("string"), F.trim(F.col(text)))
    parsed = F.try_to_timestamp(stamp, F.lit("yyyy-M-d H:mm:ss"))
    return counted.withColumn(out, F.when(year.isNotNull(), parsed)).drop("_crossings")


def is_invalid(value: Column, sentinels: Sequence[float] = SENTINELS) -> Column:
    """True for sentinel and missing readings."""
    return F.coalesce(value.isin(*sentinels) | F.isnan(value), F.lit(True))


def flag_invalid(
    df: DataFrame,
    value: str,
    also_null: Sequence[str] = (),
    flag: str = "flag_tof_invalid",
    invalid: Column | None = None,
) -> DataFrame:
    """Flag invalid readings and null the reading and its companions."""
    bad = is_invalid(F.col(value)) if invalid is None else F.coalesce(invalid, F.lit(True))
    df = df.withColumn(flag, bad)
    return df.withColumns({c: F.when(~F.col(flag), F.col(c)) for c in (value, *also_null)})


def boot_times(log: DataFrame, time: str = "timestamp", event: str = "event") -> DataFrame:
    """Log rows that mark a boot, whatever their case."""
    return log.where((F.lower(F.trim(F.col(event))) == BOOT_EVENT) & F.col(time).isNotNull())


def _with_boots(readings: DataFrame, boots: DataFrame, o: Ordering) -> tuple[DataFrame, Ordering]:
    """Readings and boots in one table, a boot ahead of readings with the same time."""
    marks = boots.select(*o.keys, o.time).withColumns({"_is_reading": F.lit(0), "_boot": F.lit(1)})
    mixed = readings.drop(BLOCK).withColumns({"_is_reading": F.lit(1), "_boot": F.lit(0)})
    return mixed.unionByName(marks, allowMissingColumns=True), Ordering(o.keys, o.time, ("_is_reading", *o.ties))


def assign_session(readings: DataFrame, boots: DataFrame, o: Ordering, out: str = "session_id") -> DataFrame:
    """Number of boots at or before each reading, 0 before the first boot.

    Boots are mixed into the readings and counted along the series; no range join
    is involved. Readings without a time get null.
    """
    mixed, o2 = _with_boots(readings, boots, o)
    counted = running(mixed, o2, sums={out: F.col("_boot")})
    return (
        counted.where(F.col("_is_reading") == 1)
        .withColumn(out, F.when(F.col(o.time).isNotNull(), F.col(out)).cast("int"))
        .drop("_is_reading", "_boot", BLOCK)
    )


def session_columns(readings: DataFrame, boots: DataFrame, o: Ordering) -> DataFrame:
    """``session_id``, ``dt_sec`` and ``session_row`` (row number in the session) in one pass.

    The same as :func:`assign_session`, :func:`delta_seconds` and numbering the
    rows of each session, but the readings are shuffled once.
    """
    mixed, o2 = _with_boots(readings, boots, o)
    is_reading = F.col("_is_reading") == 1
    counted = running(
        mixed,
        o2,
        sums={"session_id": F.col("_boot")},
        priors={"_before": F.when(is_reading, micros(o.time))},
        since={"session_row": (~is_reading, F.col("_is_reading"))},
    )
    return (
        counted.where(is_reading)
        .withColumns(
            {
                "session_id": F.col("session_id").cast("int"),
                "session_row": F.col("session_row").cast("long"),
                "dt_sec": (micros(o.time) - F.col("_before")) / F.lit(1e6),
            }
        )
        .drop("_is_reading", "_boot", "_before", BLOCK)
    )


def delta_seconds(df: DataFrame, o: Ordering, out: str = "dt_sec") -> DataFrame:
    """Seconds since the previous row of the key; sessions do not reset it."""
    lagged = running(df, o, lags={"_before": micros(o.time)})
    return lagged.withColumn(out, (micros(o.time) - F.col("_before")) / F.lit(1e6)).drop("_before")


def flag_warmup(
    df: DataFrame, o: Ordering, session: str = "session_id", n: int = WARMUP_ROWS, out: str = "flag_ema_warmup"
) -> DataFrame:
    """Flag the first ``n`` rows of each session, invalid ones included."""
    if "session_row" in df.columns:
        return df.withColumn(out, F.col("session_row") <= n)
    return running(df, o.within(session), position="_pos").withColumn(out, F.col("_pos") <= n).drop("_pos")


def flag_any_missing(df: DataFrame, columns: Sequence[str], out: str = "flag_dht_bad") -> DataFrame:
    """Flag rows in which any of the channels is missing."""
    missing = F.lit(False)
    for c in columns:
        missing = missing | F.col(c).isNull()
    return df.withColumn(out, missing)


def channel_diff(df: DataFrame, inside: str, outside: str, out: str, digits: int = 2) -> DataFrame:
    """Inside minus outside, rounded."""
    return df.withColumn(out, F.round(F.col(inside) - F.col(outside), digits))


def gaps(df: DataFrame, o: Ordering, threshold_sec: float, delta: str = "dt_sec") -> DataFrame:
    """One row per gap longer than the threshold: start, end and minutes (unrounded)."""
    if delta not in df.columns:
        df = delta_seconds(df, o, delta)
    back = F.timestamp_micros(micros(o.time) - F.round(F.col(delta) * 1e6).cast("long"))
    return df.where(F.col(delta) > threshold_sec).select(
        *o.keys,
        back.alias("gap_start"),
        F.col(o.time).alias("gap_end"),
        (F.col(delta) / 60).alias("gap_min"),
    )


def large_gaps(df: DataFrame, o: Ordering, threshold_min: float = LARGE_GAP_MIN) -> DataFrame:
    """Gaps that suggest that a file holds more than one deployment."""
    return gaps(df, o, threshold_min * 60)


def downtime_gaps(df: DataFrame, o: Ordering, threshold_sec: float = DOWNTIME_SEC) -> DataFrame:
    """Gaps that count as device downtime."""
    return gaps(df, o, threshold_sec).withColumnRenamed("gap_min", "downtime_min")


def device_mismatch(log: DataFrame, deployments: DataFrame, keys: Sequence[str] = ("deployment_id",)) -> DataFrame:
    """Device ids found in the log that differ from a non-blank id in the metadata."""
    known = deployments.select(*keys, blank_to_null(F.col("device_id")).alias("meta_device_id")).where(
        F.col("meta_device_id").isNotNull()
    )
    seen = log.select(*keys, "device_id").distinct()
    return seen.join(known, list(keys)).where(
        ~F.col("device_id").eqNullSafe(F.col("meta_device_id"))
    )


def ingest_counts(
    tof: DataFrame, dht: DataFrame, log: DataFrame, keys: Sequence[str] = ("deployment_id",)
) -> DataFrame:
    """Rows loaded, bad climate rows, invalid and warm-up readings, boots, per deployment."""
    k = list(keys)
    t = tof.groupBy(*k).agg(
        F.count(F.lit(1)).alias("n_tof"),
        F.count_if("flag_tof_invalid").alias("n_tof_invalid"),
        F.count_if("flag_ema_warmup").alias("n_tof_warmup"),
    )
    d = dht.groupBy(*k).agg(F.count(F.lit(1)).alias("n_dht"), F.count_if("flag_dht_bad").alias("n_dht_bad"))
    b = log.groupBy(*k).agg(
        F.count(F.lit(1)).alias("n_log"),
        F.count_if(F.coalesce(F.lower(F.trim("event")) == BOOT_EVENT, F.lit(False))).alias("n_boots"),
    )
    joined = t.join(d, k, "full").join(b, k, "full")
    return joined.fillna(0, [c for c in joined.columns if c not in k])


def clock_mismatch(log: DataFrame, tof: DataFrame, keys: Sequence[str] = ("deployment_id",), time: str = "timestamp") -> DataFrame:
    """Deployments whose log and readings do not overlap in time.

    Every file settles its own year, so a log that begins after New Year stays a
    year behind the readings; such deployments show up here.
    """
    def span(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.min(time).alias(f"{name}_from"), F.max(time).alias(f"{name}_to"))

    both = span(log, "log").join(span(tof, "tof"), list(keys))
    return both.where((F.col("log_to") < F.col("tof_from")) | (F.col("log_from") > F.col("tof_to")))
