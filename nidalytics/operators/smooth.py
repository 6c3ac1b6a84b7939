"""Sampling interval and rolling median."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nidalytics.functions.scalars import valid_window
from nidalytics.plans.ordered import BLOCK, Ordering, running
from nidalytics.plans.quantiles import exact_quantiles
from nidalytics.plans.stages import map_groups

DEFAULT_INTERVAL = 2.0
SMOOTH_SEC = 75.0
SLICE_ROWS = 500_000
#: Frames of more rows slide over a rank tree; shorter ones are sorted in the JVM.
WIDE_FRAME = 255


def usable(df: DataFrame) -> Column:
    """Rows that are neither invalid nor warm-up."""
    return ~F.col("flag_tof_invalid") & ~F.col("flag_ema_warmup")


def typical_interval(
    df: DataFrame, keys: tuple[str, ...], delta: str = "dt_sec", where: Column | None = None
) -> DataFrame:
    """Median seconds between readings per key, over usable rows.

    Keys without such rows are absent; callers fall back to DEFAULT_INTERVAL.
    """
    rows = df.where(usable(df) if where is None else where)
    return exact_quantiles(rows, keys, F.col(delta), {"typical_interval": 0.5})


def default_window(seconds: float = SMOOTH_SEC) -> int:
    """The window size at the default interval."""
    k = round(seconds / DEFAULT_INTERVAL)
    return max(3, k + 1 - k % 2)


def window_sizes(
    deployments: DataFrame, intervals: DataFrame, keys: tuple[str, ...], seconds: float = SMOOTH_SEC
) -> DataFrame:
    """Keys with ``typical_interval`` (default where unknown) and the odd window size ``k``."""
    joined = deployments.select(*keys).join(intervals, list(keys), "left")
    interval = F.coalesce(F.when(F.col("typical_interval") > 0, F.col("typical_interval")), F.lit(DEFAULT_INTERVAL))
    return joined.select(*keys, interval.alias("typical_interval"), valid_window(seconds, interval).alias("k"))


def rolling_median(
    df: DataFrame,
    o: Ordering,
    value: Column,
    k: int,
    nulls: str = "propagate",
    out: str = "tof_smooth_r",
    slice_rows: int = SLICE_ROWS,
    position: str | None = None,
) -> DataFrame:
    """Centred median over ``k`` rows of each series.

    The first and last (k-1)/2 rows get null, as do all rows of a series shorter
    than k. A null inside the window makes the result null ("propagate") or is
    left out ("skip"). Rows are numbered along the series and cut into slices of
    ``slice_rows`` rows; rows near a cut are copied into the neighbouring slice,
    so a frame never needs more than one slice and a long series is many tasks.
    ``position`` names a column that already holds the row numbers.
    """
    if k % 2 == 0 or k < 1:
        raise ValueError("k must be odd")
    if nulls not in ("propagate", "skip"):
        raise ValueError("nulls must be 'propagate' or 'skip'")
    if k > WIDE_FRAME:
        return sliding_median(df, o, value, F.lit(k), nulls, out, slice_rows, position)
    half = k // 2
    size = max(slice_rows, 2 * k)
    columns = [c for c in df.columns if c != out]
    numbered = df.withColumn("_x", value)
    numbered = numbered.withColumn("_pos", F.col(position)) if position else running(numbered, o, position="_pos")

    def slice_of(row: Column) -> Column:
        return F.floor((row - 1) / size)

    home = slice_of(F.col("_pos"))
    around = F.array_distinct(
        F.array(home, slice_of(F.greatest(F.col("_pos") - half, F.lit(1))), slice_of(F.col("_pos") + half))
    )
    copies = numbered.withColumns({"_home": home, "_slice": F.explode(around)})
    frame = Window.partitionBy(*o.keys, "_slice").orderBy("_pos").rowsBetween(-half, half)
    values = F.sort_array(F.collect_list("_x").over(frame))
    full = F.count(F.lit(1)).over(frame) == k
    if nulls == "propagate":
        median = F.when(full & (F.size(values) == k), F.get(values, F.lit(half)))
    else:
        n = F.size(values)
        middle = (
            F.get(values, F.floor((n - 1) / 2).cast("int")) + F.get(values, F.floor(n / 2).cast("int"))
        ) / 2
        median = F.when(full & (n > 0), middle)
    return (
        copies.withColumn(out, median)
        .where(F.col("_slice") == F.col("_home"))
        .select(*[c for c in columns if c != BLOCK], out)
    )


def sliding_median(
    df: DataFrame,
    o: Ordering,
    value: Column,
    k: Column,
    nulls: str = "propagate",
    out: str = "tof_smooth_r",
    slice_rows: int = SLICE_ROWS,
    position: str | None = None,
) -> DataFrame:
    """As :func:`rolling_median`, with the odd window size of each series as data: any mix of sizes in one pass.

    A slice, with its rows near a cut copied in, is one task's work, and a task takes many short ones at a time. Values
    are replaced by their ranks, and a tree of ranks follows the window, so a row costs log(k) and medians are exact for any type.
    A null or even ``k`` fails.
    """
    if nulls not in ("propagate", "skip"):
        raise ValueError("nulls must be 'propagate' or 'skip'")
    columns = [c for c in df.columns if c not in (out, BLOCK)]
    numbered = df.withColumns({"_x": value if nulls == "propagate" else value.cast("double"), "_width": k.cast("long")})
    numbered = numbered.withColumn("_pos", F.col(position)) if position else running(numbered, o, position="_pos")
    odd = F.col("_width").isNotNull() & (F.col("_width") % 2 == 1) & (F.col("_width") > 0)
    numbered = numbered.withColumn(
        "_width", F.when(odd, F.col("_width")).otherwise(F.raise_error(F.lit("k must be odd")).cast("long"))
    )
    half, size = F.floor(F.col("_width") / 2), F.greatest(F.lit(slice_rows), 2 * F.col("_width"))

    def slice_of(row: Column) -> Column:
        return F.floor((row - 1) / size)

    home, pos = slice_of(F.col("_pos")), F.col("_pos")
    around = F.array_distinct(F.array(home, slice_of(F.greatest(pos - half, F.lit(1))), slice_of(pos + half)))
    copies = numbered.withColumns({"_home": home, "_slice": F.explode(around)})
    copies = copies.select(*columns, *[c for c in o.keys if c not in columns], "_x", "_width", "_pos", "_home", "_slice")
    schema = T.StructType([*[copies.schema[c] for c in columns], T.StructField(out, copies.schema["_x"].dataType)])

    def slide(rows: pa.Table, starts: np.ndarray) -> pa.Table:
        x = rows["_x"].combine_chunks()
        widths, at = rows["_width"].to_numpy(), np.arange(len(x))
        sizes = np.diff(np.append(starts, len(x)))
        first = np.repeat(starts, sizes)
        inside = (at - first >= widths // 2) & (at - first < np.repeat(sizes, sizes) - widths // 2)
        known = ~x.is_null().to_numpy(zero_copy_only=False)
        levels, ranks = np.unique(x.drop_null().to_numpy(zero_copy_only=False), return_inverse=True)
        rank = np.full(len(x), np.nan)
        rank[known] = ranks
        low, high = np.full(len(x), np.nan), np.full(len(x), np.nan)
        # series of one width follow one another under the same window; frames that reach beyond a series do not count
        for width in np.unique(widths[inside]).tolist():
            of = np.flatnonzero(widths == width)
            window = pd.Series(rank[of]).rolling(width, center=True, min_periods=width if nulls == "propagate" else 1)
            low[of] = window.quantile(0.5, interpolation="lower").to_numpy()
            if nulls == "skip":
                high[of] = window.quantile(0.5, interpolation="higher").to_numpy()
        full = inside & ~np.isnan(low)
        found = levels[low[full].astype(np.int64)]
        if nulls == "skip" and full.any():
            found = (found + levels[high[full].astype(np.int64)]) / 2
        median = np.full(len(x), None, dtype=object)
        median[full] = found
        own = pa.array(rows["_home"].to_numpy() == rows["_slice"].to_numpy())
        result = pa.array(median, type=x.type, from_pandas=False)
        return rows.select(columns).append_column(out, result).filter(own)

    return map_groups(copies, [*o.keys, "_slice"], ["_pos"], slide, schema)


def smooth_by_window_size(
    df: DataFrame,
    o: Ordering,
    value: Column,
    sizes: DataFrame,
    nulls: str = "propagate",
    out: str = "tof_smooth_r",
    position: str | None = None,
    default_k: int = 39,
) -> DataFrame:
    """Rolling median with the window size of each deployment, ``default_k`` where none is known.

    Frames need literal bounds: where all deployments have one size, it is one. Where they differ, all of them
    slide in one pass, with the size as data.
    """
    by = [c for c in sizes.columns if c in o.keys]
    known = sizes.where(F.col("k").isNotNull()).select(*by, F.col("k").alias("_k")).dropDuplicates(by)
    distinct = {r["_k"] for r in known.select("_k").distinct().limit(2).collect()}
    if len(distinct) < 2 and not df.select(*by).distinct().join(known, by, "left_anti").isEmpty():
        distinct.add(default_k)
    if len(distinct) <= 1:
        return rolling_median(df, o, value, *distinct or {default_k}, nulls, out, position=position)
    sized = df.drop(BLOCK).join(known, by, "left").withColumn("_k", F.coalesce("_k", F.lit(default_k)))
    return sliding_median(sized, o, value, F.col("_k"), nulls, out, position=position).drop("_k")
