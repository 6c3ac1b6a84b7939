"""Exact grouped quantiles without one task per group.

Values are counted on a grid first; only the grid cells that contain a wanted
rank are looked at value by value.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nidalytics.plans.stages import cut

CELLS_PER_OCTAVE = 4096
#: Groups with more distinct values than this are ranked by cells instead of in one buffer.
MANY_VALUES = 2**17


def value_cell(v: Column) -> Column:
    """A whole number that grows with the value, by 4096 from one power of two to the next."""
    size = F.abs(v)
    octave = F.floor(F.log2(size))
    place = (octave + 1100) * CELLS_PER_OCTAVE + F.floor((size / F.pow(F.lit(2.0), octave) - 1) * CELLS_PER_OCTAVE)
    return F.when(v == 0, F.lit(0).cast("long")).otherwise(F.when(v > 0, place).otherwise(-place).cast("long"))


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: Column,
    probs: Mapping[str, float],
    grid: float | None = None,
) -> DataFrame:
    """One row per key with linearly interpolated quantiles of the non-null values.

    ``probs`` maps output names to probabilities. Cells are 4096 to each power of
    two, so they separate values of any unit or range; ``grid`` sets a cell width in
    units of the value instead. The work per task is bounded by the number of cells
    in a key's range and by the number of distinct values in one cell.
    """
    keys = list(keys)
    # the join below implies these filters; stated here, both its sides share one exchange
    counts = (
        df.select(*keys, value.cast("double").alias("_v"))
        .withColumn("_cell", F.floor(F.col("_v") / grid) if grid else value_cell(F.col("_v")))
        .where(" AND ".join(f"`{c}` IS NOT NULL" for c in (*keys, "_v", "_cell")))
        .groupBy(*keys, "_cell", "_v")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    return quantiles_of_counts(counts, keys, probs)


def quantiles_of_counts(counts: DataFrame, keys: Sequence[str], probs: Mapping[str, float]) -> DataFrame:
    """As :func:`exact_quantiles`, from distinct values: (keys, _cell, _v, _n)."""
    along = Window.partitionBy(*keys).orderBy("_cell")
    cells = (
        counts.groupBy(*keys, "_cell")
        .agg(F.sum("_n").alias("_n"))
        .select(
            *keys,
            "_cell",
            (F.sum("_n").over(along) - F.col("_n")).alias("_before"),
            "_n",
            F.sum("_n").over(Window.partitionBy(*keys)).alias("_total"),
        )
    )
    ranks = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(p)).alias("p")) for n, p in probs.items()])
    target = F.col("_q.p") * (F.col("_total") - 1)
    wanted = (
        cells.withColumn("_q", F.explode(ranks))
        .withColumn("_at", target)
        .where((F.ceil("_at") >= F.col("_before")) & (F.floor("_at") < F.col("_before") + F.col("_n")))
        .select(*keys, "_cell", F.col("_q.name").alias("_name"), "_at", "_before")
    )
    in_cell = Window.partitionBy(*keys, "_cell", "_name").orderBy("_v")
    upto = F.col("_before") + F.sum("_n").over(in_cell)
    ranked = counts.join(wanted, [*keys, "_cell"]).select(
        *keys, "_name", "_at", "_v", (upto - F.col("_n")).alias("_lo"), upto.alias("_hi")
    )

    def at_rank(rank: Column) -> Column:
        return F.max(F.when((F.col("_lo") <= rank) & (rank < F.col("_hi")), F.col("_v")))

    low, high = at_rank(F.floor("_at")), at_rank(F.ceil("_at"))
    picked = ranked.groupBy(*keys, "_name").agg(
        (low + (high - low) * (F.max("_at") - F.floor(F.max("_at")))).alias("_value")
    )
    return picked.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_name") == n, F.col("_value"))).alias(n) for n in probs]
    )


def histogram_quantile(
    df: DataFrame, keys: Sequence[str], value: Column, prob: float, out: str, many: int = MANY_VALUES
) -> DataFrame:
    """Quantile per group from a histogram of distinct values.

    The counting shuffles on (keys, value), so a long group is spread out. Groups of at most ``many`` distinct
    values are then merged in one buffer each; the others are ranked cell by cell, which no task holds whole.
    """
    keys = list(keys)
    counts = (
        df.select(*keys, value.cast("double").alias("_v"))
        .where(F.col("_v").isNotNull())
        .groupBy(*keys, "_v")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    counts = cut(counts)  # what comes before runs once
    # at most one group for every ``many`` distinct values
    wide = cut(counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_d")).where(F.col("_d") > many).drop("_d"))
    median = F.percentile("_v", F.lit(prob), F.col("_n")).alias(out)
    if wide.isEmpty():
        return counts.groupBy(*keys).agg(median)
    small = counts.join(F.broadcast(wide), keys, "left_anti").groupBy(*keys).agg(median)
    large = counts.join(F.broadcast(wide), keys, "left_semi").withColumn("_cell", value_cell(F.col("_v")))
    return small.unionByName(quantiles_of_counts(large, keys, {out: prob}))
