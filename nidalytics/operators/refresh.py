"""Bouts and days after new corrections, from the readings between unchanged bouts only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nidalytics.operators import bouts as bt
from nidalytics.operators import correct, summary
from nidalytics.plans.ordered import BLOCK, Ordering, running
from nidalytics.plans.stages import cut


def slices(bout_table: DataFrame, boxes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, part, lo, hi): stretches of time that hold all bouts which the boxes can change.

    A box changes readings between its times, so the last bout that ends before it keeps its start and the first
    that starts after it keeps its end, but each may grow into what lies between. A stretch goes from the
    start of the one (null: from the beginning) to the start of the bout after the other (null: to the
    end). Bouts that touch at the same time are not told apart by time, so borders lie only where a
    bout ends before the next one starts. Stretches of a key that overlap are one.
    """
    keys = list(keys)
    order = Ordering(tuple(keys), "_at", ("_side", "_no"))
    touched = boxes.select(*keys).distinct()
    table = bout_table.join(touched, keys, "left_semi").select(*keys, "bout_id", "bout_start", "bout_end")
    table = cut(running(table, Ordering(tuple(keys), "bout_id"), lags={"_prev_end": F.col("bout_end")}).drop(BLOCK))
    free = F.col("_prev_end").isNull() | (F.col("_prev_end") < F.col("bout_start"))
    # the last bout before each box, from its end on; a box starts before a bout that ends at the same time
    nothing, zero = F.lit(None).cast("timestamp"), F.lit(0).cast("long").alias("_no")
    boxes = boxes.select(*keys, "t_min", "t_max").withColumn("_box", F.monotonically_increasing_id())
    boxes = cut(boxes)
    ends = table.where(free).select(*keys, F.col("bout_end").alias("_at"), F.lit(1).alias("_side"), F.col("bout_id").alias("_no"), F.col("bout_start").alias("_start"), F.lit(None).cast("long").alias("_box"))
    starts = boxes.select(*keys, F.col("t_min").alias("_at"), F.lit(0).alias("_side"), zero, nothing.alias("_start"), "_box")
    before = running(cut(ends.unionByName(starts)), order, priors={"lo": F.col("_start")})
    lows = before.where(F.col("_box").isNotNull()).select("_box", "lo")
    # the bout after the first one after each box: seen backwards, the one before the last
    back = -F.unix_micros("bout_start")
    firsts = table.select(*keys, back.alias("_at"), F.lit(1).alias("_side"), (-F.col("bout_id")).alias("_no"), "bout_start", free.alias("_free"), F.lit(None).cast("long").alias("_box"))
    # a bout's start is a border after another whole bout only, so each start hands on the border behind it
    later = running(cut(firsts), order, priors={"_border": F.when(F.col("_free"), F.col("bout_start"))}).drop(BLOCK)
    later = later.select(*keys, "_at", "_side", "_no", F.struct("_border").alias("_next"), "_box")
    tops = boxes.select(*keys, (-F.unix_micros("t_max")).alias("_at"), F.lit(0).alias("_side"), zero, F.lit(None).cast(later.schema["_next"].dataType).alias("_next"), "_box")
    after = running(cut(later.unionByName(tops)), order, priors={"_found": F.col("_next")})
    highs = after.where(F.col("_box").isNotNull()).select("_box", F.col("_found._border").alias("hi"))
    found = boxes.join(lows, "_box").join(highs, "_box")
    # overlapping stretches of a key become one
    by = Window.partitionBy(*keys).orderBy(F.asc_nulls_first("lo"))
    reach = F.coalesce("hi", F.lit("9999-12-31").cast("timestamp"))
    found = found.select(*keys, "lo", reach.alias("hi")).distinct()
    found = found.withColumn("_upto", F.max("hi").over(by.rowsBetween(Window.unboundedPreceding, -1)))
    fresh = F.coalesce(F.col("lo") >= F.col("_upto"), F.col("lo").isNotNull() | F.col("_upto").isNull())
    found = found.withColumn("part", F.sum(fresh.cast("long")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    early = F.lit("0001-01-01").cast("timestamp")
    return found.groupBy(*keys, "part").agg(F.min(F.coalesce("lo", early)).alias("lo"), F.max("hi").alias("hi"))


def refresh(
    readings: DataFrame,
    bout_table: DataFrame,
    days: DataFrame,
    boxes: DataFrame,
    corrections: DataFrame,
    o: Ordering,
    sun: DataFrame | None = None,
    value: str = "tof_smooth_r",
    state: str = "state_corrected",
    min_bout_sec: float = bt.MIN_BOUT_SEC,
    **options,
) -> dict[str, DataFrame]:
    """Bouts and days of the keys that new ``boxes`` touch, equal to those of a full run.

    ``bout_table`` and ``days`` are the present ones, ``corrections`` all boxes so far with the
    new ones, ``readings`` rows with any state that earlier boxes may have given them. Only readings within
    :func:`slices` are read. Their bouts replace those they had, the others are numbered on; days that have
    a classified reading within a slice, before or after, are made again from the new bouts. ``options`` go to
    the day summary. Returns ``bouts``, ``days`` (all of each touched key) and ``readings`` (those within the slices,
    corrected).
    """
    keys = list(o.keys)
    boxes = cut(correct.valid_boxes(boxes))
    parts = cut(slices(bout_table, boxes, keys))
    touched = cut(parts.select(*keys).distinct())
    spans = parts.select(*keys, "part", F.col("lo").alias("t_min"), F.expr("hi - INTERVAL 1 MICROSECOND").alias("t_max"))
    rows = cut(correct.rows_in_spans(readings, spans, keys, o.time))
    old = F.col(state).isNotNull()
    mine = corrections.join(touched, keys, "left_semi")
    fixed = cut(correct.apply_corrections(rows.withColumn("_was", old), mine, o, value, state))
    made = bt.bouts(fixed, o.within("part"), state, value, min_bout_sec).drop("part")
    within = bout_table.join(touched, keys, "left_semi")
    place = [F.col("bout_start") >= F.col("lo"), F.col("bout_start") < F.col("hi")]
    inside = within.join(parts, keys).where(place[0] & place[1]).select(*keys, "bout_id")
    kept = within.join(inside, [*keys, "bout_id"], "left_anti")
    columns = [c for c in bout_table.columns if c != "bout_id"]
    both = cut(kept.select(*columns, "bout_id").unionByName(made.select(*columns, "bout_id")))
    # bouts at the same time are all kept or all new, so their old or new numbers order them
    numbered = running(both.withColumnRenamed("bout_id", "_was_id"), Ordering(tuple(keys), "bout_start", ("_was_id",)), position="bout_id")
    new_bouts = cut(numbered.select(*bout_table.columns))
    date = F.to_date(o.time).alias("date")
    at = [*keys, "date"]
    stale = cut(fixed.where(F.col("_was") | F.col(state).isNotNull()).select(*keys, date).distinct())
    starting = new_bouts.withColumn("date", F.to_date("bout_start")).join(stale, at, "left_semi").drop("date")
    again = summary.day_summary(fixed, starting, keys, o.time, sun, state, **options)
    new_days = days.join(touched, keys, "left_semi").join(stale, at, "left_anti").unionByName(again.select(*days.columns))
    return {"bouts": new_bouts, "days": new_days, "readings": fixed.drop("_was", "part")}
