"""Trim windows, box selections and manual corrections as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nidalytics.functions.scalars import blank_to_null
from nidalytics.plans.ordered import BLOCK, Ordering, micros, running
from nidalytics.plans.stages import cut

RESET = "reset"
CELL_SEC = 3600.0


def inside_trim(time: Column) -> Column:
    """Within the bounds, both inclusive; a missing bound is open."""
    start, end = F.col("trim_start"), F.col("trim_end")
    return time.isNotNull() & F.coalesce(time >= start, F.lit(True)) & F.coalesce(time <= end, F.lit(True))


def _with_trim(df: DataFrame, deployments: DataFrame, keys: Sequence[str]) -> DataFrame:
    # only deployments that are trimmed at all take part
    bounds = deployments.select(*keys, "trim_start", "trim_end").where(
        F.col("trim_start").isNotNull() | F.col("trim_end").isNotNull()
    )
    return df.join(bounds, list(keys), "left")


def trim_window(df: DataFrame, deployments: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """Rows inside the trim window of their deployment."""
    return _with_trim(df, deployments, keys).where(inside_trim(F.col(time))).select(*df.columns)


def set_trim(deployments: DataFrame, overrides: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Replace trim bounds by the override text where it parses; otherwise keep the old bound."""
    def parsed(name: str) -> Column:
        return F.try_to_timestamp(blank_to_null(F.col(name)), F.lit("yyyy-MM-dd HH:mm:ss"))

    new = overrides.select(
        *keys, parsed("trim_start").alias("_new_start"), parsed("trim_end").alias("_new_end")
    )
    joined = deployments.join(new, list(keys), "left")
    return joined.withColumns(
        {
            "trim_start": F.coalesce("_new_start", "trim_start"),
            "trim_end": F.coalesce("_new_end", "trim_end"),
        }
    ).select(*deployments.columns)


def _pair_with_spans(rows: DataFrame, spans: DataFrame, keys: Sequence[str], time: str, cell_sec: float) -> DataFrame:
    """Rows joined to the spans of time (t_min, t_max, both inclusive) that contain them.

    Spans are listed under the time cells they touch and meet the rows on (key, cell), so a long series
    is spread over its cells. Cells are ``cell_sec`` long or that times a power of eight: each span takes the length of which it
    touches nine cells at most, however long it is, and rows are listed once per length in use.
    """
    width = int(cell_sec * 1e6)

    def cell(c: Column, size: Column) -> Column:
        return F.floor(micros(c) / size)

    long = F.greatest((micros("t_max") - micros("t_min")) / F.lit(width * 8.0), F.lit(1.0))
    level = F.ceil(F.log(8.0, long) - F.lit(1e-9)).cast("int")
    size = F.col("_size")
    listed = spans.withColumn("_size", F.lit(width) * F.pow(F.lit(8), level).cast("long"))
    used = [r[0] for r in listed.select("_size").distinct().collect()]  # some twenty at most
    listed = listed.withColumn("_cell", F.explode(F.sequence(cell(F.col("t_min"), size), cell(F.col("t_max"), size))))
    t = F.col(time)
    placed = rows.withColumn("_size", F.explode(F.lit(used) if used else F.array().cast("array<bigint>")))
    placed = placed.withColumn("_size", F.col("_size").cast("long")).withColumn("_cell", cell(t, size))
    joined = placed.join(listed, [*keys, "_size", "_cell"])
    return joined.where(t.between(F.col("t_min"), F.col("t_max"))).drop("_size", "_cell")


def _pair_with_boxes(
    rows: DataFrame, boxes: DataFrame, keys: Sequence[str], time: str, value: str, cell_sec: float
) -> DataFrame:
    """Rows joined to the boxes that contain them."""
    v = F.col(value)
    return _pair_with_spans(rows, boxes, keys, time, cell_sec).where(v.between(F.col("d_min"), F.col("d_max")))


def rows_in_spans(rows: DataFrame, spans: DataFrame, keys: Sequence[str], time: str, cell_sec: float = CELL_SEC) -> DataFrame:
    """Rows inside spans of time, with the spans' further columns; spans of a key do not overlap."""
    return _pair_with_spans(rows, spans, keys, time, cell_sec).drop("t_min", "t_max")


def valid_boxes(boxes: DataFrame) -> DataFrame:
    return boxes.where((F.col("t_min") <= F.col("t_max")) & (F.col("d_min") <= F.col("d_max")))


def box_select(
    df: DataFrame, boxes: DataFrame, o: Ordering, value: str, cell_sec: float = CELL_SEC
) -> DataFrame:
    """Every (box, row) pair with the row inside the box; rows without a value are never inside."""
    return _pair_with_boxes(df, valid_boxes(boxes), o.keys, o.time, value, cell_sec)


def overlay(boxes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Slabs of time that do not overlap, each with the boxes over it, the last one on top.

    The times at which boxes of a key begin or end cut it into slabs, numbered along the key; a box is listed
    under the slabs between its own two numbers. Columns: keys, t_min, t_max (inclusive) and ``stack``, the
    bounds and actions from the highest (seq, action) down. A slab holds the boxes that people have laid over the same
    time, not what is recorded there.
    """
    keys = list(keys)
    later = F.col("t_max") + F.expr("INTERVAL 1 MICROSECOND")
    boxes = cut(boxes.select(*keys, "seq", "action", "t_min", later.alias("t_end"), "d_min", "d_max"))
    edges = boxes.select(*keys, F.explode(F.array("t_min", "t_end")).alias("_at")).distinct()
    slabs = cut(running(edges, Ordering(tuple(keys), "_at"), position="_no").drop(BLOCK))

    def number(time: str, name: str) -> DataFrame:
        return slabs.select(*keys, F.col("_at").alias(time), F.col("_no").alias(name))

    spans = boxes.join(number("t_min", "_a"), [*keys, "t_min"]).join(number("t_end", "_b"), [*keys, "t_end"])
    listed = spans.withColumn("_no", F.explode(F.sequence(F.col("_a"), F.col("_b") - 1)))
    stack = F.sort_array(F.collect_list(F.struct("seq", "action", "d_min", "d_max")), asc=False).alias("stack")
    stacks = listed.groupBy(*keys, "_no").agg(stack)
    starts = slabs.select(*keys, "_no", F.col("_at").alias("t_min"))
    ends = slabs.select(*keys, (F.col("_no") - 1).alias("_no"), (F.col("_at") - F.expr("INTERVAL 1 MICROSECOND")).alias("t_max"))
    return stacks.join(starts, [*keys, "_no"]).join(ends, [*keys, "_no"]).drop("_no")


def apply_corrections(
    df: DataFrame,
    corrections: DataFrame,
    o: Ordering,
    value: str = "tof_smooth_r",
    state: str = "state_corrected",
    auto: str = "state_auto",
    source: str = "correction_source",
    cell_sec: float = CELL_SEC,
) -> DataFrame:
    """Set the state of rows inside correction boxes; the highest ``seq`` wins.

    ``action`` is a state, or "reset" to return to the automatic state. Rows
    without a value are never hit. However many boxes lie over a row, it meets
    one slab and takes the first box of its stack that holds its value; see :func:`overlay`.
    """
    slabs = cut(overlay(valid_boxes(corrections), o.keys))
    v = F.col(value)
    rows = df.select(*o.row_id, value).where(v.isNotNull())
    met = _pair_with_spans(rows, slabs, o.keys, o.time, cell_sec)
    hit = F.get(F.filter("stack", lambda b: v.between(b["d_min"], b["d_max"])), F.lit(0))
    winner = met.select(*o.row_id, hit["action"].alias("_action")).where(F.col("_action").isNotNull())
    joined = df.join(winner, o.row_id, "left")
    action = F.col("_action")
    return joined.withColumns(
        {
            state: F.when(action == RESET, F.col(auto)).when(action.isNotNull(), action).otherwise(F.col(state)),
            source: F.when(action == RESET, "auto").when(action.isNotNull(), "manual").otherwise(F.col(source)),
        }
    ).drop("_action")


def reset_corrections(df: DataFrame, boxes: DataFrame, o: Ordering, **kwargs) -> DataFrame:
    """Return the rows inside the boxes to their automatic state."""
    return apply_corrections(df, boxes.withColumn("action", F.lit(RESET)), o, **kwargs)


def selection_counts(
    df: DataFrame, boxes: DataFrame, o: Ordering, value: str, state: str = "state_corrected", box_id: str = "seq"
) -> DataFrame:
    """Rows per box and state, and the total per box; rows without a state count in the total only."""
    hits = box_select(df.select(*o.row_id, value, state), boxes, o, value)
    per_state = hits.groupBy(*o.keys, box_id, F.col(state).alias("state")).agg(F.count(F.lit(1)).alias("n"))
    totals = per_state.groupBy(*o.keys, box_id).agg(F.sum("n").alias("n_selected"))
    return per_state.where(F.col("state").isNotNull()).join(totals, [*o.keys, box_id], "right")


def deployment_days(df: DataFrame, deployments: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """Dates with data inside the trim window; all dates where the window leaves none."""
    keys = list(keys)
    days = df.where(F.col(time).isNotNull()).select(*keys, F.to_date(F.col(time)).alias("date")).distinct()
    bounded = _with_trim(days, deployments, keys)
    inside = F.coalesce(F.col("date") >= F.to_date("trim_start"), F.lit(True)) & F.coalesce(
        F.col("date") <= F.to_date("trim_end"), F.lit(True)
    )
    bounded = bounded.withColumn("_in", inside)
    any_in = bounded.groupBy(*keys).agg(F.bool_or("_in").alias("_any"))
    return bounded.join(any_in, keys).where(F.col("_in") | ~F.col("_any")).select(*keys, "date")
