"""Runs of equal state and the bouts made of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nidalytics.operators.classify import ABSENT, PRESENT
from nidalytics.plans.ordered import BLOCK, Ordering, micros, running, steps

MIN_BOUT_SEC = 60.0
UNCLASSIFIED = "__UNCLASSIFIED__"
NO_STATE = "__NA__"


def fill_state(df: DataFrame, o: Ordering, state: str, out: str = "state_filled") -> DataFrame:
    """Carry the last state over rows without one; rows before the first get a marker."""
    filled = running(df, o, fills={out: F.col(state)})
    return filled.withColumn(out, F.coalesce(F.col(out), F.lit(UNCLASSIFIED)))


def state_runs(df: DataFrame, o: Ordering, state: str, bridge_nulls: bool = True) -> DataFrame:
    """Add ``state_run`` (0-based) and ``bout_id`` (1-based, null where no bout is).

    With ``bridge_nulls`` rows without a state belong to the run before them, and
    rows before the first state form run 0; otherwise they are runs of their own.
    """
    value = F.col(state) if bridge_nulls else F.coalesce(F.col(state), F.lit(NO_STATE))
    numbered = steps(
        df,
        o,
        value,
        lambda a, b: a != b,
        {"_steps": lambda v: F.lit(True), "_real": lambda v: v != NO_STATE},
        fill_to="_filled",
        first_to="_first_row",
    )
    if bridge_nulls:
        led = F.col("_first_row").isNull() & F.col("_filled").isNotNull()
        run = F.col("_steps") + led.cast("long")
        bout = F.when(F.col("_filled").isNotNull(), F.col("_real") + 1)
    else:
        run = F.col("_steps")
        first_is_bout = (F.col("_first_row") != NO_STATE).cast("long")
        bout = F.when(F.col(state).isNotNull(), F.col("_real") + first_is_bout)
    return numbered.withColumns({"state_run": run.cast("long"), "bout_id": bout.cast("long")}).drop(
        "_steps", "_real", "_filled", "_first_row"
    )


def bouts(
    df: DataFrame,
    o: Ordering,
    state: str = "state_corrected",
    value: str = "tof_smooth_r",
    min_bout_sec: float = MIN_BOUT_SEC,
    bridge_nulls: bool = True,
    keep_run: bool = False,
) -> DataFrame:
    """One row per bout: a maximal run of readings with the same state.

    Readings without a state, time gaps, reboots and nights do not end a bout.
    Bouts are numbered by start within each key.
    """
    if "state_run" not in df.columns:
        used = [*o.row_id, state, value, *([BLOCK] if BLOCK in df.columns else [])]
        df = state_runs(df.select(*dict.fromkeys(used)), o, state, bridge_nulls)
    t = micros(o.time)
    grouped = (
        df.where(F.col(state).isNotNull())
        .groupBy(*o.keys, "state_run", F.col(state).alias("state_corrected"))
        .agg(
            F.min(o.time).alias("bout_start"),
            F.max(o.time).alias("bout_end"),
            ((F.max(t) - F.min(t)) / F.lit(1e6)).alias("bout_duration"),
            F.count(F.lit(1)).alias("n_readings"),
            F.avg(value).alias("mean_tof_mm"),
            F.min("bout_id").alias("bout_id"),
        )
    )
    flagged = flag_short(grouped, min_bout_sec)
    return flagged if keep_run else flagged.drop("state_run")


def bouts_strict(df: DataFrame, o: Ordering, **kwargs) -> DataFrame:
    """Older rule: rows without a state end a bout."""
    return bouts(df, o, bridge_nulls=False, **kwargs)


def flag_short(bout_table: DataFrame, min_bout_sec: float = MIN_BOUT_SEC) -> DataFrame:
    """Mark bouts shorter than the minimum; they are kept."""
    return bout_table.withColumn("flag_short", F.col("bout_duration") < float(min_bout_sec))


def join_bout_id(df: DataFrame, o: Ordering, state: str = "state_corrected", bridge_nulls: bool = True) -> DataFrame:
    """Attach the bout number to every reading.

    The number of a bout is the number of runs with a state up to it, so it comes
    out of the run numbering itself and no join back from the bouts is needed.
    """
    return state_runs(df, o, state, bridge_nulls).drop("state_run", BLOCK)


def bout_counts(bout_table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Present, absent and short bouts per key."""
    s = F.col("state_corrected")
    return bout_table.groupBy(*keys).agg(
        F.count_if(s == PRESENT).alias("n_present_bouts"),
        F.count_if(s == ABSENT).alias("n_absent_bouts"),
        F.count_if("flag_short").alias("n_short_bouts"),
    )
