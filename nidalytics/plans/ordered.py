"""Ordered per-key computations that never need one task per key.

A series is identified by its key columns and ordered by time plus tie
breakers; rows without a time come last. Windows run inside (key, block). A key
of ordinary length is one block, marked by a null; the rows of longer keys are
cut into slices of bounded length along their order and spread over many tasks.
Whatever must cross the borders of such slices (running totals, the last value
seen) is carried by a second, small table with one row per (key, block). Where
there are no long keys that branch is no part of the plan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nidalytics.plans.stages import cut

BLOCK = "_blk"
TARGET_ROWS = 1_000_000


@dataclass(frozen=True)
class Ordering:
    """Key, time and tie-breaking columns of a series; (time, ties) is total."""

    keys: tuple[str, ...]
    time: str
    ties: tuple[str, ...] = ()

    def within(self, *extra: str) -> Ordering:
        """The same series split further, e.g. per session."""
        return replace(self, keys=self.keys + extra)

    @property
    def row_id(self) -> list[str]:
        return [*self.keys, self.time, *self.ties]

    @property
    def cells(self) -> list[str]:
        return [*self.keys, BLOCK]

    @property
    def position(self) -> str:
        """SQL of a value that orders the rows of a key, nulls last as in the windows."""
        return f"struct({', '.join(f'`{c}` IS NULL, `{c}`' for c in (self.time, *self.ties))})"

    def inside(self, frame: str = "") -> str:
        """SQL of the window over a block."""
        order = ", ".join(f"`{c}` ASC NULLS LAST" for c in (self.time, *self.ties))
        return f"OVER (PARTITION BY {_names(self.cells)} ORDER BY {order} {frame})"

    def across(self, frame: str = "") -> str:
        """SQL of the window over a key's blocks."""
        return f"OVER (PARTITION BY {_names(self.keys)} ORDER BY {BLOCK} {frame})"


UPTO = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def _names(columns: Iterable[str]) -> str:
    return ", ".join(f"`{c}`" for c in columns)


def micros(column: str | Column) -> Column:
    return F.unix_micros(F.col(column) if isinstance(column, str) else column)


def add_blocks(df: DataFrame, o: Ordering, target_rows: int | None = None) -> DataFrame:
    """Add the block column, unless the table already carries one.

    Keys with at most ``target_rows`` rows are one block (null). The rows of longer
    keys are laid out along their order and cut at about half as many rows, so
    that bursts, ties and rows without a time are split like any others. They are
    written once, because the cuts must not move when the rows are read again. Keys
    are counted by a job of their own; the table of long keys has at most rows /
    target_rows entries.
    """
    columns = df.columns
    if BLOCK in columns:
        return df
    target_rows = target_rows or TARGET_ROWS
    long_keys = df.groupBy(*o.keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > target_rows)
    total = long_keys.agg(F.sum("_rows")).first()[0]
    if not total:
        return df.withColumn(BLOCK, F.lit(None).cast("long"))
    long_keys = cut(long_keys.select(*[F.col(k).alias(f"_of_{k}") for k in o.keys]))
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in o.keys]
    order = [*o.keys, *[F.col(c).asc_nulls_last() for c in (o.time, *o.ties)]]
    slices = -(-2 * total // target_rows)
    laid_out = df.join(long_keys, same, "left_semi").repartitionByRange(int(slices), *order)
    sliced = cut(laid_out.withColumn(BLOCK, F.spark_partition_id().cast("long")))
    short = df.join(long_keys, same, "left_anti").withColumn(BLOCK, F.lit(None).cast("long"))
    return short.unionByName(sliced)


def _split_rows(df: DataFrame) -> DataFrame:
    """Rows of the keys that have more than one block."""
    return df.where(f"{BLOCK} IS NOT NULL")


def _aggregate(df: DataFrame, keys: list[str], items: Iterable[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*map(F.expr, items))


def running(
    df: DataFrame,
    o: Ordering,
    *,
    sums: Mapping[str, Column] | None = None,
    lags: Mapping[str, Column] | None = None,
    fills: Mapping[str, Column] | None = None,
    priors: Mapping[str, Column] | None = None,
    since: Mapping[str, tuple[Column, Column]] | None = None,
    position: str | None = None,
) -> DataFrame:
    """Several running computations along a series in one go.

    ``sums``     running sum, the current row included
    ``lags``     value of the row before, null on the first
    ``fills``    last non-null value so far
    ``priors``   last non-null value before the row
    ``since``    (mark, amount): sum of the amounts after the last marked row
    ``position`` row number from 1

    All share one shuffle of the rows and one carry table. The input is read once
    to count its keys, so cut a long lineage before (see ``stages.cut``).
    """
    sums, since = dict(sums or {}), dict(since or {})
    lags, fills, priors = dict(lags or {}), dict(fills or {}), dict(priors or {})
    df = add_blocks(df, o)
    columns = df.columns
    inputs = {f"_e_{n}": e for n, e in {**sums, **lags, **fills, **priors}.items()}
    inputs |= {f"_mark_{n}": mark for n, (mark, _) in since.items()}
    inputs |= {f"_e_{n}": amount for n, (_, amount) in since.items()}
    rows = df.select("*", *[e.alias(n) for n, e in inputs.items()]) if inputs else df
    upto, before = o.inside(UPTO), o.inside(BEFORE)
    local = rows.selectExpr(
        "*",
        *[f"sum(_e_{n}) {upto} AS _s_{n}" for n in (*sums, *since)],
        *[f"lag(struct(_e_{n} AS v)) {o.inside()} AS _l_{n}" for n in lags],
        *[f"last(_e_{n}, true) {upto} AS _f_{n}" for n in fills],
        *[f"last(_e_{n}, true) {before} AS _f_{n}" for n in priors],
        *([f"count(1) {upto} AS _s_{position}"] if position else []),
    )
    edges = _aggregate(
        _split_rows(local if since else rows),
        o.cells,
        [
            *[f"sum(_e_{n}) AS _cs_{n}" for n in (*sums, *since)],
            *[f"max_by(struct(_e_{n} AS v), {o.position}) AS _cl_{n}" for n in lags],
            *[
                f"max_by(struct(_e_{n} AS v), CASE WHEN _e_{n} IS NOT NULL THEN {o.position} END) AS _cf_{n}"
                for n in (*fills, *priors)
            ],
            *[f"max(CASE WHEN _mark_{n} THEN _s_{n} END) AS _cm_{n}" for n in since],
            f"count(1) AS _cs_{position or 'rows'}",
        ],
    )
    if since:
        local = local.selectExpr(
            "*", *[f"last(CASE WHEN _mark_{n} THEN _s_{n} END, true) {upto} AS _m_{n}" for n in since]
        )
    counted = [*sums, *([position] if position else [])]
    edges = edges.selectExpr(
        *o.cells,
        *[f"sum(_cs_{n}) {o.across(BEFORE)} AS _cs_{n}" for n in counted],
        *[f"lag(_cl_{n}) {o.across()} AS _cl_{n}" for n in lags],
        *[f"last(_cf_{n}, true) {o.across(BEFORE)} AS _cf_{n}" for n in (*fills, *priors)],
        *[f"coalesce(sum(_cs_{n}) {o.across(BEFORE)}, 0) AS _cb_{n}" for n in since],
        *[f"_cm_{n}" for n in since],
    )
    if since:
        # amounts of the blocks before, less those up to the last mark in them
        edges = edges.selectExpr(
            "*", *[f"_cb_{n} - coalesce(last(_cb_{n} + _cm_{n}, true) {o.across(BEFORE)}, 0) AS _cs_{n}" for n in since]
        )
    out = {n: f"coalesce(_s_{n}, 0) + coalesce(_cs_{n}, 0)" for n in counted}
    out |= {n: f"coalesce(_l_{n}, _cl_{n}).v" for n in lags}
    out |= {n: f"coalesce(_f_{n}, _cf_{n}.v)" for n in (*fills, *priors)}
    out |= {
        n: f"CASE WHEN _m_{n} IS NOT NULL THEN _s_{n} - _m_{n} ELSE coalesce(_s_{n}, 0) + coalesce(_cs_{n}, 0) END"
        for n in since
    }
    kept = [f"`{c}`" for c in columns if c not in out]
    return local.join(edges, o.cells, "left").selectExpr(*kept, *[f"{e} AS `{n}`" for n, e in out.items()])


def steps(
    df: DataFrame,
    o: Ordering,
    value: Column,
    is_step: Callable[[Column, Column], Column],
    counts: Mapping[str, Callable[[Column], Column]],
    *,
    fill_to: str | None = None,
    first_to: str | None = None,
) -> DataFrame:
    """Number the steps of a value along the series.

    A step is a row whose non-null value satisfies ``is_step(previous non-null
    value, value)``. Each entry of ``counts`` is an output column and a condition
    on the value stepped to; it numbers such steps up to and including the row.
    ``fill_to`` receives the last non-null value so far, ``first_to`` the value of
    the key's first row. Steps inside a block are counted by a window; the step
    between two blocks is decided on the small table of block edges.
    """
    df = add_blocks(df, o)
    columns = df.columns
    v = F.col("_v")

    def hits(before: Column, now: Column) -> dict[str, Column]:
        hit = F.coalesce(is_step(before, now), F.lit(False))
        return {n: (hit & F.coalesce(ok(now), F.lit(False))).cast("long") for n, ok in counts.items()}

    upto = o.inside(UPTO)
    rows = df.select("*", value.alias("_v")).selectExpr("*", f"last(_v, true) {o.inside(BEFORE)} AS _prev")
    rows = rows.select("*", *[h.alias(f"_hit_{n}") for n, h in hits(F.col("_prev"), v).items()])
    local = rows.selectExpr(
        *[f"`{c}`" for c in columns],
        *[f"sum(_hit_{n}) {upto} AS _run_{n}" for n in counts],
        f"last(_v, true) {upto} AS _fill",
        f"first(struct(_v)) {upto} AS _head",
    )
    present = f"CASE WHEN _v IS NOT NULL THEN {o.position} END"
    edges = _aggregate(
        _split_rows(rows),
        o.cells,
        [
            *[f"sum(_hit_{n}) AS _hits_{n}" for n in counts],
            f"min_by(_v, {present}) AS _first",
            f"max_by(_v, {present}) AS _last",
            f"min_by(struct(_v), {o.position}) AS _head",
        ],
    ).selectExpr(
        *o.cells,
        *[f"_hits_{n}" for n in counts],
        "_first",
        f"last(_last, true) {o.across(BEFORE)} AS _carry",
        f"first(_head) {o.across(UPTO)} AS _key_head",
    )
    # the step from the last value of the blocks before to the first value of this one
    edges = edges.select("*", *[j.alias(f"_jump_{n}") for n, j in hits(F.col("_carry"), F.col("_first")).items()])
    carry = edges.selectExpr(
        *o.cells,
        "_carry",
        "_key_head",
        *[f"_jump_{n}" for n in counts],
        *[f"sum(_hits_{n} + _jump_{n}) {o.across(BEFORE)} AS _base_{n}" for n in counts],
    )
    out = {
        n: f"coalesce(_base_{n}, 0) + _run_{n} + CASE WHEN _fill IS NOT NULL THEN coalesce(_jump_{n}, 0) ELSE 0 END"
        for n in counts
    }
    if fill_to:
        out[fill_to] = "coalesce(_fill, _carry)"
    if first_to:
        out[first_to] = "coalesce(_key_head, _head)._v"
    kept = [f"`{c}`" for c in columns if c not in out]
    return local.join(carry, o.cells, "left").selectExpr(*kept, *[f"{e} AS `{n}`" for n, e in out.items()])
