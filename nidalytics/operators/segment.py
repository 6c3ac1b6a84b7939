"""Change points in the mean of a series."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nidalytics.plans.ordered import BLOCK, Ordering, micros, running, steps
from nidalytics.plans.quantiles import histogram_quantile
from nidalytics.plans.stages import cut, map_groups, spread

MIN_POINTS = 10
CHUNK_ROWS = 1_000_000
OVERLAP_ROWS = 50_000
STEP = 64  # ends that are settled at a time
SIDE_BY_SIDE = 128  # series of at most as many ends are searched many at a time
SIDE_CELLS = 1_000_000
MARGIN = 1e-12  # a start goes only if others are better by more than rounding

# Penalty per change as a multiple of the log of the series length.
PENALTIES = {"MBIC": 3.0, "BIC": 2.0, "SIC": 2.0, "None": 0.0}
# Two parameters per change, its place and the new mean.
AIC, HANNAN_QUINN = "AIC", "Hannan-Quinn"


def check_penalty(penalty: str | float) -> None:
    """Reject an unknown penalty before any task starts."""
    if isinstance(penalty, str) and penalty not in (*PENALTIES, AIC, HANNAN_QUINN):
        raise ValueError(f"unknown penalty {penalty!r}")
    if not isinstance(penalty, str) and not float(penalty) >= 0:
        raise ValueError("a penalty must not be negative")


def penalty_value(penalty: str | float, n: int) -> float:
    check_penalty(penalty)
    if not isinstance(penalty, str):
        return float(penalty)
    if penalty == AIC:
        return 4.0
    if penalty == HANNAN_QUINN:
        return 4.0 * float(np.log(max(np.log(max(n, 2)), 1.0)))
    return PENALTIES[penalty] * float(np.log(n))


def signal_rows(df: DataFrame) -> DataFrame:
    """Usable, smoothed, daytime rows."""
    night = F.col("is_night") if "is_night" in df.columns else F.lit(False)
    return df.where(
        ~F.col("flag_tof_invalid") & ~F.col("flag_ema_warmup") & F.col("tof_smooth_r").isNotNull() & ~night
    )


class _Search:
    """Search for the best segmentation of one stretch of a series.

    Cost of a segment is its residual sum of squares over ``sigma2`` plus, for
    length "relative" or "absolute", the log of its share of the series or of its
    length. ``best[t]`` is the lowest penalised cost of the first t points and
    ``last[t]`` where the last segment of that solution starts; ties take the
    earliest start.

    Which starts stay live is decided as a function of the mean that the last segment
    may turn out to have. Against a later start j, a start i can only win for means
    within an interval, since the points between them cost it a square; against an
    earlier one it can only win outside of such an interval, which is narrower by
    what the log of the lengths still can change. A start whose means are all taken by
    others can never win again. Some dozens remain however long the series is without
    a change. Ends are settled ``STEP`` at a time.

    Positions count the points before them, within the stretch. A stretch that
    continues another one is given the starts that were live there (see
    :meth:`state`), with positions up to 0.
    """

    def __init__(self, x, n_series, penalty, length, sigma2, min_len, state=None, origin=0):
        x = np.asarray(x, dtype=float)
        self.n, self.origin = len(x), origin
        self.shift = state["shift"] if state else (x[0] if self.n else 0.0)
        shifted = (x - self.shift) / np.sqrt(sigma2)
        self.sum1 = np.concatenate([[0.0], np.cumsum(shifted)])
        self.sum2 = np.concatenate([[0.0], np.cumsum(shifted * shifted)])
        self.min_len = max(1, min_len)
        self.log_n = float(np.log(max(n_series, 1)))
        self.penalty = penalty_value(penalty, max(n_series, 1))
        self.length = length
        self.slack = max(0.0, self.log_n - float(np.log(4.0))) if length == "absolute" else 0.0
        self.best, self.last = np.full(self.n + 1, np.inf), np.zeros(self.n + 1, dtype=np.int64)
        self.done = 0
        # Moving a change through a run of equal values changes the cost by a concave
        # function, so a best change lies at an end of the run: only those are tried.
        # Smoothed distances are whole millimetres and stay equal for many readings.
        if self.min_len == 1:
            self.ends = np.append(np.flatnonzero(np.diff(x)) + 1, self.n)
        else:
            self.ends = np.arange(1 if state else self.min_len, self.n + 1)
        # starts: position, running sum there, best cost less the sum of squares, and the means for which they may win
        if state:
            pos = np.asarray(state["starts"], dtype=np.int64) - origin
            known = (pos, *(np.asarray(state[c], dtype=float) for c in ("sums", "offsets", "lows", "highs")))
            self.trails = {int(q): list(trail) for q, trail in zip(pos, state["trails"], strict=True)}
        else:
            self.best[0] = -self.penalty
            known = (np.zeros(1, np.int64), np.zeros(1), np.full(1, -self.penalty), np.full(1, -np.inf), np.full(1, np.inf))
            self.trails = {0: []}
        old = known[0] <= -self.min_len
        self.live = tuple(c[old] for c in known)
        self.queue = tuple(c[~old] for c in known)  # too near for any end so far
        self.limit = STEP

    def run_to(self, until: int) -> _Search:
        """Settle all ends up to a position, and the position itself."""
        if until > self.done:
            lo, hi = np.searchsorted(self.ends, [self.done + 1, until])
            ends = np.append(self.ends[lo:hi], until)
            for k in range(0, len(ends), STEP):
                self._settle(ends[k : k + STEP])
            self.done = until
        return self

    def _extra(self, size):
        """Cost of a segment by its number of points."""
        if self.length == "none":
            return 0.0
        return np.log(size) - (self.log_n if self.length == "relative" else 0.0)

    def _settle(self, t: np.ndarray) -> None:
        sum1, sum2, penalty = self.sum1, self.sum2, self.penalty
        pos, at_sum, offset, low, high = self.live
        size, gap = t[:, None] - pos, sum1[t][:, None] - at_sum
        old_total = offset - gap * gap / size + self._extra(size)
        old_least = old_total.min(axis=1, initial=np.inf)
        # starts that become available to these ends; those among the ends have no cost yet
        every = np.concatenate([self.queue[0], t])
        every_sum = np.concatenate([self.queue[1], sum1[t]])
        free = np.concatenate([self.queue[3], np.full(len(t), -np.inf)]), np.concatenate([self.queue[4], np.full(len(t), np.inf)])
        n_new = int(np.searchsorted(every, t[-1] - self.min_len, side="right"))
        new, new_sum = every[:n_new], every_sum[:n_new]
        size = t[:, None] - new
        ready = size >= self.min_len
        size = np.where(ready, size, 1)
        gap = sum1[t][:, None] - new_sum
        base = np.where(ready, self._extra(size) - gap * gap / size, np.inf)
        every_offset = np.concatenate([self.queue[2], np.full(len(t), np.inf)])
        least = None
        while True:  # a cost depends on earlier ones only, so this settles
            new_total = base + every_offset[:n_new]
            found = np.minimum(old_least, new_total.min(axis=1, initial=np.inf))
            if least is not None and np.array_equal(found, least):
                break
            least = found
            every_offset[len(self.queue[0]) :] = least + penalty
        self.best[t] = least + sum2[t] + penalty
        total = np.concatenate([old_total, new_total], axis=1)
        pos = np.concatenate([pos, new])
        self.last[t] = pos[total.argmin(axis=1)]
        keep = ((total <= (least + penalty + self.slack)[:, None]) | (total == np.inf)).all(axis=0)
        at_sum, offset = np.concatenate([at_sum, new_sum]), np.concatenate([offset, every_offset[:n_new]])
        low, high = np.concatenate([low, free[0][:n_new]]), np.concatenate([high, free[1][:n_new]])
        # the means for which a start can win against the new ones after it
        size = new[:, None] - pos
        after, size = size > 0, np.maximum(size, 1)
        gap = new_sum[:, None] - at_sum
        centre = gap / size
        tolerance = MARGIN * (1 + np.abs(offset).max(initial=0, where=np.isfinite(offset)))
        square = (every_offset[:n_new][:, None] - (offset - gap * centre) + tolerance) / size
        reach = np.sqrt(np.maximum(square, 0.0))
        none = square < 0
        low = np.maximum(low, np.where(after, np.where(none, np.inf, centre - reach), -np.inf).max(axis=0, initial=-np.inf))
        high = np.minimum(high, np.where(after, np.where(none, -np.inf, centre + reach), np.inf).min(axis=0, initial=np.inf))
        keep &= low <= high
        self.live = pos[keep], at_sum[keep], offset[keep], low[keep], high[keep]
        self.queue = every[n_new:], every_sum[n_new:], every_offset[n_new:], free[0][n_new:], free[1][n_new:]
        if len(self.live[0]) > self.limit:
            self._prune(int(t[-1]) + 1)
            self.limit = 2 * len(self.live[0]) + STEP

    def _prune(self, t: int) -> None:
        """Drop the starts whose means are all taken by earlier ones, from the end t on."""
        pos, at_sum, offset, low, high = self.live
        size = pos[:, None] - pos
        earlier, size = size > 0, np.maximum(size, 1)
        gap = at_sum[:, None] - at_sum
        centre = gap / size
        log_size = np.log(t - pos) if self.length != "none" else np.zeros(len(pos))
        tolerance = MARGIN * (1 + np.abs(offset).max())
        square = (offset[:, None] - (offset - gap * centre) - (log_size - log_size[:, None]) - tolerance) / size
        reach, lost = np.sqrt(np.maximum(square, 0.0)), earlier & (square > 0)
        begin, end = np.where(lost, centre - reach, np.inf), np.where(lost, centre + reach, -np.inf)
        order = np.argsort(begin, axis=1)
        begin, end = np.take_along_axis(begin, order, 1), np.take_along_axis(end, order, 1)
        edge = np.full((len(pos), 1), np.inf)
        # what is left between the intervals, in order
        left = np.maximum(np.concatenate([-edge, np.maximum.accumulate(end, axis=1)], axis=1), low[:, None])
        right = np.minimum(np.concatenate([begin, edge], axis=1), high[:, None])
        some = left <= right
        keep = some.any(axis=1)
        low, high = np.where(some, left, np.inf).min(axis=1), np.where(some, right, -np.inf).max(axis=1)
        self.live = tuple(c[keep] for c in (pos, at_sum, offset, low, high))

    def path(self, t: int) -> list[int]:
        """Change points of the best solution for the first t points, ascending and counted along the series."""
        found = []
        while (t := int(self.last[t])) not in self.trails:
            found.append(t + self.origin)
        return self.trails[t] + found[::-1]

    def _trail(self, start: int) -> list[int]:
        """Change points up to a start, itself included."""
        if start in self.trails:
            return self.trails[start]
        return [*self.path(start), start + self.origin]

    def state(self, base: int) -> dict:
        """What the search needs to go on after ``done``, however long the series was until there.

        ``shared`` are the change points that all starts which can still win have in
        common, ``settled`` is the last of them (or ``base``). The live starts follow, with the changes
        that lead to each since then. Sums are counted from here on, costs from the least.
        """
        known = [np.concatenate(c) for c in zip(self.live, self.queue, strict=True)]
        trails = [self._trail(int(s)) for s in known[0]]
        shared = sorted(reduce(set.__and__, map(set, trails)))
        settled = shared[-1] if shared else base
        sum1, sum2 = self.sum1[self.done], self.sum2[self.done]
        offsets = known[2] + sum2
        return {
            "shift": float(self.shift),
            "shared": shared,
            "settled": settled,
            "starts": (known[0] + self.origin).tolist(),
            "sums": (known[1] - sum1).tolist(),
            "offsets": (offsets - offsets.min()).tolist(),
            "lows": known[3].tolist(),
            "highs": known[4].tolist(),
            "trails": [[c for c in trail if c > settled] for trail in trails],
        }


def find_changes(x, penalty="MBIC", length="relative", sigma2=1.0, min_len=1, n_series=None):
    """Change points (number of points before each change) of one short series.

    A series with a value that is not finite cannot be searched and is one segment, as is one of fewer than
    ten points.
    """
    if len(x) < MIN_POINTS or not np.isfinite(np.asarray(x, dtype=float)).all():
        return []
    search = _Search(x, n_series or len(x), penalty, length, sigma2, min_len).run_to(len(x))
    return search.path(search.n)


def find_many(x, starts, penalty="MBIC", length="relative", sigma2=1.0, min_len=1) -> list[np.ndarray]:
    """:func:`find_changes` of many series that follow one another in ``x``, each from its row in ``starts`` on.

    Short series are searched side by side, an end of each at a time, over all starts: for some dozens of ends that costs less
    than to prune. Costs are summed in the same order as in the search of one series, which decides ties.
    """
    bounds = np.append(starts, len(x))
    sizes = np.diff(bounds)
    found = [np.zeros(0, np.int64)] * len(starts)
    fit = sizes >= MIN_POINTS
    if len(starts):
        fit &= np.logical_and.reduceat(np.isfinite(x), starts)
    side = []
    for i in np.flatnonzero(fit).tolist():
        of = x[bounds[i] : bounds[i + 1]]
        ends = np.append(np.flatnonzero(np.diff(of)) + 1, len(of)) if min_len <= 1 else None
        if ends is None or len(ends) > SIDE_BY_SIDE:
            found[i] = np.array(find_changes(of, penalty, length, sigma2, min_len), np.int64)
        else:
            shifted = (of - of[0]) / np.sqrt(sigma2)
            side.append((len(ends), i, ends, np.concatenate(([0.0], np.cumsum(shifted)))[ends]))
    side.sort(key=lambda s: s[:2])
    while side:
        taken = side[: max(1, SIDE_CELLS // side[0][0] ** 2)]
        del side[: len(taken)]
        for (m, i, ends, _), last in zip(taken, _side_by_side(taken, sizes, penalty, length), strict=True):
            cuts = []
            while m := int(last[m]):
                cuts.append(ends[m - 1])
            found[i] = np.array(cuts[::-1], np.int64)
    return found


def _side_by_side(taken: list[tuple], sizes: np.ndarray, penalty, length: str) -> np.ndarray:
    """Where the last segment starts, by the number of ends that it covers, for each series."""
    wide = taken[-1][0]
    pos, at_sum = np.tile(np.arange(wide + 1), (len(taken), 1)), np.zeros((len(taken), wide + 1))
    for row, (m, _, ends, sums) in enumerate(taken):
        pos[row, 1 : m + 1], at_sum[row, 1 : m + 1] = ends, sums
        pos[row, m + 1 :] += ends[-1]  # no series ends here, what is found does not count
    of = [int(sizes[i]) for _, i, _, _ in taken]
    fixed = np.array([penalty_value(penalty, n) for n in of])
    log_n = np.array([float(np.log(n)) for n in of])[:, None]
    logs = np.log(np.maximum(np.arange(pos.max() + 1), 1))
    offset, last = np.full(pos.shape, np.inf), np.zeros(pos.shape, dtype=np.int64)
    offset[:, 0] = -fixed
    for j in range(1, wide + 1):
        size, gap = pos[:, j : j + 1] - pos[:, :j], at_sum[:, j : j + 1] - at_sum[:, :j]
        square = gap * gap / size
        extra = 0.0 if length == "none" else logs[size] - (log_n if length == "relative" else 0.0)
        total = offset[:, :j] - square + extra
        new = (j - 1) // STEP * STEP + 1  # starts among the ends that are settled together
        if new < j:
            total[:, new:] = ((extra - square) + offset[:, :j])[:, new:]
        last[:, j] = total.argmin(axis=1)
        offset[:, j] = total.min(axis=1) + fixed
    return last


def _length_of(penalty, length):
    if length is not None:
        return length
    return "relative" if penalty == "MBIC" else "none"


def changepoints(
    df: DataFrame,
    o: Ordering,
    value: str,
    penalty: str | float = "MBIC",
    length: str | None = None,
    sigma2: float = 1.0,
    min_len: int = 1,
    out: str = "segment_id",
    chunk_rows: int = CHUNK_ROWS,
    overlap_rows: int = OVERLAP_ROWS,
    checkpoint=cut,
    break_on_gap_sec: float | None = None,
) -> DataFrame:
    """Number the segments between changes of the mean, 1..m along each key.

    Series with up to ``chunk_rows + overlap_rows`` rows are solved in one task
    each. Longer ones are solved in overlapping chunks that are joined or continued,
    with the answer of the whole series; see :func:`_long_series`. Fewer than ten rows
    are one segment, and so is a series with a value that is null or not finite, which no search can
    order. A segment may span a night, a reboot or a gap, unless ``break_on_gap_sec`` starts a new one
    after gaps longer than that.
    """
    check_penalty(penalty)
    if break_on_gap_sec is not None:
        options = dict(penalty=penalty, length=length, sigma2=sigma2, min_len=min_len, chunk_rows=chunk_rows)
        return _between_gaps(df, o, value, break_on_gap_sec, out, overlap_rows=overlap_rows, **options)
    if chunk_rows <= overlap_rows:
        raise ValueError("chunk_rows must be more than overlap_rows")
    settings = (penalty, _length_of(penalty, length), sigma2, min_len)
    limit = chunk_rows + overlap_rows
    rows = df.drop(BLOCK)
    x = F.col(value).cast("double")
    bad = F.max(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))).alias("_bad")
    long_keys = rows.groupBy(*o.keys).agg(F.count(F.lit(1)).alias("_n"), bad).where(F.col("_n") > limit)
    long_keys = checkpoint(long_keys)
    if long_keys.isEmpty():
        return _short_series(rows, o, value, settings, out)
    # at most rows / limit entries
    kept, unfit = (F.broadcast(long_keys.where(test).select(*o.keys)) for test in (~F.col("_bad"), F.col("_bad")))
    short = rows.join(F.broadcast(long_keys), list(o.keys), "left_anti")
    whole = rows.join(unfit, list(o.keys), "left_semi").withColumn(out, F.lit(1))
    long = rows.join(kept, list(o.keys), "left_semi")
    solved = _long_series(long, long_keys.where(~F.col("_bad")), o, value, settings, out, chunk_rows, overlap_rows, checkpoint)
    return _short_series(short, o, value, settings, out).unionByName(solved).unionByName(whole)


def _between_gaps(df: DataFrame, o: Ordering, value: str, gap_sec: float, out: str, **options) -> DataFrame:
    """Segments of each stretch between long gaps, numbered on along the key."""
    limit = F.lit(int(gap_sec * 1e6))
    parts = cut(steps(df, o, micros(o.time), lambda a, b: b - a > limit, {"_part": lambda t: F.lit(True)}).drop(BLOCK))
    solved = cut(changepoints(parts, o.within("_part"), value, out=out, **options))
    counts = solved.groupBy(*o.keys, "_part").agg(F.max(out).alias("_m"))
    before = Window.partitionBy(*o.keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*o.keys, "_part", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_offset"))
    numbered = solved.join(offsets, [*o.keys, "_part"])
    return numbered.withColumn(out, (F.col(out) + F.col("_offset")).cast("int")).drop("_part", "_offset")


def _short_series(rows: DataFrame, o: Ordering, value: str, settings: tuple, out: str) -> DataFrame:
    penalty, length, sigma2, min_len = settings
    fields = [f for f in rows.schema.fields if f.name != out]
    names = [f.name for f in fields]
    schema = T.StructType([*fields, T.StructField(out, T.IntegerType())])

    def label(table: pa.Table, starts: np.ndarray) -> pa.Table:
        x = table[value].cast(pa.float64()).to_numpy()
        cuts = find_many(x, starts, penalty, length, sigma2, min_len)
        step, here = np.zeros(len(x), np.int32), [at + c for at, c in zip(starts, cuts, strict=True)]
        step[np.concatenate(here)] = 1
        total = np.cumsum(step)
        before = np.repeat(total[starts], np.diff(np.append(starts, len(x))))
        return table.select(names).append_column(out, pa.array((total - before + 1).astype(np.int32)))

    return map_groups(rows, o.keys, [o.time, *o.ties], label, schema)


STATE = (
    "shift double, shared array<long>, settled long, starts array<long>, sums array<double>, offsets array<double>, "
    "lows array<double>, highs array<double>, trails array<array<long>>"
)
SOLVED = f"_n long, _from long, _to long, changes array<long>, low long, head_shared array<long>, state struct<{STATE.replace(' ', ':').replace(',:', ', ')}>, state_of long"


def _long_series(rows, lengths, o, value, settings, out, chunk_rows, overlap_rows, checkpoint):
    """Solve long series in chunks, none of which is ever larger.

    Chunk c covers its own rows and the first ``overlap_rows`` of the next chunk. All are first solved
    at once, each as if the series began with it. Where all starts that are live at the end of an overlap
    share a change point z in both neighbours, every later solution goes through z in both, and what
    follows z does not depend on what came before: the changes up to z come from the left chunk and those after it from
    the right one. A chunk that shares none with its left neighbour, say in a long stretch without a change, is
    solved again from the live starts that the neighbour was left with, a table with a row per
    chunk. That is repeated until every chunk goes on from its neighbour in one way or the other.
    """
    keys = list(o.keys)
    cell = F.floor((F.col("_pos") - 1) / chunk_rows)
    numbered = running(rows, o, position="_pos").drop(BLOCK).withColumn("_cell", cell)
    numbered = checkpoint(numbered, by="_cell")
    n_chunks = F.greatest(F.lit(1), F.floor(F.col("_n") / chunk_rows))
    last = F.col("_chunk") == n_chunks - 1
    layout = checkpoint(
        lengths.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), n_chunks - 1))).select(
            *keys,
            "_n",
            (F.col("_chunk") * chunk_rows).alias("_from"),
            F.when(last, F.col("_n")).otherwise((F.col("_chunk") + 1) * chunk_rows).alias("_to"),
        )
    )
    joint = Window.partitionBy(*keys).orderBy("_from")
    solved = checkpoint(_solve_chunks(numbered, layout, None, keys, value, settings, chunk_rows, overlap_rows))
    while True:
        left = F.lag("state").over(joint)
        common = F.array_max(F.array_intersect("head_shared", left["shared"]))
        checked = solved.withColumns({"_z": common, "_left": left})
        # a chunk that was continued stands as long as the state it was continued from does
        goes_on = F.when(F.col("state_of").isNull(), F.col("_z").isNotNull()).otherwise(F.col("state_of") == F.xxhash64("_left"))
        checked = checked.withColumn("_settled", (F.col("_from") == 0) | F.coalesce(goes_on, F.lit(False)))
        open_chunks = checked.withColumn("_next", ~F.col("_settled") & F.lag("_settled").over(joint)).where("_next")
        open_chunks = checkpoint(open_chunks.select(*keys, "_n", "_from", "_to", "_left"))
        if open_chunks.isEmpty():
            break
        again = _solve_chunks(numbered, open_chunks.drop("_left"), open_chunks, keys, value, settings, chunk_rows, overlap_rows)
        solved = checkpoint(solved.join(open_chunks, [*keys, "_from"], "left_anti").unionByName(again))
    low = F.when(F.col("_from") == 0, 0).otherwise(F.coalesce("low", "_z"))
    checked = checked.withColumn("_low", low)
    high = F.coalesce(F.lead("_low").over(joint), F.col("_n"))
    bounds = checked.select(*keys, "_low", high.alias("_high"), "changes")
    cuts = bounds.select(*keys, "_low", "_high", F.explode("changes").alias("_cut"))
    cuts = cuts.where((F.col("_cut") > F.col("_low")) & (F.col("_cut") <= F.col("_high")))
    # a change after _cut points starts a segment at row _cut + 1
    starts = cuts.select(*keys, (F.col("_cut") + 1).alias("_pos"), F.lit(1).alias("_starts"))
    marked = numbered.drop("_cell").join(starts, [*keys, "_pos"], "left")
    counted = running(marked, o, sums={out: F.coalesce(F.col("_starts"), F.lit(0))})
    return counted.withColumn(out, (F.col(out) + 1).cast("int")).drop("_pos", "_starts", BLOCK)


def _solve_chunks(numbered, layout, states, keys, value, settings, chunk_rows, overlap_rows) -> DataFrame:
    """A row per chunk of the layout: its changes, what it shares with its neighbours, and its live starts.

    With ``states`` (keys, _from, _left) the chunks go on from their neighbours' live starts, after the overlap.
    """
    penalty, length, sigma2, min_len = settings
    # rows meet the chunks on a coarse position cell, then on the exact range
    begin = F.col("_from") + (overlap_rows if states is not None else 0)
    reach = F.least(F.col("_to") + overlap_rows, F.col("_n"))
    spans = layout.withColumns({"_begin": begin, "_reach": reach}).withColumn(
        "_cell", F.explode(F.sequence(F.floor(F.col("_begin") / chunk_rows), F.floor((F.col("_reach") - 1) / chunk_rows)))
    )
    rows = numbered
    if states is not None:  # a directory per cell: the others are not read
        rows = rows.join(F.broadcast(spans.select("_cell").distinct()), "_cell", "left_semi")
    placed = rows.select(*keys, "_cell", "_pos", F.col(value).cast("double").alias("_x")).join(spans, [*keys, "_cell"])
    placed = placed.where((F.col("_pos") > F.col("_begin")) & (F.col("_pos") <= F.col("_reach"))).drop("_cell", "_reach")
    fields = [f"`{numbered.schema[k].name}` {numbered.schema[k].dataType.simpleString()}" for k in keys]
    schema = T.StructType.fromDDL(", ".join([*fields, SOLVED]))

    def solve(pdf: pd.DataFrame, state: dict | None) -> pd.DataFrame:
        pdf = pdf.sort_values("_pos", kind="stable")
        n, first, end, origin = (int(pdf[c].iloc[0]) for c in ("_n", "_from", "_to", "_begin"))
        search = _Search(pdf["_x"].to_numpy(), n, penalty, length, sigma2, min_len, state, origin)
        row = {**{k: pdf[k].iloc[0] for k in keys}, "_n": n, "_from": first, "_to": end, "low": None, "head_shared": None, "state": None, "state_of": None}
        if state is not None:
            row |= {"low": state["settled"], "state_of": state["hash"]}
        elif first > 0:
            row["head_shared"] = [c for c in search.run_to(overlap_rows).state(first)["shared"] if c > first]
        search.run_to(search.n)
        if end < n:
            row["state"] = search.state(row["low"] or 0)
            until = row["state"]["settled"]
            row["changes"] = [c for c in search._trail(row["state"]["starts"][0] - origin) if c <= until]
            row["state"]["shared"] = [c for c in row["state"]["shared"] if c > end]
        else:  # the last chunk ends the series
            row["changes"] = search.path(search.n)
        return pd.DataFrame([row], columns=schema.names).astype({c: "Int64" for c in ("low", "state_of")})

    if states is None:
        return spread(placed, [*keys, "_from"]).groupBy(*keys, "_from").applyInPandas(lambda pdf: solve(pdf, None), schema)
    left = states.select(*keys, "_from", "_left.*", F.xxhash64("_left").alias("hash")).groupBy(*keys, "_from")
    again = spread(placed, [*keys, "_from"]).groupBy(*keys, "_from").cogroup(left)
    return again.applyInPandas(lambda pdf, state: solve(pdf, state.to_dict("records")[0]), schema)


def segment_medians(df: DataFrame, keys, value: str, segment: str = "segment_id") -> DataFrame:
    """Median of the signal per segment."""
    return histogram_quantile(df, [*keys, segment], F.col(value), 0.5, "seg_median")
