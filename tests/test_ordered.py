"""Blocked windows give the same as plain windows, however the keys are cut."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from nidalytics.operators import bouts as bt
from nidalytics.operators import clean, smooth
from nidalytics.operators.classify import distributed_mixtures, fit_mixture, median_counts, mixture_posteriors, two_means
from nidalytics.plans import ordered
from nidalytics.plans.ordered import BLOCK, Ordering, add_blocks, running, steps
from nidalytics.plans.quantiles import exact_quantiles, histogram_quantile

O = Ordering(("k",), "t", ("i",))


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(7)
    rows = []
    for i in range(1500):
        key = "hot" if i % 2 else rng.choice(["a", "b", "c"])
        state = rng.choice([None, None, "present", "absent", "absent"])
        rows.append((key, rng.randrange(40_000), i, state, rng.choice([None, 1.5, 2.0, 7.25]), rng.random() < 0.05))
    # a key that starts without a state, and a cut in time with no rows
    rows += [("late", 10 * i, 9000 + i, None if i < 70 else "present", 1.0, i == 0) for i in range(100)]
    rows += [("late", 2_000_000 + 10 * i, 9500 + i, "absent", 2.0, False) for i in range(100)]
    df = spark.createDataFrame(rows, "k string, s long, i long, state string, v double, mark boolean")
    return df.withColumn("t", F.timestamp_seconds("s")).cache()


@pytest.fixture(params=[10_000_000, 25, 7])
def cut(request, series):
    return add_blocks(series, O, request.param)


def rows_of(df, *cols):
    return sorted(df.select("k", "i", *cols).collect(), key=lambda r: (r["k"], r["i"]))


def test_blocks_cut_long_keys_only(series):
    blocks = add_blocks(series, O, 300).groupBy("k").agg(F.count_distinct(BLOCK).alias("n")).collect()
    n = {r["k"]: r["n"] for r in blocks}
    assert n["hot"] > 1 and n["late"] == 0


def test_running(cut, series):
    w = Window.partitionBy("k").orderBy("t", "i")
    upto, prior = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    got = running(
        cut,
        O,
        sums={"total": F.col("v")},
        lags={"prev": F.col("state")},
        fills={"filled": F.col("state")},
        priors={"prior": F.col("v")},
        since={"n_since": (F.col("mark"), (~F.col("mark")).cast("int"))},
        position="pos",
    )
    marks = F.sum(F.col("mark").cast("int")).over(upto)
    want = series.select(
        "*",
        F.coalesce(F.sum("v").over(upto), F.lit(0)).alias("total"),
        F.lag("state").over(w).alias("prev"),
        F.last("state", ignorenulls=True).over(upto).alias("filled"),
        F.last("v", ignorenulls=True).over(prior).alias("prior"),
        F.row_number().over(w).alias("pos"),
        marks.alias("_g"),
    ).withColumn(
        "n_since",
        F.sum((~F.col("mark")).cast("int")).over(
            Window.partitionBy("k", "_g").orderBy("t", "i").rowsBetween(Window.unboundedPreceding, 0)
        ),
    )
    cols = ("total", "prev", "filled", "prior", "n_since", "pos")
    assert rows_of(got, *cols) == rows_of(want, *cols)


@pytest.mark.parametrize("bridge", [True, False])
def test_runs_and_bouts(cut, series, bridge):
    pdf = series.toPandas().sort_values(["k", "t", "i"])
    expect = {}
    for k, g in pdf.groupby("k"):
        s = g["state"].where(g["state"].notna(), None)
        s = s.ffill() if bridge else s
        s = s.fillna("__")
        run = (s != s.shift().fillna(s.iloc[0])).cumsum()
        real = g["state"].notna()
        order = {r: n + 1 for n, r in enumerate(dict.fromkeys(run[real]))}
        for i, r in zip(g["i"], run):
            expect[k, i] = (r, order.get(r))
    got = bt.state_runs(cut, O, "state", bridge)
    assert {(r["k"], r["i"]): (r["state_run"], r["bout_id"]) for r in got.collect()} == expect

    table = bt.bouts(cut.withColumn("x", F.col("v")), O, "state", "x", 60, bridge).toPandas()
    assert table["n_readings"].sum() == pdf["state"].notna().sum()
    for _, g in table.sort_values("bout_id").groupby("k"):
        assert list(g["bout_id"]) == list(range(1, len(g) + 1))
        assert g["bout_start"].is_monotonic_increasing
        if bridge:
            assert (g["state_corrected"] != g["state_corrected"].shift()).all()


def test_same_after_reshuffling(series):
    a = bt.bouts(add_blocks(series, O, 50), O, "state", "v")
    b = bt.bouts(add_blocks(series.repartition(13, F.rand(3)), O, 50), O, "state", "v")
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_steps_with_any_rule(cut, series):
    got = steps(cut, O, F.col("v"), lambda a, b: b - a > 4, {"up": lambda v: F.lit(True)})
    pdf = series.toPandas().sort_values(["k", "t", "i"])
    expect = {}
    for k, g in pdf.groupby("k"):
        last, n = None, 0
        for i, v in zip(g["i"], g["v"]):
            if not pd.isna(v):
                if last is not None and v - last > 4:
                    n += 1
                last = v
            expect[k, i] = n
    assert {(r["k"], r["i"]): r["up"] for r in got.collect()} == expect


@pytest.mark.parametrize("target", [10_000_000, 11])
def test_session_columns_equal_the_separate_operators(series, target, monkeypatch):
    boots = series.where("mark")
    rows = series.where("not mark")
    mixed_o = Ordering(("k",), "t", ("i",))
    monkeypatch.setattr(ordered.add_blocks, "__defaults__", (target,))
    one = clean.session_columns(rows, boots, mixed_o)
    three = clean.delta_seconds(clean.assign_session(rows, boots, mixed_o), mixed_o)
    three = running(three, mixed_o.within("session_id"), position="session_row")
    cols = ("session_id", "dt_sec", "session_row")
    assert rows_of(one, *cols) == rows_of(three, *cols)


def test_quantiles(series):
    pdf = series.toPandas()
    q = exact_quantiles(series, ["k"], F.col("s") / 7, {"a": 0.25, "b": 0.5, "c": 0.9}, grid=50.0).toPandas()
    want = (pdf["s"] / 7).groupby(pdf["k"]).quantile([0.25, 0.5, 0.9]).unstack()
    got = q.set_index("k")[["a", "b", "c"]].sort_index()
    assert abs(got.to_numpy() - want.sort_index().to_numpy()).max() < 1e-9
    h = histogram_quantile(series, ["k"], F.col("v"), 0.5, "m").toPandas().set_index("k")["m"].sort_index()
    assert list(h) == list(pdf.groupby("k")["v"].median().sort_index())


@pytest.fixture(scope="module")
def awkward(spark):
    """Undated rows, many rows at one time, bursts and a stray time, in one long key and in short ones."""
    rng = random.Random(11)
    rows = []
    for key in ("x", "y"):
        times = [None] * 60 + [5] * 300 + [1000 + i // 50 for i in range(400)] + [40_000_000]
        times += [rng.randrange(100_000) for _ in range(100)]
        rows += [(key, t, i, rng.choice([None, "present", "absent"]), rng.choice([None, 1.0, 6.0])) for i, t in enumerate(times)]
    rows.append(("z", None, 1, "present", 1.0))
    df = spark.createDataFrame(rows, "k string, s long, i long, state string, v double")
    return df.withColumn("t", F.timestamp_seconds("s")).cache()


@pytest.mark.parametrize("target", [3, 100])
def test_one_answer_at_every_size(awkward, target):
    def answers(df):
        run = running(
            df,
            O,
            sums={"total": F.col("v")},
            lags={"prev": F.col("state")},
            fills={"filled": F.col("state")},
            priors={"prior": F.col("v")},
            since={"n_since": (F.col("state") == "present", F.lit(1))},
            position="pos",
        )
        step = steps(df, O, F.col("v"), lambda a, b: b - a > 4, {"up": lambda v: F.lit(True)}, fill_to="f", first_to="h")
        one = rows_of(run, "total", "prev", "filled", "prior", "n_since", "pos")
        return one, rows_of(step, "up", "f", "h"), rows_of(bt.state_runs(df, O, "state"), "state_run", "bout_id")

    assert answers(add_blocks(awkward, O, target)) == answers(add_blocks(awkward, O, 10**9))


@pytest.mark.parametrize("target", [40, 100])
def test_no_slice_is_much_longer_than_asked(awkward, target):
    sizes = add_blocks(awkward, O, target).where(f"{BLOCK} IS NOT NULL").groupBy("k", BLOCK).count()
    assert max(r["count"] for r in sizes.collect()) <= 2 * target


def test_rolling_median_does_not_depend_on_cuts(awkward, monkeypatch):
    def smoothed():
        return rows_of(smooth.rolling_median(awkward, O, F.col("v"), 5, "skip", "m", slice_rows=40), "m")

    want = smoothed()
    monkeypatch.setattr(ordered, "TARGET_ROWS", 30)
    assert smoothed() == want


def test_wide_groups_are_ranked_by_cells(spark):
    rng = np.random.default_rng(5)
    parts = [("wide", rng.random(5000)), ("signed", rng.normal(0, 1e3, 3001)), ("few", np.repeat([1.0, 2.5, 2.5, 9.0], 50)), ("one", [4.25])]
    frame = pd.DataFrame([(k, float(v)) for k, values in parts for v in values] + [("wide", None)], columns=["k", "v"])
    series = spark.createDataFrame(frame).where("NOT isnan(v)")
    want = {k: float(np.median(values)) for k, values in parts}
    for many in (1, 100, 2**17):
        got = histogram_quantile(series, ["k"], F.col("v"), 0.5, "m", many=many).collect()
        assert {r.k: r.m for r in got} == pytest.approx(want, rel=1e-14)


def test_two_means_of_many_distinct_values(spark):
    rng = np.random.default_rng(6)
    values = {"near": np.concatenate([rng.normal(90, 2, 3000), rng.normal(130, 3, 1000)]), "signed": rng.normal(0, 5, 2001), "pair": np.array([1.0, 7.0])}
    rows = spark.createDataFrame([(k, float(v)) for k, vs in values.items() for v in vs], "k string, seg_median double")
    got = {r.k: (r.centre_lo, r.centre_hi) for r in two_means(rows, ["k"]).collect()}
    for k, vs in values.items():
        x = np.sort(vs)
        spread = [((x[:i] - x[:i].mean()) ** 2).sum() + ((x[i:] - x[i:].mean()) ** 2).sum() for i in range(1, len(x))]
        i = int(np.argmin(spread)) + 1
        assert got[k] == pytest.approx((x[:i].mean(), x[i:].mean()), rel=1e-9)


@pytest.mark.parametrize(("equal_var", "many"), [(False, 120), (True, 0)])
def test_mixtures_of_many_distinct_values_are_those_of_few(spark, equal_var, many):
    """Scans of all medians give what one task per key gives, for keys that converge at different steps or degenerate."""
    rng = np.random.default_rng(8)
    values = {
        "apart": np.concatenate([rng.normal(90, 2, 300), rng.normal(130, 3, 100)]).round(1),
        "far": np.concatenate([rng.normal(1e6, 2, 200), rng.normal(1e6 + 14, 3, 150)]),
        "flat": np.array([7.0] * 5),
        "pair": np.array([1.0, 9.0]),
    }
    rows = spark.createDataFrame([(k, float(v)) for k, vs in values.items() for v in vs], "k string, seg_median double")
    few = {(r.k, r.seg_median): (r.p_low, r.p_high) for r in mixture_posteriors(rows, ["k"], equal_var).collect()}
    got = {(r.k, r.seg_median): (r.p_low, r.p_high) for r in mixture_posteriors(rows, ["k"], equal_var, many).collect()}
    assert got.keys() == few.keys() and {k for k, _ in got} == {"apart", "far", "pair"}
    assert all(got[at] == pytest.approx(few[at], abs=1e-6) for at in few)


def test_mixtures_that_do_not_converge_have_no_row(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, 250)
    counts = median_counts(spark.createDataFrame([("one", float(v)) for v in x], "k string, seg_median double"), ["k"])
    assert fit_mixture(x, np.ones(250), iterations=2) is None
    assert distributed_mixtures(counts, ["k"], iterations=2).count() == 0
    assert distributed_mixtures(counts.where("false"), ["k"]).count() == 0


@pytest.mark.parametrize("nulls", ["propagate", "skip"])
def test_sliding_median_takes_sizes_as_data(spark, nulls):
    rng = np.random.default_rng(9)
    sizes, rows = {"a": 1, "b": 3, "c": 9, "d": 101, "e": 7}, []
    for key in sizes:
        for i in range(3 if key == "e" else 400):
            v = None if rng.random() < 0.02 else float(rng.choice([0.0, -1.5, 2.25, float("inf"), *rng.normal(0, 9, 8)]))
            rows.append((key, i, v, f"note {i}", sizes[key]))
    df = spark.createDataFrame(rows, "k string, i int, v double, note string, size int").repartition(3)
    o = Ordering(("k",), "i")
    want = {}
    for key, k in sizes.items():
        vs = [r[2] for r in rows if r[0] == key]
        for i in range(len(vs)):
            frame = sorted(v for v in vs[max(0, i - k // 2) : i + k // 2 + 1] if v is not None)
            whole = k // 2 <= i < len(vs) - k // 2 and len(frame) > (k - 1 if nulls == "propagate" else 0)
            want[key, i] = (frame[(len(frame) - 1) // 2] + frame[len(frame) // 2]) / 2 if whole else None
    for slice_rows in (20, 250, 10**6):
        got = smooth.sliding_median(df, o, F.col("v"), F.col("size"), nulls, "m", slice_rows).collect()
        assert len(got) == len(rows) and {(r.k, r.i): r.m for r in got} == want
        assert all(r.note == f"note {r.i}" for r in got)
    wide = smooth.rolling_median(df.where("k = 'a'"), o, F.col("v"), 301, "skip", "m").where("m IS NOT NULL")
    assert wide.count() == 100
    assert smooth.sliding_median(df.where("false"), o, F.col("v"), F.col("size"), nulls, "m").count() == 0
    with pytest.raises(Exception, match="k must be odd"):
        smooth.sliding_median(df, o, F.col("v"), F.lit(4), nulls, "m").count()
