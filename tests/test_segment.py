import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from nidalytics.operators import segment
from nidalytics.plans.ordered import Ordering
from nidalytics.plans.stages import cut

O = Ordering(("k",), "t", ("i",))


def brute(x, penalty, length):
    """All previous starts for every end, without pruning."""
    n = len(x)
    if n < segment.MIN_POINTS:
        return []
    c1, c2 = np.concatenate([[0], np.cumsum(x)]), np.concatenate([[0], np.cumsum(np.square(x))])
    best, last = [-penalty], [0]
    for t in range(1, n + 1):
        s = np.arange(t)
        size = t - s
        cost = c2[t] - c2[s] - (c1[t] - c1[s]) ** 2 / size
        if length == "relative":
            cost = cost + np.log(size / n)
        elif length == "absolute":
            cost = cost + np.log(size)
        total = np.array(best) + cost
        best.append(total.min() + penalty)
        last.append(int(total.argmin()))
    found, t = [], n
    while last[t] > 0:
        t = last[t]
        found.append(t)
    return found[::-1]


def steppy(rng, n, jump=6.0, run=40):
    level, out = 0.0, []
    for _ in range(n):
        if rng.random() < 1 / run:
            level = rng.choice([0.0, jump, 2 * jump])
        out.append(round(level + rng.gauss(0, 1), 3))
    return out


@pytest.mark.parametrize("length", ["relative", "absolute", "none"])
@pytest.mark.parametrize("seed", range(4))
def test_pruned_search_is_optimal(length, seed):
    rng = random.Random(seed)
    x = steppy(rng, 300, jump=1.5 + seed)
    got = segment.find_changes(x, 3 * math.log(len(x)), length)
    assert got == brute(np.array(x), 3 * math.log(len(x)), length)


@pytest.mark.parametrize("length", ["relative", "absolute", "none"])
@pytest.mark.parametrize("seed", range(3))
def test_runs_of_equal_values(length, seed):
    rng = random.Random(seed)
    x = [float(v) for v in (rng.choice([90, 91, 92, 97]) for _ in range(60)) for _ in range(rng.randrange(1, 9))]
    got = segment.find_changes(x, 3 * math.log(len(x)), length)
    assert got == brute(np.array(x) - x[0], 3 * math.log(len(x)), length)


def test_boundaries():
    assert segment.find_changes([1.0] * 9) == []
    assert segment.find_changes([5.0] * 50) == []
    assert segment.find_changes([0.0] * 9) == []
    assert segment.find_changes([0.0] * 20 + [50.0] * 20) == [20]
    assert segment.find_changes([0.0] * 20 + [50.0] * 3 + [0.0] * 20, min_len=5, penalty=1.0) != [20, 23]
    assert all(b - a >= 5 for a, b in zip([0, 20], segment.find_changes([0.0] * 20 + [9.0] * 20, min_len=5)))


def frame(spark, series):
    rows = [(k, j, j, float(v)) for k, xs in series.items() for j, v in enumerate(xs)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, s long, i long, x double")
    return df.withColumn("t", F.timestamp_seconds("s"))


def test_short_series_in_spark(spark):
    series = {"a": steppy(random.Random(3), 120), "b": [2.0] * 30, "c": [1.0, 9.0] * 4}
    got = segment.changepoints(frame(spark, series), O, "x").toPandas()
    for k, xs in series.items():
        ids = got[got.k == k].sort_values("i")["segment_id"].to_numpy()
        cuts = brute(np.array(xs), 3 * math.log(len(xs)), "relative")
        assert list(np.flatnonzero(np.diff(ids)) + 1) == cuts
        assert ids[0] == 1


@pytest.mark.parametrize("length", ["relative", "absolute"])
def test_long_series_in_chunks_are_the_same(spark, length):
    rng = random.Random(5)
    flat = [round(rng.gauss(0, 1), 3) for _ in range(600)]
    series = {
        "steps": steppy(rng, 2300),
        "weak": steppy(rng, 1500, jump=1.2, run=150),
        # no change for longer than a chunk: neighbours must be merged
        "flat": steppy(rng, 300) + flat + steppy(rng, 500),
        "short": steppy(rng, 90),
        "whole": [float(round(v)) for v in steppy(rng, 1300, jump=4, run=60)],
    }
    got = segment.changepoints(
        frame(spark, series), O, "x", length=length, chunk_rows=200, overlap_rows=100, checkpoint=cut
    ).toPandas()
    assert len(got) == sum(map(len, series.values()))
    for k, xs in series.items():
        ids = got[got.k == k].sort_values("i")["segment_id"].to_numpy()
        assert list(np.flatnonzero(np.diff(ids)) + 1) == brute(np.array(xs), 3 * math.log(len(xs)), length), k
        assert ids[0] == 1 and set(np.diff(ids)) <= {0, 1}


def test_cost_is_not_above_any_merge(spark):
    x = np.array(steppy(random.Random(11), 400))
    cuts = segment.find_changes(x)
    edges = [0, *cuts, len(x)]

    def total(edges):
        pen = 3 * math.log(len(x)) * (len(edges) - 2)
        parts = [x[a:b] for a, b in zip(edges, edges[1:])]
        return pen + sum(((p - p.mean()) ** 2).sum() + math.log(len(p) / len(x)) for p in parts)

    assert all(total(edges) <= total(edges[:j] + edges[j + 1 :]) + 1e-9 for j in range(1, len(edges) - 1))


def test_break_on_gaps(spark):
    series = {"a": [0.0] * 40 + [30.0] * 20, "b": [1.0] * 30}
    df = frame(spark, series)
    late = F.when((F.col("k") == "a") & (F.col("i") >= 15), 1000).when(F.col("i") >= 25, 500).otherwise(0)
    df = df.withColumn("t", F.timestamp_seconds(F.col("s") + late))
    got = segment.changepoints(df, O, "x", break_on_gap_sec=600).toPandas().sort_values(["k", "i"])
    assert got[got.k == "a"]["segment_id"].tolist() == [1] * 15 + [2] * 25 + [3] * 20
    assert set(got[got.k == "b"]["segment_id"]) == {1}


def test_medians(spark):
    rows = [("a", 1, 3.0), ("a", 1, 1.0), ("a", 2, 4.0), ("a", 2, 5.0), ("a", 2, None)]
    df = spark.createDataFrame(rows, "k string, segment_id int, x double")
    got = {r["segment_id"]: r["seg_median"] for r in segment.segment_medians(df, ["k"], "x").collect()}
    assert got == {1: 2.0, 2: 4.5}


def searched(x, penalty, length, min_len, splits):
    """Changes found by a chain of searches, each continued from the live starts of the one before."""
    n, settled, state, found, at = len(x), 0, None, [], 0
    for until in [*splits, n]:
        search = segment._Search(x[at:until], n, penalty, length, 1.0, min_len, state, at).run_to(until - at)
        if until == n:
            return found + [c for c in search.path(until - at) if c > settled]
        state = search.state(settled)
        found += [c for c in state["shared"] if c > settled]
        assert state["settled"] == max([settled, *state["shared"]])
        settled, at = state["settled"], until
    return found


@pytest.mark.parametrize("min_len", [1, 2, 5])
@pytest.mark.parametrize("length", ["relative", "absolute", "none"])
@pytest.mark.parametrize("seed", range(3))
def test_a_search_goes_on_from_live_starts(seed, length, min_len):
    rng = random.Random(seed)
    flat = [rng.gauss(0, 1) for _ in range(400)]
    for x in (steppy(rng, 500, jump=1 + seed), flat, flat[:150] + steppy(rng, 200) + [v + 9 for v in flat[150:]]):
        x = np.round(x, 3)
        penalty = 2 * math.log(len(x))
        want = segment.find_changes(x, penalty, length, 1.0, min_len)
        if min_len == 1:
            assert want == brute(x - x[0], penalty, length)
        for splits in ([250], [100, 130, 131, 300], list(range(70, 390, 7))):
            assert searched(x, penalty, length, min_len, splits) == want


@pytest.mark.parametrize("length", ["relative", "absolute", "none"])
def test_few_starts_stay_live_without_a_change(length):
    x = np.random.default_rng(2).normal(size=60_000)
    search = segment._Search(x, len(x), 3 * math.log(len(x)), length, 1.0, 1)
    most = 0
    for t in range(2000, len(x) + 1, 2000):
        most = max(most, len(search.run_to(t).state(0)["starts"]))
    assert search.path(search.n) == [] and most < 300


def test_values_that_are_not_finite_are_one_segment(spark):
    rng = random.Random(8)
    series = {
        "long": [0.0] * 300 + [float("nan")] + [50.0] * 300,
        "short": [0.0] * 20 + [float("inf")] + [50.0] * 20,
        "good": [0.0] * 300 + [50.0] * 300,
        "null": steppy(rng, 40),
    }
    df = frame(spark, series)
    df = df.withColumn("x", F.when((F.col("k") == "null") & (F.col("i") == 7), None).otherwise(F.col("x")))
    got = segment.changepoints(df, O, "x", chunk_rows=200, overlap_rows=100).groupBy("k").agg(F.max("segment_id")).collect()
    assert dict(map(tuple, got)) == {"long": 1, "short": 1, "null": 1, "good": 2}


def test_a_long_stretch_without_a_change_is_never_one_group(spark, monkeypatch):
    rng = random.Random(9)
    flat = [round(rng.gauss(0, 1), 3) for _ in range(3000)]
    series = {"a": flat, "b": steppy(rng, 400) + flat[:1500] + steppy(rng, 600) + flat[1500:2600]}
    largest = []
    solve = segment._solve_chunks

    def counted(*args):
        made = solve(*args)
        largest.append(args[1].agg(F.max(F.col("_to") - F.col("_from"))).first()[0])
        return made

    monkeypatch.setattr(segment, "_solve_chunks", counted)
    got = segment.changepoints(frame(spark, series), O, "x", chunk_rows=250, overlap_rows=60).toPandas()
    assert len(largest) > 3 and max(largest) < 500  # continued chunk by chunk; the last one may be longer than others
    for k, xs in series.items():
        ids = got[got.k == k].sort_values("i")["segment_id"].to_numpy()
        assert list(np.flatnonzero(np.diff(ids)) + 1) == brute(np.array(xs), 3 * math.log(len(xs)), "relative"), k
