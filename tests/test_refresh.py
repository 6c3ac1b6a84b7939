"""Bouts and days after new corrections against a full run."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from nidalytics.operators import bouts as bt
from nidalytics.operators import correct, refresh, summary
from nidalytics.plans.ordered import Ordering

O = Ordering(("k",), "t", ("i",))
START = dt.datetime(2026, 4, 15)
ROWS = "k string, t timestamp, i long, tof_smooth_r double, state_auto string, state_corrected string, correction_source string"
BOXES = "k string, seq long, t_min timestamp, t_max timestamp, d_min double, d_max double, action string"


def series(rng, keys, n, step, ties=False):
    rows = []
    for k in keys:
        state, t = None, START
        for i in range(n):
            if rng.random() < 0.15:
                state = rng.choice(["present", "absent", "uncertain", None])
            t += dt.timedelta(seconds=rng.choice([0, step, step, 3 * step]) if ties else step)
            rows.append((k, t, i, rng.choice([None, 10.0, 50.0, 90.0, 90.0]), state, state, "auto" if state else None))
    return rows


def box(rng, k, seq, n, step):
    a = START + dt.timedelta(seconds=rng.randrange(n * step))
    length = rng.choice([0, 5 * step, 30 * step])
    lo = rng.choice([0.0, 40.0])
    return (k, seq, a, a + dt.timedelta(seconds=length), lo, lo + 60, rng.choice(["present", "absent", "uncertain", "reset"]))


def full(rows, boxes):
    fixed = correct.apply_corrections(rows, boxes, O)
    table = bt.bouts(fixed, O)
    return table, summary.day_summary(fixed, table, ["k"], "t", None)


def held(df):
    names = sorted(df.columns)
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in map(r.__getitem__, names)) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed, step, ties", [(0, 600, False), (1, 3600, True), (2, 60, True)])
def test_equal_to_a_full_run(spark, seed, step, ties):
    rng = random.Random(seed)
    n = 150
    rows = spark.createDataFrame(series(rng, "abcd", n, step, ties) + [("null", START, 0, 1.0, None, None, None)], ROWS).repartition(3).cache()
    first = [box(rng, k, s, n, step) for s, k in enumerate("aabbd")]
    fresh = [box(rng, k, 10 + s, n, step) for s, k in enumerate("aaabcc")] + [("null", 30, START, START, 0.0, 9.0, "absent"), ("none", 31, START, START, 0.0, 9.0, "absent")]
    old_boxes, every = (spark.createDataFrame(b, BOXES) for b in (first, first + fresh))
    new_boxes = spark.createDataFrame(fresh, BOXES)
    table, days = full(rows, old_boxes)
    want = full(rows, every)
    # readings as stored before any correction, or with the earlier ones in them
    stored = correct.apply_corrections(rows, old_boxes, O) if seed % 2 else rows
    got = refresh.refresh(stored, table, days, new_boxes, every, O)
    keys = ["a", "b", "c", "null"]
    for part, wanted in zip(("bouts", "days"), want, strict=True):
        mine = got[part]
        assert {r[0] for r in mine.select("k").distinct().collect()} <= set(keys)
        assert held(mine) == held(wanted.where(F.col("k").isin(keys)).select(*mine.columns)), part


def test_reads_only_the_slices(spark):
    rng = random.Random(5)
    rows = spark.createDataFrame(series(rng, "ab", 3000, 60), ROWS).cache()
    none = spark.createDataFrame([], BOXES)
    table, days = full(rows, none)
    t = START + dt.timedelta(hours=25)
    boxes = spark.createDataFrame([("a", 1, t, t + dt.timedelta(minutes=10), 0.0, 100.0, "absent")], BOXES)
    seen = refresh.refresh(rows, table, days, boxes, boxes, O)["readings"]
    assert 10 <= seen.count() < 200
    parts = refresh.slices(table, boxes, ["k"]).collect()
    assert len(parts) == 1 and parts[0]["lo"] < t and parts[0]["hi"] > t + dt.timedelta(minutes=10)


def test_no_boxes_and_no_bouts(spark):
    rows = spark.createDataFrame([("a", START, 0, 5.0, None, None, None)], ROWS)
    none = spark.createDataFrame([], BOXES)
    table, days = full(rows, none)
    got = refresh.refresh(rows, table, days, none, none, O)
    assert got["bouts"].count() == got["days"].count() == got["readings"].count() == 0
    boxes = spark.createDataFrame([("a", 1, START, START, 0.0, 9.0, "present")], BOXES)
    got = refresh.refresh(rows, table, days, boxes, boxes, O)
    assert [r["bout_id"] for r in got["bouts"].collect()] == [1] and got["days"].count() == 1


def test_long_boxes_touch_few_cells(spark):
    rows = spark.createDataFrame([("a", START + dt.timedelta(days=d), d, 5.0, None, None, None) for d in range(400)], ROWS)
    boxes = [("a", 1, START, START + dt.timedelta(days=365), 0.0, 9.0, "absent"), ("a", 2, START, START, 0.0, 9.0, "present")]
    hits = correct.box_select(rows, spark.createDataFrame(boxes, BOXES), O, "tof_smooth_r")
    assert hits.where("seq = 1").count() == 366 and hits.where("seq = 2").count() == 1


def test_the_box_on_top_of_a_stack_counts(spark):
    rng = random.Random(11)
    rows = [(k, START + dt.timedelta(hours=rng.randrange(24 * 360)), i, rng.choice([None, 10.0, 50.0, 90.0]), "present", "present", "auto") for k in "ab" for i in range(150)]
    boxes = [("a", 0, START, START + dt.timedelta(days=366), 0.0, 100.0, "uncertain")]
    for seq in range(1, 400):
        a = START + dt.timedelta(hours=rng.randrange(24 * 300))
        lo = rng.choice([10.0, 10.5, 50.0, 90.0])
        boxes.append(("a", seq, a, a + dt.timedelta(days=rng.choice([0, 1, 60])), lo, lo + rng.choice([0, 40]), rng.choice(["absent", "reset", "uncertain"])))
    boxes += [("a", 7, START + dt.timedelta(days=9), START, 0.0, 99.0, "absent"), ("c", 1, START, START, 0.0, 9.0, "absent")]
    got = correct.apply_corrections(spark.createDataFrame(rows, ROWS), spark.createDataFrame(boxes, BOXES), O).collect()
    assert len(got) == 300
    for r in got:
        over = [(b[1], b[6]) for b in boxes if b[0] == r["k"] and b[2] <= r["t"] <= b[3] and r["tof_smooth_r"] is not None and b[4] <= r["tof_smooth_r"] <= b[5]]
        action = max(over)[1] if over else None
        assert r["state_corrected"] == ("present" if action in (None, "reset") else action)
        assert r["correction_source"] == ("manual" if action not in (None, "reset") else "auto")
    slabs = correct.overlay(correct.valid_boxes(spark.createDataFrame(boxes, BOXES)), ["k"]).where("k = 'a'").orderBy("t_min").collect()
    assert all(a["t_max"] < b["t_min"] for a, b in zip(slabs, slabs[1:]))


def test_no_corrections(spark):
    rows = spark.createDataFrame([("a", START, 0, 5.0, None, None, None)], ROWS)
    assert correct.apply_corrections(rows, spark.createDataFrame([], BOXES), O).collect() == rows.collect()
