import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nidalytics.operators import segment, smooth
from nidalytics.plans import stages
from nidalytics.plans.ordered import Ordering

O = Ordering(("k",), "t", ("i",))


def test_many_small_groups_take_few_calls(spark):
    rows = spark.range(6000).select(F.when(F.col("id") % 600 > 0, F.col("id") % 600).alias("k"), F.col("id").alias("t"))
    schema = T.StructType.fromDDL("groups long, bad long, rows long")

    def count(table, starts):
        k, t = table["k"].to_pylist(), table["t"].to_pylist()
        bounds = [*starts.tolist(), len(k)]
        bad = sum(len(set(k[a:b])) != 1 or t[a:b] != sorted(t[a:b]) for a, b in zip(bounds, bounds[1:]))
        return pa.table({"groups": [len(starts)], "bad": [bad], "rows": [len(k)]}, pa.schema([(c, pa.int64()) for c in schema.names]))

    calls = stages.map_groups(rows, ["k"], ["t"], count, schema).collect()
    assert len(calls) <= 4 and sum(c["groups"] for c in calls) == 600
    assert sum(c["bad"] for c in calls) == 0 and sum(c["rows"] for c in calls) == 6000


def test_group_longer_than_a_hand_over(spark, monkeypatch):
    monkeypatch.setattr(stages, "GROUP_ROWS", 50)
    rows = spark.range(50_000).select(F.when(F.col("id") < 20_000, 0).otherwise(F.col("id") % 700).alias("k"), "id")
    schema = T.StructType.fromDDL("k int, n long")

    def sizes(table, starts):
        return pa.table({"k": table["k"].take(pa.array(starts)).cast(pa.int32()), "n": np.diff(np.append(starts, len(table)))})

    got = stages.map_groups(rows, ["k"], ["id"], sizes, schema).collect()
    want = rows.groupBy("k").count().collect()
    assert sorted((r["k"], r["n"]) for r in got) == sorted((r["k"], r["count"]) for r in want)


@pytest.mark.parametrize("nulls", ["propagate", "skip"])
def test_medians_of_many_short_series_of_several_widths(spark, nulls):
    rng = np.random.default_rng(3)
    rows, widths = [], {k: [3, 5, 9, 31][k % 4] for k in range(60)}
    for k in range(60):
        for i in range(int(rng.integers(1, 25))):
            rows.append((k if k else None, i, i, None if rng.random() < 0.1 else float(rng.integers(0, 50))))
    df = spark.createDataFrame(rows, "k long, t long, i long, v double")
    width = F.coalesce(F.get(F.lit([widths[k] for k in range(60)]), F.col("k").cast("int")), F.lit(widths[0]))
    got = {(r["k"], r["t"]): r["m"] for r in smooth.sliding_median(df, O, F.col("v"), width, nulls, "m").collect()}
    series = {}
    for k, t, _, v in rows:
        series.setdefault(k, []).append(v)
    for k, x in series.items():
        w = widths[k or 0]
        for t in range(len(x)):
            frame = x[max(t - w // 2, 0) : t + w // 2 + 1]
            known = [v for v in frame if v is not None]
            none = len(frame) < w or not known or (nulls == "propagate" and len(known) < w)
            assert got[k, t] == (None if none else np.median(known))


@pytest.mark.parametrize("settings", [("MBIC", "relative"), ("BIC", "none"), (5.0, "absolute"), ("None", "none")])
def test_series_searched_side_by_side(settings):
    rng = np.random.default_rng(7)
    parts = []
    for i in range(300):
        x = np.cumsum(rng.random(int(rng.integers(1, 170))) < 0.1) * 5.0
        x = np.round(x + rng.normal(size=len(x)), 0 if i % 3 == 0 else 9)
        if i % 40 == 0:
            x[-1] = np.nan
        parts.append(x)
    starts = np.cumsum([0, *map(len, parts[:-1])])
    got = segment.find_many(np.concatenate(parts), starts, *settings)
    assert [list(c) for c in got] == [list(segment.find_changes(x, *settings)) for x in parts]
