"""Boundary cases of the operators on literal rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from nidalytics.functions import scalars
from nidalytics.functions.solar import sun_times
from nidalytics.operators import bouts as bt
from nidalytics.operators import classify, clean, correct, night, reports, smooth, summary
from nidalytics.plans.ordered import Ordering
from nidalytics.sources import raw

K = ["d"]
O = Ordering(("d",), "t", ("i",))


def column(df, name, by="i"):
    return [r[name] for r in df.orderBy(by).collect()]


def series(spark, at, seconds, **columns):
    """One row per second offset, key "a"."""
    names = list(columns)
    rows = [("a", at(s), i, *[columns[n][i] for n in names]) for i, s in enumerate(seconds)]
    kinds = {bool: "boolean", int: "int", float: "double", str: "string"}
    types = [kinds[next((type(v) for v in columns[n] if v is not None), str)] for n in names]
    ddl = ", ".join(["d string, t timestamp, i int", *[f"{n} {k}" for n, k in zip(names, types)]])
    return spark.createDataFrame(rows, ddl)


# ------------------------------------------------------------ text and dates


def test_metadata(spark):
    text = "notes=a=b\r\nno separator\r\n\r\n eggs = 7 \r\neggs=8\r\ndevice_id=\r\n"
    df = spark.createDataFrame([("f", text)], "folder string, value string")
    row = raw.parse_metadata(df, ["folder"]).first()
    assert (row["notes"], row["eggs"], row["device_id"], row["species"]) == ("a=b", "7", "", None)
    empty = raw.parse_metadata(spark.createDataFrame([("g", "x")], "folder string, value string"), ["folder"])
    assert empty.first()["notes"] is None
    named = raw.name_deployments(spark.createDataFrame([("/r/box%201", ""), ("/r/b", "B")], "folder string, deployment_id string"))
    assert sorted(r["deployment_id"] for r in named.collect()) == ["B", "box 1"]


@pytest.mark.parametrize(
    "text, year",
    [("2026-04-15", 2026), ("15/04/2026", 2026), ("04/15/26", 2026), ("20260415", 2026), ("15.4.69", 1969), ("31/12/68", 2068),
     ("04/28/2025", 2025), (" ", None), ("", None), (None, None), ("soon", None), ("2026-13-45", None)],
)
def test_infer_year(spark, text, year):
    df = spark.createDataFrame([(text,)], "x string")
    assert df.select(scalars.infer_year(F.col("x"))).first()[0] == year


def test_coalesce_blank_and_numbers(spark):
    df = spark.createDataFrame([("", "b"), (None, "b"), ("a", "b"), (" ", "b")], "a string, b string")
    assert [r[0] for r in df.select(scalars.coalesce_blank(F.col("a"), F.col("b"))).collect()] == ["b", "b", "a", " "]
    df = spark.createDataFrame([(" 1.5 ",), ("NaN",), ("x",), ("",), (None,), ("-1",)], "a string")
    assert [r[0] for r in df.select(scalars.to_number(F.col("a"))).collect()] == [1.5, None, None, None, None, -1.0]


def test_sentence_case(spark):
    df = spark.createDataFrame([("n_tof_total",), ("Device_ID",)], "a string")
    assert [r[0] for r in df.select(scalars.sentence_case(F.col("a"))).collect()] == ["N tof total", "Device id"]


def test_deployment_window(spark):
    rows = [
        ("2026-04-15", None, "2026-05-01", "07:30:15"), ("", "06:00:00", " ", ""), ("04-15", "6:05", "15/05/2026", ""),
        ("2026-04-15", "nonsense", None, None),
    ]
    df = spark.createDataFrame(rows, "deployment_date string, deployment_time string, retrieval_date string, retrieval_time string")
    got = clean.deployment_window(df.withColumn("y", F.lit(2026)), "y").collect()
    assert [(r["trim_start"], r["trim_end"]) for r in got] == [
        (dt.datetime(2026, 4, 15), dt.datetime(2026, 5, 1, 7, 30, 15)),
        (None, None),
        (dt.datetime(2026, 4, 15, 6, 5), dt.datetime(2026, 5, 15)),
        (None, None),
    ]


def test_resolve_year(spark):
    df = spark.createDataFrame([("a", "2026-04-15"), ("b", ""), ("c", ""), ("d", "1/1/2025")], "deployment_id string, deployment_date string")
    over = spark.createDataFrame([("b", 2024), ("c", 1999), ("d", 2030)], "deployment_id string, year int")
    got = clean.resolve_year(df, over, allowed=(2020, 2100))
    assert {r["deployment_id"]: r["recording_year"] for r in got.collect()} == {"a": 2026, "b": 2024, "c": None, "d": 2030}
    assert [r["source_file"] for r in clean.missing_year(got, "deployment_id").collect()] == ["c"]


def test_attach_year(spark):
    def years(texts, year):
        df = spark.createDataFrame([("a", i, x) for i, x in enumerate(texts)], "d string, n long, x string")
        df = df.withColumn("t", F.timestamp_seconds("n"))
        got = clean.attach_year(df, Ordering(("d",), "t", ("n",)), "x", F.lit(year), "stamp")
        return [v and v.year for v in column(got, "stamp", "n")]

    assert years(["12-31 23:59:58", "01-01 00:00:00"], 2025) == [2025, 2026]
    assert years(["08-01 00:00:00", "02-01 00:00:00", "01-01 00:00:00"], 2025) == [2025] * 3
    assert years(["12-31 10:00:00", "junk", "01-01 10:00:00"], 2025) == [2025, None, 2026]
    assert years(["12-31 10:00:00", "02-29 10:00:00"], 2027) == [2027, 2028]
    assert years(["02-29 10:00:00"], 2027) == [None]
    assert years(["12-31 10:00:00", "01-01 00:00:00", "12-30 10:00:00", "01-02 00:00:00"], 2025) == [2025, 2026, 2026, 2027]


# ------------------------------------------------------------ cleaning


def test_flag_invalid(spark, at):
    df = series(spark, at, range(6), v=[-1.0, 8190.0, None, float("nan"), 0.0, 95.0], e=[1.0] * 6)
    got = clean.flag_invalid(df, "v", ["e"])
    assert column(got, "flag_tof_invalid") == [True] * 4 + [False] * 2
    assert column(got, "v") == [None] * 4 + [0.0, 95.0] and column(got, "e") == [None] * 4 + [1.0, 1.0]


def test_assign_session(spark, at):
    df = series(spark, at, [0, 10, 11, 20, 30])
    boots = spark.createDataFrame([("a", at(10)), ("a", at(20)), ("a", at(20)), ("b", at(0))], "d string, t timestamp")
    assert column(clean.assign_session(df, boots, O), "session_id") == [0, 1, 1, 3, 3]
    got = clean.session_columns(df, boots, O)
    assert column(got, "session_id") == [0, 1, 1, 3, 3]
    assert column(got, "session_row") == [1, 1, 2, 1, 2]
    assert column(got, "dt_sec") == [None, 10.0, 1.0, 9.0, 10.0]
    null_time = spark.createDataFrame([("a", None, 9)], "d string, t timestamp, i int")
    assert clean.assign_session(null_time, boots, O).first()["session_id"] is None


def test_boot_times_ignore_case(spark, at):
    log = spark.createDataFrame([("a", at(0), "START"), ("a", at(1), " start"), ("a", at(2), "stop"), ("a", None, "start")], "d string, t timestamp, event string")
    assert clean.boot_times(log, "t").count() == 2
    assert reports.reboot_events(log, K, "t").count() == 2


def test_warmup(spark, at):
    df = series(spark, at, range(45), session_id=[1] * 22 + [2] * 23)
    flags = column(clean.flag_warmup(df, O), "flag_ema_warmup")
    assert flags == [True] * 20 + [False] * 2 + [True] * 20 + [False] * 3


def test_gaps(spark, at):
    df = series(spark, at, [0, 300, 601, 7801, 15002])
    assert [r["downtime_min"] for r in clean.downtime_gaps(df, O).orderBy("gap_end").collect()] == [301 / 60, 120.0, 7201 / 60]
    large = clean.large_gaps(df, O).collect()
    assert [(r["gap_start"], r["gap_end"]) for r in large] == [(at(7801), at(15002))]


def test_device_mismatch(spark):
    log = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("c", "z"), ("a", None)], "deployment_id string, device_id string")
    meta = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", " ")], "deployment_id string, device_id string")
    got = {(r["deployment_id"], r["device_id"]) for r in clean.device_mismatch(log, meta).collect()}
    assert got == {("a", "y"), ("a", None)}


# ------------------------------------------------------------ smoothing, night


def test_valid_window(spark):
    df = spark.createDataFrame([(75.0, 2.0), (1.0, 2.0), (20.0, 2.0), (10.0, 2.0)], "s double, i double")
    assert [r[0] for r in df.select(scalars.valid_window(F.col("s"), F.col("i"))).collect()] == [39, 3, 11, 5]


@pytest.mark.parametrize("rows", [3, 500_000])
def test_rolling_median(spark, at, rows):
    v = [5.0, 1.0, None, 4.0, 9.0, 2.0, 7.0, 8.0, 3.0]
    df = series(spark, at, range(9), v=v)
    got = smooth.rolling_median(df, O, F.col("v"), 3, out="m", slice_rows=rows)
    assert column(got, "m") == [None, None, None, None, 4.0, 7.0, 7.0, 7.0, None]
    got = smooth.rolling_median(df, O, F.col("v"), 3, "skip", "m", slice_rows=rows)
    assert column(got, "m") == [None, 3.0, 2.5, 6.5, 4.0, 7.0, 7.0, 7.0, None]
    short = smooth.rolling_median(df.where("i < 4"), O, F.col("v"), 5, "skip", "m")
    assert column(short, "m") == [None] * 4
    with pytest.raises(ValueError):
        smooth.rolling_median(df, O, F.col("v"), 4)


def test_window_sizes_default(spark):
    deployments = spark.createDataFrame([("a",), ("b",)], "d string")
    intervals = spark.createDataFrame([("a", 5.0)], "d string, typical_interval double")
    got = {r["d"]: (r["typical_interval"], r["k"]) for r in smooth.window_sizes(deployments, intervals, ("d",)).collect()}
    assert got == {"a": (5.0, 15), "b": (2.0, 39)}


def test_smoothing_with_two_window_sizes(spark, at):
    df = series(spark, at, range(9), v=[float(x) for x in range(9)])
    df = df.unionByName(df.withColumn("d", F.lit("b")))
    sizes = spark.createDataFrame([("a", 3), ("b", 5)], "d string, k int")
    got = smooth.smooth_by_window_size(df, O, F.col("v"), sizes, out="m")
    n = {r["d"]: r["n"] for r in got.groupBy("d").agg(F.count("m").alias("n")).collect()}
    assert n == {"a": 7, "b": 5} and got.count() == 18


def test_sun_times(spark):
    df = spark.createDataFrame([("2026-04-15", 52.09, 5.12), ("2026-06-21", 78.0, 15.0), ("2026-12-21", 78.0, 15.0)], "day string, lat double, lon double")
    got = df.select(*[c.alias(n) for n, c in sun_times(F.to_date("day"), F.col("lat"), F.col("lon")).items()]).collect()
    assert abs((got[0]["sunrise"] - dt.datetime(2026, 4, 15, 4, 44, 17)).total_seconds()) <= 1
    assert abs((got[0]["sunset"] - dt.datetime(2026, 4, 15, 18, 37, 6)).total_seconds()) <= 1
    assert (got[1]["sunrise"], got[1]["polar"]) == (None, "day") and (got[2]["sunset"], got[2]["polar"]) == (None, "night")


def test_mark_night(spark, at):
    df = series(spark, at, [0, 100, 200, 201], x=[1, 1, 1, 1])
    df = df.unionByName(df.withColumn("d", F.lit("b"))).unionByName(df.withColumn("d", F.lit("p")))
    day = dt.date(2026, 4, 15)
    sun = spark.createDataFrame(
        [("a", day, at(100), at(200), None), ("p", day, None, None, "night")],
        "d string, date date, sunrise timestamp, sunset timestamp, polar string",
    )
    got = night.mark_night(df, "t", sun, K)
    assert column(got.where("d = 'a'"), "is_night") == [True, False, False, True]
    assert column(got.where("d = 'b'"), "is_night") == [False] * 4
    assert column(got.where("d = 'p'"), "is_night") == [True] * 4


def test_daylight_across_midnight(spark, at):
    # sunset of the day before is at 02:00 UTC of this one
    rows = series(spark, at, [-3 * 3600, 0, 20 * 3600], x=[1, 1, 1])
    days = [dt.date(2026, 4, 14), dt.date(2026, 4, 15), dt.date(2026, 4, 16)]
    sun = spark.createDataFrame(
        [("a", d, dt.datetime(2026, 4, d.day, 13), dt.datetime(2026, 4, d.day, 13) + dt.timedelta(hours=13), None) for d in days],
        "d string, date date, sunrise timestamp, sunset timestamp, polar string",
    )
    assert column(night.mark_night(rows, "t", sun, K), "is_night") == [True, True, True]
    assert column(night.mark_night(rows, "t", sun, K, neighbours=True), "is_night") == [False, True, False]


def test_clock_mismatch(spark, at):
    tof = spark.createDataFrame([("a", at(0)), ("a", at(9)), ("b", at(0))], "deployment_id string, timestamp timestamp")
    log = spark.createDataFrame([("a", at(5)), ("b", at(-9))], "deployment_id string, timestamp timestamp")
    assert [r["deployment_id"] for r in clean.clock_mismatch(log, tof).collect()] == ["b"]


# ------------------------------------------------------------ classification


def segments(spark, medians, key="a"):
    return spark.createDataFrame([(key, i, float(m)) for i, m in enumerate(medians)], "d string, segment_id int, seg_median double")


def states(df):
    return [r["state_auto"] for r in df.orderBy("segment_id").collect()]


@pytest.mark.parametrize("medians, viable", [([90, 94.9], False), ([90, 95], True), ([90], False), ([90.2, 89.8], False)])
def test_viable(spark, medians, viable):
    segs = segments(spark, medians)
    assert classify.cluster_viable(segs, K).first()["viable"] is viable
    if not viable:
        for method in (classify.classify_kmeans, classify.classify_gmm):
            assert set(states(method(segs, K))) == {"uncertain"}


def test_kmeans(spark):
    segs = segments(spark, [90, 90, 100, 110, 110, 103, 97])
    assert states(classify.classify_kmeans(segs, K, 0.0)).count("uncertain") <= 1
    two = segments(spark, [90, 110])
    assert states(classify.classify_kmeans(two, K, 1.0)) == ["uncertain", "uncertain"]
    assert states(classify.classify_kmeans(two, K, 0.99)) == ["present", "absent"]
    lo_hi = classify.two_means(segments(spark, [1, 2, 3, 50, 52, 54, 55]), K).first()
    assert (lo_hi["centre_lo"], lo_hi["centre_hi"]) == (2.0, 52.75)


def test_gmm(spark):
    segs = segments(spark, [88, 90, 91, 92, 89, 130, 131, 128, 133, 110])
    assert "uncertain" not in states(classify.classify_gmm(segs, K, 0.0))
    got = states(classify.classify_gmm(segs, K, 0.3))
    assert got[:5] == ["present"] * 5 and got[5:9] == ["absent"] * 4
    # more segments of the same kind do not change the split
    both = segs.unionByName(segments(spark, [5, 5, 5, 5], "b"))
    assert states(classify.classify_gmm(both, K).where("d = 'b'")) == ["uncertain"] * 4


def test_gmm_falls_back_to_kmeans(spark, monkeypatch):
    segs = segments(spark, [90, 91, 130, 131])
    nothing = classify.mixture_posteriors(segs, K).where("false")
    monkeypatch.setattr(classify, "mixture_posteriors", lambda *a, **k: nothing)
    assert states(classify.classify_gmm(segs, K)) == states(classify.classify_kmeans(segs, K)) == ["present"] * 2 + ["absent"] * 2


def test_inversions(spark):
    df = segments(spark, [50, 90, 130]).withColumn("state_auto", F.when(F.col("seg_median") == 90, "present").otherwise("absent"))
    assert classify.inversions(df, K).first()["n_inversions"] == 1


def test_iqr_floor(spark, at):
    signal = series(spark, at, range(5), v=[100.0, 100.0, 100.0, 100.0, 100.0])
    segs = segments(spark, [98.9, 99.0, 101.0, 101.1])
    got = states(classify.classify_iqr(signal, segs, K, "v"))
    assert got == ["present", "uncertain", "uncertain", "absent"]


def test_labels(spark, at):
    rows = series(spark, at, range(3), is_night=[False, True, False])
    labels = spark.createDataFrame([("a", 0, 1, "absent"), ("a", 1, 1, "absent")], "d string, i int, segment_id int, state_auto string")
    got = classify.apply_labels(rows, labels, ["d", "i"])
    assert column(got, "state_corrected") == ["absent", "present", None]
    assert column(got, "correction_source") == ["auto", "night_auto", None]
    assert classify.state_counts(got, K).first()[1:] == (1, 1, 0, 1)


# ------------------------------------------------------------ bouts and summaries


def test_bouts(spark, at):
    s = [None, None, "present", None, "present", "absent", None, "absent", "uncertain"]
    df = series(spark, at, [0, 10, 20, 30, 80, 90, 100, 149, 200], s=s, v=[1.0] * 9)
    got = bt.bouts(df, O, "s", "v").orderBy("bout_id").collect()
    assert [(r["state_corrected"], r["bout_duration"], r["n_readings"], r["flag_short"]) for r in got] == [
        ("present", 60.0, 2, False), ("absent", 59.0, 2, True), ("uncertain", 0.0, 1, True),
    ]
    strict = bt.bouts_strict(df, O, state="s", value="v").orderBy("bout_id").collect()
    assert [r["state_corrected"] for r in strict] == ["present", "present", "absent", "absent", "uncertain"]
    assert column(bt.join_bout_id(df, O, "s"), "bout_id") == [None, None, 1, 1, 1, 2, 2, 2, 3]
    assert column(bt.join_bout_id(df, O, "s", False), "bout_id") == [None, None, 1, None, 2, 3, None, 4, 5]
    assert column(bt.fill_state(df, O, "s"), "state_filled")[:4] == [bt.UNCLASSIFIED] * 2 + ["present"] * 2


def bout(at, state, start, end, n=1):
    return ("a", state, at(start), at(end), float(end - start), 5, 90.0, n, end - start < 60)


BOUT = "d string, state_corrected string, bout_start timestamp, bout_end timestamp, bout_duration double, n_readings long, mean_tof_mm double, bout_id long, flag_short boolean"


def test_day_summary(spark, at):
    hour = 3600
    table = spark.createDataFrame(
        [bout(at, "present", 0, hour), bout(at, "absent", hour, hour + 30, 2), bout(at, "present", 14 * hour, 44 * hour, 3)], BOUT
    )
    rows = series(spark, at, [0, 14 * hour, 30 * hour], s=["present"] * 3)
    days = summary.day_summary(rows, table, K, "t", None, "s").orderBy("date").collect()
    # the evening bout counts whole on its start date; the next day has none
    assert [(r["n_on_bouts"], r["prop_on_nest"], r["mean_on_bout_min"], r["n_off_bouts"]) for r in days] == [
        (2, round(31 / 24, 3), 930.0, 1), (0, 0.0, None, 0),
    ]
    assert (days[0]["first_off_start"], days[0]["last_off_end"]) == ("05:00", "05:00")
    split = summary.day_summary(rows, table, K, "t", None, "s", by_midnight=True).orderBy("date").collect()
    assert [r["prop_on_nest"] for r in split] == [round(7 / 24, 3), 1.0]
    long_only = summary.day_summary(rows, table, K, "t", None, "s", exclude_short=True, digits=None)
    first = long_only.orderBy("date").first()
    assert first["n_off_bouts"] == 0 and first["prop_off_nest"] > 0

    sunset = at(14 * hour)
    sun = spark.createDataFrame([("a", dt.date(2026, 4, 15), at(100), sunset, None)], "d string, date date, sunrise timestamp, sunset timestamp, polar string")
    # the first bout starts before sunrise, the last exactly at sunset
    active = summary.active_bouts(table, sun, K).collect()
    assert sorted(r["bout_id"] for r in active) == [2, 3]
    lit = summary.day_summary(rows.where("i < 2"), table, K, "t", sun, "s").first()
    assert (lit["n_on_bouts"], lit["day_length_h"], lit["sunrise"]) == (1, 13.97, "04:01")


def test_device_summary(spark, at):
    df = series(
        spark, at, [0, 10, 400], session_id=[1, 1, 3], dt_sec=[None, 10.0, 390.0],
        flag_tof_invalid=[False, True, False], flag_ema_warmup=[True, False, False],
    )
    log = spark.createDataFrame([("a", "START"), ("a", "start"), ("a", None)], "d string, event string")
    got = summary.device_summary(df, None, log, None, K, "t").first()
    assert (got["n_sessions"], got["n_reboots"], got["total_downtime_min"], got["n_tof_total"]) == (2, 1, 6.5, 3)
    assert (got["pct_tof_invalid"], got["n_dht_bad"], got["pct_downtime"]) == (33.33, None, 97.5)


# ------------------------------------------------------------ trims, corrections, reports


def test_trim(spark, at):
    df = series(spark, at, [0, 10, 20]).unionByName(spark.createDataFrame([("a", None, 9), ("b", at(5), 10)], "d string, t timestamp, i int"))
    bounds = spark.createDataFrame([("a", at(0), at(10)), ("b", None, None)], "d string, trim_start timestamp, trim_end timestamp")
    assert column(correct.trim_window(df, bounds, K, "t"), "i") == [0, 1, 10]
    over = spark.createDataFrame([("a", "bad", "2026-04-15 04:00:20"), ("b", "", None)], "d string, trim_start string, trim_end string")
    new = {r["d"]: (r["trim_start"], r["trim_end"]) for r in correct.set_trim(bounds, over, K).collect()}
    assert new == {"a": (at(0), at(20)), "b": (None, None)}


def test_corrections(spark, at):
    df = series(
        spark, at, range(5), v=[1.0, 2.0, None, 4.0, 5.0], state_auto=["present"] * 5, state_corrected=["present"] * 5,
        correction_source=["night_auto"] * 5,
    )
    boxes = spark.createDataFrame(
        [("a", 1, at(0), at(4), 0.0, 4.0, "absent"), ("a", 3, at(0), at(0), 0.0, 9.0, "reset"), ("a", 2, at(0), at(1), 0.0, 9.0, "uncertain"),
         ("a", 9, at(4), at(3), 0.0, 9.0, "absent")],
        "d string, seq long, t_min timestamp, t_max timestamp, d_min double, d_max double, action string",
    )
    got = correct.apply_corrections(df, boxes, O, "v", cell_sec=2)
    assert column(got, "state_corrected") == ["present", "uncertain", "present", "absent", "present"]
    assert column(got, "correction_source") == ["auto", "manual", "night_auto", "manual", "night_auto"]
    counts = correct.selection_counts(got, boxes, O, "v").where("seq = 1").orderBy("n", "state").collect()
    assert [(r["state"], r["n"], r["n_selected"]) for r in counts] == [("absent", 1, 3), ("present", 1, 3), ("uncertain", 1, 3)]
    back = correct.reset_corrections(got, boxes.where("seq = 1"), O, value="v")
    assert column(back, "state_corrected") == ["present"] * 5
    assert column(back, "correction_source") == ["auto", "auto", "night_auto", "auto", "night_auto"]


def test_days(spark, at):
    day = 86400
    df = series(spark, at, [0, day, 2 * day])
    def days(start, end):
        bounds = spark.createDataFrame([("a", start, end)], "d string, trim_start timestamp, trim_end timestamp")
        return correct.deployment_days(df, bounds, K, "t")
    assert days(at(day), None).count() == 2
    assert days(at(9 * day), None).count() == 3
    steps = summary.adjacent_days(days(None, None), K).orderBy("date").collect()
    assert [r["prev_date"] for r in steps] == [None, dt.date(2026, 4, 15), dt.date(2026, 4, 16)]


def test_downsample(spark):
    def sample(n, m):
        df = spark.range(n).select(F.lit("a").alias("d"), F.timestamp_seconds("id").alias("t"), F.col("id").alias("i"))
        return sorted(r["i"] for r in reports.downsample(df, O, m).collect())

    assert sample(8000, 8000) == list(range(8000))
    for n, m in ((8001, 8000), (100, 7), (16, 6), (999, 500)):
        want = [round(1 + j * ((n - 1) / (m - 1))) - 1 for j in range(m)]
        assert sample(n, m) == want
        assert want[0] == 0 and want[-1] == n - 1


def test_reports(spark, at):
    table = spark.createDataFrame([bout(at, "present", 0, 60), bout(at, "absent", 60, 114, 2)], BOUT)
    lines = reports.bout_timeline(table, K).orderBy("bout_id").collect()
    assert [(r["state_y"], r["hover_text"]) for r in lines] == [(0, "Present<br>04:00 – 04:01<br>1 min"), (2, "Absent<br>04:01 – 04:01<br>0.9 min")]
    assert [r["transition"] for r in reports.transitions(table, K).collect()] == [at(60)]
    row = reports.bout_report(table, K).where("bout_id = 2").first()
    assert (row["state"], row["start"], row["duration_min"], row["flag_short"]) == ("Absent", "2026-04-15 04:01", 0.9, True)
    assert reports.overview_intervals(table, K).first()["state"] == "absent"
    df = series(spark, at, [0, 10, 20], tof_smooth_r=[1.0, 2.0, None], flag_tof_invalid=[False] * 3, state_corrected=[None, "absent", "absent"])
    bounds = spark.createDataFrame([("a", None, at(5))], "d string, trim_start timestamp, trim_end timestamp")
    points = reports.day_points(df, O, bounds, F.lit(dt.date(2026, 4, 15)))
    assert column(points, "state_label") == ["Unclassified", "Outside trim"]
    assert reports.overview_series(df, O).count() == 2


def polar_days(spark, latitude, month):
    start = dt.datetime(2026, month, 15, 4, 0, 0)
    times = [start + dt.timedelta(hours=h) for h in range(12)]
    rows = spark.createDataFrame([("p", t, "present") for t in times], "deployment_id string, timestamp timestamp, state_corrected string")
    table = spark.createDataFrame(
        [("p", 1, "present", times[0], times[5], 5 * 3600.0, 6, 90.0, False), ("p", 2, "absent", times[6], times[11], 5 * 3600.0, 6, 130.0, False)],
        "deployment_id string, bout_id long, state_corrected string, bout_start timestamp, bout_end timestamp, "
        "bout_duration double, n_readings long, mean_tof_mm double, flag_short boolean",
    )
    places = spark.createDataFrame([("p", latitude, 15.0)], "deployment_id string, latitude double, longitude double")
    sun = night.sun_table(rows, "timestamp", places)
    keys = ["deployment_id"]
    (day,) = summary.day_summary(rows, table, keys, "timestamp", sun).collect()
    pct = summary.active_day_pct(rows, sun, keys, "timestamp").collect()
    return day, summary.active_bouts(table, sun, keys).count(), pct


def test_polar_day_counts_everything(spark):
    day, active, pct = polar_days(spark, 78.0, 6)
    assert day["day_length_h"] == 24.0 and day["sunrise"] is None
    assert day["prop_on_nest"] == day["prop_off_nest"] == round(5 / 24, 3)
    assert (day["n_on_bouts"], day["n_off_bouts"], active) == (1, 1, 2)
    assert pct[0]["n_active"] == 12 and pct[0]["pct_active_on_nest"] == 100


def test_polar_night_has_no_active_day(spark):
    day, active, pct = polar_days(spark, 78.0, 12)
    assert day["day_length_h"] == 0.0
    assert day["prop_on_nest"] is None and day["prop_off_nest"] is None and day["prop_uncertain"] is None
    assert (day["n_on_bouts"], day["n_off_bouts"], active, pct) == (0, 0, 0, [])


def test_one_digit_months_and_slashes(spark):
    df = spark.createDataFrame([("k", 1, "4-5 6:00:00"), ("k", 2, "04-05 06:00:20"), ("k", 3, "13-1 00:00:00")], "k string, i int, x string")
    got = clean.attach_year(df, Ordering(("k",), "i"), "x", F.lit(2026)).orderBy("i").collect()
    assert [r["timestamp"] for r in got] == [dt.datetime(2026, 4, 5, 6), dt.datetime(2026, 4, 5, 6, 0, 20), None]
    df = spark.createDataFrame([("04/15", "4-9")], "deployment_date string, retrieval_date string")
    df = df.withColumns({"deployment_time": F.lit("06:00"), "retrieval_time": F.lit(None).cast("string"), "y": F.lit(2026)})
    row = clean.deployment_window(df, "y").first()
    assert (row["trim_start"], row["trim_end"]) == (dt.datetime(2026, 4, 15, 6), dt.datetime(2026, 4, 9))


@pytest.mark.parametrize("sizes", [{"a": 3, "b": 3}, {"a": 3, "b": 5}, {}, {"a": 7}])
def test_smoothing_keeps_deployments_without_a_size(spark, at, sizes):
    rows = [(k, at(10 * i), i, float(i * i % 17)) for k in "abc" for i in range(30)]
    df = spark.createDataFrame(rows, "key string, t timestamp, i int, x double")
    o = Ordering(("key",), "t", ("i",))
    table = spark.createDataFrame([(k, 2.0, v) for k, v in sizes.items()], "key string, typical_interval double, k int")
    got = smooth.smooth_by_window_size(df, o, F.col("x"), table, out="m", default_k=9).collect()
    assert len(got) == len(rows)
    for key in "abc":
        k = sizes.get(key, 9)
        xs = [float(i * i % 17) for i in range(30)]
        want = [sorted(xs[i - k // 2 : i + k // 2 + 1])[k // 2] if k // 2 <= i < 30 - k // 2 else None for i in range(30)]
        assert [r["m"] for r in sorted((r for r in got if r["key"] == key), key=lambda r: r["i"])] == want
