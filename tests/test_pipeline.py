"""Raw folders to processed tables and exports."""

import datetime as dt
import math
import pathlib
import random

import pytest
from pyspark.sql import functions as F

from nidalytics.operators import bouts as bt
from nidalytics.operators import correct
from nidalytics.plans import pipeline, stages
from nidalytics.sources import raw, schemas, tables, versions
from nidalytics.streaming.arrivals import process_arrivals


def write_folder(root, name, start, hours, metadata, *, year_in_data=None, seed=1, step=20, skip=()):
    """A small deployment: 40 minutes on the nest, 20 minutes off, in turn."""
    folder = root / name
    folder.mkdir()
    rng = random.Random(seed)
    n = int(hours * 3600 / step)
    tof, dht = ["timestamp,tof_raw,tof_smooth"], ["timestamp,temp1,hum1,temp2,hum2"]
    for j in range(n):
        t = start + dt.timedelta(seconds=j * step)
        off = (j * step // 60) % 60 >= 40
        mm = round(rng.gauss(130 if off else 90, 1.5))
        text = t.strftime("%m-%d %H:%M:%S")
        if j % 97 == 5:
            mm = -1 if j % 2 else 8190
        tof.append(f" {text} ,{mm},{mm + 0.5}")
        if j % 15 == 0:
            dht.append(f"{text},{'NA' if j == 30 else 31.25},60,{12.5 + j % 3},70")
    tof.append("not a time,1,1")
    boots = [start, start + dt.timedelta(hours=hours / 2)]
    log = ["timestamp,event,device_id,notes"]
    log += [f"{b.strftime('%m-%d %H:%M:%S')},{e},d-{name},x" for b, e in zip(boots, ("START", "start"))]
    files = {
        "METADATA.TXT": "\r\n".join(f"{k}={v}" for k, v in metadata.items()),
        "LOG.CSV": "\n".join(log) + "\n",
        "DHT.CSV": "\n".join(dht) + "\n",
        "TOF.CSV": "\n".join(tof) + "\n",
    }
    for file, text in files.items():
        if file not in skip:
            (folder / file).write_text(text)
    return n


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")
    n = {
        "alpha": write_folder(
            root, "alpha", dt.datetime(2026, 4, 15, 5, 0), 20,
            {"device_id": "d-alpha", "deployment_id": "A1", "nestbox": "7", "species": "Parus major", "eggs": "8",
             "deployment_date": "2026-04-15", "deployment_time": "06:00:00", "retrieval_date": "2026-04-15",
             "retrieval_time": "23:00:00", "latitude": "52.09", "longitude": "5.12", "notes": "a=b"},
        ),
        # crosses the new year and a leap day's year, no deployment id
        "newyear": write_folder(
            root, "newyear", dt.datetime(2027, 12, 31, 20, 0), 8, {"device_id": "other", "deployment_date": "31/12/2027"}, seed=2
        ),
        "noyear": write_folder(root, "noyear", dt.datetime(2026, 5, 1), 1, {"device_id": "x", "deployment_date": " "}),
        "broken": write_folder(root, "broken", dt.datetime(2026, 5, 1), 1, {"deployment_date": "2026-05-01"}, skip=("DHT.CSV",)),
    }
    return root, n


@pytest.fixture(scope="module")
def out(spark, root, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("out"))
    assert pipeline.load_or_process(spark, str(root[0]), out, pipeline.Params(classification_method="gmm")) == 2
    return out


def test_discovery(spark, root):
    found = {r["deployment_id"]: r for r in raw.discover_deployments(spark, str(root[0])).collect()}
    assert set(found) == {"A1", "newyear", "noyear"}
    assert found["A1"]["notes"] == "a=b"
    missing = raw.require_files(raw.list_files(spark, str(root[0]))).collect()
    assert [(r["folder"].split("/")[-1], r["missing"]) for r in missing] == [("broken", ["DHT.CSV"])]


def test_second_run_does_nothing(spark, root, out):
    before = tables.load_processed(spark, out)["tof_processed"].count()
    assert pipeline.load_or_process(spark, str(root[0]), out) == 0
    assert tables.load_processed(spark, out)["tof_processed"].count() == before


def test_quarantine(spark, out):
    rows = spark.read.schema(schemas.QUARANTINE).parquet(f"{out}/quarantine").collect()
    reasons = {(r["source_file"].split("raw")[-1].split("/", 1)[-1], r["reason"]) for r in rows}
    assert ("noyear", "recording_year_needed") in reasons
    assert ("broken", "missing DHT.CSV") in reasons
    assert ("alpha/TOF.CSV", "unparseable timestamp") in reasons
    assert {r["raw"] for r in rows if r["reason"] == "unparseable timestamp"} == {"not a time"}


def test_clean_tables(spark, root, out):
    clean = tables.load_clean(spark, out)
    tof = clean["tof_clean"].where("deployment_id = 'newyear'").toPandas().sort_values("timestamp")
    assert len(tof) == root[1]["newyear"]
    assert tof["timestamp"].min() == dt.datetime(2027, 12, 31, 20, 0)
    assert tof["timestamp"].max().year == 2028
    assert tof["dt_sec"].isna().sum() == 1 and set(tof["dt_sec"].dropna()) == {20.0}
    assert list(tof["session_id"].unique()) == [1, 2]
    assert tof.groupby("session_id")["flag_ema_warmup"].sum().tolist() == [20, 20]
    assert tof.loc[tof["flag_tof_invalid"], ["tof_raw_mm", "tof_smooth_ema"]].isna().all().all()
    assert not tof["tof_raw_mm"].isin([-1, 8190]).any()
    dht = clean["dht_clean"].where("deployment_id = 'A1'").toPandas().sort_values("timestamp")
    assert dht["flag_dht_bad"].sum() == 1
    assert dht["temp_diff"].dropna().iloc[0] == 18.75 and (dht["hum_diff"] == -10).all()


def test_processed_tables(spark, out):
    p = tables.load_processed(spark, out, ids=["A1"])
    tof = p["tof_processed"].toPandas().sort_values("timestamp").reset_index(drop=True)
    assert set(tof["state_auto"].dropna()) >= {"present", "absent"}
    assert set(tof["correction_source"].dropna()) == {"auto", "night_auto"}
    night = tof["correction_source"] == "night_auto"
    assert (tof.loc[night, "state_auto"] == "present").all()
    day = tof[~night & tof["state_auto"].notna()]
    off = (tof["timestamp"].dt.minute >= 40).loc[day.index]
    sure = day["state_auto"] != "uncertain"
    agreement = ((day["state_auto"] == "absent") == off)[sure].mean()
    assert agreement > 0.95
    bouts = p["bout_summary"].toPandas().sort_values("bout_id")
    assert bouts["n_readings"].sum() == tof["state_corrected"].notna().sum()
    assert (bouts["state_corrected"] != bouts["state_corrected"].shift()).all()
    days = p["day_summary"].toPandas()
    assert list(days["date"].astype(str)) == ["2026-04-15", "2026-04-16"]
    # sunset 18:37:06 less sunrise 04:44:17
    assert days["sunrise"][0] == "04:44" and days["sunset"][0] == "18:37" and days["day_length_h"][0] == 13.88
    device = p["device_summary"].toPandas().iloc[0]
    assert (device["n_sessions"], device["n_reboots"], device["n_tof_warmup"]) == (2, 1, 40)
    assert device["species"] == "Parus major" and device["n_dht_bad"] == 1
    gone = tables.load_table(spark, out, "large_gaps", "deployment_id string, gap_min double")
    assert gone.count() == 0


def test_no_coordinates_use_the_whole_day(spark, out):
    days = tables.load_processed(spark, out, ids=["newyear"])["day_summary"].toPandas()
    assert set(days["day_length_h"]) == {24.0} and days["sunrise"].isna().all()


def test_export_after_corrections(spark, out, tmp_path):
    t0 = dt.datetime(2026, 4, 15, 12, 0)
    corrections = spark.createDataFrame(
        [("A1", 1, t0, t0 + dt.timedelta(hours=3), 0.0, 500.0, "absent"),
         ("A1", 2, t0, t0 + dt.timedelta(hours=1), 0.0, 500.0, "reset")],
        schemas.CORRECTIONS,
    )
    pipeline.export_all(spark, out, str(tmp_path / "ex"), corrections)
    ex = tables.load_processed(spark, str(tmp_path / "ex"), ids=["A1"], exported=True)
    tof = ex["tof_processed"].toPandas().sort_values("timestamp")
    assert tof["timestamp"].min() >= dt.datetime(2026, 4, 15, 6, 0)
    assert tof["timestamp"].max() <= dt.datetime(2026, 4, 15, 23, 0)
    manual = tof[tof["correction_source"] == "manual"]
    assert manual["timestamp"].min() > t0 + dt.timedelta(hours=1) and (manual["state_corrected"] == "absent").all()
    assert manual["bout_id_corrected"].nunique() == 1 and manual["bout_id_auto"].nunique() > 1
    before = ex["device_summary"].toPandas().iloc[0]
    assert before["n_reboots"] == 1 and not math.isnan(before["pct_dht_bad"])
    # an exported table can be exported again
    deployments = tables.load_table(spark, out, "deployments", schemas.DEPLOYMENTS)
    again = pipeline.export_corrected(
        tables.load_processed(spark, str(tmp_path / "ex"), exported=True), deployments
    )["tof_processed"].where("deployment_id = 'A1'").toPandas()
    a, b = (d.set_index(["src_block", "src_row"]).sort_index() for d in (tof, again))
    assert (a["bout_id_auto"].fillna(0) == b["bout_id_auto"].fillna(0)).all()
    assert (a["bout_id_corrected"].fillna(0) == b["bout_id_corrected"].fillna(0)).all()


def test_csv_export(spark, out, tmp_path):
    processed = tables.load_processed(spark, out)
    tables.write_table(processed["bout_summary"], str(tmp_path), "bout_summary", "csv")
    back = spark.read.option("header", True).csv(f"{tmp_path}/bout_summary")
    assert back.count() == processed["bout_summary"].count()


def test_overwrite_touches_given_deployments_only(spark, out, tmp_path):
    bouts = tables.load_processed(spark, out)["bout_summary"]
    tables.write_table(bouts, str(tmp_path), "b")
    tables.write_table(bouts.where("deployment_id = 'A1' and bout_id = 1"), str(tmp_path), "b")
    back = tables.load_table(spark, str(tmp_path), "b", schemas.BOUTS)
    assert back.where("deployment_id = 'A1'").count() == 1
    assert back.where("deployment_id <> 'A1'").count() == bouts.where("deployment_id <> 'A1'").count()


def test_older_settings(spark, out):
    clean = tables.load_clean(spark, out)
    deployments = tables.load_table(spark, out, "deployments", schemas.DEPLOYMENTS)
    for method in ("iqr", "kmeans"):
        params = pipeline.Params(classification_method=method, bridge_nulls=False, sensitivity=0.5)
        done = pipeline.process(deployments, clean["tof_clean"], clean["dht_clean"], clean["log_clean"], params)
        states = {r["state_auto"] for r in done["tof_processed"].select("state_auto").distinct().collect()}
        assert {"present", "absent"} <= states


def test_year_override_and_arrivals(spark, tmp_path):
    root, out = tmp_path / "raw", str(tmp_path / "out")
    root.mkdir()
    write_folder(root, "one", dt.datetime(2026, 5, 1), 2, {"deployment_id": "one", "deployment_date": "2026-05-01"})
    for _ in range(2):
        process_arrivals(spark, str(root), out, str(tmp_path / "cp")).awaitTermination()
        assert tables.load_manifest(spark, out).count() == 1
    write_folder(root, "two", dt.datetime(2026, 5, 1), 2, {"deployment_id": "two"})
    write_folder(root, "three", dt.datetime(2026, 5, 1), 2, {"deployment_id": "three"}, skip=("TOF.CSV",))
    process_arrivals(spark, str(root), out, str(tmp_path / "cp")).awaitTermination()
    assert {r[0] for r in tables.load_manifest(spark, out).collect()} == {"one"}
    years = spark.createDataFrame([("two", 2026)], "deployment_id string, year int")
    assert pipeline.load_or_process(spark, str(root), out, year_overrides=years) == 1
    days = tables.load_processed(spark, out, ids=["two"])["day_summary"].select(F.year("date")).collect()
    assert {r[0] for r in days} == {2026}


def test_odd_folders_do_not_stop_the_others(spark, tmp_path):
    root, out = tmp_path / "raw", str(tmp_path / "out")
    root.mkdir()
    assert pipeline.load_or_process(spark, str(root), out) == 0
    start, about = dt.datetime(2026, 5, 1), {"deployment_date": "2026-05-01"}
    n = write_folder(root, "a1", start, 2, {"deployment_id": "same", **about}, seed=3)
    n = write_folder(root, "a2", start, 3, {"deployment_id": "same", **about}, seed=4)
    write_folder(root, "nometa", start, 1, about, skip=("METADATA.TXT",))
    write_folder(root, "badhead", start, 1, about)
    (root / "badhead" / "LOG.CSV").write_text("time,what\n05-01 00:00:00,START\n")
    write_folder(root, "extra", start, 1, about)
    log = "notes,extra column,event, timestamp ,device_id\nn,1,START,05-01 00:00:00,d-extra\n"
    (root / "extra" / "LOG.CSV").write_text(log)
    assert pipeline.load_or_process(spark, str(root), out) == 2
    assert {r[0] for r in tables.load_manifest(spark, out).collect()} == {"same", "extra"}
    # the last folder of the id counts, once
    tof = tables.load_processed(spark, out)["tof_processed"]
    assert tof.where("deployment_id = 'same'").count() == n
    devices = tables.load_processed(spark, out)["device_summary"].collect()
    assert sorted(r["deployment_id"] for r in devices) == ["extra", "same"]
    assert {r["deployment_id"]: r["n_reboots"] for r in devices}["extra"] == 0

    def quarantine():
        rows = spark.read.schema(schemas.QUARANTINE).parquet(f"{out}/quarantine").collect()
        return sorted((r["source_file"].split("/raw/")[-1], r["reason"]) for r in rows if r["reason"] != "unparseable timestamp")

    want = [
        ("a1", "deployment_id is that of a later folder"),
        ("badhead/LOG.CSV", "unexpected header"),
        ("nometa", "missing METADATA.TXT"),
    ]
    assert quarantine() == want
    assert pipeline.load_or_process(spark, str(root), out) == 0
    assert quarantine() == want


def test_reprocess_with_other_settings(spark, out, tmp_path):
    clean_tables = tables.load_clean(spark, out)
    copy = str(tmp_path / "copy")
    tables.write_clean(clean_tables, copy)
    tables.write_table(tables.load_table(spark, out, "deployments", schemas.DEPLOYMENTS), copy, "deployments")
    pipeline.reprocess(spark, copy, pipeline.Params(min_bout_sec=1e9))
    bouts = tables.load_processed(spark, copy)["bout_summary"]
    assert bouts.count() == bouts.where("flag_short").count() > 0
    with pytest.raises(ValueError, match="unknown penalty"):
        pipeline.reprocess(spark, copy, pipeline.Params(cpt_penalty="XYZ"))
    for penalty in ("AIC", "Hannan-Quinn"):
        pipeline.reprocess(spark, copy, pipeline.Params(cpt_penalty=penalty), ids=clean_tables["log_clean"].limit(1))


def test_export_of_a_deployment_that_was_trimmed_empty(spark, out, tmp_path):
    root = str(tmp_path / "ex")
    pipeline.export_all(spark, out, root)
    assert tables.load_processed(spark, root, ids=["A1"], exported=True)["bout_summary"].count() > 0
    trims = spark.createDataFrame(
        [("A1", "2001-01-01 00:00:00", "2001-01-02 00:00:00")], "deployment_id string, trim_start string, trim_end string"
    )
    pipeline.export_all(spark, out, root, trims=trims, min_bout_sec=1e9)
    again = tables.load_processed(spark, root, exported=True)
    assert again["tof_processed"].where("deployment_id = 'A1'").count() == 0
    assert again["bout_summary"].where("deployment_id = 'A1'").count() == 0
    assert again["bout_summary"].where("NOT flag_short").count() == 0
    assert again["tof_processed"].count() > 0


def test_readings_are_judged_in_one_pass_per_deployment(spark):
    """What is joined and told apart afterwards is a row per deployment, not per reading."""
    t = dt.datetime(2026, 4, 15, 12, 0)
    rows = [("a", t, "present"), ("a", t, None), ("b", None, "absent"), ("b", t, "asleep"), ("b", t, "asleep"), ("c", t, None), (None, t, "absent")]
    tof = stages.cut(spark.createDataFrame(rows, "deployment_id string, timestamp timestamp, state_auto string"))
    described = spark.createDataFrame([("a",), ("b",), ("d",)], "deployment_id string")
    found = pipeline.unfit(described, {"tof_processed": tof}, None)
    assert "state_auto" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((str(r[0]), r[1]) for r in found.collect()) == [
        ("None", "no description"), ("b", "a reading without a time"), ("b", "a state that is not known"), ("c", "no description"),
    ]


def test_export_of_a_sound_fleet_reads_its_tables_as_they_are(spark, out, tmp_path, monkeypatch):
    plans, work = [], pipeline.export_corrected

    def watched(processed, *more):
        plans.extend(t._jdf.queryExecution().optimizedPlan().toString() for t in processed.values())
        return work(processed, *more)

    monkeypatch.setattr(pipeline, "export_corrected", watched)
    assert pipeline.export_all(spark, out, str(tmp_path / "ex")) == 2
    assert plans and not any("LeftAnti" in p for p in plans)


def test_a_deployment_that_cannot_be_exported_does_not_stop_the_others(spark, out, tmp_path):
    copy, ex = str(tmp_path / "copy"), str(tmp_path / "ex")
    now = versions.snapshot(spark, out)
    ddls = {**schemas.PROCESSED_TABLES, "log_clean": schemas.LOG_CLEAN, "deployments": schemas.DEPLOYMENTS}
    versions.commit({n: now.table(n, ddl) for n, ddl in ddls.items()}, copy, buckets=97)  # one deployment in a bucket
    files = tables.load_processed(spark, copy)["tof_processed"].withColumn("file", F.input_file_name())
    of = {r["deployment_id"]: r["file"] for r in files.select("deployment_id", "file").distinct().collect()}
    assert of["A1"] != of["newyear"]
    before = tables.load_processed(spark, out)["tof_processed"].where("deployment_id = 'A1'").count()
    broken = pathlib.Path(of["A1"].removeprefix("file://"))
    broken.write_bytes(b"PAR1" + b"\0" * 500)
    assert pipeline.export_all(spark, copy, ex) == 1

    def reasons():
        rows = spark.read.schema(schemas.QUARANTINE).parquet(f"{ex}/quarantine").collect()
        return sorted((r["source_file"], r["reason"]) for r in rows)

    assert reasons() == [("A1", f"tof_processed: 0 of {before} rows can be read")]
    got = {n: {r[0] for r in t.select("deployment_id").distinct().collect()} for n, t in tables.load_processed(spark, ex, exported=True).items()}
    assert got == dict.fromkeys(schemas.PROCESSED_TABLES, {"newyear"})
    t0 = dt.datetime(2026, 4, 15, 12, 0)
    boxes = [("newyear", 1, t0, t0, 0.0, 500.0, "asleep")]
    assert pipeline.export_all(spark, out, ex, spark.createDataFrame(boxes, schemas.CORRECTIONS)) == 1
    assert reasons()[1:] == [("newyear", "a correction that cannot be read")]
    ids = {r[0] for r in tables.load_processed(spark, ex, exported=True)["bout_summary"].select("deployment_id").distinct().collect()}
    assert ids == {"A1", "newyear"}  # what was exported before stays


def test_device_files_in_slices_and_with_many_columns(spark, tmp_path):
    folder = tmp_path / "hot"
    (folder / "TOF.CSV").mkdir(parents=True)
    (folder / "METADATA.TXT").write_text("deployment_id=H\nno pair here\ndeployment_date=2026-05-01\n")
    names = [f"extra{i}" for i in range(30)]
    head = ",".join([*names, "tof_smooth", "timestamp", "tof_raw"])
    rows = [f"{','.join(['\"a,b\"'] * 30)},{i + 0.5},05-01 00:{i // 60:02d}:{i % 60:02d},{i}" for i in range(250)]
    for n in range(12):  # the tenth slice comes after the ninth
        lines = [head, *rows[n * 21 : (n + 1) * 21], ""]
        (folder / "TOF.CSV" / f"{n}.csv").write_text("\n".join(lines))
    (folder / "DHT.CSV").write_text("timestamp,temp1,hum1,temp2,hum2\n05-01 00:00:01,1,2,3,4\n")
    listing = raw.list_files(spark, str(tmp_path))
    assert {r["name"] for r in listing.collect()} == {"METADATA.TXT", "TOF.CSV", "DHT.CSV"} and listing.count() == 3
    deployments = raw.deployment_table(raw.read_metadata(spark, f"{tmp_path}/*/METADATA.TXT"))
    log = spark.createDataFrame([], schemas.LOG_CLEAN)
    tof = raw.read_tof(spark, f"{tmp_path}/*/TOF.CSV", deployments, log).orderBy("src_block", "src_row").collect()
    assert [r["tof_raw_mm"] for r in tof] == [None if i == -1 else float(i) for i in range(250)]
    assert {r["deployment_id"] for r in tof} == {"H"} and tof[9]["tof_smooth_ema"] == 9.5
    assert [r["timestamp"].second for r in tof[:3]] == [0, 1, 2] and tof[-1]["timestamp"].minute == 4


def test_corrections_refresh_bouts_and_days_in_steps(spark, out, tmp_path):
    root, t0 = str(tmp_path / "corrected"), dt.datetime(2026, 4, 15, 12, 0)
    steps = [
        [("A1", 1, t0, t0 + dt.timedelta(hours=3), 0.0, 500.0, "absent")],
        [("A1", 2, t0 + dt.timedelta(hours=1), t0 + dt.timedelta(hours=1, minutes=10), 0.0, 500.0, "present"),
         ("newyear", 3, dt.datetime(2027, 12, 31, 21), dt.datetime(2028, 1, 1, 1), 0.0, 500.0, "reset")],
    ]
    processed = tables.load_processed(spark, out)
    for i, boxes in enumerate(steps):
        assert pipeline.refresh_corrected(spark, out, root, spark.createDataFrame(boxes, schemas.CORRECTIONS)) == 1 + i
        every = spark.createDataFrame([b for s in steps[: i + 1] for b in s], schemas.CORRECTIONS)
        fixed = correct.apply_corrections(processed["tof_processed"].drop("bout_id"), every, pipeline.ORDER)
        want = bt.bouts(fixed, pipeline.ORDER)
        now = versions.snapshot(spark, root)
        got = now.table("bout_summary", schemas.BOUTS)
        ids = ["A1", "newyear"][: 1 + i]
        columns = ["deployment_id", "bout_id", "state_corrected", "bout_start", "bout_end", "n_readings", "flag_short"]
        a, b = (sorted(map(tuple, d.where(F.col("deployment_id").isin(ids)).select(*columns).collect())) for d in (got, want))
        assert a == b
        assert now.table("corrections", schemas.CORRECTIONS).count() == every.count()
        days = {(r["deployment_id"], str(r["date"])) for r in now.table("day_summary", schemas.DAYS).collect()}
        assert ("A1", "2026-04-15") in days
