"""Tables that are replaced by deployment, all of a set at once."""

import os

import pytest
from pyspark.sql import functions as F

from nidalytics.sources import tables, versions

A, B = "deployment_id string, x long", "deployment_id string, y string"


def rows(spark, ddl, *pairs):
    return spark.createDataFrame(list(pairs), ddl)


def held(df):
    return sorted(map(tuple, df.collect()), key=str)


def files(root, table):
    return [f for d, _, names in os.walk(f"{root}/{table}") for f in names if f.endswith(".parquet")]


def test_commits_replace_whole_deployments_in_all_tables(spark, tmp_path):
    root = str(tmp_path)
    versions.commit({"a": rows(spark, A, ("p", 1), ("p", 2), ("q", 3)), "b": rows(spark, B, ("p", "u"), ("r", "v"))}, root)
    first = versions.snapshot(spark, root)
    ids = rows(spark, "deployment_id string", ("p",), ("s",))
    versions.commit({"a": rows(spark, A, ("p", 9)), "b": rows(spark, B, ("t", "w"))}, root, ids)
    now = versions.snapshot(spark, root)
    assert held(now.table("a", A)) == [("p", 9), ("q", 3)]
    assert held(now.table("b", B)) == [("r", "v"), ("t", "w")]  # p has no rows in b any more
    assert {r[0] for r in now.ids("a").collect()} == {"p", "q", "r", "s", "t"}
    # a reader keeps what it saw
    assert held(first.table("a", A)) == [("p", 1), ("p", 2), ("q", 3)]
    assert held(versions.snapshot(spark, root, versions.commits(spark, root)[0]).table("b", B)) == [("p", "u"), ("r", "v")]
    assert held(now.table("c", A)) == []


def test_a_commit_that_was_not_finished_is_not_seen(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    versions.commit({"a": rows(spark, A, ("p", 1)), "b": rows(spark, B, ("p", "u"))}, root)

    def fails(x):
        raise RuntimeError("lost")

    broken = rows(spark, B, ("p", "new")).mapInArrow(lambda batches: (fails(b) for b in batches), B)
    with pytest.raises(Exception, match="lost"):
        versions.commit({"a": rows(spark, A, ("p", 5)), "b": broken}, root)
    store = versions._store

    def no_marker(session, path):
        if "/order/" in path:
            raise RuntimeError("died before the last step")
        return store(session, path)

    monkeypatch.setattr(versions, "_store", no_marker)
    with pytest.raises(RuntimeError):
        versions.commit({"a": rows(spark, A, ("p", 6)), "b": rows(spark, B, ("p", "z"))}, root)
    monkeypatch.undo()
    now = versions.snapshot(spark, root)
    assert held(now.table("a", A)) == [("p", 1)] and held(now.table("b", B)) == [("p", "u")]
    assert len(versions.vacuum(spark, root, older_than_sec=-1)) == 2
    assert held(versions.snapshot(spark, root).table("a", A)) == [("p", 1)]


def test_files_do_not_grow_with_deployments(spark, tmp_path):
    many = spark.range(3000).select(F.concat(F.lit("dep-"), F.col("id").cast("string")).alias("deployment_id"), F.col("id").alias("x"))
    versions.commit({"a": many}, str(tmp_path), buckets=4)
    assert 0 < len(files(tmp_path, "a")) <= 16
    now = versions.snapshot(spark, str(tmp_path))
    assert now.table("a", A).count() == 3000
    some = now.table("a", A, ids=["dep-7", "dep-2999", "none"])
    assert held(some) == [("dep-2999", 2999), ("dep-7", 7)]
    read = {f for f in some.inputFiles()}
    assert some.count() == 2 and len(read) <= 16
    versions.commit({"a": many.where("x < 10").withColumn("x", -F.col("x"))}, str(tmp_path), buckets=3)
    some = versions.snapshot(spark, str(tmp_path)).table("a", A, ids=["dep-7", "dep-2999"])
    assert held(some) == [("dep-2999", 2999), ("dep-7", -7)]


def test_each_table_is_evaluated_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = rows(spark, A, *[(f"d{i}", i) for i in range(50)]).mapInArrow(count, A)
    tables.write_table(df, str(tmp_path), "a", ids=df.sparkSession.createDataFrame([("d1",), ("z",)], "deployment_id string"))
    assert seen.value == 50


def test_null_ids_and_empty_tables(spark, tmp_path):
    root = str(tmp_path)
    assert held(versions.snapshot(spark, root).table("a", A)) == []
    versions.commit({"a": rows(spark, A, (None, 1), ("p", 2))}, root)
    versions.commit({"a": rows(spark, A)}, root, rows(spark, "deployment_id string", ("p",)))
    assert held(versions.snapshot(spark, root).table("a", A)) == [(None, 1)]
    versions.commit({"a": rows(spark, A)}, root)
    assert held(versions.snapshot(spark, root).table("a", A)) == [(None, 1)]


def test_vacuum_keeps_what_counts(spark, tmp_path):
    root = str(tmp_path)
    dead = versions.commit({"a": rows(spark, A, ("p", 1))}, root)
    versions.commit({"a": rows(spark, A, ("p", 2), ("q", 2))}, root)
    versions.commit({"a": rows(spark, A, ("q", 3))}, root)
    assert versions.vacuum(spark, root) == []  # too young
    assert versions.vacuum(spark, root, older_than_sec=-1) == [dead]
    assert held(versions.snapshot(spark, root).table("a", A)) == [("p", 2), ("q", 3)]
