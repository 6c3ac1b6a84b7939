"""Folders that arrive file by file. The processing itself is tested with the pipeline; here it only takes notes."""

import time

import pytest
from pyspark.sql import functions as F

from nidalytics.sources import schemas
from nidalytics.streaming import arrivals

ALL = schemas.REQUIRED_FILES


@pytest.fixture
def site(spark, tmp_path, monkeypatch):
    """Deliver files to a root, and run the stream over it."""

    class Site:
        root, out, checkpoint = tmp_path / "raw", str(tmp_path / "out"), str(tmp_path / "cp")
        done = []

        def deliver(self, name, *files):
            for file in files:
                path = self.root / name / file
                path.parent.mkdir(exist_ok=True, parents=True)
                path.write_text(f"deployment_id={name}\n")

        def start(self, **options):
            return arrivals.process_arrivals(spark, str(self.root), self.out, self.checkpoint, **options)

        def run(self, **options):
            self.start(**options).awaitTermination()
            return self.done

        def reasons(self):
            try:
                rows = spark.read.schema(schemas.QUARANTINE).parquet(f"{self.out}/quarantine").collect()
            except Exception as e:  # no such table yet
                assert "PATH_NOT_FOUND" in str(e)
                return []
            return sorted((r.source_file.rsplit("/", 1)[1], r.reason) for r in rows)

    def process_new(session, found, listing, out, params, **_):
        assert {r[0] for r in listing.groupBy("folder").agg(F.count("name")).select("count(name)").collect()} == {4}
        Site.done += sorted(r.deployment_id for r in found.collect())

    monkeypatch.setattr(arrivals, "process_new", process_new)
    Site.root.mkdir()
    return Site()


def test_files_in_any_order_over_several_runs(site):
    site.deliver("a", "METADATA.TXT", "LOG.CSV")
    site.deliver("b", "TOF.CSV/0.csv", "TOF.CSV/1.csv")  # a long file in slices
    site.deliver("c", *ALL)
    assert site.run() == ["c"]
    site.deliver("a", "TOF.CSV", "DHT.CSV")
    site.deliver("b", "METADATA.TXT", "DHT.CSV")
    assert site.run() == ["c", "a"]
    site.deliver("b", "LOG.CSV")
    site.deliver("c", "NOTES.TXT")  # a folder is taken once, whatever comes later
    assert site.run() == ["c", "a", "b"]
    assert site.run() == ["c", "a", "b"] and site.reasons() == []


def test_overdue_folder_is_reported_once_and_taken_when_complete(site):
    site.deliver("late", "METADATA.TXT", "DHT.CSV", "LOG.CSV")
    assert site.run(hold_sec=0.2) == []
    time.sleep(0.5)
    site.deliver("other", *ALL)
    assert site.run(hold_sec=0.2) == ["other"]
    assert site.reasons() == [("late", "missing TOF.CSV")]
    site.deliver("late", "TOF.CSV")
    assert site.run(hold_sec=0.2) == ["other", "late"]
    assert site.reasons() == [("late", "missing TOF.CSV")]


def test_only_other_files(site):
    site.deliver("x", "README")
    assert site.run() == []


def test_batches_of_folders(spark, site):
    batch = spark.createDataFrame([(f"{site.root}/{n}", []) for n in "abc"], "folder string, missing array<string>")
    for name in "abc":
        site.deliver(name, *ALL)
    arrivals.settle(batch, site.out, arrivals.Params(), batch_folders=2)
    arrivals.settle(batch.limit(0), site.out, arrivals.Params())
    assert site.done == ["a", "b", "c"]


def test_a_query_that_goes_on_reports_without_new_files(site):
    site.deliver("late", "TOF.CSV")
    query, until = site.start(hold_sec=0.2, trigger={"processingTime": "1 second"}), time.time() + 60

    def wait(ready):
        while not ready() and time.time() < until:
            assert query.exception() is None
            time.sleep(0.3)

    try:
        wait(site.reasons)
        assert site.reasons() == [("late", "missing DHT.CSV, LOG.CSV, METADATA.TXT")]
        site.deliver("late", "METADATA.TXT", "LOG.CSV", "DHT.CSV")
        wait(lambda: site.done)
        assert site.done == ["late"]
    finally:
        query.stop()
