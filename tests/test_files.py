import io

import pytest

from nidalytics.plans import pipeline
from nidalytics.sources import files, raw, schemas

TEXT = b"\xef\xbb\xbfone\r\ntwo\rthree\n\n\xffour, and a longer line than others\nlast"


@pytest.mark.parametrize("split", [1, 2, 3, 5, 7, 16, 1000])
def test_ranges_give_each_line_once(split):
    found = []
    for start in range(0, len(TEXT), split):
        found += files.lines_of(io.BytesIO(TEXT), start, min(start + split, len(TEXT)), len(TEXT))
    assert [v for v in found if v] == [v for v in TEXT[3:].splitlines() if v]


def test_lines_of_files_in_ranges(spark, tmp_path):
    for name, n in (("a", 400), ("b", 3), ("empty", 0)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "TOF.CSV").write_text("".join(f"{name},{i}\n" for i in range(n)))
    found = files.lines(files.named(spark, f"{tmp_path}/*/TOF.CSV"), split_bytes=100).collect()
    assert {r["path"].split("/")[-2] for r in found if r["whole"]} == {"b"}
    rows = sorted((r["path"].split("/")[-2], r["start"], r["row"], r["value"]) for r in found)
    assert [r[3] for r in rows] == [f"{name},{i}" for name, n in (("a", 400), ("b", 3)) for i in range(n)]


def test_odd_folder_names_and_hidden_files(spark, tmp_path):
    names = ["a b", "c%20d", "é#[x]", "plain"]
    for name in names:
        (tmp_path / name).mkdir()
        for file in schemas.REQUIRED_FILES:
            text = ",".join(dict(schemas.RAW_FILES)[file].names) if file in schemas.RAW_FILES else f"deployment_id=of {name}"
            (tmp_path / name / file).write_text(text + "\n")
    (tmp_path / "bare").mkdir()
    (tmp_path / "bare" / "_TOF.CSV").write_text("")
    (tmp_path / "stray").write_text("")
    found = raw.discover_deployments(spark, str(tmp_path)).collect()
    assert {r["deployment_id"] for r in found} == {f"of {n}" for n in names}
    folders = spark.createDataFrame([(r["folder"],) for r in found], "folder string")
    assert raw.read_lines(spark, raw.files_of(folders, schemas.TOF_FILE)).count() == 4
    plain = spark.createDataFrame([(f"file:{tmp_path}/{n}",) for n in names], "folder string")
    assert {r[0] for r in files.addressed(plain).collect()} == {r["folder"] for r in found}
    assert raw.list_files(spark, str(tmp_path / "nowhere")).count() == 0


def test_empty_metadata_describes_no_deployment(spark, tmp_path):
    for name, text in (("none", ""), ("some", "notes=x\n")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "METADATA.TXT").write_text(text)
    assert [r["deployment_id"] for r in raw.read_metadata(spark, f"{tmp_path}/*/METADATA.TXT").collect()] == ["some"]


def test_folders_are_processed_together(spark, tmp_path, monkeypatch):
    """No list of names passes through the driver, and batches depend on ``batch_folders`` alone."""
    seen = []
    monkeypatch.setattr(pipeline, "process_pipeline", lambda session, folders, *_: seen.append([r[0] for r in folders.collect()]))
    rows = [(f"file:/x/{i}", f"d{i}", "2024-05-01") for i in range(40)]
    found = spark.createDataFrame(rows, "folder string, deployment_id string, deployment_date string")
    listing = spark.createDataFrame([(r[0], n) for r in rows for n in schemas.REQUIRED_FILES], "folder string, name string")
    pipeline.process_new(spark, found, listing, str(tmp_path / "out"))
    assert len(seen) == 1 and sorted(seen.pop()) == sorted(r[0] for r in rows)
    pipeline.process_new(spark, found, listing, str(tmp_path / "out"), batch_folders=10)
    assert len(seen) == 4 and sorted(sum(seen, [])) == sorted(r[0] for r in rows)
