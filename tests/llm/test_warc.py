import hashlib
import uuid
import zlib
from collections import defaultdict

import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from nidalytics.llm import warc
from nidalytics.plans.stages import cut, shared_folder

HTML = "<p>line\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n</p>" * 4
ROWS = [
    (5, "http://a/", HTML),
    (3, "http://b/\r\nx%0A", HTML),
    (9, "http://c/", HTML),
    (3, "http://b2/", HTML),
    (1, "http://d/", "short"),
    (2, "http://e/", "short"),
    (4, None, None),
    (6, "http://f/", ""),
    (None, "http://g/", HTML),
    (None, "http://h/", "only without id " * 10),
    (None, "http://i/", "only without id " * 10),
    (7, "http://j/", "é" * 50),
    (8, "http://k/", "é" * 50),
    (10, "http://l/", "é" * 49),
    (11, "http://m/", "é" * 49),
    (12, "http://n/", "y" * 400_000),
    *((i, "http://hot/", "hot page " * 20) for i in range(100, 180)),
]


def pages(spark, rows=ROWS):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], "page_id long, url string, html string, payload int, size int").repartition(3)


def brute(rows):
    ids = defaultdict(list)
    for page_id, _, html in rows:
        ids[html or ""].append(page_id)
    out = []
    for page_id, _, html in rows:
        raw = (html or "").encode()
        known = [i for i in ids[html or ""] if i is not None]
        first = min(known) if known else None
        again = len(raw) >= 100 and page_id != first
        out.append((page_id, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def test_round_trip_matches_brute_force(spark):
    got = warc.round_trip(pages(spark)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(ROWS)


def test_empty_table(spark):
    assert warc.round_trip(pages(spark, [])).count() == 0


def written(spark, archive_bytes=warc.ARCHIVE_BYTES):
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    return folder, warc.write(warc.with_revisits(warc.pages_with_digest(pages(spark))), folder, archive_bytes)


def test_archives_are_whole_and_indexed(spark):
    folder, index = written(spark, archive_bytes=2000)
    rows = index.collect()
    assert len({r.archive for r in rows}) > 3
    store, base = pafs.FileSystem.from_uri(f"file://{folder}")
    by_archive = defaultdict(list)
    for r in rows:
        by_archive[r.archive].append((r.offset, r.length))
    for name, found in by_archive.items():
        data = store.open_input_file(f"{base}/{name}").readall()
        at = 0
        for offset, length in sorted(found):  # records follow each other without a gap
            assert offset == at
            fields, _ = warc.parse(zlib.decompress(data[offset : offset + length], 31))
            assert fields["warc-type"] in ("response", "revisit")
            at += length
        assert at == len(data)


def test_selected_records_by_range(spark):
    folder, index = written(spark)
    some = index.filter("page_id in (3, 7, 12)")
    got = {(r.page_id, r.url): bytes(r.payload) for r in warc.read(some, folder, gap=0, most=1000).collect()}
    assert got[(12, "http://n/")] == b"y" * 400_000
    assert got[(3, "http://b/\r\nx%0A")] == HTML.encode()
    assert got[(7, "http://j/")] == ("é" * 50).encode()
    assert len(got) == 4


def test_damaged_record_is_not_read_silently(spark):
    folder, index = written(spark)
    wrong = cut(index.limit(1).withColumn("offset", F.col("offset") + 1))
    with pytest.raises(Exception):  # noqa: B017
        warc.read(wrong, folder).collect()


@pytest.mark.parametrize(
    ("gap", "most", "want"), [(0, 100, [(0, 20), (25, 30), (90, 100)]), (5, 100, [(0, 30), (90, 100)]), (1000, 30, [(0, 30), (90, 100)]), (1000, 1000, [(0, 100)])]
)
def test_ranges(gap, most, want):
    found = [(0, 10), (10, 10), (25, 5), (90, 10)]
    got = list(warc.ranges(found, gap, most))
    assert [(a, b) for a, b, _ in got] == want
    assert [r for _, _, rows in got for r in rows] == found


def test_record_fields():
    raw = warc.record(7, "http://x/\nWARC-Type: fake", b"body\r\n\r\n", "ab", None, False)
    fields, payload = warc.parse(raw)
    assert payload == b"body\r\n\r\n" and fields["warc-type"] == "response"
    assert warc.original(fields["warc-target-uri"]) == "http://x/\nWARC-Type: fake"
    fields, payload = warc.parse(warc.record(None, None, b"", "ab", 3, True))
    assert payload == b"" and warc.id_of(fields["warc-record-id"]) is None and warc.id_of(fields["warc-refers-to"]) == 3
