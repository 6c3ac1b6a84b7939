import hashlib
from collections import defaultdict

import pytest
from helpers import documents, lower

from nidalytics.llm import repeats

ROWS = [
    (1, "Same Text"),
    (2, "same text"),
    (7, "SAME TEXT"),
    (7, "same text"),
    (3, "É"),
    (4, "é"),
    (5, None),
    (6, ""),
    (None, "same text"),
    (None, "alone"),
    (None, "alone"),
    (8, "x" * 300_000),
    (9, "X" * 300_000),
    (10, "unique"),
    *((i, "hot") for i in range(100, 160)),
]


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[lower(text)].append(doc_id)
    out = []
    for doc_id, text in rows:
        ids = groups[lower(text)]
        known = [i for i in ids if i is not None]
        out.append((doc_id, max(known) if known else None, len(ids), hashlib.sha256(lower(text).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [repeats.BLOCK, repeats.FILTER_BITS])
def test_copies_match_brute_force(spark, bits):
    got = repeats.copies(documents(spark, ROWS), bits=bits).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute(ROWS)
    kept = defaultdict(list)
    for r in got:
        if r.kept:
            kept[r.text_sha256].append((r.doc_id, r.keep_id))
    # exactly one row of each group, also where rows are repeated or have no id
    assert len(kept) == len({r.text_sha256 for r in got})
    assert all(len(k) == 1 and k[0][0] == k[0][1] for k in kept.values())


def test_drop_copies_keeps_columns_and_one_row_each(spark):
    docs = documents(spark, ROWS)
    got = repeats.drop_copies(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    assert sorted(lower(r.text) for r in rows) == sorted({lower(t) for _, t in ROWS})
    best = {lower(r.text): r.doc_id for r in rows}
    assert best["same text"] == 7 and best["hot"] == 159 and best[""] == 6 and best["alone"] is None


def test_empty_table(spark):
    docs = documents(spark, [])
    assert repeats.copies(docs).count() == 0
    assert repeats.drop_copies(docs).count() == 0


def test_filter_flags_every_repeat(spark):
    rows = spark.createDataFrame([(str(i % 900),) for i in range(1000)], "digest string")
    flagged = repeats.may_repeat(rows, "digest", repeats.repeat_filter(rows, "digest"), "flag")
    by = {r.digest: r.flag for r in flagged.collect()}
    assert all(by[str(i)] for i in range(100))
    assert sum(by.values()) < 150


def test_only_candidates_are_shuffled(spark):
    rows = documents(spark, [(i, f"text {i}") for i in range(50)]).selectExpr("doc_id", "text as digest", "false as flag")
    out = repeats.group_repeats(rows, "digest", "doc_id", "flag").collect()
    assert len(out) == 50 and all(r.size == 1 and r.keep is None for r in out)


@pytest.mark.parametrize("most", [0, 100_000])
@pytest.mark.parametrize("bits", [repeats.BLOCK, repeats.FILTER_BITS])
def test_listed_rows_go(spark, monkeypatch, most, bits):
    monkeypatch.setattr(repeats, "BROADCAST_ROWS", most)
    rows = spark.createDataFrame([(f"k{i % 400}", i) for i in range(4000)], "key string, v int")
    gone = spark.createDataFrame([(f"k{i}",) for i in range(0, 600, 3)], "key string")
    got = repeats.drop_listed(rows, rows.select("key"), gone, "key", bits)
    assert sorted(r.v for r in got.collect()) == [i for i in range(4000) if (i % 400) % 3]
