import random
import tracemalloc
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from helpers import documents, prose, words
from pyspark.sql import functions as F

from nidalytics.llm import lines
from nidalytics.plans import stages
from nidalytics.plans.stages import shared_folder


def brute(rows):
    """Lines to remove: any earlier line has a set at least 0.8 alike. Order: id, null first, then row."""
    placed = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, i))
    seen, out = [], {}
    for i in placed:
        gone = []
        for no, line in enumerate((rows[i][1] or "").split("\n")):
            s = set(words(line))
            if not s:
                continue
            if any(9 * len(s & t) >= 4 * (len(s) + len(t)) for t in seen):
                gone.append(no)
            seen.append(s)
        out[i] = (rows[i][0], sum(bool(words(x)) for x in (rows[i][1] or "").split("\n")), gone)
    return sorted(out.values(), key=str)


def edits(seed, n, base, changes):
    draw, out = random.Random(seed), []
    for _ in range(n):
        w = base.split()
        for _ in range(draw.randint(0, changes)):
            w[draw.randrange(len(w))] = f"new{draw.randint(0, 30)}"
        out.append(" ".join(w))
    return out


def made(seed):
    draw = random.Random(seed)
    rows = []
    for i in range(40):
        text = []
        for k in range(draw.randint(0, 6)):
            base = prose(draw.randint(0, 12), draw.choice([1, 2, 3, 4, 5, 8, 20, 40]), 40)
            text += edits(1000 * i + k, 1, base, 3)
        rows.append((i, "\n".join(text)))
    return rows


ODD = [
    (1, "a b c"),
    (2, "c b a"),
    (3, "a a  b\tc"),
    (4, " a\x0bb c \r"),
    (5, None),
    (6, ""),
    (7, "\n \n\t\n"),
    (8, "the\nthe\n\nthe"),
    (9, "a b c d"),
    (10, "a b c d e"),
    (11, "a b c d e f"),
    (12, prose(1, 20_000, 4000)),
    (13, prose(1, 20_000, 4000) + " more"),
    (None, "null id line one"),
    (14, "null id line one"),
]


@pytest.mark.parametrize("rows", [ODD, made(1), made(2), [(i, x) for i, x in enumerate(edits(3, 150, prose(9, 30), 4))]])
@pytest.mark.parametrize("many", [2, 64])
def test_matches_brute_force(spark, monkeypatch, rows, many):
    monkeypatch.setattr(lines, "MANY", many)
    got = lines.repeated_lines(documents(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_lines, r.removed) for r in got), key=str) == brute(rows)
    assert all(r.n_removed == len(r.removed) for r in got)


def test_comparisons_grow_with_the_lines(spark, monkeypatch):
    compared, verified = [], lines.verified
    monkeypatch.setattr(lines, "verified", lambda pairs, sets: compared.append(pairs.count()) or verified(pairs, sets))
    for n in (150, 600):
        compared.clear()
        rows = [(i, f"{prose(9, 18)} new{i}") for i in range(n)]  # any two of them match
        got = lines.repeated_lines(documents(spark, rows)).collect()
        assert [r.doc_id for r in got if not r.n_removed] == [0] and sum(compared) <= 2 * n


def test_large_tables_go_when_they_are_read(spark, monkeypatch):
    """Prefixes and entries are the bulk of the disk: of them the present tables stay, in the end none."""
    monkeypatch.setattr(lines, "MANY", 2)
    folder = Path(shared_folder(spark).removeprefix("file:"))
    earlier, held, cut = set(folder.iterdir()), [], lines.cut

    def large():
        names = [next(t.glob("*.parquet"), None) for t in set(folder.iterdir()) - earlier]
        return sum(bool({"prefix", "pos"} & set(pq.read_schema(n).names)) for n in names if n)

    def watched(df):
        out = cut(df)
        held.append(large())
        return out

    monkeypatch.setattr(lines, "cut", watched)
    rows = made(5)
    got = lines.repeated_lines(documents(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_lines, r.removed) for r in got), key=str) == brute(rows)
    assert max(held) <= 3 and not large()


def test_words_and_pairs_are_worked_on_in_slices(spark, monkeypatch):
    """What is joined at a time, and so lies in the shuffle, is a share of the entries, in rounds and after them."""
    rows = list(enumerate(edits(3, 40, prose(9, 30), 4)))
    for name, value in (("MANY", 2), ("SLICES", 2), ("SLICE_ENTRIES", 1), ("SLICE_PAIRS", 1)):
        monkeypatch.setattr(lines, name, value, raising=False)
    entries_of, led_pairs, open_pairs = lines.entries_of, lines.led_pairs, lines.open_pairs
    verified, all_entries, at_once, pairs = lines.verified, [], [], []

    def made_entries(firsts):
        all_entries.append((out := entries_of(firsts)).count())
        return out

    def joined(work):
        return lambda mine, other: at_once.append(mine.count()) or work(mine, other)

    monkeypatch.setattr(lines, "entries_of", made_entries)
    monkeypatch.setattr(lines, "led_pairs", joined(led_pairs))
    monkeypatch.setattr(lines, "open_pairs", joined(open_pairs))
    monkeypatch.setattr(lines, "verified", lambda part, sets: pairs.append(part.count()) or verified(part, sets))
    got = lines.repeated_lines(documents(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_lines, r.removed) for r in got), key=str) == brute(rows)
    assert max(at_once) < 0.7 * all_entries[0] and len(pairs) >= 4


def test_partitioned_tables_go(spark):
    table = stages.cut(spark.range(10).selectExpr("id", "int(id % 3) AS slice"), "slice")
    place = Path(table.inputFiles()[0].removeprefix("file:")).parents[1]
    stages.forget(table)
    assert place.name.startswith("stage-") and not place.exists()


def test_one_cell_for_all_words_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(lines, "CELLS", 1)
    rows = made(4)
    got = lines.repeated_lines(documents(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_lines, r.removed) for r in got), key=str) == brute(rows)


def test_repeated_ids(spark):
    rows = [(1, "some line of text"), (1, "some line of text"), (1, "another one here now")]
    got = lines.repeated_lines(documents(spark, rows, 1)).collect()
    assert len(got) == 3 and sum(r.n_removed for r in got) == 1


def test_empty_table(spark):
    assert lines.repeated_lines(documents(spark, [])).count() == 0


def test_cleaned_texts(spark):
    docs = documents(spark, [(1, "one two three\n\nfour five"), (2, "four five\nnew line"), (3, None)])
    out = lines.without_repeats(docs)
    assert out.columns == docs.columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: "one two three\n\nfour five", 2: "new line", 3: None}


def test_order_of_words_is_held_as_plain_numbers(spark, monkeypatch):
    """What the driver holds of it is some bytes a cell."""
    monkeypatch.setattr(lines, "CELLS", 2**17)
    rows = [(i, " ".join(f"w{k}" for k in range(1000 * i, 1000 * i + 1000)) + "\nthe\tthe  end" * (i < 4)) for i in range(300)]
    rows = lines.numbered(documents(spark, rows), "doc_id", "text")
    tracemalloc.start()
    found = lines.frequencies(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 * lines.CELLS
    cell = F.xxhash64("w").bitwiseAND(F.lit(lines.CELLS - 1)).cast("int")
    got = spark.createDataFrame([("the",), ("end",)], "w string").select("w", F.get(found, cell).alias("digits")).collect()
    assert all(r.digits >= {"the": 4, "end": 3}[r.w] for r in got)
