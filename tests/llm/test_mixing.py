import random
from collections import Counter, defaultdict

import pytest
from helpers import documents, words

from nidalytics.llm import mixing


def made(n=600, seed=3):
    draw = random.Random(seed)
    sources = ["b", "a", None, "é", "zz"]
    return [(i, " ".join(["w"] * draw.randint(0, 40)), sources[min(4, int(draw.expovariate(1)))]) for i in range(n)]


def wanted(sizes, weights=(5, 2, 1), most=3):
    """Shares by weight; what is above the limit goes to the others until nothing is."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in full]
        if not rest:
            return full
        left, w = total - sum(full.values()), sum(weight[s] for s in rest)
        share = {s: weight[s] * left / w for s in rest}
        over = [s for s in rest if share[s] > most * sizes[s]]
        if not over:
            return full | share
        full |= {s: most * sizes[s] for s in over}


def sizes_of(rows):
    out = Counter()
    for _, text, source in rows:
        out[source] += len(words(text))
    return out


@pytest.mark.parametrize("rows", [made(), made(40, 5), [(1, "a b c", "x")], [(1, "", "x"), (2, None, "y")]])
def test_targets_and_taken_words(spark, rows):
    got = mixing.mix_report(documents(spark, rows)).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    source, sizes = {r[0]: r[2] for r in rows}, sizes_of(rows)
    target = wanted(sizes) if sum(sizes.values()) else dict.fromkeys(sizes, 0)
    taken, largest = Counter(), defaultdict(int)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s]
        assert r.target == pytest.approx(target[s])
        assert r.size * int(r.target // max(1, r.source_size)) <= r.taken <= 3 * r.size
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    for s in sizes:
        assert target[s] - largest[s] <= taken[s] <= target[s] + 1e-6


def test_reruns_agree_whatever_the_layout(spark):
    rows = made()
    one = {r.doc_id: r.taken for r in mixing.mix_report(documents(spark, rows, 2)).collect()}
    two = {r.doc_id: r.taken for r in mixing.mix_report(documents(spark, rows[::-1], 7)).collect()}
    assert one == two
    assert one != {r.doc_id: r.taken for r in mixing.mix_report(documents(spark, rows), seed="other").collect()}


def test_many_cells_give_the_same_order(spark, monkeypatch):
    rows = made(500)
    sizes = sizes_of(rows)
    monkeypatch.setattr(mixing, "CELL_ROWS", 10)
    taken = Counter()
    source = {r[0]: r[2] for r in rows}
    got = mixing.mix_report(documents(spark, rows)).collect()
    for r in got:
        taken[source[r.doc_id]] += r.taken
    for s, target in wanted(sizes).items():
        assert target - 40 <= taken[s] <= target + 1e-6


def test_mixed_repeats_rows_as_reported(spark):
    rows = made(200)
    docs = documents(spark, rows)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    copies = Counter(r.doc_id for r in out.collect())
    for r in mixing.mix_report(docs).collect():
        if r.size:
            assert copies[r.doc_id] * r.size == r.taken


def test_longer_documents_are_drawn_more_often(spark):
    rows = [(i, " ".join(["w"] * (5 if i % 2 else 80)), "x" if i % 10 else "y") for i in range(4000)]
    got = mixing.mix_report(documents(spark, rows), weights=(1, 3)).collect()
    x = [r for r in got if rows[r.doc_id][2] == "x"]
    short, long = ([r.taken > 0 for r in x if r.size == n] for n in (5, 80))
    assert 0 < sum(short) / len(short) < sum(long) / len(long) < 1


def test_repeated_rows_draw_one_by_one(spark, monkeypatch):
    """A source of equal rows comes within one of them of its target, as slices of any size do."""
    monkeypatch.setattr("nidalytics.plans.ordered.TARGET_ROWS", 200)
    rows = [(1, "a b c d e f g h i j", "b")] * 1000 + [(10 + i, "k " * 10, "a") for i in range(1000)]
    got = mixing.mix_report(documents(spark, rows, 5)).collect()
    taken, target = sum(r.taken for r in got if r.doc_id == 1), next(r.target for r in got if r.doc_id == 1)
    assert len(got) == 2000 and abs(taken - target) <= 10
    again = mixing.mix_report(documents(spark, rows[::-1], 2)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    out = mixing.mixed(documents(spark, rows, 5))
    assert 10 * out.where("doc_id = 1").count() == taken


def test_null_ids_and_empty_table(spark):
    rows = [(None, f"text {i} of no id", None) for i in range(30)]
    assert sum(r.taken for r in mixing.mix_report(documents(spark, rows)).collect()) == 150
    assert mixing.mix_report(documents(spark, [])).count() == 0
    assert mixing.mixed(documents(spark, [])).count() == 0
