import random
import re

import numpy as np
import pytest
import xxhash
from helpers import components, documents, lower, prose, words

from nidalytics.llm import simhash


def brute_print(text, k=3):
    w = words(lower(text))
    shingles = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def edited(text, seed, n):
    draw, w = random.Random(seed), text.split()
    for _ in range(n):
        w[draw.randrange(len(w))] = f"edit{draw.random()}"
    return " ".join(w)


BASE = prose(1, 300)
ROWS = [
    (50, BASE),
    *((51 + i, edited(BASE, i, 1)) for i in range(25)),
    (3, BASE.upper()),
    (2, None),
    (9, ""),
    (8, " \n\t"),
    (10, "one"),
    (11, "ONE"),
    (12, "one two"),
    (13, "É é"),
    (14, prose(14, 40_000)),
    (15, "x y " * 500),
    (15, "x y " * 500),
    (None, prose(20, 50)),
    (None, prose(21, 50)),
    *((200 + i, prose(200 + i, 60)) for i in range(20)),
]


def test_groups_match_brute_force(spark):
    got = simhash.near_groups(documents(spark, ROWS)).collect()
    prints = [brute_print(t) for _, t in ROWS]
    label = components(len(ROWS), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3)
    least = {}
    for (doc_id, _), c in zip(ROWS, label, strict=True):
        if doc_id is not None:
            least[c] = min(least.get(c, doc_id), doc_id)
    want = [(i, f"{p:016x}", least.get(c)) for (i, _), p, c in zip(ROWS, prints, label, strict=True)]
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("text", [BASE, "", "a", "a b", "Straße ÉÀ b\x0bc\x0cd", "repeat it " * 30, "\x85\xa0 x y"])
def test_fingerprint(text):
    assert simhash.fingerprint(simhash.shingle_hashes(text, 3)).hex() == f"{brute_print(text):016x}"


def clustered(bits, radius, seed=0):
    draw = np.random.default_rng(seed)
    rows = []
    for base in draw.integers(0, 2, (30, bits), dtype=np.uint8):
        for _ in range(draw.integers(1, 15)):
            row = base.copy()
            row[draw.choice(bits, draw.integers(0, radius + 3), replace=False)] ^= 1
            rows.append(row)
    return np.packbits(np.array(rows), axis=1)


@pytest.mark.parametrize(("bits", "radius"), [(64, 0), (64, 1), (64, 3), (64, 9), (128, 7), (256, 42)])
def test_forest_matches_all_pairs(bits, radius):
    fps = clustered(bits, radius)
    unit = np.sort(np.random.default_rng(1).integers(0, 4, len(fps)))
    flat = np.unpackbits(fps, axis=1).astype(int)
    near = ((flat[:, None] != flat[None]).sum(axis=-1) <= radius) & (unit[:, None] == unit[None])
    assert simhash.forest(fps, unit, radius).tolist() == components(len(fps), lambda i, j: near[i, j])


def test_small_batches_and_jobs_give_the_same(monkeypatch):
    fps = clustered(64, 3, 5)
    unit = np.zeros(len(fps), int)
    want = simhash.forest(fps, unit, 3).tolist()
    monkeypatch.setattr(simhash, "JOBS", 10)
    assert simhash.forest(fps, unit, 3).tolist() == want


@pytest.mark.parametrize("bucket_rows", [4, 30, 4096])
def test_split_buckets_lose_no_link(spark, bucket_rows):
    fps = np.unique(clustered(64, 3, 7), axis=0)
    rows = spark.createDataFrame([(f.tobytes(),) for f in fps], "fp binary")
    found = simhash.components(simhash.linked(rows, simhash.blocks(64, 3), 3, bucket_rows)).collect()
    got = {bytes(r.node): bytes(r.label) for r in found}
    flat = np.unpackbits(fps, axis=1).astype(int)
    near = (flat[:, None] != flat[None]).sum(axis=-1) <= 3
    label = components(len(fps), lambda i, j: near[i, j])
    assert [got.get(f.tobytes(), f.tobytes()) for f in fps] == [fps[k].tobytes() for k in label]


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(bytes([1, i]), bytes([1, i + 1])) for i in range(40)]
    star = [(bytes([2, 9]), bytes([2, i])) for i in range(60)]
    found = simhash.components(spark.createDataFrame(chain + star, "a binary, b binary"))
    got = {bytes(r.node): bytes(r.label) for r in found.collect()}
    assert got == {bytes([1, i]): bytes([1, 0]) for i in range(41)} | {bytes([2, i]): bytes([2, 0]) for i in range(60)}
    assert simhash.components(spark.createDataFrame([], "a binary, b binary")).count() == 0


@pytest.mark.parametrize("links", [7, 2**20])
def test_tasks_contract_links_before_any_are_shuffled(spark, monkeypatch, links):
    monkeypatch.setattr(simhash, "LINKS", links)
    written, cut = [], simhash.cut
    monkeypatch.setattr(simhash, "cut", lambda *a: written.append(cut(*a)) or written[-1])
    chain = [(bytes([1, i]), bytes([1, i + 1])) for i in range(60)]
    knot = [(bytes([2, 9 * i % 11]), bytes([2, i])) for i in range(11)]
    rows = chain + knot
    random.Random(1).shuffle(rows)
    found = simhash.components(spark.createDataFrame(rows, "a binary, b binary").repartition(5)).collect()
    got = {bytes(r.node): bytes(r.label) for r in found}
    nodes = sorted({x for r in rows for x in r})
    near = {frozenset(r) for r in rows}
    label = components(len(nodes), lambda i, j: frozenset((nodes[i], nodes[j])) in near)
    assert [got.get(x, x) for x in nodes] == [nodes[k] for k in label]
    # one task holds all links: they are written twice; star steps alone took four tables a round
    assert links == 7 or len(written) == 2


def test_the_smallest_id_of_each_group_stays(spark):
    rows = []
    for i in range(40):
        base = prose(1000 + i, 400, 3000)
        rows.append((1000 * i + 1, base))
        rows += [(1000 * i + 2 + j, edited(base, 10 * i + j, 2)) for j in range(4)]
        rows.append((1000 * i + 9, edited(base, 99 + i, 120)))
    docs = documents(spark, rows)
    out = simhash.drop_near_copies(docs)
    assert out.columns == docs.columns
    prints = [brute_print(t) for _, t in rows]
    label = components(len(rows), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3)
    want = {min(rows[j][0] for j in range(len(rows)) if label[j] == k) for k in label}
    assert {r.doc_id for r in out.collect()} == want
    assert all(1000 * i + 1 in want and 1000 * i + 9 in want for i in range(40)) and len(want) < 200


def test_drop_on_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, BASE), (4, BASE), (5, "a b"), (6, prose(7, 90)), (6, prose(8, 90))]
    kept = [(r.doc_id, r.text) for r in simhash.drop_near_copies(documents(spark, rows)).collect()]
    assert sorted(kept, key=str) == sorted([(1, None), (None, BASE), (5, "a b"), (6, prose(7, 90)), (6, prose(8, 90))], key=str)


def test_empty_table(spark):
    assert simhash.near_groups(documents(spark, [])).count() == 0
    assert simhash.drop_near_copies(documents(spark, [])).count() == 0


def test_pattern_of_words_is_the_contracts():
    text = "a\x1cb\x85c\xa0d e\x0bf"
    assert [w.decode() for w in text.encode().split()] == re.findall(r"[^\x20\x09-\x0d]+", text)
