import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from nidalytics.llm import nearest

ROWS = "vec_id long, embedding array<float>, label int, id int, row int, asks boolean, vector string, query_id int, rank int, score int"


def table(spark, rows, parts=4):
    return spark.createDataFrame([(*r, 1, 2, 3, False, "x", 4, 5, 6) for r in rows], ROWS).repartition(parts)


def asks():
    return F.col("vec_id") % 50 == 0


def brute(rows, k=5):
    good = [(i, e) for i, e in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    whole = [(i, [math.floor(256 * float(np.float32(x))) for x in e]) for i, e in good]
    out = []
    for q, (query, a) in enumerate(whole):
        if query is None or query % 50:
            continue
        scores = [(-sum(x * y for x, y in zip(a, b, strict=False)), i is None, i or 0) for c, (i, b) in enumerate(whole) if c != q]
        out += [(query, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def told(df):
    return sorted(((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect()), key=str)


def vectors(n, dims, seed=0, scale=0.3):
    draw = random.Random(seed)
    return [(i, [draw.gauss(0, scale / (1 + d % 7)) for d in range(dims)]) for i in range(n)]


@pytest.mark.parametrize("dims", [1, 15, 16, 17, 64])
@pytest.mark.parametrize("query_block", [8192, 3])
def test_against_brute_force(spark, dims, query_block):
    rows = vectors(400, dims, dims)
    assert told(nearest.top_inner_products(table(spark, rows), asks(), query_block=query_block)) == brute(rows)


def test_ties_repeats_and_unusable_vectors(spark):
    rows = vectors(120, 8, 1)
    rows += [(50, rows[50][1])] * 3 + [(i, [0.5] * 8) for i in (300, 300, 307, 301, 350, 302, 303, 304)]
    rows += [(None, [0.5] * 8), (None, [0.25] * 8), (400, None), (401, [0.1, None]), (450, [float("nan")]), (451, [float("inf"), 1.0])]
    got = told(nearest.top_inner_products(table(spark, rows), asks()))
    assert got == brute(rows)


def test_vectors_of_unequal_length(spark):
    rows = [(i, e[: 1 + i % 40]) for i, e in vectors(150, 40, 2)] + [(500, []), (501, []), (550, [1.0] * 90)]
    assert told(nearest.top_inner_products(table(spark, rows), asks())) == brute(rows)


def test_few_rows_and_empty_tables(spark):
    rows = vectors(3, 4, 3)
    assert told(nearest.top_inner_products(table(spark, rows), asks())) == brute(rows)
    assert nearest.top_inner_products(table(spark, [(0, [1.0])]), asks()).collect() == []
    assert nearest.top_inner_products(table(spark, [(1, [1.0])]), asks()).collect() == []
    assert nearest.top_inner_products(table(spark, []), asks()).columns == ["query_id", "rank", "vec_id", "score"]


def test_integers_beyond_float64(spark):
    rows = [(i, [3e6 + i, -7e3 * i, 1.5]) for i in range(120)]
    assert told(nearest.top_inner_products(table(spark, rows), asks())) == brute(rows)


def test_many_equal_vectors(spark):
    rows = [(i, [0.5, 0.25]) for i in range(5000)]
    got = told(nearest.top_inner_products(table(spark, rows, 8), asks()))
    score = 128 * 128 + 64 * 64
    want = [(q, r, i, score) for q in range(0, 5000, 50) for r, i in enumerate([j for j in range(6) if j != q][:5], 1)]
    assert got == sorted(want, key=str)


def test_bounds_abandon_most_pairs():
    rng = np.random.default_rng(0)
    weight = np.exp(-np.arange(64) / 8.0)[:, None]
    tile = np.floor(256 * rng.normal(size=(64, 4000)) * weight)
    queries = np.floor(256 * rng.normal(size=(64, 20)) * weight)
    best = nearest.Best(20, 5, np.sort(queries.T @ tile, axis=1)[:, -5])
    offered = []
    add = best.add
    best.add = lambda q, score, *rest: (offered.append(len(score)), add(q, score, *rest))
    ids = np.arange(4000)
    nearest.search_tile(queries, nearest.remaining_mass(queries), -1 - np.arange(20), tile, ids, np.zeros(4000, bool), ids, best, 0)
    assert sum(offered) == 100  # only the five best of each query reach the end
    for q in range(20):
        assert best.rows[q][0].tolist() == sorted((queries[:, q] @ tile).tolist(), reverse=True)[:5]
