import math
import re
from collections import Counter

import numpy as np
import pytest
from helpers import lower, prose

from nidalytics.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, id int, n int, terms string, score int, rank int, item_id int, DOC int"
ITEMS = "item_id long, text string, term string, rank int, item int"


def docs(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, 2, "x", 3, 4, 5, 6) for r in rows], DOCS).repartition(parts)


def items(spark, rows):
    return spark.createDataFrame([(*r, "y", 7, 8) for r in rows], ITEMS)


def brute(asked, rows, k=10):
    counted = [(d, Counter(TERM.findall(lower(t)))) for d, t in rows]
    n_docs = sum(1 for _, c in counted if c)
    total = sum(sum(c.values()) for _, c in counted)
    holders = Counter(t for _, c in counted for t in c)
    wanted = {}
    for item, text in asked:
        wanted.setdefault(item, set()).update(TERM.findall(lower(text)))
    out = []
    for item, terms in wanted.items():
        scores = []
        for doc, c in counted:
            n, score = sum(c.values()), 0
            for t in terms & c.keys():
                m = 100 - 90 + (90 * n * n_docs) // total
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holders[t] + 1)))
                score += w * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        out += [(item, r, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def told(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


def test_terms_of_bytes_are_those_of_the_pattern():
    text = "Ab9_c--É x\x7fy 日本　語 [Z] ß\U0001f642q\x00w\x1cz"
    found = TERM.findall(lower(text))
    places = {t.encode(): i for i, t in enumerate(dict.fromkeys(found))}
    for piece in (1, 2, 3, 7, 1 << 20):
        n, counts = lexical.count_terms(text.encode(), places, piece)
        assert n == len(found) and counts == Counter(places[t.encode()] for t in found)
    assert lexical.count_terms(b"", places) == (0, Counter())


def test_tiles_are_exact_beyond_float64(monkeypatch):
    draw = np.random.default_rng(3)
    n_items, n_docs, n_terms = 150, 37, 900
    w = draw.integers(0, 40_000, (n_items, n_terms)) * (draw.random((n_items, n_terms)) < 0.3)
    x = draw.integers(0, lexical.TOP_IMPACT, (n_docs, n_terms)) * (draw.random((n_docs, n_terms)) < 0.3)
    item, term = np.nonzero(w)
    doc, doc_term = np.nonzero(x)
    want = w.astype(object) @ x.T.astype(object)
    for tile, exact in ((4096, 1 << 53), (100, 1 << 53), (4096, 1 << 38)):  # one tile, many, and so narrow that few terms fit
        monkeypatch.setattr(lexical, "TERM_TILE", tile)
        monkeypatch.setattr(lexical, "EXACT", exact)
        got = lexical.tile_scores(item, term, w[item, term], n_items, doc, doc_term, x[doc, doc_term], n_docs)
        assert (got == want).all()


def test_best_keeps_ties_by_id():
    best = lexical.Best(1, 3)
    for ids in ([9, 4, 7], [5, 1, 8], [2, 3, 6]):
        best.add(np.array([[5, 5, 5]]), np.array(ids), np.array([False, ids[0] == 2, False]))
    assert best.rows[0][2].tolist() == [1, 2, 4]  # 3 stands for a null
    best.add(np.array([[4, 6, 0]]), np.array([0, 50, 51]), np.zeros(3, bool))
    assert best.rows[0][2].tolist() == [50, 1, 2]


ASKED = [(0, prose(50, 30)), (1, prose(51, 12).upper()), (1, "w1 Zeta"), (2, "nowhere-to_be found"), (3, None), (4, ""), (None, prose(52, 9)), (5, "ñandú 日本"), (6, "zeta zeta ZETA")]


@pytest.mark.parametrize("block_pairs, block_items", [(1 << 18, 4096), (8, 4096), (1 << 18, 2)])
def test_against_brute_force(spark, block_pairs, block_items):
    rows = [(i, prose(50 + i % 4, 20 + 7 * i)) for i in range(40)]
    rows += [(100 + i, "zeta Ñandú ñandú") for i in range(14)]  # ties, and É, Ñ are no A-Z
    rows += [(7, "zeta"), (7, "zeta"), (None, "zeta"), (None, "zeta zeta"), (60, None), (61, ""), (62, "-- !!"), (63, "日本" * 50)]
    got = told(lexical.search(items(spark, ASKED), docs(spark, rows), block_pairs=block_pairs, block_items=block_items))
    assert got == brute(ASKED, rows)


def test_long_texts_and_a_term_in_every_document(spark, monkeypatch):
    monkeypatch.setattr(lexical, "PIECE_BYTES", 1000)
    rows = [(1, "common " * 300_000 + "rare"), (2, "x" * 1_500_000), (3, "common"), (4, "common rare")]
    asked = [(1, "common rare " + "q" * 5000)]
    assert told(lexical.search(items(spark, asked), docs(spark, rows))) == brute(asked, rows)


def test_many_documents_fewer_than_k_and_empty_tables(spark):
    rows = [(i, f"alpha {'beta ' * (i % 5)}") for i in range(2500)]
    asked = [(1, "beta"), (2, "alpha beta")]
    assert told(lexical.search(items(spark, asked), docs(spark, rows, 7), k=4)) == brute(asked, rows, 4)
    assert lexical.search(items(spark, []), docs(spark, rows)).collect() == []
    assert lexical.search(items(spark, asked), docs(spark, [])).collect() == []
    assert lexical.search(items(spark, [(1, None)]), docs(spark, [(1, None)])).columns == ["item_id", "rank", "doc_id", "score"]
