from itertools import permutations

import numpy as np
import pytest
from helpers import WORD, prose
from pyspark.sql import functions as F

from nidalytics.llm import audit

DOCS = "doc_id long, text string, lang string, part string, word int, digest string, n long, first long, l0 boolean"


def docs(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", 1, "y", 2, 3, True) for r in rows], DOCS).repartition(parts)


def labels(spark, rows):
    return spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, quality int, toxic int, part int")


def fails(rows):
    """Bit i: the row fails the i-th of the five filters."""
    first = {}
    for doc, text, *_ in rows:
        if doc is not None:
            first[text or ""] = min(doc, first.get(text or "", doc))
    out = []
    for doc, text, *_ in rows:
        text = text or ""
        words = WORD.findall(text)
        capitals = sum("A" <= c <= "Z" for c in text)
        checks = [
            len(words) < 200,
            100 * len(set(words)) < 50 * len(words),
            100 * capitals > 3 * len(text),
            any(c in "#$%&*|" for c in text),
            doc is not None and doc > first[text],
        ]
        out.append(sum(1 << i for i, bad in enumerate(checks) if bad))
    return out


def brute(rows, marks):
    masks = fails(rows)
    good = {d for d, q, _ in marks if q == 1}
    toxic = {d for d, _, t in marks if t == 1}
    out = {}
    for part in {r[2] or "" for r in rows}:
        mine = [(m, r[0]) for m, r in zip(masks, rows, strict=True) if (r[2] or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            alive = list(mine)
            for step, name in enumerate(order, 1):
                bit = 1 << "ABCDE".index(name)
                gone = [x for x in alive if x[0] & bit]
                alive = [x for x in alive if not x[0] & bit]
                failing = sum(1 for m, _ in mine if m & bit)
                unique = sum(1 for m, _ in mine if m == bit)
                lost = [sum(1 for _, d in gone if d is not None and d in marked) for marked in (good, toxic)]
                shapley[name] += len(gone)
                out[part, "".join(order), step] = [len(alive), len(gone), failing - len(gone), unique, *lost]
        for (p, order, step), values in out.items():
            if p == part:
                values.append(shapley[order[step - 1]])
    return out


def told(df):
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in names] for r in df.collect()}


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 97, 1000, 40_001])
def test_positional_popcount(n):
    words = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint32)
    want = [int((words >> np.uint32(i) & 1).sum()) for i in range(32)]
    assert audit.positional_popcount(words).tolist() == want


def test_words_say_which_subsets_a_document_survives(spark):
    rows = [(1, prose(1, 250), "en"), (2, prose(1, 250), "en"), (3, "a $ B", None), (4, None, "de")]
    text = F.col("_text")
    filters = {"A": audit.length_below(text, 200), "D": text.rlike("[$]")}
    words = {r["id"]: r["word"] & 0xFF for r in audit.survival_words(docs(spark, rows), filters, copies="E").collect()}
    # subsets of A, D, E as bits 1, 2, 4
    assert words == {1: 0xFF, 2: 0x0F, 3: 0b00010001, 4: 0b01010101}


def test_against_brute_force(spark):
    long, loud = prose(2, 300), prose(3, 210).upper()
    rows = [(i, long, "en") for i in (5, 5, 7, 9, 11)]  # copies, the smallest id twice
    rows += [(20 + i, prose(20 + i, 150 + 20 * i), ["en", "fr", None][i % 3]) for i in range(9)]
    rows += [(40, loud, "fr"), (41, loud, "de"), (42, "x " * 300, "de"), (43, "x " * 300 + "&", "de"), (44, "Ä|B", "fr")]
    rows += [(50, None, "de"), (51, "", "de"), (52, None, None), (None, long, "en"), (None, long, "en"), (None, "", "")]
    marks = [(5, 1, 0), (7, 1, 1), (7, 0, 0), (9, 0, 1), (20, 1, None), (40, None, 1), (None, 1, 1), (99, 1, 1)]
    got = told(audit.five_filters(docs(spark, rows), labels(spark, marks)))
    assert got == brute(rows, marks)


def test_one_group_of_copies_and_many_parts(spark):
    rows = [(i, "same text", "en") for i in range(3000)] + [(5000 + i, f"text {i}", f"p{i}") for i in range(40)]
    got = told(audit.five_filters(docs(spark, rows, 8), labels(spark, [(i, 1, 0) for i in range(0, 3000, 3)])))
    assert got["en", "EABCD", 1] == [1, 2999, 0, 0, 999, 0, 60 * 2999]
    assert got["en", "ABCDE", 5] == [0, 0, 2999, 0, 0, 0, 60 * 2999]
    assert len(got) == 41 * 600


def test_long_text_and_empty_tables(spark):
    rows = [(1, "word " * 400_000, "en"), (2, "É" * 300_000, "en")]
    got = told(audit.five_filters(docs(spark, rows), labels(spark, [])))
    assert got["en", "ABCDE", 1][:2] == [1, 1] and got["en", "BACDE", 1][:2] == [1, 1]
    assert audit.five_filters(docs(spark, []), labels(spark, [])).count() == 0


def test_too_many_filters(spark):
    with pytest.raises(ValueError):
        audit.survival_words(docs(spark, []), {c: F.lit(False) for c in "ABCDEF"})
