"""Rows and brute-force versions that the tests of the text operators share."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, source string, keep int, size int, row int, id int, digest int, words int"
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark, rows, parts=3):
    """(doc_id, text[, source]) with further columns whose names the operators use inside."""
    full = [(*r, *(["s"] if len(r) < 3 else []), 1, 2, 3, 4, 5, 6) for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return (text or "").translate(UP)


def prose(seed, n, vocabulary=300):
    draw = random.Random(seed)
    made = ["w" + "".join(draw.choice("aeiourtnsl") for _ in range(draw.randint(1, 6))) for _ in range(vocabulary)]
    return " ".join(draw.choice(made) for _ in range(n))


def components(n, linked):
    """Smallest member of each item's component, given a predicate on pairs."""
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            for j in range(n):
                if label[j] < label[i] and linked(i, j):
                    label[i], changed = label[j], True
    return label
