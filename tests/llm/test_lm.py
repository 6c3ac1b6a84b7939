import math
import os
import random
import subprocess
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from helpers import documents, lower, words

from nidalytics.llm import attention as at
from nidalytics.llm import lm

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
SMALL = at.Shape(classes=2, width=4, keys=3, window=8, pairs=16)


def random_model(shape=SMALL, seed=0):
    draw = np.random.default_rng(seed)
    return {k: (0.5 * draw.standard_normal(s)).astype(np.float32) for k, s in shape.parts().items()}


def test_probabilities_sum_to_one():
    p, o = random_model(), np.random.default_rng(1).standard_normal((3, 4)).astype(np.float32)
    total = np.zeros(3)
    for r in range(SMALL.ranks):
        target = np.full(3, r)
        total += np.exp(at._of_class(p, o, target) + at._of_member(p, SMALL, o, target))
    assert total == pytest.approx(np.ones(3), abs=1e-4)


@pytest.mark.parametrize(("n", "stride"), [(1, 6), (7, 6), (8, 6), (9, 6), (40, 6), (41, 1), (100, 8)])
def test_each_token_is_scored_once(n, stride):
    texts = [np.arange(n) % 100, np.arange(3), np.arange(0)]
    w = at.Windows(texts, SMALL, stride)
    inputs, before, targets, scored = w.batch(slice(None))
    got = [targets[w.text == i][scored[w.text == i]].tolist() for i in range(2)]
    assert got == [texts[0].tolist(), [0, 1, 2]]
    assert (inputs[:, 1:] == targets[:, :-1])[scored[:, :-1]].all()
    # the first token of a text is told from the start mark, later ones from those before
    for i in range(2):
        rows = inputs[w.text == i][scored[w.text == i]].tolist()
        assert rows == [SMALL.ranks, *texts[i][:-1].tolist()]


@pytest.mark.parametrize("stride", [3, 6, 8])
def test_scoring_agrees_with_training(stride):
    p, draw = random_model(), np.random.default_rng(3)
    texts = [draw.integers(0, SMALL.ranks, n) for n in (50, 1, 8, 9, 0, 23)]
    w = at.Windows(texts, SMALL, stride)
    loss, places, _ = at.gradients(p, SMALL, *w.batch(slice(None)))
    scores = at.log_probabilities(p, SMALL, w, batch=3, together=7)
    assert places == 91 and -scores.sum() == pytest.approx(loss, rel=1e-4)
    alone = [at.log_probabilities(p, SMALL, at.Windows([t], SMALL, stride))[0] for t in texts]
    assert scores == pytest.approx(alone, rel=1e-4)


def test_words_are_encoded_as_alone():
    table = lm.Words(RANKS, PATTERN)
    found = [w.encode() for w in ("plain", "don't", "'s", "1st", "--", "naïve", "日本語", "🙂x", "a\u3000b", "\xa0c", "x\x85", "\x1cq", "", "z")]
    for group in (found[:8], found[8:], found):
        rows = table.number(group)
        for w, r in zip(group, rows, strict=True):
            assert table.ids_of(np.array([r])).tolist() == table.encoding.encode_ordinary(" " + w.decode())
        table.clear()


def test_no_place_sees_what_follows():
    p = random_model()
    a, b = np.arange(8), np.arange(8)
    b[6] = 50
    rows = [at._context(p, SMALL, x[None], np.zeros((1, 8), int))[-1][0] for x in (a, b)]
    assert rows[0][:6] == pytest.approx(rows[1][:6]) and not np.allclose(rows[0][6:], rows[1][6:])


def test_gradients_match_differences():
    p = {k: v.astype(np.float64) for k, v in random_model().items()}
    draw = np.random.default_rng(2)
    batch = [draw.integers(0, SMALL.ranks, (3, 8)) for _ in range(3)] + [draw.random((3, 8)) < 0.7]
    _, _, grad = at.gradients(p, SMALL, *batch)
    for name, g in grad.items():
        full = np.zeros_like(p[name])
        if isinstance(g, tuple):
            full[g[0]] = g[1]
        else:
            full = g
        spot = tuple(int(i) for i in np.unravel_index(np.argmax(np.abs(full)), full.shape))
        step = 1e-4
        values = []
        for sign in (1, -1):
            q = {k: v.copy() for k, v in p.items()}
            q[name][spot] += sign * step
            loss, m, _ = at.gradients(q, SMALL, *batch)
            values.append(loss / m)
        assert (values[0] - values[1]) / (2 * step) == pytest.approx(full[spot], rel=2e-2, abs=1e-5), name


def text_of(draw):
    """Words of two parts each in one of two styles, so that context tells much."""
    style = draw.choice(["fog", "sun"])
    return " ".join(f"{style}{draw.choice('abcdef')} the" for _ in range(draw.randint(20, 60)))


def corpus(n=400):
    draw = random.Random(1)
    return [(i, text_of(draw)) for i in range(n)]


def baseline(rows):
    train = [t for i, t in rows if zlib.crc32(str("" if i is None else i).encode()) % 5 != 1]
    count = Counter(w for t in train for w in words(lower(t)))
    count["\n"] = len(train)
    total, distinct = sum(count.values()), len([w for w in count if count[w]])

    def one(text):
        found = [*words(lower(text)), "\n"]
        score = sum(math.log10((count[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in found)
        return len(found), sum(count[w] > 0 for w in found), total, score

    return one


def checked(rows, got):
    one = baseline(rows)
    want = sorted(((i, *one(t)) for i, t in rows), key=str)
    have = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=str)
    for a, b in zip(have, want, strict=True):
        assert a[:4] == b[:4]
        assert a[4] == pytest.approx(b[4])
    for r in got:
        assert r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 1)
        assert r.score < 0


def test_model_beats_the_baseline_on_held_out_texts(spark):
    rows = corpus()
    got = lm.scores(documents(spark, rows), RANKS, PATTERN).collect()
    checked(rows, got)
    held = [r for r in got if r.held_out]
    assert len(held) > 40
    assert sum(r.score for r in held) > 0.8 * sum(r.base_score for r in held)


def test_every_training_text_is_learned_from(spark, monkeypatch):
    """Training visits each token of each training text, also where a share of them is visited more often."""
    rows = corpus(60)
    train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    encoding = lm.load(RANKS, PATTERN)
    tokens = sum(len(encoding.encode_ordinary(" " + w)) for t in train for w in words(lower(t))) + len(train)
    visits, averaged = [], lm.averaged
    monkeypatch.setattr(lm, "averaged", lambda found: visits.append(found.filter("block = 0").agg({"places": "sum"}).first()[0]) or averaged(found))
    monkeypatch.setattr(lm, "TRAIN_TOKENS", 300)
    monkeypatch.setattr(lm, "TRAINER_TOKENS", 500)
    monkeypatch.setattr(lm, "STREAM_TOKENS", 400)
    got = lm.scores(documents(spark, rows), RANKS, PATTERN).collect()
    checked(rows, got)
    assert len(visits) == lm.PASSES + lm.ROUNDS
    assert visits[0] < tokens // 2 and visits[0] + sum(visits[lm.PASSES :]) == tokens


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 3)  # most words take the way of rare ones
    monkeypatch.setattr(lm, "TEXT_BYTES", 500)
    rows = [(1, "A bé C"), (2, None), (3, ""), (None, "no id"), (5, "word " * 3000), (5, "word " * 3000), (6, "\n\t "), *corpus(30)[7:]]
    got = lm.scores(documents(spark, rows), RANKS, PATTERN).collect()
    checked(rows, got)
    same = [r.score for r in got if r.doc_id == 5]
    assert same[0] == pytest.approx(same[1])


def test_long_text_is_scored_as_in_one_piece(spark, monkeypatch):
    rows = [*corpus(20), (100, " ".join(t for _, t in corpus(60)))]
    want = {r.doc_id: r.score for r in lm.scores(documents(spark, rows, 1), RANKS, PATTERN).collect()}
    monkeypatch.setattr(lm, "TEXT_BYTES", 2000)
    got = {r.doc_id: r.score for r in lm.scores(documents(spark, rows, 1), RANKS, PATTERN).collect()}
    assert got == pytest.approx(want, rel=1e-3)


def test_nothing_to_learn_from(spark):
    assert lm.scores(documents(spark, []), RANKS, PATTERN).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    (r,) = lm.scores(documents(spark, [(held, "a b")]), RANKS, PATTERN).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0) and r.score < 0


def test_workers_need_not_find_the_package(tmp_path):
    """The entry is used from another folder, so that the workers cannot import the package."""
    script = """
import sys
sys.path.insert(0, sys.argv[1])
import __spark_entry__ as entry
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
  .config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", sys.argv[2] + "/stages").getOrCreate())
rows = [(i, f"some words of text {i % 3} " * (i + 1), "en", "a", 1) for i in range(8)]
spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(sys.argv[2] + "/documents.parquet")
print("scored", entry.queries()["op1_lm_score"](spark, sys.argv[2]).filter("score < 0").count())
"""
    root = Path(__file__).resolve().parents[2]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", script, str(root), str(tmp_path)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240
    )
    assert "scored 8" in done.stdout, done.stderr[-2000:]
