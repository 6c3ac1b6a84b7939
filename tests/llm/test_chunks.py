import random

import numpy as np
import pytest
from helpers import documents, prose

from nidalytics.llm import chunks

TABLE = chunks.gear()


def slow_gear(data):
    h, out = 0, []
    for b in data:
        h = ((h << 1) + int(TABLE[b])) % 2**32
        out.append(h)
    return out


def pieces(text):
    raw = text.encode()
    places, _ = chunks.cuts(np.frombuffer(raw, np.uint8), TABLE)
    return [raw[a:b] for a, b in zip(places, places[1:], strict=False)]


@pytest.mark.parametrize("text", ["", "a", "short text", prose(1, 300), "日本語" * 40])
def test_rolling_hash_is_the_recurrence(text):
    data = np.frombuffer(text.encode(), np.uint8)
    assert chunks.rolling(data, TABLE).tolist() == slow_gear(data)


def test_texts_without_words_have_no_chunks():
    assert pieces("") == pieces(" \n\t") == []


@pytest.mark.parametrize("text", ["a", "é" * 100, prose(2, 500), "日本語です。" * 50, "x" * 5000, "🙂 " * 60])
def test_chunks_make_up_the_text(text):
    found = pieces(text)
    assert b"".join(found) == text.encode()
    for piece in found:
        piece.decode()


def test_insertion_changes_only_chunks_near_it():
    text = prose(3, 1000)
    at = len(text) // 2
    before, after = pieces(text), pieces(text[:at] + " inserted words here " + text[at:])
    assert len(set(before) - set(after)) <= 6
    assert 3 < len(text.split()) / len(before) < 5


def test_chunks_span_enough_words():
    _, words_at = chunks.cuts(np.frombuffer(prose(8, 400).encode(), np.uint8), TABLE)
    first, last = chunks.spans(words_at)
    assert (words_at[last] - words_at[first] >= chunks.CHUNK_WORDS).all()
    assert (words_at[last - 1] - words_at[first] < chunks.CHUNK_WORDS)[:-1].all()
    assert last[-1] == len(words_at) - 1
    assert len(chunks.spans(np.array([0, 5, 15]))[0]) == 0


def test_common_short_phrases_are_no_passage(spark):
    phrases = [prose(i, 5, 30) for i in range(40)]
    draw = random.Random(3)
    rows = [(i, " ".join(draw.choice(phrases) for _ in range(60))) for i in range(60)]
    spans = chunks.repeated(documents(spark, rows)).collect()
    assert not spans


def corpus(n, seed):
    draw = random.Random(seed)
    passages = [prose(500 + i, 51 + 3 * i, 4000) for i in range(n)]
    rows, holders = [], {}
    for i, passage in enumerate(passages):
        for j in range(3):
            doc_id = 10 * i + j
            rows.append((doc_id, f"{prose(9000 + doc_id, draw.randint(30, 90), 4000)} {passage} {prose(5000 + doc_id, 40, 4000)}"))
            holders.setdefault(i, []).append(doc_id)
    rows += [(100_000 + i, prose(20_000 + i, 200, 4000)) for i in range(100)]
    draw.shuffle(rows)
    return rows, passages, holders


def test_repeated_passages_are_found_and_clean_documents_left(spark):
    rows, passages, holders = corpus(40, 1)
    texts = dict(rows)
    spans = chunks.repeated(documents(spark, rows)).collect()
    later = {d for ids in holders.values() for d in ids[1:]}
    found = {r.doc_id for r in spans}
    assert found <= later  # neither a clean document nor the first holder
    assert len(found) >= 0.97 * len(later)
    for r in spans:
        passage = passages[r.doc_id // 10]
        assert texts[r.doc_id].encode()[r.start : r.end].decode().strip() in passage
        # a cut near the start of a passage may be common to two later texts only
        assert r.doc_id // 10 * 10 in r.first_ids and set(r.first_ids) <= set(holders[r.doc_id // 10])
        assert r.n_words >= chunks.LEAST_WORDS


def test_first_place_stays(spark):
    rows = [(i, prose(1, 120)) for i in range(8)] + [(20, None), (21, ""), (22, "few words")]
    docs = documents(spark, rows)
    out = chunks.without_repeats(docs)
    assert out.columns == docs.columns
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts == {0: prose(1, 120), **{i: "" for i in range(1, 8)}, 20: None, 21: "", 22: "few words"}


def test_repeats_within_a_text(spark):
    passage = prose(4, 90, 2000)
    text = f"{passage} {prose(5, 50, 2000)} {passage}"
    (span,) = chunks.repeated(documents(spark, [(1, text)])).collect()
    assert span.doc_id == 1 and span.start > len(passage) and span.first_ids == [1]


def test_repeated_rows_are_one_text(spark):
    rows = [(1, prose(6, 100)), (1, prose(6, 100)), (None, prose(7, 100)), (None, prose(7, 100)), (3, prose(6, 100))]
    spans = chunks.repeated(documents(spark, rows)).collect()
    assert [r.doc_id for r in spans] == [3]


def test_small_filter_gives_the_same(spark):
    rows, _, _ = corpus(8, 2)
    docs = documents(spark, rows)
    small, large = (sorted(chunks.repeated(docs, bits=b).collect(), key=str) for b in (32768, 2**24))
    assert small == large and small


def test_empty_table(spark):
    assert chunks.repeated(documents(spark, [])).count() == 0
    assert chunks.without_repeats(documents(spark, [])).count() == 0
