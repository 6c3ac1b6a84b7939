import hashlib

import numpy as np
import public_tokenizers
import pytest
from helpers import documents, prose

from nidalytics.llm import bpe

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
LONG = "\n\n".join(prose(i, 400) + "  don't 12,345\t🙂 日本語  x\r\n" for i in range(60))
ROWS = [
    (1, "Hello world"),
    (2, None),
    (3, ""),
    (4, "   \n\n  \t "),
    (5, "<|endoftext|> is ordinary here"),
    (6, LONG),
    (7, "a" * 120_000),
    (8, "日本語" * 30_000),
    (9, "é 🙂   x"),
    (9, "é 🙂   x"),
    (None, "no id"),
]


@pytest.fixture(scope="module")
def encoding():
    return bpe.load(RANKS, PATTERN)


def test_digests_match_the_library_on_whole_texts(spark, encoding):
    got = {r.doc_id: r for r in bpe.digests(documents(spark, ROWS), RANKS, PATTERN).collect()}
    for doc_id, text in ROWS:
        ids = np.array(encoding.encode_ordinary(text or ""), dtype="<u4")
        r = got[doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


@pytest.mark.parametrize("size", [1, 7, 100, 5000])
@pytest.mark.parametrize("text", [LONG, "x y", "  a  b  ", "can't  won't\n\n 1 2", "日本 語 \n a"])
def test_pieces_join_and_encode_as_the_whole(encoding, size, text):
    found = list(bpe.pieces(text, size))
    assert "".join(found) == text
    assert [i for p in found for i in encoding.encode_ordinary(p)] == encoding.encode_ordinary(text)


def test_ids_and_back(spark):
    docs = documents(spark, ROWS)
    encoded = bpe.tokens(docs, RANKS, PATTERN)
    assert encoded.columns == [*(c for c in docs.columns if c != "text"), "ids", "n_tokens"]
    back = {r.doc_id: bytes(r.text).decode() for r in bpe.texts(encoded, RANKS, PATTERN).collect()}
    assert back == {i: t or "" for i, t in ROWS}


def test_empty_table(spark):
    docs = documents(spark, [])
    assert bpe.digests(docs, RANKS, PATTERN).count() == 0
    assert bpe.tokens(docs, RANKS, PATTERN).count() == 0


def test_decoding_part_of_a_character(encoding):
    ids = bpe.encode(encoding, "🙂")
    assert b"".join(bpe.decode(encoding, ids[i : i + 1]) for i in range(len(ids))) == "🙂".encode()


@pytest.mark.parametrize("blank", [" ", "\n", "\r\n", " \n\t", "\u3000", "\x85", "\u2028 "])
@pytest.mark.parametrize("frame", ["{}", "word{}", "{}word", "word{}'s 12", "a.{}日本{}!?", "x{}\x1cy"])
def test_long_blanks_encode_as_the_library_does(encoding, blank, frame, monkeypatch):
    monkeypatch.setattr(bpe, "LONG_BLANK", bpe.regex.compile(bpe.LONG_BLANK.pattern.replace("10000", "5")))
    for n in (4, 5, 6, 301):
        text = frame.replace("{}", (blank * n)[:n])
        assert bpe.encode(encoding, text).tolist() == encoding.encode_ordinary(text)


def test_two_million_blanks(spark, encoding):
    blanks = [" " * 2_000_000, "\n" * 2_000_000, " \t\n" * 700_000]
    rows = [(3 * i + j, t) for i, b in enumerate(blanks) for j, t in enumerate((b, b + "word", "Some prose." + b + "and more"))]
    got = {r.doc_id: r for r in bpe.digests(documents(spark, rows), RANKS, PATTERN).collect()}
    for doc_id, text in rows:
        assert got[doc_id].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        kept = text.rstrip() if doc_id % 3 == 1 else text
        body = kept[:-4] if doc_id % 3 == 1 else kept
        if doc_id % 3 == 0:
            assert got[doc_id].n_tokens == len(encoding._encode_single_piece(body.encode()))


def test_columns_with_the_names_of_new_ones(spark):
    docs = spark.createDataFrame([(1, "a b", 7, 8)], "doc_id long, text string, N_TOKENS int, Ids int")
    out = bpe.tokens(docs, RANKS, PATTERN)
    assert out.columns == ["doc_id", "ids", "n_tokens"] and out.select("n_tokens").first()[0] == 2
