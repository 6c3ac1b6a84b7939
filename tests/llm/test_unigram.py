import random

import public_tokenizers
import pytest
from helpers import documents, prose
from tokenizers import Tokenizer, models, pre_tokenizers

from nidalytics.llm import unigram

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def library(pieces):
    """The tokenizers library with the same pieces, byte pieces for unknown characters."""
    low = min(s for _, s in pieces)
    vocab = [("<unk>", low), *(p for p in pieces), *((f"<0x{i:02X}>", 0.0) for i in range(256))]
    made = Tokenizer(models.Unigram(vocab, 0, True))
    made.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return made


def pieces_of_file():
    found = unigram.vocabulary(PIECES)
    crossing = set(unigram.inner_marks(found))
    return [p for p in found if p[0] not in crossing]


TEXTS = [
    "Hello world",
    "two  spaces   and\ttabs\nand lines",
    "日本語 text 🙂🙂 ﷽",
    " leading and trailing ",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa",
    "Ünïcödé naïve — dashes… ‘quotes’",
    prose(1, 400),
    "\x00\x01 control",
]


def test_counts_match_the_library():
    pieces = pieces_of_file()
    mine, theirs = unigram.Counter(pieces), library(pieces)
    for text in TEXTS:
        assert mine.text(text) == len(theirs.encode(text).ids), text


@pytest.mark.parametrize("seed", range(4))
def test_ties_are_settled_as_by_the_library(seed):
    draw = random.Random(seed)
    pieces = {"▁": -3.0, "a": -2.0, "b": -2.0}
    for _ in range(40):
        p = "".join(draw.choice("ab") for _ in range(draw.randint(2, 4)))
        pieces[p] = -float(draw.randint(1, 4))
        pieces["▁" + p] = -float(draw.randint(1, 4))
    found = list(pieces.items())
    mine, theirs = unigram.Counter(found), library(found)
    for _ in range(300):
        text = " ".join("".join(draw.choice("abc") for _ in range(draw.randint(1, 9))) for _ in range(3))
        assert mine.text(text) == len(theirs.encode(text).ids), text


def whole_library(pieces):
    """As library(), over whole texts: pieces may match runs of spaces."""
    made = library(pieces)
    made.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=False)
    return made


SPACED = ["a        b", "def f():\n        return  1\n", "x" + " " * 40 + "y", "   ", "  lead", "a▁▁b c", "▁a", *TEXTS]


def test_all_pieces_of_the_file_count():
    pieces = unigram.vocabulary(PIECES)
    assert unigram.inner_marks(pieces)
    mine, theirs = unigram.counter(PIECES), whole_library(pieces)
    for text in SPACED:
        assert mine(text) == len(theirs.encode(text).ids), text


def test_pieces_that_cross_words():
    found = [("▁", -3.0), ("a", -2.0), ("b", -2.0), ("a▁b", -1.0), ("▁▁", -2.0)]
    mine, theirs = unigram.Counter(found), whole_library(found)
    for text in ("a b", "a  b a b", "b a b "):
        assert mine.text(text) == len(theirs.encode(text).ids), text


def test_known_words_do_not_change_counts():
    pieces = pieces_of_file()
    small, large = unigram.Counter(pieces, 3), unigram.Counter(pieces)
    assert [small.text(t) for t in TEXTS * 2] == [large.text(t) for t in TEXTS * 2]


def test_operator(spark):
    rows = [(1, "Hello world"), (2, None), (3, ""), (4, "x" * 50_000), (5, TEXTS[2]), (5, TEXTS[2]), (None, "no id")]
    got = unigram.token_counts(documents(spark, rows), PIECES).collect()
    count = unigram.Counter(pieces_of_file())
    assert sorted(((r.doc_id, r.n_chars, r.n_tokens) for r in got), key=str) == sorted(
        ((i, len(t or ""), count.text(t or "")) for i, t in rows), key=str
    )
    assert unigram.token_counts(documents(spark, []), PIECES).count() == 0


def test_no_pieces():
    assert unigram.Counter([]).text("é a") == len("▁é".encode()) + len("▁a".encode())
