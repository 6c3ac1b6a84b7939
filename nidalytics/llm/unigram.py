"""Numbers of tokens under a unigram vocabulary, without making the tokens."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nidalytics.llm.bpe import by_text
from nidalytics.llm.common import per_process, whole

MARK = "▁"  # stands for a space, and before the first word
UNIT = re.compile(f"{MARK}+[^{MARK}]*")  # a run of marks and the word after it
UNKNOWN_PENALTY = 10.0  # an unknown character scores the least piece's score less this
#: Counts of so many words are kept per worker.
KNOWN_WORDS = 300_000


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece file, without byte and control pieces."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = (i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)))
    return [(model.id_to_piece(i), model.get_score(i)) for i in plain]


class Counter:
    """Best path through the pieces of a run of marks with its word that an Aho-Corasick automaton finds.

    The automaton gives the pieces that end at a place, longest first, and a path replaces another of the
    same end only with a larger score: of equal paths the one whose last piece is longest wins. A
    character that is no piece scores ``UNKNOWN_PENALTY`` below the least piece and becomes its bytes.
    """

    def __init__(self, pieces: Sequence[tuple[str, float]], known_words: int = KNOWN_WORDS):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        if len(self.automaton):
            self.automaton.make_automaton()
        self.unknown = min((score for _, score in pieces), default=0.0) - UNKNOWN_PENALTY
        #: a piece with a mark after another character would cross units; none of the given file does
        self.crosses = any(MARK in piece.lstrip(MARK) for piece, _ in pieces)
        self.known: dict[str, int] = {}
        self.most = known_words

    def word(self, word: str) -> int:
        n = len(word)
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        last = -1
        found = self.automaton.iter(word) if len(self.automaton) else ()

        def unknown(end: int) -> None:
            best[end + 1] = best[end] + self.unknown
            count[end + 1] = count[end] + len(word[end].encode())

        single = False
        for end, (length, score) in found:
            if end != last:
                if last >= 0 and not single:
                    self._lone(word, last, best, count)
                for at in range(last + 1, end):
                    unknown(at)
                last, single = end, False
                best[end + 1] = -float("inf")
            single |= length == 1
            value = best[end + 1 - length] + score
            if value > best[end + 1]:
                best[end + 1], count[end + 1] = value, count[end + 1 - length] + 1
        if last >= 0 and not single:
            self._lone(word, last, best, count)
        for at in range(last + 1, n):
            unknown(at)
        return count[n]

    def _lone(self, word: str, end: int, best: list[float], count: list[int]) -> None:
        """The last character as an unknown one, after all pieces that end with it."""
        value = best[end] + self.unknown
        if value > best[end + 1]:
            best[end + 1], count[end + 1] = value, count[end] + len(word[end].encode())

    def text(self, text: str) -> int:
        """Tokens of a text: the sum over runs of marks with their words, as no piece crosses the next run.

        A mark is put before the text unless it begins with one or a space. With pieces that cross, the
        text is one unit.
        """
        if not text:
            return 0
        text = text.replace(" ", MARK)
        if not text.startswith(MARK):
            text = MARK + text
        if self.crosses:
            return self.word(text)
        known, total = self.known, 0
        for word in UNIT.findall(text):
            n = known.get(word)
            if n is None:
                n = self.word(word)
                if len(known) >= self.most:
                    known.clear()
                if len(word) <= 100:
                    known[word] = n
            total += n
        return total


def inner_marks(pieces: Sequence[tuple[str, float]]) -> list[str]:
    """Pieces with a mark after their first character; these match runs of spaces, or cross words."""
    return [piece for piece, _ in pieces if MARK in piece[1:]]


def counter(path: str) -> Callable[[str], int]:
    return per_process(f"unigram {path}", lambda: Counter(vocabulary(path))).text


def token_counts(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: id, ``n_chars`` and ``n_tokens`` of the whole text.

    A null or empty text has no tokens. All pieces count, also those for runs of spaces (Metaspace
    without splitting). Repeated rows are counted alike; an empty table gives no rows.
    """

    def make():
        count = counter(path)
        return lambda text: (len(text), count(text))

    schema = pa.schema([("n_chars", pa.int64()), ("n_tokens", pa.int64())])
    rows = docs.select(F.col(id_column).alias("id"), whole(text_column).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(by_text(make, schema, "text"), f"id {kind}, n_chars long, n_tokens long")
    return out.withColumnRenamed("id", id_column)
