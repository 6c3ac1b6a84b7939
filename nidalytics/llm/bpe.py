"""Byte-level BPE with the tiktoken library: ids of whole texts, and back to bytes."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nidalytics.llm.common import per_process, whole

#: Texts are handed to the tokenizer in pieces of about so many characters.
PIECE_CHARS = 50_000
#: A space or line break after a letter, digit or punctuation mark: no match of the usual patterns spans
#: it. They take white space only at their start, never look back, and look ahead only from white space.
SAFE = regex.compile(r"(?<=[\p{L}\p{N}\p{P}])(?=[ \n])")

#: White space this long is one piece of the usual patterns, but for a last character that something follows; their
#: look ahead would fill the stack of the pattern matcher.
LONG_BLANK = regex.compile(r"\p{White_Space}{10000,}+")


def load(path: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file, built once per worker."""

    def make() -> tiktoken.Encoding:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    return per_process(f"bpe {path} {pattern}", make)


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """The text in consecutive pieces that are tokenized as they would be within the whole text.

    A piece ends at the first safe boundary after ``size`` characters; without one it is longer.
    """
    start = 0
    while len(text) - start > size:
        boundary = SAFE.search(text, start + size)
        if boundary is None:
            break
        yield text[start : boundary.start()]
        start = boundary.start()
    yield text[start:]


def encode(encoding: tiktoken.Encoding, text: str) -> np.ndarray:
    """Ids as unsigned 32-bit integers; the strings of special tokens are ordinary text.

    Long white space is taken out as the pattern would match it and encoded as one piece, however long it is.
    """
    ids: list[int] = []
    start = 0
    for blank in LONG_BLANK.finditer(text):
        end = blank.end() - (blank.end() < len(text))
        for piece in pieces(text[start : blank.start()]):
            ids += encoding.encode_ordinary(piece)
        ids += encoding._encode_single_piece(text[blank.start() : end].encode())
        start = end
    for piece in pieces(text[start:]):
        ids += encoding.encode_ordinary(piece)
    return np.array(ids, dtype="<u4")


def decode(encoding: tiktoken.Encoding, ids: np.ndarray) -> bytes:
    """The bytes that the ids stand for; a prefix of a text may end within a character."""
    return encoding.decode_bytes(ids.tolist())


def by_text(make: Callable[[], Callable[[str], tuple]], schema: pa.Schema, column: str) -> Callable:
    """A mapInArrow function that replaces the text column by what ``make()`` gives for each text.

    Texts become Python strings a few at a time, so that a batch is not held twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_text = make()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(column)
                rows = [of_text(texts[i].as_py()) for i in range(part.num_rows)]
                values = list(zip(*rows, strict=True)) or [[] for _ in schema]
                arrays = [pa.array(v, type=f.type) for v, f in zip(values, schema, strict=True)]
                kept = [n for n in part.schema.names if n != column]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in kept), *arrays], [*kept, *schema.names])

    return run


def digests(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: n_tokens, ids_sha256 and decoded_sha256 (see :func:`tokens` for the ids).

    Null counts as empty (no ids). Repeated rows are encoded alike; an empty table gives no rows.
    """

    def make():
        encoding = load(path, pattern)

        def one(text: str) -> tuple:
            ids = encode(encoding, text)
            return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(decode(encoding, ids)).hexdigest()

        return one

    schema = pa.schema([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    rows = docs.select(F.col(id_column).alias("id"), whole(text_column).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(by_text(make, schema, "text"), f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_column)


def tokens(
    docs: DataFrame,
    path: str,
    pattern: str,
    text_column: str = "text",
    ids_column: str = "ids",
    decoded_column: str | None = None,
) -> DataFrame:
    """The input with its text replaced by ``ids_column`` (array of int) and ``n_tokens``.

    Columns of the input with the names of new ones, in whatever case, are replaced too. A null text has no ids.
    ``decoded_column`` adds the SHA-256 of the bytes that the ids decode to; a text whose ids do not give
    back its own bytes is an error.
    """

    def make():
        encoding = load(path, pattern)

        def one(text: str) -> tuple:
            ids = encode(encoding, text)
            if not decoded_column:
                return ids.astype(np.int32), len(ids)
            raw = decode(encoding, ids)
            if raw != text.encode():
                raise ValueError(f"ids of a text of {len(text)} characters decode to other bytes")
            return ids.astype(np.int32), len(ids), hashlib.sha256(raw).hexdigest()

        return one

    made = [(ids_column, pa.list_(pa.int32())), ("n_tokens", pa.int64())]
    if decoded_column:
        made.append((decoded_column, pa.string()))
    schema = pa.schema(made)
    new = {n.lower() for n in (text_column, *schema.names)}
    rest = [c for c in docs.columns if c.lower() not in new]
    rows = docs.select(*rest, whole(text_column).alias("__text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__text")
    kept += f", `{ids_column}` array<int>, n_tokens long" + (f", `{decoded_column}` string" if decoded_column else "")
    return rows.mapInArrow(by_text(make, schema, "__text"), kept)


def texts(encoded: DataFrame, path: str, pattern: str, ids_column: str = "ids", text_column: str = "text") -> DataFrame:
    """The inverse of :func:`tokens`: bytes of the ids in a binary column; null ids give empty bytes."""
    rest = [c for c in encoded.columns if c not in (ids_column, text_column)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load(path, pattern)
        for batch in batches:
            ids = batch.column("__ids")
            raw = [encoding.decode_bytes(ids[i].as_py() or []) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), pa.array(raw, pa.binary())], [*rest, text_column])

    rows = encoded.select(*rest, F.col(ids_column).alias("__ids"))
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name != "__ids")
    return rows.mapInArrow(run, f"{kept}`{text_column}` binary")
