"""Substring dedup: texts are cut where their content says so, and chunks are compared by digest.

A gear hash rolls over the bytes; there is a cut before a word if the 32 bytes before it hash to a small
value. The cuts of a passage are therefore the same wherever it stands, whatever precedes it by more
than 32 bytes, and an insertion changes only the cuts around it. A chunk goes from each cut to the first
cut that is enough words away, so that no chunk is so short that unrelated texts share it. Chunks that
stood earlier in the corpus are joined where they overlap, and those of enough words together are
repeated passages.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nidalytics.llm.common import per_process, whole
from nidalytics.llm.repeats import group_repeats, may_repeat, repeat_filter
from nidalytics.plans.stages import cut

#: Words between two cuts, on average, and the fewest words of a chunk.
CUT_WORDS, CHUNK_WORDS = 4, 16
#: Chunks together must span so many words. A passage of 50 words loses what is beyond its first and last cut.
LEAST_WORDS = 25
#: Bits of the filter over chunks: 32 MB of bitmaps, whatever the input.
FILTER_BITS = 2**28
SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def gear() -> np.ndarray:
    """A random number for each byte value."""
    return np.random.default_rng(2**31 - 1).integers(0, 2**32, 256, dtype=np.uint32)


def rolling(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The gear hash after each byte, ``h = (h << 1) + table[byte]`` in 32 bits, hence of the last 32 bytes.

    The sum over 32 shifted terms is built by doubling the number of terms five times.
    """
    h = table[data]
    for terms in (1, 2, 4, 8, 16):
        longer = h.copy()
        longer[terms:] += h[:-terms] << np.uint32(terms) if len(h) > terms else 0
        h = longer
    return h


def word_starts(data: np.ndarray) -> np.ndarray:
    """Places where a word begins; in scripts without spaces (three bytes a character and more) every character."""
    space = SPACES[data]
    start = ~space
    start[1:] &= space[:-1]
    return np.flatnonzero(start | (data >= 0xE3))


def cuts(data: np.ndarray, table: np.ndarray, words: int = CUT_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Each cut in bytes and in words, the start of the text first; its end and number of words come last."""
    starts = word_starts(data)
    if not len(starts):
        return np.array([0]), np.array([0])
    h = rolling(data, table)
    first = np.flatnonzero((starts > 0) & (h[np.maximum(starts, 1) - 1] < 2**32 // words))
    first = np.concatenate(([0], first[first > 0]))
    return np.concatenate((starts[first], [len(data)])), np.concatenate((first, [len(starts)]))


def spans(words_at: np.ndarray, least: int = CHUNK_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """First and last cut of each chunk, as places in the list of cuts; one more reaches the text's end."""
    last = np.searchsorted(words_at, words_at + least)
    first = np.flatnonzero(last < len(words_at))
    last, end = last[first], len(words_at) - 1
    if len(first) and last[-1] != end:
        first, last = np.append(first, first[-1]), np.append(last, end)
    return first, last


CHUNKS = "id {kind}, text_key long, n int, start int, end int, word int, word_end int, digest binary"


def chunks(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = CHUNK_WORDS) -> DataFrame:
    """One row per chunk: place in bytes and words, and 128-bit digest; ``text_key`` tells texts of one id apart.

    White space at the end of a chunk is no part of its digest. Texts of fewer words have no chunks.
    """
    names = ["text_key", "n", "start", "end", "word", "word_end", "digest"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = per_process("gear", gear)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                texts = batch.column("text").slice(at, 128)
                columns: list[list] = [[] for _ in names]
                taken, digests = [], []
                for i in range(len(texts)):
                    raw = texts[i].as_py().encode()
                    places, words_at = cuts(np.frombuffer(raw, np.uint8), table)
                    first, last = spans(words_at, words)
                    starts, ends = places[first], places[last]
                    digests += [
                        hashlib.blake2b(raw[a:b].rstrip(), digest_size=16).digest()
                        for a, b in zip(starts.tolist(), ends.tolist(), strict=True)
                    ]
                    taken.append(np.full(len(first), at + i))
                    key = np.full(len(first), np.array(xxhash.xxh64_intdigest(raw), dtype=np.uint64).view(np.int64))
                    values = (key, np.arange(len(first)), starts, ends, words_at[first], words_at[last])
                    for column, value in zip(columns, values, strict=False):
                        column.append(value)
                ids = batch.column("id").take(pa.array(np.concatenate(taken)))
                arrays = [pa.array(np.concatenate(c), k) for c, k in zip(columns[:-1], kinds, strict=False)]
                yield pa.RecordBatch.from_arrays([ids, *arrays, pa.array(digests, pa.binary())], ["id", *names])

    rows = docs.select(F.col(id_column).alias("id"), whole(text_column).alias("text"))
    return rows.mapInArrow(run, CHUNKS.format(kind=rows.schema["id"].dataType.simpleString()))


def repeated(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    words: int = CHUNK_WORDS,
    least_words: int = LEAST_WORDS,
    bits: int = FILTER_BITS,
) -> DataFrame:
    """Passages that stood earlier: id, text_key, start and end in bytes, n_words, and ``first_ids``.

    "Earlier" is in the order of id (null first), text key and place, so every passage stays where it is
    first. ``first_ids`` are the texts in which the chunks of the passage are first. Passages may repeat
    within a text. Rows that repeat both id and text are one text. Null and empty texts have none.

    Chunks are made twice: first for a filter of those that may be repeated, then only these are shuffled.
    """
    found = repeat_filter(chunks(docs, id_column, text_column, words), "digest", bits, hashes=1)
    place = F.struct("id", "text_key", "start")
    rows = may_repeat(chunks(docs, id_column, text_column, words), "digest", found, "flag", bits, hashes=1)
    rows = cut(rows.filter("flag").withColumn("place", place))
    later = group_repeats(rows, "digest", "place", "flag", F.min).filter("size > 1 and place != keep")
    text = Window.partitionBy("id", "text_key").orderBy("n")
    reach = F.max("end").over(text.rowsBetween(Window.unboundedPreceding, -1))
    later = later.withColumn("opens", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int"))
    runs = later.withColumn("run", F.sum("opens").over(text)).groupBy("id", "text_key", "run")
    found = runs.agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        (F.max("word_end") - F.min("word")).alias("n_words"),
        F.array_sort(F.collect_set("keep.id")).alias("first_ids"),
    )
    return found.filter(F.col("n_words") >= least_words).drop("run").withColumnRenamed("id", id_column)


def without_repeats(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = CHUNK_WORDS, least_words: int = LEAST_WORDS
) -> DataFrame:
    """The input with repeated passages cut out of its texts; a text that is all repeats becomes empty."""
    gone = repeated(docs, id_column, text_column, words, least_words)
    gone = gone.groupBy(F.col(id_column).alias("__id"), F.col("text_key").alias("__key")).agg(
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("__spans")
    )
    rest = [c for c in docs.columns if c != text_column]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (x.as_py() for x in batch.column("__text"))
            keys = [None if t is None else xxhash.xxh64_intdigest(t.encode()) for t in texts]
            signed = [None if k is None else k - 2**64 if k >= 2**63 else k for k in keys]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(signed, pa.int64())], [*batch.schema.names, "__key"])

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, found in zip(batch.column("__text"), batch.column("__spans"), strict=True):
                value = text.as_py()
                if value is not None and found.is_valid:
                    raw, at, parts = value.encode(), 0, []
                    for span in found.as_py():
                        parts.append(raw[at : span["start"]])
                        at = max(at, span["end"])
                    value = b"".join([*parts, raw[at:]]).decode()
                out.append(value)
            kept = [n for n in batch.schema.names if n in rest]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(out, pa.string())], [*kept, text_column])

    rows = docs.select(*rest, F.col(text_column).alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    rows = rows.mapInArrow(keyed, f"{kinds}, __key long")
    joined = rows.join(gone, F.col(id_column).eqNullSafe(F.col("__id")) & (rows["__key"] == gone["__key"]), "left")
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name in rest)
    columns = [*(F.col(c) for c in rest), F.col("__text"), F.col("__spans")]
    return joined.select(*columns).mapInArrow(cleaned, f"{kept}`{text_column}` string").select(*docs.columns)
