"""Ranked lexical search: tiles of item weights times tiles of document impacts, exact in float64."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nidalytics.llm.common import lower_ascii, whole
from nidalytics.plans.stages import cut

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The same on the bytes of UTF-8: digits, letters in lower case and all bytes beyond ASCII, else a space.
TERM_BYTES = bytes(b if chr(b).isalnum() or b > 127 else 32 for b in bytes(range(128)).lower() + bytes(range(128, 256)))
#: A block of items has about so many (item, term) pairs and items at most; a task holds one block.
BLOCK_PAIRS, BLOCK_ITEMS = 1 << 18, 4096
ITEM_TILE, TERM_TILE, DOC_TILE = 64, 4096, 512
#: Long texts are cut into terms in pieces of so many bytes.
PIECE_BYTES = 1 << 20
EXACT = 1 << 53
TOP_IMPACT = 1_000_000


def count_terms(raw: bytes, vocabulary: Mapping[bytes, int], piece: int = PIECE_BYTES) -> tuple[int, Counter]:
    """Number of terms of a text, and how often each term of the vocabulary occurs (None: any other)."""
    n, counts, rest = 0, Counter(), b""
    for at in range(0, len(raw), piece):
        part = rest + raw[at : at + piece].translate(TERM_BYTES)
        end = len(part) if at + piece >= len(raw) else part.rfind(b" ") + 1
        found = part[:end].split()
        rest = part[end:]
        n += len(found)
        counts.update(map(vocabulary.get, found))
    counts.pop(None, None)
    return n, counts


def _counted(vocabulary: Broadcast):
    """mapInArrow: (id, text) to (id, n, terms, tfs), the terms as places in the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = {term: i for i, term in enumerate(vocabulary.value)}
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                texts = part.column("text")
                rows = [count_terms(texts[i].as_buffer().to_pybytes(), places) for i in range(part.num_rows)]
                terms = pa.array([list(c.keys()) for _, c in rows], pa.list_(pa.int32()))
                tfs = pa.array([list(c.values()) for _, c in rows], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([n for n, _ in rows], pa.int64()), terms, tfs], ["id", "n", "terms", "tfs"])

    return run


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, all_terms: int) -> np.ndarray:
    """What a term adds per unit of weight: saturates with its occurrences, later in long documents."""
    m = 100 - 90 + (90 * n * documents) // all_terms
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def tile_scores(
    items: np.ndarray, terms: np.ndarray, weights: np.ndarray, n_items: int, doc: np.ndarray, doc_terms: np.ndarray, impact: np.ndarray, n_docs: int
) -> np.ndarray:
    """Scores of all items (rows) for a tile of documents (columns), as 64-bit integers.

    Items come as (item, term, weight) sorted by item, documents as (doc, term, impact). Only terms that occur
    on both sides become columns of a tile. A tile has so few terms that its sums stay below 2^53, where
    float64 products and sums of integers are exact; tiles are added up as integers.
    """
    scores = np.zeros((n_items, n_docs), dtype=np.int64)
    shared = np.intersect1d(terms, doc_terms)
    if not shared.size:
        return scores
    width = min(TERM_TILE, (EXACT - 1) // max(1, int(weights.max()) * TOP_IMPACT))
    if not width:
        raise OverflowError("a single term's contribution is beyond 2^53")
    for lo in range(0, shared.size, width):
        vocabulary = shared[lo : lo + width]
        here = np.isin(doc_terms, vocabulary)
        tile = np.zeros((vocabulary.size, n_docs))
        tile[np.searchsorted(vocabulary, doc_terms[here]), doc[here]] = impact[here]
        wanted = np.flatnonzero(np.isin(terms, vocabulary))
        edges = np.searchsorted(items[wanted], np.arange(0, n_items + ITEM_TILE, ITEM_TILE))
        for first, a, b in zip(range(0, n_items, ITEM_TILE), edges[:-1], edges[1:], strict=False):
            pairs = wanted[a:b]
            if not pairs.size:
                continue
            compact, column = np.unique(terms[pairs], return_inverse=True)
            block = np.zeros((min(ITEM_TILE, n_items - first), compact.size))
            block[items[pairs] - first, column] = weights[pairs]
            scores[first : first + block.shape[0]] += (block @ tile[np.searchsorted(vocabulary, compact)]).astype(np.int64)
    return scores


class Best:
    """The k best documents of each item so far; of equal scores the smaller id, ids that are null last."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.rows = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))] * n_items
        self.least = np.ones(n_items, np.int64)  # a score below has no chance

    def add(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        hopeful = scores >= self.least[:, None]
        for i in np.flatnonzero(hopeful.any(axis=1)):
            at = np.flatnonzero(hopeful[i])
            joined = [np.concatenate(x) for x in zip(self.rows[i], (scores[i, at], null[at], ids[at]), strict=True)]
            order = np.lexsort((joined[2], joined[1], -joined[0]))[: self.k]
            self.rows[i] = tuple(x[order] for x in joined)
            if order.size == self.k:
                self.least[i] = self.rows[i][0][-1]


def _ranked(block: Broadcast, documents: int, all_terms: int, k: int):
    """mapInArrow: (id, n, terms, tfs) to the best k of the task for each item of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, terms, weights, n_items = block.value
        best = Best(n_items, k)
        for batch in batches:
            for at in range(0, batch.num_rows, DOC_TILE):
                part = batch.slice(at, DOC_TILE)
                lists = part.column("terms")
                sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
                doc = np.repeat(np.arange(part.num_rows), sizes)
                n = part.column("n").to_numpy()
                impact = impacts(part.column("tfs").flatten().to_numpy(), n[doc], documents, all_terms)
                scores = tile_scores(items, terms, weights, n_items, doc, lists.flatten().to_numpy(), impact, part.num_rows)
                ids = part.column("id")
                best.add(scores, ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False))
        for i, (score, null, ids) in enumerate(best.rows):
            if score.size:
                at = pa.array(np.full(score.size, i, np.int32))
                yield pa.RecordBatch.from_arrays([at, pa.array(ids, mask=null), pa.array(score)], ["item", "doc_id", "score"])

    return run


def search(
    items: DataFrame,
    docs: DataFrame,
    k: int = 10,
    item_id: str = "item_id",
    item_text: str = "text",
    id_column: str = "doc_id",
    text_column: str = "text",
    block_pairs: int = BLOCK_PAIRS,
    block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """The k best documents of every item with a score above 0: (item_id, rank, doc_id, score).

    Item rows of one id are one item, null being an id. Every document row counts, also repeated ones; among
    equal scores the smaller doc_id ranks first, null last. Null or empty texts hold no terms; a text of any
    length is read whole, in pieces. Ids of documents are integers. An empty table on either side gives no rows.

    Items are dealt into blocks by a hash; a block's pairs and weights are broadcast (some ``block_pairs``
    pairs, or one item's), and each block is a pass over the documents that writes the terms it shares with
    them. Tasks hand on k rows per item.
    """
    spark = docs.sparkSession
    words = F.array_distinct(F.regexp_extract_all(lower_ascii(whole(item_text)), F.lit(TERM), F.lit(0)))
    pairs = items.select(F.col(item_id).alias("item_id"), F.explode(words).alias("term")).distinct()
    pairs = cut(pairs)
    sizes = pairs.agg(F.count(F.lit(1)), F.count_distinct(F.struct("item_id"))).first()
    blocks = max(1, -(-sizes[0] // block_pairs), -(-sizes[1] // block_items))
    texts = docs.select(F.col(id_column).cast("long").alias("id"), whole(text_column).alias("text"))
    found, stats = [], None
    for b in range(blocks):
        mine = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).toArrow()
        ids, terms = mine.column("item_id").combine_chunks().dictionary_encode("encode"), mine.column("term").combine_chunks().dictionary_encode()
        vocabulary = spark.sparkContext.broadcast([t.encode() for t in terms.dictionary.to_pylist()])
        counted = cut(texts.mapInArrow(_counted(vocabulary), "id long, n long, terms array<int>, tfs array<long>"))
        if stats is None:  # the same for every block
            stats = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        n_docs, n_terms = stats
        holders = dict(counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect()) if n_terms else {}
        if not holders:
            continue
        of_term = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holders.get(t, 0) + 1))) for t in range(len(terms.dictionary))])
        item, term = ids.indices.to_numpy(), terms.indices.to_numpy()
        order = np.argsort(item, kind="stable")
        order = order[of_term[term[order]] > 0]
        if not order.size:
            continue
        block = spark.sparkContext.broadcast((item[order], term[order], of_term[term[order]], len(ids.dictionary)))
        best = counted.where(F.size("terms") > 0).mapInArrow(_ranked(block, n_docs, n_terms, k), "item int, doc_id long, score long")
        by = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = best.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
        names = spark.createDataFrame(pa.table({"item": pa.array(range(len(ids.dictionary)), pa.int32()), "item_id": ids.dictionary}))
        found.append(cut(best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")))
        vocabulary.unpersist()
        block.unpersist()
    if not found:
        kind = pairs.schema["item_id"].dataType.simpleString()
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
