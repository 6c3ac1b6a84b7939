"""Language-model scores of texts, with a model that is trained on the corpus.

Every training text is counted: words for the baseline, subword ids for the model's vocabulary and its
starting biases. The attention model (see ``attention``) is trained on every training text by several
trainers at a time, whose parameters are averaged: some passes over a share of the texts (all of a small
corpus), then one over all the others. Then all texts are scored.
"""

from __future__ import annotations

import uuid
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nidalytics.llm import attention as at
from nidalytics.llm.bpe import load
from nidalytics.llm.common import per_process, whole
from nidalytics.plans.stages import cut, spread

FOLDS, HELD = 5, 1
#: Words with at least this share of the training tokens are sent to all tasks, so there are at most a million.
FREQUENT = 10**6
#: Subwords that training goes through ``PASSES`` times if the corpus has as many; they grow as the cube root of the corpus.
TRAIN_TOKENS = 800_000
TRAINER_TOKENS = 1_000_000
PASSES, RATE, BATCH = 3, 0.1, 64
#: All other texts are visited once, in some rounds, by trainers that read theirs as a stream.
ROUNDS, STREAM_TOKENS, STREAM_BATCH = 4, 4_000_000, 256
STRIDE = 28
#: Words kept per worker, and bytes of text worked on together.
KNOWN_WORDS = 400_000
TEXT_BYTES = 2**20
BLOCK = 65_536  # numbers in one row of parameters
#: White space that does not part words here but may part tokens.
ODD_SPACE = regex.compile(r"[^\S ]")
SEED = 42  # of the hash, as in Spark's own
END = b"\n"  # no word holds a line break
END_KEY = xxhash.xxh64_intdigest(END, SEED)


@dataclass
class Words:
    """Subword ids, hash and training count of each word seen, as flat arrays."""

    path: str
    pattern: str
    frequent: tuple[np.ndarray, np.ndarray] | None = None  # sorted hashes, counts
    index: dict[bytes, int] = field(default_factory=dict)

    def __post_init__(self):
        self.encoding = load(self.path, self.pattern)
        tokens = self.encoding.token_byte_values()
        self.spaced = np.zeros(self.encoding.n_vocab, dtype=bool)
        self.spaced[[self.encoding.encode_single_token(t) for t in tokens if t.startswith(b" ")]] = True
        self.clear()

    def clear(self) -> None:
        self.index = {}
        self.ids, self.starts, self.hashes, self.counts = array("i"), array("q", [0]), array("Q"), array("q")

    def number(self, words: list[bytes]) -> np.ndarray:
        """The row of each word; new words are added."""
        if len(self.index) > KNOWN_WORDS:
            self.clear()
        rows = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        unknown = np.flatnonzero(rows < 0).tolist()
        if unknown:
            new = list({words[i] for i in unknown})
            for at in range(0, len(new), 20_000):
                self._add(new[at : at + 20_000])
            rows[unknown] = [self.index[words[i]] for i in unknown]
        return rows

    def _add(self, words: list[bytes]) -> None:
        """Encode words, each after a space, in one call; the tokens that begin with a space tell them apart."""
        joined = " " + " ".join(w.decode("utf-8", "replace") for w in words)
        ids = np.array(self.encoding.encode_ordinary(joined), dtype=np.int32)
        starts = np.flatnonzero(self.spaced[ids])
        if len(starts) != len(words) or ODD_SPACE.search(joined):
            each = [self.encoding.encode_ordinary(" " + w.decode("utf-8", "replace")) for w in words]
            starts = np.cumsum([0, *map(len, each[:-1])])
            ids = np.array(list(chain.from_iterable(each)), dtype=np.int32)
        base = len(self.ids)
        self.ids.frombytes(ids.tobytes())
        self.starts.frombytes((base + np.append(starts[1:], len(ids))).astype(np.int64).tobytes())
        hashes = np.array([xxhash.xxh64_intdigest(w, SEED) for w in words], dtype=np.uint64)
        self.hashes.frombytes(hashes.tobytes())
        self.counts.frombytes(self._counts(hashes).astype(np.int64).tobytes())
        self.index.update(zip(words, range(len(self.index), len(self.index) + len(words)), strict=True))

    def _counts(self, hashes: np.ndarray) -> np.ndarray:
        """Training counts of frequent words, -1 for others."""
        if self.frequent is None or not len(self.frequent[0]):
            return np.full(len(hashes), -1)
        keys, counts = self.frequent
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return np.where(keys[at] == hashes, counts[at], -1)

    def ids_of(self, rows: np.ndarray) -> np.ndarray:
        """The subword ids of words in a row."""
        starts = np.frombuffer(self.starts, np.int64)
        begin, size = starts[rows], starts[rows + 1] - starts[rows]
        shift = np.repeat(begin - np.concatenate(([0], np.cumsum(size)[:-1])), size)
        return np.frombuffer(self.ids, np.int32)[shift + np.arange(len(shift))] if len(shift) else np.zeros(0, np.int32)


def parts(raw: bytes) -> Iterator[bytes]:
    """A text in consecutive parts that end where a word does."""
    start = 0
    while len(raw) - start > TEXT_BYTES:
        end = start + TEXT_BYTES
        while end < len(raw) and raw[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield raw[start:end]
        start = end
    yield raw[start:]


def groups(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, list[bytes]]]:
    """Texts of a batch, lower-cased A-Z, in groups of about ``TEXT_BYTES``, with the place of the first."""
    held, size, first = [], 0, 0
    texts = batch.column(column)
    for i in range(batch.num_rows):
        raw = texts[i].as_py().encode().lower()
        held.append(raw)
        size += len(raw)
        if size >= TEXT_BYTES:
            yield first, held
            held, size, first = [], 0, i + 1
    if held:
        yield first, held


def remainder(identity: Column) -> Column:
    """crc32 of the id as text modulo the folds; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(identity.cast("string"), F.lit(""))), F.lit(FOLDS))


# --- counts ---


def counted(texts: DataFrame) -> DataFrame:
    """(word, key, n): each word of the texts, with an end per text, its hash and how often it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()

        def flush() -> pa.RecordBatch:
            columns = [pa.array(list(words), pa.binary()), pa.array(list(words.values()), pa.int64())]
            words.clear()
            return pa.RecordBatch.from_arrays(columns, ["word", "n"])

        for batch in batches:
            for _, raws in groups(batch, "text"):
                words[END] += len(raws)
                for raw in raws:
                    for part in parts(raw):
                        words.update(part.split())
                        if len(words) > KNOWN_WORDS:
                            yield flush()
        if words:
            yield flush()

    rows = texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return cut(rows.select("word", F.xxhash64("word").alias("key"), "n"))


def counts_per_id(words: DataFrame, path: str, pattern: str) -> np.ndarray:
    """How often the training texts hold each subword id, the end's last: a sum over distinct words."""
    size = load(path, pattern).n_vocab + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = per_process("lm words", lambda: Words(path, pattern), "counts")
        total = np.zeros(size)
        for batch in batches:
            for at in range(0, batch.num_rows, 100_000):
                part = batch.slice(at, 100_000)
                found, n = part.column("word").to_pylist(), part.column("n").to_numpy()
                plain = np.array([w != END for w in found])
                total[-1] += n[~plain].sum()
                rows = table.number([w for w in found if w != END])
                starts = np.frombuffer(table.starts, np.int64)
                ids, each = table.ids_of(rows), np.repeat(n[plain], starts[rows + 1] - starts[rows])
                total += np.bincount(ids, weights=each, minlength=size)
                del starts
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used].astype(np.int64))], ["id", "n"])

    rows = words.mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    out = np.zeros(size, dtype=np.int64)
    for r in rows.collect():  # at most the tokenizer's vocabulary
        out[r["id"]] = r["n"]
    return out


def signed(value: int) -> int:
    return value - 2**64 if value >= 2**63 else value


@dataclass(frozen=True)
class Vocabulary:
    """Ranks of subword ids by training count; the last rank stands for all ids that have none."""

    rank: np.ndarray
    share: np.ndarray
    rare: np.ndarray  # log probability of an id given the last rank, 0 for ids with a rank of their own


def vocabulary(per_id: np.ndarray, shape: at.Shape) -> Vocabulary:
    order = np.argsort(-per_id, kind="stable")
    last = shape.ranks - 1
    rank = np.full(len(per_id), last)
    rank[order[:last]] = np.arange(min(last, len(order)))
    share = np.full(shape.ranks, 0.5)
    np.add.at(share, rank, per_id)
    rare = np.zeros(len(per_id))
    others = order[last:]
    if len(others):
        rare[others] = np.log((per_id[others] + 0.5) / (per_id[others] + 0.5).sum())
    return Vocabulary(rank.astype(np.int32), share / share.sum(), rare)


# --- training ---


def flattened(p: at.Params, shape: at.Shape) -> np.ndarray:
    return np.concatenate([p[name].ravel() for name in shape.parts()])


def shaped(flat: np.ndarray, shape: at.Shape) -> at.Params:
    out, start = {}, 0
    for name, size in shape.parts().items():
        n = int(np.prod(size))
        out[name] = flat[start : start + n].reshape(size).copy()
        start += n
    return out


def averaged(rows: DataFrame) -> np.ndarray:
    """Mean of the trainers' parameters, weighted by their places; two steps bound what a task holds."""
    schema = "block int, shard int, trainer int, places long, numbers binary"

    def mean(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("trainer")
        places = group["places"].sum()
        total = sum(n * np.frombuffer(raw, np.float32).astype(np.float64) for n, raw in zip(group["places"], group["numbers"], strict=True))
        first = group.iloc[:1].copy()
        first["places"] = places
        first["numbers"] = [(total / max(places, 1)).astype(np.float32).tobytes()]
        return first

    part = rows.groupBy("block", "shard").applyInPandas(mean, schema)
    found = part.groupBy("block").applyInPandas(mean, schema).select("block", "numbers").collect()  # of fixed size
    return np.concatenate([np.frombuffer(r["numbers"], np.float32) for r in sorted(found, key=lambda r: r["block"])])


def numbers_of(trainer: int, places: int, params: at.Params, seen: at.Params, shape: at.Shape) -> pa.Table:
    """What a trainer has learned, in rows for :func:`averaged`."""
    flat = np.concatenate((flattened(params, shape), flattened(seen, shape)))
    blocks = range(0, len(flat), BLOCK)
    columns = [
        pa.array(range(len(blocks)), pa.int32()),
        pa.array([trainer % 32] * len(blocks), pa.int32()),
        pa.array([trainer] * len(blocks), pa.int32()),
        pa.array([places] * len(blocks), pa.int64()),
        pa.array([flat[b : b + BLOCK].tobytes() for b in blocks], pa.binary()),
    ]
    return pa.Table.from_arrays(columns, ["block", "shard", "trainer", "places", "numbers"])


def trained(texts: DataFrame, path: str, pattern: str, words: Vocabulary, shape: at.Shape, total: int) -> at.Params:
    """Train on all texts: ``PASSES`` times on a share of them (all of a small corpus), once on the others.

    The share is chosen by hash and falls with the corpus, such that its subwords grow as the cube root; the
    others are dealt into rounds by the same hash. The number of trainers grows with what they visit. Trainers
    and the order of their texts depend on hashes alone.
    """
    spark = texts.sparkSession
    params = at.start(shape, words.share)
    seen = {k: np.zeros_like(v) for k, v in params.items()}
    if not total:
        return params
    share = min(1.0, (TRAIN_TOKENS / total) ** (2 / 3))
    trainers = max(1, -(-int(total * share) // TRAINER_TOKENS))
    placed = texts.withColumn("place", F.xxhash64("id", "text"))
    slot, slots = F.pmod("place", F.lit(2**30)), 2**30
    first = int(share * slots)

    def dealt(rows: DataFrame, n: int) -> DataFrame:
        return rows.select(F.pmod(F.xxhash64(F.lit(1), "place"), F.lit(n)).cast("int").alias("trainer"), "place", "text")

    sample = cut(dealt(placed.filter(slot < F.lit(first)), trainers))
    state = np.concatenate((flattened(params, shape), flattened(seen, shape)))
    half = len(state) // 2
    schema = "block int, shard int, trainer int, places long, numbers binary"

    def step(sent, rate: float, turn: int):
        def run(key: tuple, rows: pa.Table) -> pa.Table:
            state, rank = sent.value
            table = per_process("lm words", lambda: Words(path, pattern), "counts")
            batches = rows.sort_by("place").to_batches()
            ranks = [r for batch in batches for _, raws in groups(batch, "text") for r in ranks_of(table, rank, raws)]
            params, seen = shaped(state[:half], shape), shaped(state[half:], shape)
            places = at.train(params, seen, shape, at.Windows(ranks, shape, STRIDE), rate, BATCH, turn)
            return numbers_of(key[0].as_py(), places, params, seen, shape)

        return run

    def stream(sent, rate: float, turn: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            state, rank = sent.value
            table = per_process("lm words", lambda: Words(path, pattern), "counts")
            params, seen, places, trainer = shaped(state[:half], shape), shaped(state[half:], shape), 0, 0
            for batch in batches:
                for at_row, raws in groups(batch, "text"):
                    trainer = batch.column("trainer")[at_row].as_py()  # a partition has one
                    windows = at.Windows(ranks_of(table, rank, raws), shape, STRIDE)
                    places += at.train(params, seen, shape, windows, rate, STREAM_BATCH, turn)
            if places:
                yield from numbers_of(trainer, places, params, seen, shape).to_batches()

        return run

    for turn in range(PASSES):
        sent = spark.sparkContext.broadcast((state, words.rank))
        run = step(sent, RATE * (1 - turn / PASSES), turn)
        rows = cut(spread(sample, ["trainer"]).groupBy("trainer").applyInArrow(run, schema))
        if rows.isEmpty():
            break
        state = averaged(rows)
        sent.unpersist()

    others = total * (1 - first / slots)
    rounds = min(ROUNDS, max(-(-int(others) // TRAINER_TOKENS), int(first < slots)))
    for turn in range(rounds):
        low, high = (first + (slots - first) * k // rounds for k in (turn, turn + 1))
        n = max(1, -(-int(others / rounds) // STREAM_TOKENS))
        part = dealt(placed.filter((slot >= F.lit(low)) & (slot < F.lit(high))), n)
        sent = spark.sparkContext.broadcast((state, words.rank))
        run = stream(sent, RATE * (1 - turn / rounds), PASSES + turn)
        rows = cut(part.repartitionById(n, F.col("trainer")).sortWithinPartitions("place").mapInArrow(run, schema))
        if not rows.isEmpty():
            state = averaged(rows)
        sent.unpersist()
    return shaped(state[:half], shape)


def ranks_of(table: Words, rank: np.ndarray, raws: list[bytes]) -> list[np.ndarray]:
    """The ranks of each text, with the end's; words of several short texts are looked up together."""
    end = rank[-1:]
    if len(raws) == 1:
        return [np.concatenate([*(rank[table.ids_of(table.number(part.split()))] for part in parts(raws[0])), end])]
    split = [raw.split() for raw in raws]
    rows = table.number(list(chain.from_iterable(split)))
    return [np.concatenate((r, end)) for r in by_text(table, rows, [len(s) for s in split], rank)]


def by_text(table: Words, rows: np.ndarray, sizes: list[int], rank: np.ndarray | None = None) -> list[np.ndarray]:
    """The subword ids of each text, or their ranks."""
    starts = np.frombuffer(table.starts, np.int64)
    upto = np.concatenate(([0], np.cumsum(starts[rows + 1] - starts[rows])))
    ids = table.ids_of(rows)
    ranks = ids if rank is None else rank[ids]
    ends = np.cumsum(sizes)
    return [ranks[upto[e - n] : upto[e]] for e, n in zip(ends, sizes, strict=True)]


# --- scoring ---


def scores(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text", shape: at.Shape | None = None) -> DataFrame:
    """One row per input row: held_out, n_tokens, n_known, train_tokens, base_score and score (log10).

    The text that is scored is its sequence of lower-cased words and its end; the model's probability is
    that of their subword ids. Rows whose id has crc32 remainder 1 are held out of all counts and training; a null id
    counts as the empty text (remainder 0). A null text counts as empty: its end alone is scored. Repeated
    rows are scored alike, an empty table gives no rows. Words are told apart by a 64-bit hash.
    """
    shape = shape or at.Shape()
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_column).alias("id"), whole(text_column).alias("text"), (remainder(F.col(id_column)) == HELD).alias("held_out")
    )
    training = rows.filter("not held_out").select("id", "text")
    words = counted(training)
    tokens, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("n")).first()
    per_id = counts_per_id(words, path, pattern)
    known = vocabulary(per_id, shape)
    params = trained(training, path, pattern, known, shape, int(per_id.sum()))

    often = words.filter(F.col("n") * FREQUENT >= tokens).select("key", "n").toPandas()
    keys = often["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    frequent = (keys[order], often["n"].to_numpy(np.int64)[order])
    ends = int(frequent[1][frequent[0] == np.uint64(END_KEY)].sum()) or (words.filter(F.col("key") == signed(END_KEY)).agg(F.sum("n")).first()[0] or 0)
    # plain arrays: workers need not be able to import this package
    sent = spark.sparkContext.broadcast((flattened(params, shape), known.rank, known.rare, frequent))
    version = uuid.uuid4().hex
    schema = "row long, id {}, held_out boolean, n_tokens long, n_known long, logs double, rare array<long>, score double"
    names = ["n_tokens", "n_known", "logs", "rare", "score"]
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64()), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, rank, rare_share, frequent = sent.value
        params = shaped(flat, shape)
        table = per_process("lm words", lambda: Words(path, pattern, frequent), version)

        def facts(found: np.ndarray) -> tuple[int, int, float, np.ndarray]:
            n = np.frombuffer(table.counts, np.int64)[found]
            rare = np.frombuffer(table.hashes, np.uint64)[found[n < 0]].view(np.int64)
            return len(found), int((n >= 0).sum()), float(np.log10(n[n >= 0] + 0.5).sum()), rare

        for batch in batches:
            for first, raws in groups(batch, "text"):
                out, ids = [], []
                if len(raws) == 1:
                    pieces = []
                    for part in parts(raws[0]):
                        found = table.number(part.split())
                        pieces.append(facts(found))
                        ids.append(table.ids_of(found))
                    ids = [np.concatenate(ids)]
                    n, k, logs, rare = zip(*pieces, strict=True)
                    out.append((sum(n), sum(k), sum(logs), np.concatenate(rare)))
                else:
                    split = [raw.split() for raw in raws]
                    found = table.number(list(chain.from_iterable(split)))
                    sizes = [len(s) for s in split]
                    to = np.cumsum(sizes)
                    out = [facts(found[e - n : e]) for e, n in zip(to, sizes, strict=True)]
                    ids = by_text(table, found, sizes)
                ranks = [np.concatenate((rank[i], rank[-1:])) for i in ids]
                score = at.log_probabilities(params, shape, at.Windows(ranks, shape, STRIDE))
                score += [rare_share[i].sum() + rare_share[-1] for i in ids]
                columns = [list(c) for c in zip(*out, strict=True)]
                end = ends > 0
                columns[0] = [n + 1 for n in columns[0]]
                columns[1] = [n + end for n in columns[1]]
                columns[2] = [x + np.log10(ends + 0.5) for x in columns[2]]
                part = batch.slice(first, len(raws))
                made = [pa.array(c, k) for c, k in zip([*columns, score / np.log(10)], kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("row", "id", "held_out")), *made], ["row", "id", "held_out", *names])

    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    scored = cut(numbered.mapInArrow(run, schema.format(rows.schema["id"].dataType.simpleString())))
    # words that are not frequent: each has less than a millionth of the training tokens
    less = words.filter(F.col("n") * FREQUENT < tokens).select("key", "n")
    rare = scored.select("row", F.explode("rare").alias("key")).join(less, "key", "left")
    rare = rare.groupBy("row").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("more_logs"), F.count("n").alias("more_known"))
    share = float(np.log10(tokens + 0.5 * (distinct + 1)))
    return scored.drop("rare").join(rare, "row", "left").select(
        F.col("id").alias(id_column),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * share).alias("base_score"),
        "score",
    )
