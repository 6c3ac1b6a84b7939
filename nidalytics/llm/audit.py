"""What each filter of a cascade removes, in every order, from one word of surviving subsets per document."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import reduce
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nidalytics.llm.common import count_words, join_by_size, let, whole, words_of
from nidalytics.plans.stages import cut

#: A word has a bit for each subset of the filters.
BITS = 32
MOST_FILTERS = 5
#: Counts of at most so many parts are held by a task before it hands them on.
PARTS_HELD = 10_000


def length_below(text: Column, words: int) -> Column:
    """Fewer words than that."""
    return count_words(text) < words


def repetitive(text: Column, percent: int) -> Column:
    """Distinct words are less than that share of all words."""
    return let(words_of(text), lambda w: 100 * F.size(F.array_distinct(w)) < percent * F.size(w))


def shouting(text: Column, percent: int) -> Column:
    """A-Z make up more than that share of the code points."""
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return 100 * capitals.cast("long") > percent * F.length(text)


def truth_table(n: int, filter_index: int) -> int:
    """The subsets of ``n`` filters without the given one, as a signed word: what remains of a document that fails it."""
    word = sum(1 << s for s in range(1 << n) if not s >> filter_index & 1)
    return word - (1 << BITS) if word >> (BITS - 1) else word


def positional_popcount(words: np.ndarray) -> np.ndarray:
    """How many of the 32-bit words have each bit set.

    Carry-save: three words of one weight become a sum word of that weight and a carry word of twice the
    weight, bit by bit and for thirds of the array at once, until few words of a weight are left to be
    unpacked.
    """
    total, shift = np.zeros(BITS, dtype=np.int64), 0
    words = words.astype("<u4", copy=False)
    while words.size:
        carries = []
        while words.size > BITS:
            third = words.size // 3
            a, b, c = words[:third], words[third : 2 * third], words[2 * third : 3 * third]
            half = a ^ b
            carries.append((a & b) | (half & c))
            words = np.concatenate([half ^ c, words[3 * third :]])
        bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64) << shift
        words = np.concatenate(carries) if carries else words[:0]
        shift += 1
    return total


def _counts(n_labels: int, subsets: int):
    """mapInArrow: (part, word, labels) to (part, subset, survivors of all documents and of each label)."""

    def flush(held: dict) -> pa.RecordBatch:
        parts = [p for p in held for _ in range(subsets)]
        counts = np.stack(list(held.values()))[:, :, :subsets]  # part, label, subset
        columns = [pa.array(counts[:, i, :].ravel()) for i in range(n_labels + 1)]
        index = pa.array(np.tile(np.arange(subsets, dtype=np.int32), len(held)))
        names = ["part", "subset", *[f"n{i}" for i in range(n_labels + 1)]]
        return pa.RecordBatch.from_arrays([pa.array(parts, pa.string()), index, *columns], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column("part").dictionary_encode()
            codes = coded.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(codes, kind="stable")
            edges = np.searchsorted(codes[order], np.arange(len(coded.dictionary) + 1))
            words = batch.column("word").to_numpy(zero_copy_only=False).astype(np.int32).view(np.uint32)[order]
            labels = [batch.column(f"l{i}").to_numpy(zero_copy_only=False)[order] for i in range(n_labels)]
            for part, lo, hi in zip(coded.dictionary.to_pylist(), edges[:-1], edges[1:], strict=True):
                mine = words[lo:hi]
                sums = [positional_popcount(w) for w in (mine, *(mine[flag[lo:hi]] for flag in labels))]
                held[part] = held[part] + sums if part in held else np.stack(sums)
            if len(held) >= PARTS_HELD:
                yield flush(held)
                held = {}
        if held:
            yield flush(held)

    return run


def _total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def survival_words(
    docs: DataFrame,
    filters: Mapping[str, Column],
    copies: str | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
    part_column: str = "lang",
) -> DataFrame:
    """(id, part, word) per row; bit S of the word says that the row passes all filters of the subset S.

    ``filters`` are conditions of failure over the text (null texts are empty). ``copies`` names a further
    filter, which a row fails whose text is that of a row with a smaller id; a null id is neither smaller nor
    larger than another, so rows without one never fail it, and of rows that repeat the smallest id all stay.
    Filters are numbered in the order of their names. Nulls of the part count as empty; texts are compared by
    their SHA-256. A text of any length is judged whole. An empty table gives no rows.
    """
    names = sorted([*filters, *([copies] if copies else [])])
    if len(names) > MOST_FILTERS:
        raise ValueError(f"{len(names)} filters, a word holds the subsets of {MOST_FILTERS}")
    text = F.col("_text")

    def keeps(name: str, fails: Column) -> Column:
        return F.when(fails, F.lit(truth_table(len(names), names.index(name)))).otherwise(F.lit(-1))

    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(part_column), F.lit("")).alias("part"), whole(text_column).alias("_text"))
    word = reduce(lambda a, b: a.bitwiseAND(b), [keeps(name, fails) for name, fails in filters.items()], F.lit(-1))
    judged = rows.select("id", "part", word.alias("word"), *([F.unhex(F.sha2(text, 256)).alias("digest")] if copies else []))
    if not copies:
        return judged
    judged = cut(judged)
    groups = cut(judged.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).where("n > 1"))
    found = join_by_size(judged, groups, ["digest"], "n", "left")
    later = F.coalesce(F.col("id") > F.col("first"), F.lit(False))
    return found.select("id", "part", F.col("word").bitwiseAND(keeps(copies, later)).alias("word"))


def interactions(words: DataFrame, names: list[str], labels: DataFrame, flags: Mapping[str, Column], id_column: str = "doc_id") -> DataFrame:
    """One row per part, order of the filters and step, from the words of :func:`survival_words`.

    ``names`` are the filters' letters, sorted. ``flags`` are conditions over ``labels``; a document has a flag
    if any row of its id meets the condition, documents without labels have none. Columns: part,
    filter_order, step, kept, removed, redundant, unique_fails, ``<flag>_lost`` and shapley (see the query).
    A part needs one row per subset in the exchange; documents are counted before it.
    """
    n, subsets = len(names), 1 << len(names)
    marked = [F.max(F.coalesce(test, F.lit(False))).alias(f"l{i}") for i, test in enumerate(flags.values())]
    known = labels.where(F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("id")).agg(*marked)
    rows = words.join(known, "id", "left")
    rows = rows.select("part", "word", *[F.coalesce(F.col(f"l{i}"), F.lit(False)).alias(f"l{i}") for i in range(len(flags))])
    counted = [f"n{i}" for i in range(len(flags) + 1)]
    partial = rows.mapInArrow(_counts(len(flags), subsets), "part string, subset int, " + ", ".join(f"{c} long" for c in counted))
    survivors = partial.groupBy("part", "subset").agg(*[F.sum(c).alias(c) for c in counted])
    by_subset = F.array_sort(F.collect_list(F.struct("subset", *counted)))
    parts = survivors.groupBy("part").agg(by_subset.alias("s"))

    def of(subset: Column | int, column: str = "n0") -> Column:
        return F.get(F.col("s"), F.lit(subset) if isinstance(subset, int) else subset)[column]

    def share(i: int) -> Column:
        """Removed by a filter, over all orders: each subset that may stand before it, as often as it does."""
        before = [s for s in range(subsets) if not s >> i & 1]
        orders = [factorial(s.bit_count()) * factorial(n - 1 - s.bit_count()) for s in before]
        return _total([F.lit(k) * (of(s) - of(s | 1 << i)) for s, k in zip(before, orders, strict=True)])

    parts = parts.select("part", "s", F.array(*[share(i) for i in range(n)]).alias("shares"))
    orders = F.lit(["".join(p) for p in permutations(names)])
    steps = parts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.lit(list(range(1, n + 1)))))
    place = [F.instr(F.col("filter_order"), name) for name in names]
    steps = steps.select(
        "*",
        _total([F.when(p < F.col("step"), 1 << i).otherwise(0) for i, p in enumerate(place)]).alias("before"),
        _total([F.when(p == F.col("step"), i).otherwise(0) for i, p in enumerate(place)]).alias("mine"),
    )
    bit = F.call_function("shiftleft", F.lit(1), F.col("mine"))
    before, after = F.col("before"), F.col("before") + bit
    removed = of(before) - of(after)
    return steps.select(
        "part",
        "filter_order",
        "step",
        of(after).alias("kept"),
        removed.alias("removed"),
        (of(0) - of(bit) - removed).alias("redundant"),
        (of(F.lit(subsets - 1) - bit) - of(subsets - 1)).alias("unique_fails"),
        *[(of(before, c) - of(after, c)).alias(f"{flag}_lost") for flag, c in zip(flags, counted[1:], strict=True)],
        F.get(F.col("shares"), F.col("mine")).alias("shapley"),
    )


def five_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit with the five filters of the registered query; E removes later copies."""
    text = F.col("_text")
    filters = {
        "A": length_below(text, 200),
        "B": repetitive(text, 50),
        "C": shouting(text, 3),
        "D": text.rlike(r"[#$%&*|]"),
    }
    words = survival_words(docs, filters, copies="E")
    flags = {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1}
    return interactions(words, ["A", "B", "C", "D", "E"], labels, flags)
