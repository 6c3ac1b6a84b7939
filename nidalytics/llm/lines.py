"""Line dedup: an exact set-similarity join of lines, and the removal of later matches.

A line is the set of its words. Two lines match where the Jaccard similarity of their sets is 0.8 or
more. Words are ordered from rare to frequent, so that matching lines share a word among the first few
of each; only these prefixes are joined. Candidates pass a length, a position and a parity filter before
their sets are compared. Only DataFrame functions are used.
"""

from __future__ import annotations

from functools import partial, reduce
from itertools import count

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nidalytics.llm.common import SPACE, join_by_size, whole
from nidalytics.llm.repeats import group_repeats, may_repeat, repeat_filter
from nidalytics.plans.stages import cut, forget, tidy

#: The threshold as a fraction.
NUM, DEN = 4, 5
#: Cells in which words are counted for their order. Any order gives the same result, a better one less work.
CELLS = 2**20
#: Words with so many entries are compared with single lines first; the result does not depend on it.
MANY = 64
#: Entries and pairs are worked on in up to so many slices, one after the other, so that what is shuffled at a time is a share of them.
SLICES = 8
#: Tables of fewer rows are not sliced: of entries (some 30 bytes each when shuffled), of pairs (two word sets each).
SLICE_ENTRIES, SLICE_PAIRS = 2**21, 2**18
cut_by_slice = partial(cut, by="slice")
KEY_BITS = 57  # of a word's hash; the order of magnitude of its frequency stands above them


#: White space as a set of characters.
BLANKS = " \t\n\x0b\x0c\r"


def split_words(line: Column) -> Column:
    """The words of a line that holds one; most lines have single spaces only and need no pattern."""
    trimmed = F.btrim(line, F.lit(BLANKS))
    plain = F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" "))
    for mark in ("  ", "\t", "\x0b", "\x0c", "\r"):
        plain = plain | F.contains(line, F.lit(mark))
    return F.when(plain, F.split(trimmed, SPACE)).otherwise(F.split(line, " "))


def frequencies(rows: DataFrame) -> Column:
    """For each cell the number of binary digits of how often its words occur, over all texts; an array."""
    plain = ~F.contains("text", F.lit("\t"))
    for mark in ("\x0b", "\x0c", "\r"):
        plain = plain & ~F.contains("text", F.lit(mark))
    # a text's words are those of its lines; most need no pattern
    words = F.when(plain, F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")).otherwise(F.split("text", SPACE))
    words = rows.select(F.explode(words).alias("word")).filter("word != ''")
    counts = words.groupBy((F.xxhash64("word").bitwiseAND(F.lit(CELLS - 1))).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    found = counts.select(F.col("cell").cast("int"), F.length(F.bin("n")).cast("byte").alias("digits"))
    table = found.toArrow()  # a row per cell, whatever the input
    digits = np.zeros(CELLS, dtype=np.int8)
    digits[table["cell"].to_numpy()] = table["digits"].to_numpy()
    names = [str(i) for i in range(65)]  # shared by all cells: the driver holds no object for each
    return F.expr("cast(split('%s', ',') as array<tinyint>)" % ",".join(map(names.__getitem__, digits.tolist())))


def word_set(line: Column) -> Column:
    """64-bit hashes of the distinct words of a line."""
    return F.array_distinct(F.transform(split_words(line), lambda w: F.xxhash64(w)))


def by_rarity(words: Column, digits: Column) -> Column:
    """Hashes in a fixed order of all words: rare ones first."""

    def key(h: Column) -> Column:
        rank = F.get(digits, h.bitwiseAND(F.lit(CELLS - 1)).cast("int")).cast("long")
        placed = F.shiftleft(rank, KEY_BITS).bitwiseOR(h.bitwiseAND(F.lit((1 << KEY_BITS) - 1)))
        return F.coalesce(placed, F.lit(0).cast("long"))  # never null, so that plain numbers are sorted

    return F.sort_array(F.transform(words, key))


def prefix(ordered: Column) -> Column:
    """The rarest words of a set: as many as two matching sets need to share one of them."""
    n = F.size(ordered)
    return F.slice(ordered, 1, n - F.floor((NUM * n + DEN - 1) / DEN).cast("int") + 1)


def parity(words: Column) -> Column:
    """64 bits; each word flips one. Sets that differ in d words differ in d bits at most."""

    def flip(bits: Column, h: Column) -> Column:
        return bits.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int")))

    return F.aggregate(words, F.lit(0).cast("long"), flip)


def numbered(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(
        F.col(id_column).alias("id"), F.monotonically_increasing_id().alias("row"), whole(text_column).alias("text")
    )


def lines_of(rows: DataFrame) -> DataFrame:
    """id, row, line number and text of every line of (id, row, text), blank ones included; at least one per row."""
    return rows.select("id", "row", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def with_prefixes(rows: DataFrame) -> DataFrame:
    """Every line with its place, the hash of its text and of its set, and its prefix; written once."""
    digits = frequencies(rows)
    lines = lines_of(rows).withColumn("lid", F.monotonically_increasing_id())
    holds_word = F.btrim("line", F.lit(BLANKS)) != ""
    # what is used more than once is a column of its own, which Spark computes once
    lines = lines.withColumn("words", F.when(holds_word, word_set(F.col("line"))))
    lines = lines.withColumn("ordered", by_rarity(F.col("words"), digits))
    return cut(
        lines.select(
            "id",
            "row",
            "line_no",
            F.struct("id", "lid").alias("place"),
            F.xxhash64("line").alias("text_hash"),
            F.when(F.col("ordered").isNotNull(), F.size("ordered")).alias("n"),
            parity(F.col("words")).alias("parity"),
            F.when(
                F.col("ordered").isNotNull(),
                F.struct(F.xxhash64("ordered").alias("h1"), F.xxhash64(F.lit(1), F.col("ordered")).alias("h2")),
            ).alias("set"),
            prefix(F.col("ordered")).alias("prefix"),
        )
    )


def word_sets(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(lid, words) for the wanted (lid, text_hash, set), read from the texts again.

    A filter of the wanted hashes keeps other lines out of the shuffle.
    """
    wanted = cut(wanted)
    found = repeat_filter(wanted.select("text_hash"), "text_hash", hashes=1, least=1)
    lines = lines_of(rows).select("line", F.xxhash64("line").alias("text_hash"))
    lines = may_repeat(lines, "text_hash", found, "flag", hashes=1).filter("flag").groupBy("text_hash").agg(F.first("line").alias("line"))
    sets = lines.select("text_hash", word_set(F.col("line")).alias("words"))
    return cut(wanted.join(sets, "text_hash").select("lid", "words"))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the written pairs (a, b) whose sets match."""
    named = cut(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("pairs")))
    theirs = cut(named.join(sets, named["b"] == sets["lid"]).select("b", "pairs", F.col("words").alias("words_b")))
    both = join_by_size(pairs, theirs, ["b"], "pairs")
    both = both.join(sets, both["a"] == sets["lid"]).withColumn("common", F.size(F.array_intersect("words", "words_b")))
    # common / (n + m - common) >= num / den
    total = F.size("words") + F.size("words_b")
    found = cut(both.filter((NUM + DEN) * F.col("common") >= NUM * total).select("a", "b"))
    forget(named, theirs)
    return found


def possible(near: str, other: str) -> Column:
    """Length, position and parity filter for two entries of a word; ``other`` is the shorter line."""
    n, m = F.col(f"{near}n"), F.col(f"{other}n")
    rest = F.least(n - F.col(f"{near}pos"), m - F.col(f"{other}pos"))  # words from the shared one on
    apart = F.bit_count(F.col(f"{near}parity").bitwiseXOR(F.col(f"{other}parity")))
    return (
        (m <= n)
        & (DEN * m >= NUM * n)
        & ((NUM + DEN) * rest >= NUM * (n + m))
        & ((NUM + DEN) * apart <= (DEN - NUM) * (n + m))
        & (F.col(f"{near}lid") != F.col(f"{other}lid"))
    )


def pairs_of(joined: DataFrame, near: str, other: str) -> DataFrame:
    """Distinct (a, b): line a and the line b before it."""
    places = [F.struct(F.col(f"{x}id").alias("id"), F.col(f"{x}lid").alias("lid")) for x in (near, other)]
    return joined.select(F.greatest(*places)["lid"].alias("a"), F.least(*places)["lid"].alias("b")).distinct()


#: Leader rounds go on while the open lines would meet more than so many entries each, and while a round settles an eighth.
ENOUGH, LEAST_SETTLED = 16, 8


def led_pairs(open_entries: DataFrame, led: int) -> DataFrame | None:
    """Pairs of open lines with two leaders of each crowded word, None where no word is crowded.

    The first round takes the line with most copies and the earliest; later ones, any two lines.
    """
    line = F.struct("id", "lid", "n", "pos", "parity")
    # at most one such word in MANY entries; Spark broadcasts the table where its size allows
    crowded = cut(open_entries.groupBy("word").agg(F.count(F.lit(1)).alias("all")).filter(F.col("all") >= MANY).select("word"))
    if crowded.isEmpty():
        return None
    crowd = open_entries.join(crowded, "word")
    draw = F.xxhash64("lid", F.lit(led))
    two = (
        (F.max_by(line, F.struct("copies", "n")), F.min(line)) if led == 0 else (F.max_by(line, draw), F.min_by(line, draw))
    )
    leaders = crowd.groupBy("word").agg(two[0].alias("one"), two[1].alias("two"), F.count(F.lit(1)).alias("rows"))
    near = join_by_size(crowd.select("word", "id", "lid", "n", "pos", "parity"), cut(leaders), ["word"], "rows")
    near = near.withColumn("o", F.explode(F.array("one", "two"))).drop("one", "two", "rows")
    near = near.select("*", *(F.col(f"o.{c}").alias(f"o_{c}") for c in ("id", "lid", "n", "pos", "parity")))
    return pairs_of(near.filter(possible("", "o_") | possible("o_", "")), "", "o_")


def work_left(entries: list[DataFrame], settled: DataFrame) -> bool:
    """Whether open lines share their words with so many entries that another leader round pays; for slices of the entries."""
    meets, rows = 0, 0
    for part in entries:
        both = part.groupBy("word").agg(F.count(F.lit(1)).alias("all"))
        mine = unsettled(part, settled).groupBy("word").agg(F.count(F.lit(1)).cast("double").alias("open"))
        found = mine.join(both, "word").agg(F.sum(F.col("open") * F.col("all")), F.sum("open")).first()
        meets, rows = meets + (found[0] or 0), rows + (found[1] or 0)
    return meets > ENOUGH * rows


def open_pairs(open_entries: DataFrame, closed: DataFrame) -> DataFrame:
    """Pairs in which the later line is open; two settled lines never meet."""
    facts = ("id", "lid", "n", "pos", "parity")

    def longer(rows: DataFrame) -> DataFrame:
        return rows.select("word", *facts)

    def shorter(rows: DataFrame, *more: str) -> DataFrame:
        return rows.filter("short").select("word", *(F.col(c).alias(f"o_{c}") for c in facts), *more)

    after = F.struct("id", "lid") > F.struct(F.col("o_id").alias("id"), F.col("o_lid").alias("lid"))
    everything = open_entries.withColumn("o_open", F.lit(True)).unionByName(closed.withColumn("o_open", F.lit(False)))
    mine = longer(open_entries).join(shorter(everything, "o_open"), "word").filter((after | F.col("o_open")) & possible("", "o_"))
    words = repeat_filter(closed.select("word"), "word", hashes=1, least=1)
    met = may_repeat(open_entries, "word", words, "flag", hashes=1).filter("flag")
    theirs = longer(closed).join(shorter(met), "word").filter(~after & possible("", "o_"))
    return pairs_of(mine.drop("o_open").unionByName(theirs), "", "o_")


def entries_of(firsts: DataFrame) -> DataFrame:
    """(word, pos, id, lid, n, copies, parity, short) for the prefix words of lines (place, n, prefix, parity, copies) that others share."""
    n = F.col("n")
    reach = n - F.floor((2 * NUM * n + DEN + NUM - 1) / (DEN + NUM)).cast("int")  # last place in a shorter line
    entries = firsts.select(
        F.posexplode("prefix").alias("pos", "word"), "place.id", "place.lid", "n", "copies", "parity", reach.alias("reach")
    )
    found = repeat_filter(entries.select("word"), "word", hashes=1)
    entries = may_repeat(entries, "word", found, "flag", hashes=1).filter("flag").drop("flag")
    entries = entries.withColumn("short", F.col("pos") <= F.col("reach")).drop("reach")
    return cut_by_slice(entries.withColumn("slice", F.col("word").bitwiseAND(F.lit(SLICES - 1)).cast("int")))


def slices(rows: DataFrame, number: Column, size: int) -> list[DataFrame]:
    """A written table in equal parts by a number below ``SLICES``; one part if it has fewer than ``size`` rows."""
    n = min(SLICES, 1 << (rows.count() // size).bit_length())
    return [rows.filter(number % n == k) for k in range(n)] if n > 1 else [rows]


def union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def settled_by(pairs: DataFrame, fetch) -> DataFrame:
    """(settled): the later lines of those written pairs whose sets match; written, so that the sets can go."""
    sets = fetch(pairs)
    parts = slices(pairs, F.pmod(F.xxhash64("a"), F.lit(SLICES)), SLICE_PAIRS)
    found = [cut(verified(part, sets).select(F.col("a").alias("settled")).distinct()) for part in parts]
    forget(sets)
    return union(found)


def matched(entries: DataFrame, fetch) -> DataFrame:
    """The lids of lines that match an earlier one of them, for the written table of their entries, which goes.

    A word's entries that stand early enough in their lines (``short``) find all lines that are not
    shorter. Where a word has many entries, its open lines are first compared with two of them, which
    settles most of a large group of like lines in a number of comparisons that grows with the group, not
    its square; such rounds go on as long as they settle much and much is left. Lines that are still open
    are compared with all entries of their words, so that no match is missed; settled lines are only
    looked up by these, never with each other. The words of a large table are worked on slice after slice, and so are the
    pairs found: what is shuffled or copied at a time is a share of them.
    """
    parts, settled, tried = slices(entries, F.col("slice"), SLICE_ENTRIES), None, None
    n_open = entries.count()
    for led in count():
        found = []
        for part in parts:
            mine = part if settled is None else cut(unsettled(part, settled))
            if (pairs := led_pairs(mine, led)) is not None:
                found.append(cut(pairs))
            if settled is not None:
                forget(mine)
        if not found:
            break
        pairs = new_pairs(found, tried)
        new = settled_by(pairs, fetch)
        tried = pairs if tried is None else tried.unionByName(pairs)
        settled = new if settled is None else settled.unionByName(new)
        n_before, n_settled = n_open, sum(of_settled(part, new).count() for part in parts)
        n_open -= n_settled
        if n_before > LEAST_SETTLED * n_settled or not work_left(parts, settled):
            break
    found = []
    for part in parts:
        if settled is None:
            found.append(cut(open_pairs(part, part.limit(0))))
        else:
            mine, theirs = cut(unsettled(part, settled)), cut(of_settled(part, settled))
            found.append(cut(open_pairs(mine, theirs)))
            forget(mine, theirs)
    forget(entries)
    more = settled_by(new_pairs(found, tried), fetch)
    return (more if settled is None else settled.unionByName(more)).distinct()


def unsettled(entries: DataFrame, settled: DataFrame) -> DataFrame:
    return entries.join(settled, F.col("lid") == F.col("settled"), "left_anti")


def of_settled(entries: DataFrame, settled: DataFrame) -> DataFrame:
    return entries.join(settled, F.col("lid") == F.col("settled"), "left_semi")


def new_pairs(found: list[DataFrame], tried: DataFrame | None) -> DataFrame:
    """Written tables of pairs as one, without those tried before; the tables go."""
    if len(found) == 1 and tried is None:
        return found[0]
    pairs = union(found) if len(found) == 1 else union(found).distinct()
    pairs = cut(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
    forget(*found)
    return pairs


def removals(rows: DataFrame) -> DataFrame:
    """(id, row, n_lines, n_removed, removed) for rows of (id, row, text)."""
    with tidy(rows.sparkSession):
        lines, later = later_lines(rows)
    flagged = lines.join(later.withColumnRenamed("lid", "gone"), F.col("lid") == F.col("gone"), "left")
    return flagged.groupBy("id", "row").agg(
        F.count("n").alias("n_lines"),
        F.count("gone").alias("n_removed"),
        F.array_sort(F.collect_list(F.when(F.col("gone").isNotNull(), F.col("line_no")))).alias("removed"),
    )


def later_lines(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All lines (id, row, line_no, lid, n) of (id, row, text), and the lids of those that copy or match an earlier one.

    Sets and prefixes are large, so tables that hold them are deleted as soon as the next is written.
    """
    full = with_prefixes(rows)
    worded = full.filter("n is not null")
    found = repeat_filter(worded.select("set"), "set")
    grouped = group_repeats(may_repeat(worded, "set", found, "flag"), "set", "place", "flag", F.min)
    copy = F.coalesce(F.col("place") != F.col("keep"), F.lit(False))
    grouped = cut(
        grouped.withColumn("copy", copy).select(
            "place", "copy", "n", "parity", "text_hash", F.col("size").alias("copies"), F.when(~F.col("copy"), F.col("prefix")).alias("prefix")
        )
    )
    lines = cut(full.select("id", "row", "line_no", "place.lid", "n"))
    forget(full)
    entries = entries_of(grouped.filter("not copy"))
    hashes = cut(grouped.select("place.lid", "copy", "text_hash"))
    forget(grouped)

    def fetch(pairs: DataFrame) -> DataFrame:
        lids = pairs.select(F.explode(F.array("a", "b")).alias("wanted")).distinct()
        return word_sets(rows, hashes.join(lids, F.col("lid") == F.col("wanted")).select("lid", "text_hash"))

    return lines, cut(hashes.filter("copy").select("lid").unionByName(matched(entries, fetch).toDF("lid")))


def repeated_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: id, ``n_lines`` that hold a word, ``n_removed``, ``removed`` line numbers (from 0).

    A line is removed if any line before it, in the order of id (null first), row and line, matches it.
    Blank lines are neither counted nor removed; null and empty texts have none. An empty table gives no
    rows. Words are compared by 64 bits of their hash, lines by 128.
    """
    return removals(numbered(docs, id_column, text_column)).drop("row").withColumnRenamed("id", id_column)


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The input without the lines that :func:`repeated_lines` removes; a null text stays null."""
    rows = cut(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")))
    found = removals(rows.select(F.col(f"doc.{id_column}").alias("id"), "row", whole(F.col(f"doc.{text_column}")).alias("text")))
    gone = cut(found.filter("n_removed > 0").select(F.col("row").alias("r"), "removed"))
    out = rows.join(gone, F.col("row") == F.col("r"), "left")
    kept = F.filter(F.split(F.col(f"doc.{text_column}"), "\n"), lambda _, i: ~F.array_contains("removed", i))
    text = F.when(F.col("removed").isNull(), F.col(f"doc.{text_column}")).otherwise(F.array_join(kept, "\n"))
    return out.select(*(text.alias(c) if c == text_column else F.col(f"doc.{c}").alias(c) for c in docs.columns))
