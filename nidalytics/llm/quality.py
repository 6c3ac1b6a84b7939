"""Quality rules as a cascade: cheap rules that reject much come first, later ones see what is left."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nidalytics.llm.common import WORD, let, whole, words_of
from nidalytics.plans.stages import cut

#: Texts on which costs and rejections are estimated; only the order of the rules depends on them.
SAMPLE_ROWS = 400
#: The sample is gone through so often that a rule reads about this many characters while it is timed.
TIMED_CHARS = 4_000_000


def n_words(text: Column) -> Column:
    return F.size(words_of(text))


def word_chars(text: Column) -> Column:
    return F.length(F.translate(text, " \t\n\x0b\x0c\r", ""))


def n_symbols(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))


def lines_of(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda line: F.regexp_like(line, F.lit(WORD)))


def n_dup_lines(text: Column) -> Column:
    return let(lines_of(text), lambda lines: F.size(lines) - F.size(F.array_distinct(lines)))


def n_repeat_words(text: Column) -> Column:
    """Words that lie in a three-word window which the text holds twice or more.

    Windows are compared by a 64-bit hash of their words. Where no hash repeats the answer is 0;
    else the windows are sorted by hash, those equal to a neighbour give their places, and the
    places, sorted, are merged into the number of words they cover.
    """

    def windows(words: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(words) - 3)
        return F.transform(places, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def covered(hashes: Column) -> Column:
        ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(ranked, lambda s: let(F.sort_array(places(s)), merged))

    def places(s: Column) -> Column:
        def same(x: Column, j: Column) -> Column:
            return (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"])

        return F.transform(F.filter(s, lambda x, j: F.coalesce(same(x, j), F.lit(False))), lambda x: x["i"])

    def merged(p: Column) -> Column:
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(
            p,
            start,
            lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3), x - a["last"])).alias("n")),
            lambda a: a["n"],
        )

    def count(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(covered(hashes))

    return let(words_of(text), lambda w: F.when(F.size(w) < 3, 0).otherwise(let(windows(w), count)))


@dataclass(frozen=True)
class Rule:
    """``reject`` is true where a text fails; it must not be null."""

    name: str
    reject: Column


def rules(text: Column) -> list[Rule]:
    """The rules that are applied, in no particular order. Published thresholds, the same for all languages."""
    lines = lines_of(text)
    words = n_words(text)
    with_letter = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]*\p{L}[^\x20\x09-\x0D]*"))
    bullets = F.size(F.filter(lines, lambda x: F.regexp_like(x, F.lit(r"^[\x20\x09-\x0D]*[-*\x{2022}]"))))
    dots = F.size(F.filter(lines, lambda x: F.regexp_like(x, F.lit(r"(\.\.\.|\x{2026})[\x20\x09-\x0D]*$"))))
    return [
        Rule("few_words", words < 50),
        Rule("repeated_words", 100 * n_repeat_words(text) > 50 * words),
        Rule("word_length", (word_chars(text) < 2 * words) | (word_chars(text) > 15 * words)),
        Rule("symbols", 10 * n_symbols(text) > words),
        Rule("repeated_lines", let(n_dup_lines(text), lambda n: (n >= 3) & (100 * n > 30 * F.size(lines)))),
        Rule("few_letters", 100 * with_letter < 70 * words),
        Rule("bullets", 100 * bullets > 90 * F.size(lines)),
        Rule("cut_lines", 100 * dots > 30 * F.size(lines)),
    ]


def sampled(docs: DataFrame, text_column: str, sample_rows: int) -> DataFrame:
    """The distinct texts of lowest hash, whole and written: the same ones in every run, wherever rows lie."""
    texts = docs.select(whole(text_column).alias(text_column)).withColumn("_h", F.xxhash64(text_column))
    # a bounded number of hashes, of which one goes to the driver
    highest = texts.select("_h").distinct().orderBy("_h").limit(sample_rows).agg(F.max("_h")).first()[0]
    near = texts.filter(F.col("_h") <= F.lit(highest)) if highest is not None else texts.filter("false")
    return cut(near.groupBy("_h").agg(F.first(text_column).alias(text_column)).drop("_h"))


def order_by_gain(docs: DataFrame, text_column: str, found: Sequence[Rule], sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejection per cost on a sample, where each rejects from what the rules before it leave.

    Rules that reject none of the sample come last, by name. The order decides how much work is done for a text
    that fails, never whether it fails.
    """
    sample = sampled(docs, text_column, sample_rows)
    rows, chars = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length(text_column)), F.lit(0))).first()
    if not rows:
        return list(found)
    failing = F.array_compact(F.array(*[F.when(rule.reject, rule.name) for rule in found]))
    left = [set(r[0]) for r in sample.select(failing).collect()]  # names of rules, for each text of the sample
    times = max(1, TIMED_CHARS // (chars + 20 * rows))
    often = sample.select(text_column, F.explode(F.sequence(F.lit(1), F.lit(times))).alias("_turn"))

    def seconds(value: Column) -> float:
        spent = []
        for _ in range(3):  # the first run compiles
            start = time.perf_counter()
            often.agg(F.count_if(value)).first()
            spent.append(time.perf_counter() - start)
        return min(spent)

    idle = seconds(F.length(text_column) < 0)
    rejecting = [rule for rule in found if any(rule.name in names for names in left)]
    cost = {rule.name: max(seconds(rule.reject) - idle, 1e-3) for rule in rejecting}
    order, rest = [], sorted(found, key=lambda rule: rule.name)
    while rest:
        # max keeps the first of equals, so rules that reject nothing more keep the order of their names
        best = max(rest, key=lambda rule: sum(rule.name in names for names in left) / cost.get(rule.name, 1.0))
        order.append(best)
        rest.remove(best)
        left = [names for names in left if best.name not in names]
    return order


def verdict(cascade: Sequence[Rule]) -> Column:
    """The name of the first rule that rejects, null if none does; later rules are not evaluated."""
    out = F.when(cascade[0].reject, cascade[0].name)
    for rule in cascade[1:]:
        out = out.when(rule.reject, rule.name)
    return out


def good_rows(docs: DataFrame, text_column: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows that no rule rejects, with all their columns. A null text counts as empty and is rejected."""
    cascade = order_by_gain(docs, text_column, rules(whole(text_column)), sample_rows)
    return docs.filter(verdict(cascade).isNull())


def judge(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per input row: counts, ``base_failed`` and ``kept``.

    Texts of any length are judged whole, each in its own row of the plan.
    A null text has no words, so it fails. Repeated rows are judged alike, an empty table gives no rows.
    """
    named = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    ordered = order_by_gain(named, "text", rules(whole("text")), sample_rows)
    text = whole("text")
    counts = F.struct(
        n_words(text).cast("long").alias("n_words"),
        word_chars(text).cast("long").alias("word_chars"),
        n_symbols(text).cast("long").alias("n_symbols"),
        n_dup_lines(text).cast("long").alias("n_dup_lines"),
        n_repeat_words(text).cast("long").alias("n_repeat_words"),
    )
    # the counts are part of the result, so the rules that rest on them read them
    ready = {
        "few_words": lambda c: c["n_words"] < 50,
        "repeated_words": lambda c: 100 * c["n_repeat_words"] > 50 * c["n_words"],
        "word_length": lambda c: (c["word_chars"] < 2 * c["n_words"]) | (c["word_chars"] > 15 * c["n_words"]),
        "symbols": lambda c: 10 * c["n_symbols"] > c["n_words"],
    }

    def row(c: Column) -> Column:
        failed = ready["few_words"](c) | ready["repeated_words"](c)
        known = [Rule(r.name, ready[r.name](c)) for r in ordered if r.name in ready]
        rest = [Rule(r.name, r.reject) for r in ordered if r.name not in ready]
        return F.struct(
            c.alias("c"), failed.alias("base_failed"), (~failed & verdict([*known, *rest]).isNull()).alias("kept")
        )

    return named.select(F.col("doc_id").alias(id_column), let(counts, row).alias("r")).select(
        id_column, "r.c.*", "r.base_failed", "r.kept"
    )
