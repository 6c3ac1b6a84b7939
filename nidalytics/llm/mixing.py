"""Mixing sources to target weights by Pareto order sampling.

A source's target is a number of words. Whole copies that every document gets come first; the words
that remain are drawn: each document has a uniform random number u and inclusion odds g, and the
documents with the smallest u / (1 - u) / g are taken until the next one would exceed what remains. The
gap that this one leaves is filled with documents after it, in order, that fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nidalytics.llm.common import count_words, whole
from nidalytics.plans.ordered import Ordering, running
from nidalytics.plans.stages import cut

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
#: Rows in a cell of the order, about; only one cell per source is ever sorted.
CELL_ROWS = 1000
#: How often the gap is filled; each time with what fits of the documents left in the cell.
FILLS = 3


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """Add the target of each source to (source, source_size): shares of the total by weight.

    Sources take the weights in the order of their code points, null last. No target is above
    ``most`` times its source; what is cut off goes to the others by weight. One row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(weights)
    table = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), place + 1).cast("long"))
    # fill sources from the one that is full first: those before it are full, those after it share the rest
    ratio = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, rest = ratio.rowsBetween(Window.unboundedPreceding, -1), ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    table = table.withColumns(
        {
            "left_words": F.sum("source_size").over(everything) - F.coalesce(most * F.sum("source_size").over(before), F.lit(0)),
            "left_weight": F.sum("weight").over(rest),
        }
    )
    full = most * F.col("source_size") * F.col("left_weight") <= F.col("weight") * F.col("left_words")
    table = table.withColumn("level", F.when(~full, F.struct("left_weight", "left_words")))
    level = F.max("level").over(everything)  # the first that is not full has the largest weight left
    share = (F.col("weight") * level["left_words"]).cast("double") / level["left_weight"]
    cap = (most * F.col("source_size")).cast("double")
    return table.select("source", "source_size", F.least(cap, F.coalesce(share, cap)).alias("target"))


def row_digest(id_column: Column, source: Column, text: Column, seed: str) -> Column:
    """A digest of what the draw of a row depends on."""
    parts = [F.lit(seed), F.coalesce(id_column.cast("string"), F.lit("null")), F.coalesce(source, F.lit("null")), F.md5(text)]
    return F.md5(F.concat_ws("|", *parts))


def draw(digest: Column, occurrence: Column) -> Column:
    """A uniform number in [0, 1) that depends on the row alone, so that reruns and retries agree.

    Rows that repeat each other draw one after the other, by ``occurrence`` from 0.
    """
    own = F.when(occurrence == 0, digest).otherwise(F.md5(F.concat_ws("|", digest, occurrence.cast("string"))))
    return F.conv(F.substring(own, 1, 12), 16, 10).cast("double") / float(2**48)


def numbered(rows: DataFrame, repeated: DataFrame, order: Column) -> DataFrame:
    """Add ``occurrence``, the number of a row among those with its ``digest``, for the digests in ``repeated``.

    ``repeated`` is a written table. Only rows of such digests are ordered; groups of any size are cut into slices.
    """
    first = F.lit(0).cast("long").alias("occurrence")
    if repeated.isEmpty():
        return rows.select("*", first)
    some = rows.join(repeated, "digest", "left_semi").select("*", order.alias("__order"), F.monotonically_increasing_id().alias("__row"))
    placed = running(cut(some), Ordering(("digest",), "__order", ("__row",)), position="__place")
    placed = placed.withColumn("occurrence", F.col("__place") - 1).select(*rows.columns, "occurrence")
    return rows.join(repeated, "digest", "left_anti").select(*rows.columns, first).unionByName(placed)


def order_value(u: Column, odds: Column) -> Column:
    """u / (1 - u) / odds, mapped from [0, inf) to [0, 1) in the same order."""
    return u / (u + (1 - u) * odds)


def _cell(mean_odds: Column, rows: Column) -> Column:
    """Cells of the order that hold about equally many rows."""
    even = F.col("v") * mean_odds / (F.col("v") * mean_odds + 1 - F.col("v"))
    return F.least(F.floor(even * rows), rows - 1)


def plan(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST_COPIES,
    seed: str = "mix",
) -> DataFrame:
    """Per source: size, target, whole copies, and which documents get one more copy: all up to the cell
    ``last_cell`` of the order, in this cell those up to ``end`` and the few in ``more``.

    ``docs`` has doc_id, source, size, v and odds. Sizes are summed per cell of the order before any
    sorting; the cell in which the target is reached is sorted, about ``CELL_ROWS`` rows per source.
    """
    per_source = cut(docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")))
    wanted = targets(per_source.select("source", "source_size"), weights, most)
    table = wanted.join(per_source.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    table = table.withColumn("mean_odds", F.sqrt(F.col("source_size") / F.col("n") + 1))
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    table = table.withColumn("whole", copies.cast("long"))
    table = table.withColumn("remains", F.col("target") - F.col("whole") * F.col("source_size"))
    table = cut(table.withColumn("cells", F.ceil(F.col("n") / CELL_ROWS)))
    # which cell of each source holds the end of the sample
    placed = docs.join(table.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    placed = placed.withColumn("cell", _cell(F.col("mean_odds"), F.col("cells")))
    per_cell = placed.groupBy("source", "cell").agg(F.sum("size").alias("words"), F.first("remains").alias("remains"))
    running = Window.partitionBy("source").orderBy("cell")
    per_cell = per_cell.withColumn("upto", F.sum("words").over(running))
    last = per_cell.filter(F.col("upto") >= F.col("remains")).groupBy(F.col("source").alias("s2"))
    last = cut(last.agg(F.min_by(F.struct("cell", (F.col("upto") - F.col("words")).alias("base")), "cell").alias("last")))
    inside = placed.join(last, F.col("source").eqNullSafe(F.col("s2")) & (F.col("cell") == F.col("last.cell")))
    order = Window.partitionBy("source").orderBy("v", F.col("doc_id").asc_nulls_first())
    order, everything = order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("source")
    room = F.col("remains") - F.col("last.base")
    inside = inside.withColumn("taken", F.sum("size").over(order) <= room).withColumn("first", F.col("taken"))
    for _ in range(FILLS):
        gap = room - F.coalesce(F.sum(F.when(F.col("taken"), F.col("size"))).over(everything), F.lit(0))
        inside = inside.withColumn("gap", gap)
        inside = inside.withColumn("fits", ~F.col("taken") & F.col("size").between(F.lit(1), F.col("gap")))
        upto = F.sum(F.when(F.col("fits"), F.col("size"))).over(order)
        inside = inside.withColumn("taken", F.col("taken") | (F.col("fits") & (upto <= F.col("gap"))))
    key = F.struct("v", "doc_id")
    ends = inside.filter("taken").groupBy(F.col("source").alias("s3"))
    ends = ends.agg(
        F.max(F.when(F.col("first"), key)).alias("end"), F.collect_set(F.when(~F.col("first"), key)).alias("more")
    )
    out = table.join(last, F.col("source").eqNullSafe(F.col("s2")), "left")
    out = out.join(ends, F.col("source").eqNullSafe(F.col("s3")), "left")
    known = ["source", "source_size", "target", "whole", "remains", "mean_odds", "cells", "end", "more"]
    return cut(out.select(*known, F.col("last.cell").alias("last_cell")))


def sized(docs: DataFrame, id_column: str, text_column: str, source_column: str, seed: str) -> DataFrame:
    """doc_id, source, size, odds and the place v in the Pareto order; longer documents have larger odds."""
    text = whole(text_column)
    rows = cut(
        docs.select(
            F.col(id_column).alias("doc_id"),
            F.col(source_column).alias("source"),
            count_words(text).alias("size"),
            row_digest(F.col(id_column), F.col(source_column), text, seed).alias("digest"),
        )
    )
    counts = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    rows = numbered(rows, cut(counts.where("n > 1").select("digest")), F.lit(0))
    odds = F.sqrt(F.col("size") + 1.0)
    place = order_value(draw(F.col("digest"), F.col("occurrence")), odds)
    return rows.select("doc_id", "source", "size", odds.alias("odds"), place.alias("v"), "digest", "occurrence")


def copies_of(rows: DataFrame, mix: DataFrame) -> DataFrame:
    """Add the plan of a row's source and ``copies``, how often the mix takes the row.

    The plan has a row per source; Spark broadcasts it where its size allows and else splits hot sources.
    """
    plan_rows = mix.withColumnRenamed("source", "__source")
    out = rows.join(plan_rows, F.col("source").eqNullSafe(F.col("__source")), "left")
    cell = _cell(F.col("mean_odds"), F.col("cells"))
    key = F.struct("v", "doc_id")
    inside = F.coalesce(key <= F.col("end"), F.lit(False)) | F.coalesce(F.array_contains("more", key), F.lit(False))
    drawn = (F.col("remains") > 0) & (
        F.col("last_cell").isNull() | (cell < F.col("last_cell")) | ((cell == F.col("last_cell")) & inside)
    )
    return out.withColumn("copies", (F.col("whole") + F.coalesce(drawn.cast("long"), F.lit(0))).cast("int"))


def mix_report(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST_COPIES,
    seed: str = "mix",
) -> DataFrame:
    """One row per input row: its size, its source's size and target, and the words the mix takes.

    A null source is a source of its own, a null text has no words. Rows that repeat id, source and
    text draw one by one, like any others. A source misses its target by less than the smallest
    document left in the cell where its sample ends.
    """
    rows = cut(sized(docs, id_column, text_column, source_column, seed))
    out = copies_of(rows, plan(rows, weights, most, seed))
    return out.select(
        F.col("doc_id").alias(id_column), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


def mixed(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST_COPIES,
    seed: str = "mix",
) -> DataFrame:
    """The mix itself: each row as often as it is taken, with all its columns."""
    table = cut(sized(docs, id_column, text_column, source_column, seed))
    mix = plan(table, weights, most, seed)
    text = whole(text_column)
    rows = docs.select(
        F.struct("*").alias("row"),
        F.col(id_column).alias("doc_id"),
        F.col(source_column).alias("source"),
        F.sqrt(count_words(text) + 1.0).alias("odds"),
        row_digest(F.col(id_column), F.col(source_column), text, seed).alias("digest"),
    )
    rows = numbered(rows, cut(table.where("occurrence = 1").select("digest")), F.xxhash64("row"))
    rows = rows.withColumn("v", order_value(draw(F.col("digest"), F.col("occurrence")), F.col("odds")))
    out = copies_of(rows, mix).withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies"))))
    return out.select("row.*")
