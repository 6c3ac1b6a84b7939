"""Exact deduplication: a Bloom filter tells which rows may be repeated, and only those are shuffled."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nidalytics.llm.common import lower_ascii, whole
from nidalytics.plans.stages import cut

#: Cells of the filter. It is broadcast as bitmaps: 2**27 bits are 16 MB, whatever the input.
FILTER_BITS = 2**27
BLOCK = 32768  # bits in one bitmap
#: A group with at least this share of all repeated rows is hot, so there are at most so many hot groups.
HOT_GROUPS = 1000


def _cell(digest: str, salt: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(F.col(digest), F.lit(salt)), F.lit(bits))


def repeat_filter(rows: DataFrame, digest: str, bits: int = FILTER_BITS, hashes: int = 2, least: int = 2) -> DataFrame:
    """First pass: bitmaps (block, bits) of the cells that two (``least``) or more rows hit.

    Every row sets ``hashes`` cells. Hits are counted per cell before the shuffle, and what is kept is one
    bit per cell: at most ``bits / 32768`` bitmaps of 4 KB.
    """
    cells = rows.select(F.explode(F.array(*(_cell(digest, k, bits) for k in range(1, hashes + 1)))).alias("cell"))
    twice = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    # cells are shuffled, not bitmaps of few bits
    marked = twice.select("cell", F.expr(f"int(cell div {BLOCK})").alias("block")).repartition("block")
    return cut(marked.groupBy("block").agg(F.expr(f"bitmap_construct_agg(cell % {BLOCK})").alias("bits")))


def may_repeat(
    rows: DataFrame, digest: str, found: DataFrame, flag: str, bits: int = FILTER_BITS, hashes: int = 2
) -> DataFrame:
    """Second pass: add ``flag``; a row without it is surely unique.

    The bitmaps have a size bound of their own, hence the broadcast. A filter too small for the input
    marks more rows, which costs shuffling but changes no result.
    """
    out, hit = rows, F.lit(True)
    for k in range(1, hashes + 1):
        side = found.select(F.col("block").alias(f"__block{k}"), F.col("bits").alias(f"__bits{k}"))
        out = out.withColumn(f"__cell{k}", _cell(digest, k, bits))
        out = out.join(F.broadcast(side), F.expr(f"int(__cell{k} div {BLOCK}) = __block{k}"), "left")
        byte = f"int(conv(hex(substring(__bits{k}, int(__cell{k} % {BLOCK} div 8) + 1, 1)), 16, 10))"
        hit = hit & F.expr(f"coalesce(shiftright({byte}, int(__cell{k} % 8)) & 1, 0) = 1")
    return out.select(*rows.columns, hit.alias(flag))


def group_repeats(
    rows: DataFrame, digest: str, order: str, flag: str, pick: Callable[[Column], Column] = F.max
) -> DataFrame:
    """Add ``keep`` (``pick`` of ``order`` among equal digests) and ``size`` to rows that carry ``flag``.

    Rows without the flag pass straight through with ``keep`` null and size 1. Groups are counted
    before the shuffle. A group that holds a thousandth of the repeated rows is looked up in a
    broadcast of at most a thousand rows, so that no join key is hot.
    """
    candidates = rows.filter(F.col(flag))
    groups = candidates.groupBy(F.col(digest).alias("__digest"))
    groups = cut(groups.agg(pick(order).alias("keep"), F.count(F.lit(1)).alias("size")).filter("size > 1"))
    least = max(2, (groups.agg(F.sum("size")).first()[0] or 0) // HOT_GROUPS)
    same = F.col(digest) == F.col("__digest")
    hot, rest = F.broadcast(groups.filter(F.col("size") >= least)), groups.filter(F.col("size") < least)
    in_hot = candidates.join(hot, same, "inner")
    in_rest = candidates.join(hot.select("__digest"), same, "left_anti").join(rest, same, "left")
    alone = rows.filter(~F.col(flag)).withColumns({"keep": F.lit(None).cast(groups.schema["keep"].dataType), "size": F.lit(1)})
    columns = [*rows.columns, "keep", F.coalesce("size", F.lit(1)).cast("long").alias("size")]
    return alone.select(*columns).unionByName(in_hot.select(*columns)).unionByName(in_rest.select(*columns))


def normal_digest(text: Column) -> Column:
    """SHA-256 of the text after lower-casing A-Z, as lower-case hex; null counts as empty."""
    return F.sha2(lower_ascii(whole(text)), 256)


def copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", bits: int = FILTER_BITS) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Of equal texts the row with the largest id stays; a null id is less than any other. Of rows
    that repeat both id and text exactly one is kept. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_column).alias("id"), normal_digest(F.col(text_column)).alias("digest"))
    # written once: the number of a row must not change between the passes
    rows = cut(rows.withColumn("rank", F.struct("id", F.monotonically_increasing_id().alias("row"))))
    flagged = may_repeat(rows, "digest", repeat_filter(rows, "digest", bits), "flag", bits)
    found = group_repeats(flagged, "digest", "rank", "flag")
    best = F.coalesce("keep", "rank")
    return found.select(
        F.col("id").alias(id_column),
        best["id"].alias("keep_id"),
        F.col("size").alias("group_size"),
        (best["row"] == F.col("rank.row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


#: Rows of a table of keys that may be broadcast, by its count.
BROADCAST_ROWS = 100_000


def row_key(identity: Column, text_digest: Column) -> Column:
    """One string that tells documents apart: rows that share id and text share it."""
    return F.concat_ws(":", text_digest, F.coalesce(identity.cast("string"), F.lit("null")))


def drop_listed(rows: DataFrame, keys: DataFrame, gone: DataFrame, key: str, bits: int = FILTER_BITS) -> DataFrame:
    """The rows whose key is not in the written table ``gone``; ``keys`` are the keys of all rows, also written.

    Rows are not shuffled for it: a filter of bounded size tells which may be listed, and the few that it
    takes for listed are found among the keys and looked up. Only if these are too many to broadcast are
    the rows that the filter marks shuffled.
    """
    found = repeat_filter(gone, key, bits, least=1)
    marked = may_repeat(keys.select(key), key, found, "__marked", bits).filter("__marked").select(key)
    stays = cut(marked.join(gone, key, "left_anti").distinct().withColumn("__stays", F.lit(True)))
    flagged = may_repeat(rows, key, found, "__marked", bits)
    if stays.count() <= BROADCAST_ROWS:
        known = flagged.join(F.broadcast(stays), key, "left")
        return known.filter(~F.col("__marked") | F.col("__stays").isNotNull()).select(*rows.columns)
    straight = flagged.filter(~F.col("__marked")).select(*rows.columns)
    return straight.unionByName(flagged.filter("__marked").join(stays, key, "left_semi").select(*rows.columns))


def drop_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", bits: int = FILTER_BITS) -> DataFrame:
    """The rows that stay, with all their columns.

    Same choice as :func:`copies`, made on ids and digests; texts are read again and not shuffled. Where
    rows repeat both id and text, one of them stays.
    """
    digest = normal_digest(F.col(text_column))
    rows = cut(docs.select(F.col(id_column).alias("id"), digest.alias("digest")))
    flagged = may_repeat(rows, "digest", repeat_filter(rows, "digest", bits), "flag", bits)
    repeated = group_repeats(flagged, "digest", "id", "flag").filter("size > 1")
    named = repeated.withColumn("key", row_key(F.col("id"), F.col("digest")))
    gone = cut(named.filter(~F.col("id").eqNullSafe(F.col("keep"))).select("key").distinct())
    twins = named.filter(F.col("id").eqNullSafe(F.col("keep"))).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    twins = cut(twins.filter("n > 1").select("key"))
    keys = rows.select(row_key(F.col("id"), F.col("digest")).alias("key"))
    whole_rows = docs.select(F.struct("*").alias("row"), row_key(F.col(id_column), digest).alias("key"))
    kept = drop_listed(whole_rows, keys, gone, "key", bits)
    if not twins.isEmpty():
        single = kept.join(twins, "key", "left_anti")
        kept = single.unionByName(kept.join(twins, "key", "left_semi").dropDuplicates(["key"]))
    return kept.select("row.*")
