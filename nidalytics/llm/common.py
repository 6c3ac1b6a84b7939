"""Helpers that several text operators share."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf: str, table: str, schema: str) -> DataFrame:
    """The named columns of one of the given tables."""
    return spark.read.schema(schema).parquet(f"{sf}/{table}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def whole(text: str | Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``use``.

    A lambda that mentions a computed column would compute it again for every element.
    """
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    """The words of a text, in order."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def count_words(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def per_process(key: str, make: Callable[[], Any], version: str = "") -> Any:
    """Build something once per Python worker and keep it for the worker's later tasks.

    Functions travel to the workers by value, so a module-level cache would be new in each task. Another
    ``version`` replaces what is kept under the key.
    """
    name = "_nidalytics_worker"
    store = sys.modules.setdefault(name, types.ModuleType(name)).__dict__
    if key not in store or store[key][0] != version:
        store[key] = (version, make())
    return store[key][1]


#: A key that holds at least this share of the rows is hot, so there are at most so many hot keys.
HOT_KEYS = 1000


def join_by_size(rows: DataFrame, groups: DataFrame, keys: list[str], n: str, how: str = "inner") -> DataFrame:
    """Join rows to a table of their keys in which ``n`` is the number of rows of each key.

    Keys with a thousandth of all rows are looked up in a broadcast of at most a thousand rows; the
    others are shuffled, none of them large. ``groups`` must be a written table, it is read three times.
    """
    least = max(2, (groups.agg(F.sum(n)).first()[0] or 0) // HOT_KEYS)
    hot, rest = F.broadcast(groups.filter(F.col(n) >= least)), groups.filter(F.col(n) < least)
    in_hot = rows.join(hot, keys)
    in_rest = rows.join(hot.select(*keys), keys, "left_anti").join(rest, keys, how)
    return in_hot.unionByName(in_rest)
