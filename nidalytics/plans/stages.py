"""Cutting a long lineage with a table in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Spark then deletes the shuffle files of a query when the query ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_HELD: ContextVar[list[str] | None] = ContextVar("held", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete the stage tables that are cut inside, at the end: for jobs that write all their results."""
    paths: list[str] = []
    token = _HELD.set(paths)
    try:
        yield
    finally:
        _HELD.reset(token)
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in paths:
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a local session without one gets its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="nidalytics-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """What queries shuffle that are made and run inside goes when each of them ends."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def cut(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write the table out and read it back; ``by`` lays it out by a column of few values.

    Survives lost executors, and later reads fetch only the columns (and values of
    ``by``) that they need. The files stay until the shared folder is cleared, or
    until the end of the :func:`scratch` block that they were cut in; what was shuffled
    for them goes at once.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(by) if by else df.write
    if (held := _HELD.get()) is not None:
        held.append(path)
    with tidy(spark):
        writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete tables that :func:`cut` wrote and nothing will read again, before the shared folder is cleared."""
    for table in tables:
        spark = table.sparkSession
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in {name[: name.index("/", name.rindex("/stage-") + 1)] for name in table.inputFiles()}:
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)


def spread(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Partition by key for work that is heavier than its input is large.

    Adaptive execution merges small partitions, which would leave a long search
    over little data to one worker.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


#: Rows that a task hands to its work at a time; a longer group is handed over whole.
GROUP_ROWS = 65_536


def group_starts(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """The rows of a table at which another group begins; nulls are a group like any other value."""
    n = table.num_rows
    new = np.zeros(max(n - 1, 0), dtype=bool)
    for k in keys:
        column = table[k].combine_chunks()
        before, after = column.slice(0, n - 1), column.slice(1)
        differ = pc.fill_null(pc.not_equal(before, after), False).to_numpy(zero_copy_only=False)
        new |= differ | (before.is_null().to_numpy(zero_copy_only=False) != after.is_null().to_numpy(zero_copy_only=False))
    return np.concatenate(([0], np.flatnonzero(new) + 1)) if n else np.zeros(0, np.int64)


def map_groups(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], work: Callable[[pa.Table, np.ndarray], pa.Table], schema: T.StructType
) -> DataFrame:
    """``work`` on whole groups, many small ones at a time: a call per group would cost more than what is done in it.

    ``work`` is given the rows of some groups, sorted by ``order`` (nulls last) inside each, and the rows at which groups begin.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid_out = df.repartition(n, *keys).sortWithinPartitions(*keys, *[F.col(c).asc_nulls_last() for c in order])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, limit = [], 0, GROUP_ROWS
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < limit:
                continue
            table = pa.Table.from_batches(held)
            starts = group_starts(table, keys)
            last = int(starts[-1])  # the last group may go on
            if last:
                yield from work(table.slice(0, last), starts[:-1]).to_batches()
            held, rows = table.slice(last).to_batches(), table.num_rows - last
            limit = max(GROUP_ROWS, 2 * rows)
        if rows:
            table = pa.Table.from_batches(held)
            yield from work(table, group_starts(table, keys)).to_batches()

    return laid_out.mapInArrow(run, schema)
