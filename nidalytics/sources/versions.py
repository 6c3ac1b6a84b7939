"""Sets of tables whose deployments are replaced all at once.

A commit writes the rows of its tables into folders of its own, in hash buckets of the deployment, then what it
holds (a row per table and deployment with its number of rows), and last an empty file that names
it. Only commits with such a file exist for readers, and of the commits that hold a deployment the last one
counts. So nothing is ever overwritten: a reader sees all tables of a set as one commit left them, a job that
dies leaves nothing to be seen, and a deployment without rows hides those that it had.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY, COMMIT, BUCKET = "deployment_id", "table_commit", "table_bucket"
BUCKETS = 16
LOG = "commits"
LOG_DDL = f"{KEY} string, name string, n long, buckets int"


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64(KEY), F.lit(buckets)).cast("int")


def _store(spark: SparkSession, path: str):
    """(file system, path) of the store that Spark itself writes to."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _names(spark: SparkSession, path: str) -> list[str]:
    store, place = _store(spark, path)
    return [s.getPath().getName() for s in store.listStatus(place)] if store.exists(place) else []


def commits(spark: SparkSession, root: str) -> list[str]:
    """Commits that readers may see, in order."""
    return [n.split("-", 1)[1] for n in sorted(_names(spark, f"{root.rstrip('/')}/{LOG}/order"))]


def commit(tables: Mapping[str, DataFrame], root: str, ids: DataFrame | None = None, buckets: int = BUCKETS) -> str:
    """Replace deployments in all given tables at once and leave the others alone; returns the commit's name.

    ``ids`` are all deployments that were worked on, those with rows always being among them. Each table
    is evaluated once; its number of files depends on its size and on ``buckets``, not on how many
    deployments it has. Of two commits at the same time the one whose name sorts last counts.
    """
    root, name = root.rstrip("/"), uuid.uuid4().hex
    spark = next(iter(tables.values())).sparkSession
    held = []
    for table, df in tables.items():
        path = f"{root}/{table}/{COMMIT}={name}"
        rows = df.withColumn(BUCKET, _bucket(buckets)).hint("rebalance", BUCKET)
        rows.sortWithinPartitions(BUCKET, KEY).write.partitionBy(BUCKET).parquet(path)
        back = spark.read.schema(f"{KEY} string, {BUCKET} int").parquet(path)
        held.append(back.groupBy(KEY).agg(F.count(F.lit(1)).alias("n")).withColumn("name", F.lit(table)))
    counts = reduce(DataFrame.unionByName, held)
    every = counts.select(KEY) if ids is None else counts.select(KEY).unionByName(ids.select(KEY))
    cells = every.distinct().withColumn("name", F.explode(F.lit(list(tables))))
    same = F.col(f"c.{KEY}").eqNullSafe(F.col(f"r.{KEY}")) & (F.col("c.name") == F.col("r.name"))
    log = cells.alias("c").join(counts.alias("r"), same, "left")
    log = log.select("c.*", F.coalesce("r.n", F.lit(0)).alias("n"), F.lit(buckets).alias("buckets"))
    log.write.parquet(f"{root}/{LOG}/held/{COMMIT}={name}")
    taken = [int(n.split("-")[0]) for n in _names(spark, f"{root}/{LOG}/order")]
    store, place = _store(spark, f"{root}/{LOG}/order/{max(taken, default=0) + 1:012d}-{name}")
    store.create(place, False).close()
    return name


@dataclass(frozen=True)
class Snapshot:
    """The tables under a root as the last of ``commits`` left them, whatever is committed meanwhile."""

    root: str
    commits: tuple[str, ...]
    #: (deployment_id, name, commit, n) of the commits that count, one row per table and deployment
    owners: DataFrame
    #: (name, commit): deployments that count, deployments in all, rows that count, buckets
    shares: dict[tuple[str, str], tuple[int, int, int, int]]

    def ids(self, name: str) -> DataFrame:
        """Deployments that a table has been written for, also those without rows."""
        return self.owners.where(F.col("name") == name).select(KEY)

    def counts(self) -> DataFrame:
        """(name, deployment_id, n): how many rows were written."""
        return self.owners.select("name", KEY, "n")

    def table(self, name: str, ddl: str, ids: Iterable[str] | None = None, skip_broken: bool = False) -> DataFrame:
        """The rows of a table; ``ids`` prunes to the buckets of some deployments.

        Commits of which every deployment counts are read as they are; others are joined with those
        that do. A table without rows is empty. ``skip_broken`` leaves out files that cannot be read (compare
        :meth:`counts`).
        """
        spark, fields = self.owners.sparkSession, T.StructType.fromDDL(ddl)
        chosen = None if ids is None else list(ids)

        def read(which: list[str]) -> DataFrame:
            if not which:
                return spark.createDataFrame([], T.StructType.fromDDL(f"{ddl}, {COMMIT} string"))
            reader = spark.read.schema(f"{ddl}, {COMMIT} string, {BUCKET} int").option("basePath", f"{self.root}/{name}")
            if skip_broken:
                reader = reader.option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
            rows = reader.parquet(*[f"{self.root}/{name}/{COMMIT}={c}" for c in which])
            if chosen is not None:
                sizes = {self.shares[name, c][3] for c in which}
                of = spark.createDataFrame([(i,) for i in chosen], f"{KEY} string").select(*[_bucket(b).alias(f"b{b}") for b in sizes])
                places = {b: sorted({r[f"b{b}"] for r in of.collect()}) for b in sizes}
                tests = [(F.col(COMMIT) == c) & F.col(BUCKET).isin(places[self.shares[name, c][3]]) for c in which]
                rows = rows.where(reduce(Column.__or__, tests) & F.col(KEY).isin(chosen))
            return rows.drop(BUCKET)

        some = [c for c in self.commits if self.shares.get((name, c), (0, 0, 0, 0))[2]]
        whole = [c for c in some if self.shares[name, c][0] == self.shares[name, c][1]]
        parts = [c for c in some if c not in whole]
        rows = read(whole)
        if parts:
            mine = self.owners.where(F.col("name") == name).select(F.col(KEY).alias("_key"), F.col(COMMIT).alias("_commit"))
            same = F.col(KEY).eqNullSafe(F.col("_key")) & (F.col(COMMIT) == F.col("_commit"))
            rows = rows.unionByName(read(parts).join(mine, same, "left_semi"))
        return rows.select(*fields.names)


def snapshot(spark: SparkSession, root: str, upto: str | None = None) -> Snapshot:
    """The tables under ``root`` now, or as the commit ``upto`` left them; no tables where nothing was committed."""
    root = root.rstrip("/")
    found = commits(spark, root)
    if upto is not None:
        found = found[: found.index(upto) + 1]
    if not found:
        return Snapshot(root, (), spark.createDataFrame([], f"{KEY} string, name string, {COMMIT} string, n long"), {})
    log = spark.read.schema(f"{LOG_DDL}, {COMMIT} string").option("basePath", f"{root}/{LOG}/held")
    log = log.parquet(*[f"{root}/{LOG}/held/{COMMIT}={c}" for c in found])
    order = spark.createDataFrame(list(zip(found, range(len(found)), strict=True)), f"{COMMIT} string, place int")
    log = log.join(F.broadcast(order), COMMIT)  # a row per commit
    last = log.groupBy(F.col(KEY).alias("_key"), F.col("name").alias("_name")).agg(F.max("place").alias("_last"))
    log = log.join(last, (F.col(KEY).eqNullSafe(F.col("_key"))) & (F.col("name") == F.col("_name"))).drop("_key", "_name")
    counts = F.col("place") == F.col("_last")
    shares = log.groupBy("name", COMMIT).agg(
        F.count_if(counts), F.count(F.lit(1)), F.coalesce(F.sum(F.when(counts, F.col("n"))), F.lit(0)), F.max("buckets")
    )
    owners = log.where(counts).select(KEY, "name", COMMIT, "n")
    return Snapshot(root, tuple(found), owners, {(r[0], r[1]): tuple(r[2:]) for r in shares.collect()})


def vacuum(spark: SparkSession, root: str, older_than_sec: float = 86_400.0) -> list[str]:
    """Delete the folders of commits that no longer count for any deployment, and of those that were never finished.

    Only folders that have not been changed for ``older_than_sec`` go, so that readers and writers at work keep theirs.
    Returns the names that went.
    """
    root = root.rstrip("/")
    now = snapshot(spark, root)
    live = {c for (_, c), share in now.shares.items() if share[0]}
    store, base = _store(spark, root)
    if not store.exists(base):
        return []
    markers = {n.split("-", 1)[1]: n for n in _names(spark, f"{root}/{LOG}/order")}
    late, gone = (time.time() - older_than_sec) * 1000, set()
    tables = [n for n in _names(spark, root) if n != LOG]
    for folder in [f"{root}/{LOG}/held", *(f"{root}/{t}" for t in tables)]:
        for entry in _names(spark, folder):
            name = entry.removeprefix(f"{COMMIT}=")
            _, place = _store(spark, f"{folder}/{entry}")
            if entry == name or name in live or store.getFileStatus(place).getModificationTime() > late:
                continue
            if name in markers:  # unseen first, then deleted
                store.delete(_store(spark, f"{root}/{LOG}/order/{markers.pop(name)}")[1], False)
            store.delete(place, True)
            gone.add(name)
    return sorted(gone)
