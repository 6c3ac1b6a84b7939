"""Writing and loading the derived tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nidalytics.plans.stages import cut
from nidalytics.sources import schemas, versions
from nidalytics.sources.raw import read_or_empty

def write_table(df: DataFrame, root: str, name: str, fmt: str = "parquet", ids: DataFrame | None = None) -> None:
    """Replace the deployments present in ``df`` and leave the others alone; see :func:`write_tables`."""
    write_tables({name: df}, root, fmt, ids)


def write_tables(tables: Mapping[str, DataFrame], root: str, fmt: str = "parquet", ids: DataFrame | None = None) -> None:
    """Replace deployments in all tables.

    ``ids`` are all deployments that were worked on: those of them without rows in
    a table lose the rows that they had. Parquet tables are replaced together by one
    commit (see :mod:`nidalytics.sources.versions`). CSV is for use elsewhere: a
    folder per deployment, table by table.
    """
    if fmt == "csv":
        for name, df in tables.items():
            _write_csv(cut(df), root, name, ids)
    else:
        versions.commit(tables, root, ids)


def _write_csv(df: DataFrame, root: str, name: str, ids: DataFrame | None) -> None:
    path = f"{root.rstrip('/')}/{name}"
    if ids is not None:
        _drop_stale(ids.select("deployment_id").join(df.select("deployment_id"), "deployment_id", "left_anti"), path)
    writer = df.hint("rebalance", "deployment_id").write.mode("overwrite").partitionBy("deployment_id")
    writer = writer.option("header", True).option("nullValue", "NA")
    writer.option("partitionOverwriteMode", "dynamic").csv(path)


def _drop_stale(ids: DataFrame, path: str) -> None:
    """Delete the folders of deployments that have no rows any more."""
    spark = ids.sparkSession

    def read() -> DataFrame:
        rows = spark.read.schema("deployment_id string").csv(path)
        return rows.select("deployment_id", F.regexp_extract("_metadata.file_path", "^(.*)/[^/]+$", 1).alias("folder"))

    there = read_or_empty(spark, read, "deployment_id string, folder string")
    gone = there.join(ids, "deployment_id", "left_semi").select("folder").distinct()
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for row in gone.toLocalIterator():
        folder = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(row["folder"]))
        folder.getFileSystem(conf).delete(folder, True)


def write_clean(
    tables: Mapping[str, DataFrame], root: str, fmt: str = "parquet", ids: DataFrame | None = None
) -> None:
    write_tables({n: tables[n] for n in schemas.CLEAN_TABLES}, root, fmt, ids)


def write_processed(
    tables: Mapping[str, DataFrame], root: str, fmt: str = "parquet", ids: DataFrame | None = None
) -> None:
    write_tables({n: tables[n] for n in schemas.PROCESSED_TABLES}, root, fmt, ids)


def append_table(df: DataFrame, root: str, name: str) -> None:
    df.write.mode("append").parquet(f"{root.rstrip('/')}/{name}")


def load_table(spark: SparkSession, root: str, name: str, ddl: str) -> DataFrame:
    return versions.snapshot(spark, root).table(name, ddl)


def load_clean(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    now = versions.snapshot(spark, root)
    return {n: now.table(n, ddl) for n, ddl in schemas.CLEAN_TABLES.items()}


def load_processed(
    spark: SparkSession, root: str, ids: Iterable[str] | None = None, exported: bool = False
) -> dict[str, DataFrame]:
    """The five processed tables with their types, all as of one commit; ``ids`` prunes to deployments."""
    ddls = schemas.EXPORTED_TABLES if exported else schemas.PROCESSED_TABLES
    now, chosen = versions.snapshot(spark, root), None if ids is None else list(ids)
    return {n: now.table(n, ddl, chosen) for n, ddl in ddls.items()}


def load_manifest(spark: SparkSession, root: str) -> DataFrame:
    """Ids of deployments that are already processed; empty before the first run."""
    return versions.snapshot(spark, root).ids("device_summary")


def quarantine(rows: DataFrame, root: str) -> None:
    """Add rows to the quarantine table, each once however often the job runs."""
    spark, ddl, path = rows.sparkSession, schemas.QUARANTINE, f"{root.rstrip('/')}/quarantine"
    there = read_or_empty(spark, lambda: spark.read.schema(ddl).parquet(path), ddl)
    same = [F.col(f"new.{c}").eqNullSafe(F.col(f"old.{c}")) for c in ("source_file", "reason", "raw")]
    fresh = rows.distinct().alias("new").join(there.alias("old"), same, "left_anti")
    fresh = cut(fresh)  # the table is read and added to
    append_table(fresh, root, "quarantine")
