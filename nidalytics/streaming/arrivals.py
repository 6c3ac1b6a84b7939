"""Processing deployment folders as their files arrive, in whatever order."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from nidalytics.plans.pipeline import BATCH_FOLDERS, Params, process_new
from nidalytics.plans.stages import cut
from nidalytics.sources import files, raw, schemas, tables

HOLD_SEC = 3600.0
# The columns of Spark's binary file source.
BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FolderGate(StatefulProcessor):
    """Holds a folder until the required files are there.

    State is a row per folder: the files seen, and whether the folder was let through. A folder is let
    through once, whatever arrives later. One that lacks a file when its time is over is reported once,
    stays held, and is let through when the file comes after all.
    """

    def __init__(self, required: tuple[str, ...], hold_ms: int) -> None:
        self.required, self.hold_ms = required, hold_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "names string, through boolean")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        held = self.seen.get() if self.seen.exists() else None
        if held is not None and held[1]:
            return
        before = set(held[0].split(",")) - {""} if held is not None else set()
        names = before | {r["name"] for r in rows if r["name"] in self.required}
        through = len(names) == len(self.required)
        self.seen.update((",".join(sorted(names)), through))
        if through:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            yield Row(folder=key[0], missing=[])
        elif held is None:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.hold_ms)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        names, through = self.seen.get() if self.seen.exists() else ("", True)
        if not through:
            yield Row(folder=key[0], missing=sorted(set(self.required) - set(names.split(","))))

    def close(self) -> None:
        pass


def arriving_files(spark: SparkSession, root: str) -> DataFrame:
    """A stream of (folder, name), a row per file (or slice of one) that has not been seen before."""
    files = spark.readStream.schema(BINARY_FILE).format("binaryFile").load(f"{root.rstrip('/')}/*/*").select("path")
    return raw.folder_files(files)


def gated(files: DataFrame, hold_sec: float = HOLD_SEC) -> DataFrame:
    """(folder, missing): nothing missing where a folder is complete, else what it lacks when its time is over."""
    gate = FolderGate(tuple(schemas.REQUIRED_FILES), int(hold_sec * 1000))
    return files.groupBy("folder").transformWithState(
        gate, "folder string, missing array<string>", outputMode="Append", timeMode="ProcessingTime"
    )


def settle(batch: DataFrame, out: str, params: Params, batch_folders: int = BATCH_FOLDERS) -> None:
    """Process the complete folders of a batch, and report the others in the quarantine table."""
    spark, rows = batch.sparkSession, cut(batch)
    late = rows.where(F.size("missing") > 0)
    if not late.isEmpty():
        tables.quarantine(raw.missing_files(late), out)
    whole = rows.where(F.size("missing") == 0).select("folder")
    if not whole.isEmpty():
        found = cut(raw.read_metadata(spark, raw.files_of(files.addressed(whole), schemas.METADATA_FILE)))
        listing = found.select("folder", F.explode(F.array(*map(F.lit, schemas.REQUIRED_FILES))).alias("name"))
        process_new(spark, found, listing, out, params, batch_folders=batch_folders)


def process_arrivals(
    spark: SparkSession,
    root: str,
    out: str,
    checkpoint: str,
    params: Params = Params(),
    hold_sec: float = HOLD_SEC,
    trigger: dict[str, Any] | None = None,
) -> StreamingQuery:
    """Process every folder under ``root`` once its four files are there, in any order and over any number of runs.

    Files seen and folders held live in the query's checkpoint, so a run that stops goes on where it was. A folder
    still incomplete ``hold_sec`` after its first file is put in the quarantine table once and stays held. Undated
    folders go to quarantine too and can be taken up by :func:`nidalytics.plans.pipeline.load_or_process`. A batch
    that runs again does no harm: the manifest and the quarantine table know what was done.

    Without ``trigger`` the query takes what is there and stops; overdue folders are then reported by the next run
    that finds a new file. With ``{"processingTime": "1 minute"}`` it goes on, and reports them in time.
    """
    once = trigger is None
    names = ("spark.sql.streaming.stateStore.providerClass", "spark.sql.streaming.noDataMicroBatches.enabled")
    before = {n: spark.conf.get(n) for n in names}
    try:
        # timers of processing time would keep a query that should stop going with empty batches
        for name, value in zip(names, (ROCKSDB, str(not once).lower()), strict=True):
            spark.conf.set(name, value)
        return (
            gated(arriving_files(spark, root), hold_sec)
            .writeStream.foreachBatch(lambda batch, _: settle(batch, out, params))
            .option("checkpointLocation", checkpoint)
            .trigger(**({"availableNow": True} if once else trigger))
            .start()
        )
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
