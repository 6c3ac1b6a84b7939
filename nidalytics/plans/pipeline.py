"""The whole chain from raw folders to processed tables, and the corrected export."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nidalytics.operators import bouts as bt
from nidalytics.operators import classify, clean, correct, night, refresh, segment, smooth, summary
from nidalytics.plans.ordered import BLOCK
from nidalytics.plans.stages import cut, scratch
from nidalytics.sources import raw, schemas, tables, versions

KEYS = ("deployment_id",)
ORDER = raw.READING_ORDER
SMOOTHED = "tof_smooth_r"
BATCH_FOLDERS = 1_000_000


@dataclass(frozen=True)
class Params:
    """User-tunable settings."""

    smooth_sec: float = smooth.SMOOTH_SEC
    cpt_penalty: str | float = "MBIC"
    sensitivity: float = classify.SENSITIVITY
    min_bout_sec: float = bt.MIN_BOUT_SEC
    classification_method: str = "gmm"
    gap_threshold_min: float = clean.LARGE_GAP_MIN
    ema_warmup_n: int = clean.WARMUP_ROWS
    nulls: str = "propagate"
    bridge_nulls: bool = True


def ingest(
    spark: SparkSession,
    folders: list[str] | DataFrame,
    params: Params = Params(),
    year_overrides: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Clean tables, deployments and quarantine of complete deployment folders, given by name or as a table (folder)."""

    def paths(name: str) -> list[str] | DataFrame:
        return raw.files_of(folders, name) if isinstance(folders, DataFrame) else [f"{f}/{name}" for f in folders]

    settled = cut(raw.settle_ids(cut(raw.read_metadata(spark, paths(schemas.METADATA_FILE)))))
    metadata = settled.where("NOT replaced").drop("replaced")
    lines = {n: raw.read_lines(spark, paths(n)) for n in schemas.RAW_FILES}
    bad = reduce(
        DataFrame.unionByName,
        [raw.bad_headers(metadata, raw.headers(lines[n], ddl), n) for n, ddl in schemas.RAW_FILES.items()],
    )
    bad = cut(bad)
    metadata = metadata.join(bad, "folder", "left_anti")
    deployments = cut(raw.deployment_table(metadata, one_year(year_overrides)))
    log_rows = cut(raw.stamp(raw.scan(lines[schemas.LOG_FILE], schemas.LOG_RAW), deployments))
    dht_rows = cut(raw.stamp(raw.scan(lines[schemas.DHT_FILE], schemas.DHT_RAW), deployments))
    tof_rows = cut(raw.stamp(raw.scan(lines[schemas.TOF_FILE], schemas.TOF_RAW), deployments))
    log = raw.clean_log(log_rows)
    quarantine = (
        clean.missing_year(deployments, "folder")
        .unionByName(raw.replaced_folders(settled))
        .unionByName(bad.drop("folder"))
        .unionByName(raw.bad_rows(log_rows, schemas.LOG_FILE))
        .unionByName(raw.bad_rows(dht_rows, schemas.DHT_FILE))
        .unionByName(raw.bad_rows(tof_rows, schemas.TOF_FILE))
    )
    return {
        "deployments": deployments.where(F.col("recording_year").isNotNull()),
        "log_clean": log,
        "dht_clean": cut(raw.clean_dht(dht_rows, log)),
        "tof_clean": cut(raw.clean_tof(tof_rows, log, params.ema_warmup_n)),
        "quarantine": quarantine,
    }


def process(
    deployments: DataFrame,
    tof_clean: DataFrame,
    dht_clean: DataFrame,
    log_clean: DataFrame,
    params: Params = Params(),
    corrections: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Smooth, find change points, classify, make bouts and summaries.

    Coordinates come from the deployment table. Corrections, where given, are
    replayed on the labelled readings.
    """
    segment.check_penalty(params.cpt_penalty)
    keys = list(KEYS)
    intervals = smooth.typical_interval(tof_clean, KEYS)
    sizes = cut(smooth.window_sizes(deployments, intervals, KEYS, params.smooth_sec))
    sun = cut(night.sun_table(tof_clean, "timestamp", deployments, KEYS))

    usable = F.when(smooth.usable(tof_clean), F.col("tof_raw_mm"))
    smoothed = smooth.smooth_by_window_size(
        tof_clean, ORDER.within("session_id"), usable, sizes, params.nulls, SMOOTHED, "session_row",
        smooth.default_window(params.smooth_sec),
    )
    readings = cut(night.mark_night(smoothed, "timestamp", sun, KEYS))

    signal = segment.signal_rows(readings).select(*ORDER.row_id, SMOOTHED)
    segmented = cut(segment.changepoints(signal, ORDER, SMOOTHED, params.cpt_penalty))
    medians = cut(segment.segment_medians(segmented, keys, SMOOTHED))
    classes = classify.classify_segments(
        medians, keys, params.classification_method, params.sensitivity, segmented, SMOOTHED
    )
    labelled = segmented.join(classes.select(*keys, "segment_id", "state_auto"), [*keys, "segment_id"], "left")
    states = classify.apply_labels(readings, labelled, ORDER.row_id).drop("is_night")
    if corrections is not None:
        states = correct.apply_corrections(cut(states), corrections, ORDER)
    states = cut(states)
    runs = cut(bt.state_runs(states, ORDER, "state_corrected", params.bridge_nulls).drop(BLOCK))
    bout_table = cut(bt.bouts(runs, ORDER, min_bout_sec=params.min_bout_sec))
    return {
        "tof_processed": _typed(runs, schemas.TOF_PROCESSED),
        "dht_processed": dht_clean,
        "bout_summary": _typed(_round_mean(bout_table), schemas.BOUTS),
        "day_summary": _typed(summary.day_summary(runs, bout_table, keys, "timestamp", sun), schemas.DAYS),
        "device_summary": _typed(
            summary.device_summary(runs, dht_clean, log_clean, deployments, keys), schemas.DEVICES
        ),
        "typical_interval": sizes,
    }


def _round_mean(bout_table: DataFrame) -> DataFrame:
    return bout_table.withColumn("mean_tof_mm", F.round("mean_tof_mm", 1))


def _typed(df: DataFrame, ddl: str) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(ddl)])


def diagnostics(ingested: dict[str, DataFrame], params: Params = Params()) -> dict[str, DataFrame]:
    """Tables for checking the raw data: long gaps, row counts, and devices or clocks that do not fit."""
    log, dht, tof = (ingested[n] for n in ("log_clean", "dht_clean", "tof_clean"))
    return {
        "large_gaps": clean.large_gaps(dht, ORDER, params.gap_threshold_min),
        "large_gaps_tof": clean.large_gaps(tof, ORDER, params.gap_threshold_min),
        "ingest_counts": clean.ingest_counts(tof, dht, log),
        "device_mismatch": clean.device_mismatch(log, ingested["deployments"]),
        "clock_mismatch": clean.clock_mismatch(log, tof),
    }


def process_pipeline(
    spark: SparkSession,
    folders: list[str] | DataFrame,
    out: str,
    params: Params = Params(),
    year_overrides: DataFrame | None = None,
) -> None:
    """Ingest and process complete folders and write all tables under ``out``."""
    with scratch(spark):
        _ingest_and_process(spark, folders, out, params, year_overrides)


def _ingest_and_process(spark, folders, out, params, year_overrides) -> None:
    ingested = ingest(spark, folders, params, year_overrides)
    deployments = ingested["deployments"]
    tables.quarantine(ingested["quarantine"], out)
    clean_tables = {n: ingested[n] for n in schemas.CLEAN_TABLES}
    processed = process(deployments, ingested["tof_clean"], ingested["dht_clean"], ingested["log_clean"], params)
    results = {n: processed[n] for n in schemas.PROCESSED_TABLES}
    # one commit: a deployment is there with all its tables or not at all
    tables.write_tables(
        {**clean_tables, **results, **diagnostics(ingested, params), "deployments": deployments}, out, ids=deployments
    )


def pending(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Deployments that are not processed yet."""
    return found.join(manifest, "deployment_id", "left_anti")


def process_new(
    spark: SparkSession,
    found: DataFrame,
    listing: DataFrame,
    out: str,
    params: Params = Params(),
    year_overrides: DataFrame | None = None,
    batch_folders: int = BATCH_FOLDERS,
) -> int:
    """Process the deployments of ``found`` that are complete, dated and not in the manifest.

    The others go to quarantine, also folders of the listing without metadata. Of
    folders with the same deployment id the last one counts. Folders are processed
    some ``batch_folders`` at a time, drawn by hash; neither their names nor readings
    pass through the driver. Returns the number of deployments processed.
    """
    with scratch(spark):
        return _process_new(spark, found, listing, out, params, year_overrides, batch_folders)


def _process_new(spark, found, listing, out, params, year_overrides, batch_folders) -> int:
    before = cut(tables.load_manifest(spark, out))
    settled = cut(raw.settle_ids(cut(found)))
    done = settled.join(before, "deployment_id", "left_semi").select("folder")
    incomplete = cut(raw.require_files(listing).join(done, "folder", "left_anti"))
    todo = pending(settled, before)
    whole = todo.where("NOT replaced").drop("replaced").join(incomplete, "folder", "left_anti")
    dated = cut(clean.resolve_year(whole, one_year(year_overrides), allowed=(2020, 2100)))
    rejected = raw.missing_files(incomplete).unionByName(clean.missing_year(dated, "folder"))
    tables.quarantine(rejected.unionByName(raw.replaced_folders(todo)), out)
    ready = dated.where("recording_year IS NOT NULL").select("folder")
    batches = -(-ready.count() // batch_folders)
    drawn = F.pmod(F.xxhash64("folder"), F.lit(max(batches, 1)))
    for batch in range(batches):
        process_pipeline(spark, ready.where(drawn == batch), out, params, year_overrides)
    return tables.load_manifest(spark, out).join(before, "deployment_id", "left_anti").count()


def one_year(overrides: DataFrame | None) -> DataFrame | None:
    """At most one explicit year per deployment, the latest."""
    return None if overrides is None else overrides.groupBy(*KEYS).agg(F.max("year").alias("year"))


def reprocess(
    spark: SparkSession, out: str, params: Params = Params(), ids: DataFrame | None = None, corrections: DataFrame | None = None
) -> None:
    """Process again from the stored clean tables, with other settings; ``ids`` limits it to some deployments."""
    clean_tables = tables.load_clean(spark, out)
    deployments = tables.load_table(spark, out, "deployments", schemas.DEPLOYMENTS)
    if ids is not None:
        chosen = ids.select(*KEYS).distinct()
        clean_tables = {n: t.join(chosen, list(KEYS), "left_semi") for n, t in clean_tables.items()}
        deployments = deployments.join(chosen, list(KEYS), "left_semi")
    log, dht, tof = (clean_tables[n] for n in ("log_clean", "dht_clean", "tof_clean"))
    with scratch(spark):
        processed = process(deployments, tof, dht, log, params, corrections)
        tables.write_processed(processed, out, ids=deployments)


def load_or_process(
    spark: SparkSession,
    root: str,
    out: str,
    params: Params = Params(),
    year_overrides: DataFrame | None = None,
) -> int:
    """Process the folders under ``root`` that are not in the manifest; returns how many."""
    found = raw.read_metadata(spark, f"{root.rstrip('/')}/*/{schemas.METADATA_FILE}")
    return process_new(spark, found, raw.list_files(spark, root), out, params, year_overrides)


def export_corrected(
    processed: dict[str, DataFrame],
    deployments: DataFrame,
    log_clean: DataFrame | None = None,
    corrections: DataFrame | None = None,
    min_bout_sec: float = bt.MIN_BOUT_SEC,
    bridge_nulls: bool = True,
) -> dict[str, DataFrame]:
    """The five tables re-derived after corrections and trimming.

    The automatic bout id stays beside the new one; a table that was exported
    before keeps its ``bout_id_auto``.
    """
    keys = list(KEYS)
    tof = processed["tof_processed"]
    if "bout_id" in tof.columns:
        tof = tof.withColumnRenamed("bout_id", "bout_id_auto")
    tof = tof.drop("bout_id_corrected")
    if corrections is not None:
        tof = cut(correct.apply_corrections(tof, corrections, ORDER))
    trimmed = correct.trim_window(tof, deployments, keys, "timestamp")
    runs = cut(bt.state_runs(trimmed, ORDER, "state_corrected", bridge_nulls).drop(BLOCK))
    bout_table = cut(bt.bouts(runs, ORDER, min_bout_sec=min_bout_sec))
    sun = cut(night.sun_table(runs, "timestamp", deployments, keys))
    dht = correct.trim_window(processed["dht_processed"], deployments, keys, "timestamp")
    out = runs.withColumnRenamed("bout_id", "bout_id_corrected")
    return {
        "tof_processed": _typed(out, schemas.TOF_EXPORTED),
        "dht_processed": dht,
        "bout_summary": _typed(_round_mean(bout_table), schemas.BOUTS),
        "day_summary": _typed(summary.day_summary(runs, bout_table, keys, "timestamp", sun), schemas.DAYS),
        "device_summary": _typed(summary.device_summary(runs, dht, log_clean, deployments, keys), schemas.DEVICES),
    }


def broken_tables(found: dict[str, DataFrame], written: DataFrame) -> DataFrame:
    """(deployment_id, reason) of deployments with fewer or more rows in a table than were written."""
    there = reduce(
        DataFrame.unionByName,
        [t.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_read")).withColumn("name", F.lit(n)) for n, t in found.items()],
    )
    both = written.where(F.col("name").isin(*found)).join(there, [*KEYS, "name"], "left")
    short = both.where(F.coalesce("_read", F.lit(0)) != F.col("n"))
    reason = F.format_string("%s: %d of %d rows can be read", "name", F.coalesce("_read", F.lit(0)), "n")
    return short.groupBy(*KEYS).agg(F.array_join(F.array_sort(F.collect_list(reason)), "; ").alias("reason"))


def unfit(deployments: DataFrame, found: dict[str, DataFrame], corrections: DataFrame | None) -> DataFrame:
    """(deployment_id, reason) of deployments whose tables cannot be derived again.

    Readings must have a time and a known state or none, a deployment must be described, and its
    corrections must have a number, bounds and a known action.
    """
    states = ("present", "absent", "uncertain")
    tof = found["tof_processed"]
    strange = F.col("state_auto").isNotNull() & ~F.col("state_auto").isin(*states)
    # readings are gone through once, and what is joined is a row per deployment
    seen = cut(tof.groupBy(*KEYS).agg(F.bool_or(F.col("timestamp").isNull()).alias("_undated"), F.bool_or(strange).alias("_strange")))
    rules = [
        seen.where("_undated").select(*KEYS, F.lit("a reading without a time").alias("reason")),
        seen.where("_strange").select(*KEYS, F.lit("a state that is not known").alias("reason")),
        seen.select(*KEYS).join(deployments, list(KEYS), "left_anti").select(*KEYS, F.lit("no description").alias("reason")),
    ]
    if corrections is not None:
        known = F.coalesce(F.col("action").isin(*states, correct.RESET), F.lit(False))
        for c in ("seq", "t_min", "t_max", "d_min", "d_max"):
            known &= F.col(c).isNotNull()
        rules.append(corrections.where(~known).select(*KEYS, F.lit("a correction that cannot be read").alias("reason")))
    return reduce(DataFrame.unionByName, rules).distinct()


def export_all(
    spark: SparkSession,
    out: str,
    export_root: str,
    corrections: DataFrame | None = None,
    fmt: str = "parquet",
    trims: DataFrame | None = None,
    min_bout_sec: float = bt.MIN_BOUT_SEC,
    bridge_nulls: bool = True,
) -> int:
    """Export every processed deployment under ``out`` to ``export_root``; returns how many were exported.

    ``trims`` (deployment_id, trim_start, trim_end as text) replaces stored trim bounds. A deployment that has no rows
    left loses those of an earlier export. A deployment that cannot be exported (rows that are lost, see :func:`broken_tables`;
    contents that make no sense, see :func:`unfit`) does not stop the others: it goes to the quarantine
    table of the export with the reason, and keeps what was exported before.
    """
    now = versions.snapshot(spark, out)
    deployments = now.table("deployments", schemas.DEPLOYMENTS, skip_broken=True)
    ddls = {**schemas.PROCESSED_TABLES, "log_clean": schemas.LOG_CLEAN}
    found = {n: now.table(n, ddl, skip_broken=True) for n, ddl in ddls.items()}
    with scratch(spark):
        # plans of their own: the driver holds each plan and what its tasks report
        lost = cut(broken_tables({**found, "deployments": deployments}, now.counts()))
        failed = cut(lost.unionByName(unfit(deployments, found, corrections)))
        bad = None if failed.isEmpty() else failed.select(*KEYS).distinct()
        tables.quarantine(
            failed.select(F.col("deployment_id").alias("source_file"), "reason", F.lit(None).cast("string").alias("raw")), export_root
        )

        def good(df: DataFrame) -> DataFrame:
            return df if bad is None else df.join(bad, list(KEYS), "left_anti")

        described = cut(good(deployments))
        trimmed = described if trims is None else correct.set_trim(described, trims, list(KEYS))
        log = good(found.pop("log_clean"))
        kept = {n: good(t) for n, t in found.items()}
        boxes = None if corrections is None else good(corrections)
        exported = export_corrected(kept, trimmed, log, boxes, min_bout_sec, bridge_nulls)
        tables.write_processed(exported, export_root, fmt, ids=described)
        return described.count()


def refresh_corrected(spark: SparkSession, out: str, root: str, boxes: DataFrame, min_bout_sec: float = bt.MIN_BOUT_SEC) -> int:
    """Take new correction boxes into the bouts and days under ``root``; returns how many deployments they touch.

    ``root`` holds bout_summary, day_summary and all corrections of deployments that were corrected before; others
    start from the processed tables under ``out``, whose readings are only read between the bouts that a box can
    change. One commit replaces the three tables of the touched deployments, see :func:`refresh.refresh`.
    """
    keys = list(KEYS)
    processed, corrected = versions.snapshot(spark, out), versions.snapshot(spark, root)
    names = T.StructType.fromDDL(schemas.CORRECTIONS).names
    with scratch(spark):
        boxes = cut(boxes.select(*names))
        touched = cut(boxes.select(*keys).distinct())
        done = corrected.ids("bout_summary")

        def now(name: str, ddl: str) -> DataFrame:
            first = processed.table(name, ddl).join(done, keys, "left_anti")
            return first.unionByName(corrected.table(name, ddl)).join(touched, keys, "left_semi")

        every = cut(corrected.table("corrections", schemas.CORRECTIONS).join(touched, keys, "left_semi").unionByName(boxes))
        deployments = processed.table("deployments", schemas.DEPLOYMENTS).join(touched, keys, "left_semi")
        readings = processed.table("tof_processed", schemas.TOF_PROCESSED).join(touched, keys, "left_semi")
        days = cut(now("day_summary", schemas.DAYS))
        # a day may get its first classified reading, next to those that have one
        near = days.select(*keys, "date").unionByName(boxes.select(*keys, F.explode(F.expr("sequence(to_date(t_min), to_date(t_max))")).alias("date")))
        sun = night.sun_table(near.distinct().select(*keys, F.col("date").cast("timestamp").alias("timestamp")), "timestamp", deployments, KEYS)
        fresh = refresh.refresh(readings, cut(now("bout_summary", schemas.BOUTS)), days, boxes, every, ORDER, cut(sun), min_bout_sec=min_bout_sec)
        bouts = _typed(_round_mean(fresh["bouts"]), schemas.BOUTS)
        results = {"bout_summary": bouts, "day_summary": _typed(fresh["days"], schemas.DAYS), "corrections": every}
        tables.write_tables(results, root, ids=touched)
        return touched.count()
