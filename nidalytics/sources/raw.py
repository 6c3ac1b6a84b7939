"""Reading raw deployment folders."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nidalytics.functions.scalars import blank_to_null, coalesce_blank, to_number
from nidalytics.operators import clean
from nidalytics.operators.night import parse_coords
from nidalytics.plans import stages
from nidalytics.plans.ordered import BLOCK, Ordering
from nidalytics.sources import files, schemas

FILE_ORDER = ("src_block", "src_row")
READING_ORDER = Ordering(("deployment_id",), "timestamp", FILE_ORDER)
Cut = Callable[[DataFrame], DataFrame]


def read_or_empty(spark: SparkSession, read: Callable[[], DataFrame], ddl: str) -> DataFrame:
    """What ``read`` gives, or no rows where there are no such files."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ddl)


#: A device file is a file or, when it is long, a folder of that name with numbered slices, each with the header.
SLICED = r"/[^/]+\.(?:CSV|csv)/(\d+)\.csv$"
SLICE_SPAN = 1 << 40


def _folder(path: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(path, SLICED, "/slices"), r"^(.*)/[^/]+$", 1)


def _slice(path: Column) -> Column:
    """Number of the slice, null for a file in one piece."""
    return F.nullif(F.regexp_extract(path, SLICED, 1), F.lit("")).cast("long")


def metadata_pairs(texts: DataFrame, keys: Sequence[str], text: str = "value") -> DataFrame:
    """Key/value rows of whole metadata texts, with the line number.

    Lines without "=" are dropped; the first "=" separates; both sides are trimmed.
    """
    return _split_lines(texts, keys, text).where(F.col("key").isNotNull())


def _split_lines(texts: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """(keys, pos, key, value) of every line; key and value are null where there is no "="."""
    lines = texts.select(*keys, F.posexplode(F.split(F.col(text), "\r\n|\n|\r")).alias("pos", "line"))
    parts, pair = F.split(F.col("line"), "=", 2), F.contains("line", F.lit("="))
    return lines.select(*keys, "pos", F.when(pair, F.trim(parts[0])).alias("key"), F.when(pair, F.trim(F.get(parts, F.lit(1)))).alias("value"))


def parse_metadata(
    texts: DataFrame, keys: Sequence[str], text: str = "value", names: Sequence[str] = schemas.METADATA_KEYS
) -> DataFrame:
    """One row per text with a column per known key; the first value of a key counts."""
    found = _split_lines(texts, keys, text)
    return found.groupBy(*keys).agg(*[F.min_by("value", F.when(F.col("key") == n, F.col("pos"))).alias(n) for n in names])


def read_metadata(spark: SparkSession, paths: str | list[str] | DataFrame) -> DataFrame:
    """One row per METADATA.TXT that is not empty; the folder name stands in for a missing deployment id."""
    texts = files.texts(files.named(spark, paths).where("size > 0")).select(_folder(F.col("path")).alias("folder"), "value")
    return name_deployments(parse_metadata(texts, ["folder"]))


def settle_ids(found: DataFrame) -> DataFrame:
    """Add ``replaced``: true for all but the last folder (by name) of a deployment id.

    Everything downstream joins on the id, so it must stand for one folder.
    """
    last = found.groupBy("deployment_id").agg(F.max("folder").alias("_last"))
    joined = found.join(last, "deployment_id")
    return joined.withColumn("replaced", F.col("folder") != F.col("_last")).drop("_last")


def replaced_folders(settled: DataFrame) -> DataFrame:
    """Quarantine rows for folders whose id a later folder has."""
    return quarantined(settled.where("replaced"), "deployment_id is that of a later folder")


def quarantined(folders: DataFrame, reason: str) -> DataFrame:
    return folders.select(
        F.col("folder").alias("source_file"), F.lit(reason).alias("reason"), F.lit(None).cast("string").alias("raw")
    )


def name_deployments(metadata: DataFrame) -> DataFrame:
    name = F.element_at(F.split(F.col("folder"), "/"), -1)
    return metadata.withColumn("deployment_id", coalesce_blank(F.col("deployment_id"), F.url_decode(name)))


def deployment_table(metadata: DataFrame, year_overrides: DataFrame | None = None) -> DataFrame:
    """Typed deployment dimension with recording year, coordinates and trim window."""
    d = clean.resolve_year(metadata, year_overrides, allowed=(2020, 2100))
    d = clean.deployment_window(parse_coords(d), "recording_year")
    text = ("device_id", "nestbox", "species", "notes")
    d = d.withColumns(
        {
            **{c: blank_to_null(F.col(c)) for c in text},
            "eggs": F.trim("eggs").try_cast("int"),
            "utc_offset_min": F.trim("utc_offset_min").try_cast("int"),
        }
    )
    return d.select(*T.StructType.fromDDL(schemas.DEPLOYMENTS).names)


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Folders under the root with the required files that they hold."""
    return folder_files(files.files_below(files.folders(spark, root))).distinct()


def folder_files(found: DataFrame) -> DataFrame:
    """(folder, name) of device files by ``path``; a slice counts as the file that it is part of."""
    whole = F.regexp_replace("path", r"/\d+\.csv$", "")
    path = F.when(F.col("path").rlike(SLICED), whole).otherwise(F.col("path"))
    return found.select(_folder(F.col("path")).alias("folder"), F.element_at(F.split(path, "/"), -1).alias("name"))


def _missing(listing: DataFrame, required: Sequence[str]) -> DataFrame:
    """(folder, missing): the required files that each folder lacks."""
    wanted = F.array(*[F.lit(f) for f in required])
    held = F.collect_set(F.when(F.col("name").isin(*required), F.col("name")))
    return listing.groupBy("folder").agg(F.array_sort(F.array_except(wanted, held)).alias("missing"))


def files_of(folders: DataFrame, name: str) -> DataFrame:
    """(path): the file of that name in each folder."""
    return folders.select(F.concat(F.col("folder"), F.lit(f"/{name}")).alias("path"))


def require_files(listing: DataFrame, required: Sequence[str] = schemas.REQUIRED_FILES) -> DataFrame:
    """Folders that lack a required file, with the missing names."""
    return _missing(listing, required).where(F.size("missing") > 0)


def missing_files(incomplete: DataFrame) -> DataFrame:
    """Quarantine rows for incomplete folders."""
    return incomplete.select(
        F.col("folder").alias("source_file"),
        F.concat(F.lit("missing "), F.array_join("missing", ", ")).alias("reason"),
        F.lit(None).cast("string").alias("raw"),
    )


def complete_deployments(metadata: DataFrame, listing: DataFrame) -> DataFrame:
    """Deployments whose folder holds all required files."""
    complete = _missing(listing, schemas.REQUIRED_FILES).where(F.size("missing") == 0)
    return metadata.join(complete, "folder", "left_semi")


def discover_deployments(spark: SparkSession, root: str) -> DataFrame:
    """One row per direct subfolder that has all required files."""
    metadata = read_metadata(spark, f"{root.rstrip('/')}/*/{schemas.METADATA_FILE}")
    return complete_deployments(metadata, list_files(spark, root))


def read_lines(spark: SparkSession, paths: str | list[str] | DataFrame, cut: Cut = stages.cut) -> DataFrame:
    """The lines of device files with folder and place in the file, read once and kept in a stage table.

    A file may be read in several ranges, or consist of slices; (src_block, src_row) is
    file order. The ranges serve as blocks, and a file read in one piece is one block.
    """
    lines = files.lines(files.named(spark, paths, must=True))
    number = _slice(F.col("path"))
    start = F.coalesce(number, F.lit(0)) * SLICE_SPAN + F.col("start")
    return cut(
        lines.where(F.trim("value") != "").select(
            _folder(F.col("path")).alias("folder"),
            start.alias("src_block"),
            F.when(number.isNotNull() | ~F.col("whole"), start).alias(BLOCK),
            F.col("row").alias("src_row"),
            "value",
        )
    )


def headers(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """(folder, names): the column names of each file whose header line has all the required ones.

    The header is the first line that names the time column; quotes and blanks around names are dropped.
    """
    titles = lines.where(F.contains("value", F.lit("timestamp")))
    first = titles.groupBy("folder").agg(F.min_by("value", F.struct("src_block", "src_row")).alias("line"))
    names = F.transform(F.split("line", ","), lambda n: F.trim(F.translate(n, '"\ufeff\r', "")))
    wanted = F.array(*[F.lit(c) for c in schema.names])
    return first.select("folder", names.alias("names")).where(F.size(F.array_except(wanted, "names")) == 0)


def scan(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """CSV rows as trimmed text, with folder and place in the file, from :func:`read_lines`.

    Columns are found by the names in each file's header, whatever their order and
    whatever and however many others there are; files without such a header give no rows (see
    :func:`bad_headers`). A value in quotes may hold commas, but no line break.
    """
    found = headers(lines, schema)
    width = found.agg(F.max(F.size("names"))).first()[0] or 1
    wide = ", ".join(f"c{i} string" for i in range(width))
    named = lines.join(found, "folder")
    cells = F.array(*[F.col(f"_row.c{i}") for i in range(width)])
    named = named.withColumn("_row", F.from_csv("value", wide, {"nullValue": "NA"})).withColumn("_cells", cells)
    values = {
        c: blank_to_null(F.get("_cells", F.array_position("names", F.lit(c)).cast("int") - 1)) for c in schema.names
    }
    data = named.select("folder", "src_block", BLOCK, "src_row", *[c.alias(n) for n, c in values.items()])
    return data.where(~F.col("timestamp").eqNullSafe(F.lit("timestamp")))


def bad_headers(deployments: DataFrame, found: DataFrame, file_name: str) -> DataFrame:
    """(folder, source_file, reason, raw) for folders whose file has no usable header."""
    return deployments.select("folder").join(found, "folder", "left_anti").select(
        "folder",
        F.concat_ws("/", "folder", F.lit(file_name)).alias("source_file"),
        F.lit("unexpected header").alias("reason"),
        F.lit(None).cast("string").alias("raw"),
    )


def stamp(raw: DataFrame, deployments: DataFrame, o: Ordering | None = None) -> DataFrame:
    """Give raw rows their deployment and a full timestamp.

    ``raw`` has ``folder``, text ``timestamp`` and file order; see :func:`scan`
    for its blocks. Rows of folders without a recording year are left out.
    """
    o = o or Ordering(("folder",), "src_row")
    dated = deployments.where(F.col("recording_year").isNotNull()).select(
        "folder", "deployment_id", "recording_year", "utc_offset_min"
    )
    rows = raw.withColumnRenamed("timestamp", "stamp_text").join(dated, "folder")
    rows = clean.attach_year(rows, o, "stamp_text", F.col("recording_year")).drop(BLOCK)
    shift = F.make_dt_interval(mins=F.coalesce("utc_offset_min", F.lit(0)))
    return rows.withColumn("timestamp", F.col("timestamp") - shift).drop("recording_year", "utc_offset_min")


def bad_rows(stamped: DataFrame, file_name: str) -> DataFrame:
    """Quarantine rows whose time cannot be read."""
    return stamped.where(F.col("timestamp").isNull()).select(
        F.concat_ws("/", "folder", F.lit(file_name)).alias("source_file"),
        F.lit("unparseable timestamp").alias("reason"),
        F.col("stamp_text").alias("raw"),
    )


def _good(stamped: DataFrame) -> DataFrame:
    return stamped.where(F.col("timestamp").isNotNull()).drop("folder", "stamp_text")


def _ordered_names(df: DataFrame, ddl: str) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType) for f in T.StructType.fromDDL(ddl)])


def clean_log(stamped: DataFrame) -> DataFrame:
    return _ordered_names(_good(stamped), schemas.LOG_CLEAN)


def clean_dht(stamped: DataFrame, log: DataFrame) -> DataFrame:
    """Numeric climate channels (1 inside, 2 outside), sessions, gaps, flags and differences."""
    channels = {"temp1": "temp_in", "hum1": "hum_in", "temp2": "temp_out", "hum2": "hum_out"}
    rows = _good(stamped)
    rows = rows.withColumns({new: to_number(F.col(old)) for old, new in channels.items()}).drop(*channels)
    rows = clean.session_columns(rows, clean.boot_times(log), READING_ORDER)
    rows = clean.flag_any_missing(rows, list(channels.values()))
    rows = clean.channel_diff(rows, "temp_in", "temp_out", "temp_diff")
    rows = clean.channel_diff(rows, "hum_in", "hum_out", "hum_diff")
    return _ordered_names(rows, schemas.DHT_CLEAN)


def clean_tof(stamped: DataFrame, log: DataFrame, warmup_rows: int = clean.WARMUP_ROWS) -> DataFrame:
    """Numeric distances with sentinels nulled, sessions, gaps and warm-up flags."""
    rows = _good(stamped).withColumns(
        {"tof_raw_mm": to_number(F.col("tof_raw")), "tof_smooth_ema": to_number(F.col("tof_smooth"))}
    )
    rows = clean.flag_invalid(rows.drop("tof_raw", "tof_smooth"), "tof_raw_mm", ["tof_smooth_ema"])
    rows = clean.session_columns(rows, clean.boot_times(log), READING_ORDER)
    rows = clean.flag_warmup(rows, READING_ORDER, n=warmup_rows)
    return _ordered_names(rows, schemas.TOF_CLEAN)


def write_files(contents: DataFrame, root: str) -> None:
    """Write texts (folder, name, content) as files below ``root``, one folder per deployment.

    A name may hold a slice, as in ``TOF.CSV/3.csv``. The tasks write through Arrow's file systems, a
    text at a time; a file written again is the same file.
    """
    top = files.address(contents.sparkSession, root).rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = files.Stores().find(top)
        last = None
        for batch in batches:
            for folder, name, content in zip(*batch.columns, strict=True):
                path = f"{base}/{folder}/{name}"
                if (parent := path.rsplit("/", 1)[0]) != last:
                    store.create_dir(parent, recursive=True)
                    last = parent
                with store.open_output_stream(path, compression=None) as file:
                    file.write(content.as_buffer())
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    contents.select("folder", "name", "content").mapInArrow(run, "n long").agg(F.sum("n")).collect()


def read_log(spark: SparkSession, paths, deployments: DataFrame) -> DataFrame:
    return clean_log(stamp(scan(read_lines(spark, paths), schemas.LOG_RAW), deployments))


def read_dht(spark: SparkSession, paths, deployments: DataFrame, log: DataFrame, cut: Cut = lambda d: d) -> DataFrame:
    return clean_dht(cut(stamp(scan(read_lines(spark, paths), schemas.DHT_RAW), deployments)), log)


def read_tof(
    spark: SparkSession,
    paths,
    deployments: DataFrame,
    log: DataFrame,
    cut: Cut = lambda d: d,
    warmup_rows: int = clean.WARMUP_ROWS,
) -> DataFrame:
    return clean_tof(cut(stamp(scan(read_lines(spark, paths), schemas.TOF_RAW), deployments)), log, warmup_rows)
