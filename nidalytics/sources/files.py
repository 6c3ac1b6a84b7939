"""Listing and reading many small files by tasks, without a row per file on the driver.

Files are named by their addresses, as Spark's ``_metadata.file_path`` has them. The tasks list and read
through Arrow's file systems; of a pattern ``root/*/name`` one task lists the root, all others its folders.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PATTERN = re.compile(r"^([^*?\[\]{}]+)/\*/([^*?\[\]{}/]+)$")
GLOB = re.compile(r"[*?\[\]{}]")
#: Characters that an address holds as they are.
ESCAPED = re.compile(r"[^A-Za-z0-9_\-!.~'()*,;:$&+=@/\u0080-\U0010ffff]")
SPLIT_BYTES = 32 * 2**20
BATCH_LINES = 50_000
NAMES = 10_000
#: Arrow's names of stores that Hadoop calls otherwise.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def quoted(path: str) -> str:
    return ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", path)


def hidden(name: str) -> bool:
    """Names that Spark's readers pass over too."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def address(spark: SparkSession, path: str) -> str:
    """The address of a path as given to Spark's readers; one that has a scheme is an address already."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return _address(store.makeQualified(place).toUri(), path if re.match(r"^\w[\w+.\-]*:", path) else None)


def _address(uri, known: str | None = None) -> str:
    base = f"{uri.getScheme()}:" + (f"//{uri.getAuthority()}" if uri.getAuthority() else "")
    if known is not None and "%" in known:  # escaped before
        return base + quoted(unquote(uri.getPath()))
    return base + quoted(uri.getPath())


def addressed(folder_table: DataFrame) -> DataFrame:
    """(folder): the addresses of folders that are named by plain paths, as Spark's binary file source has them."""
    default = address(folder_table.sparkSession, "/").rstrip("/")

    def made(name: str) -> str:
        scheme = re.match(r"^(\w[\w+.\-]*:(?://[^/]*)?)(.*)$", name, re.S)
        base, path = scheme.groups() if scheme else (default, name)
        return ("file:" if base == "file://" else base) + quoted(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(map(made, batch.column(0).to_pylist()), pa.string())], ["folder"])

    return folder_table.select("folder").mapInArrow(run, "folder string")


class Stores:
    """Opens addresses; a store is set up once per task."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[pafs.FileSystem, str]] = {}

    def find(self, uri: str) -> tuple[pafs.FileSystem, str]:
        scheme, rest = uri.split(":", 1)
        authority = ""
        if rest.startswith("//"):
            authority, _, rest = rest[2:].partition("/")
            rest = f"/{rest}"
        base = f"{SCHEMES.get(scheme, scheme)}://{authority}"
        if base not in self.known:
            store, place = pafs.FileSystem.from_uri(f"{base}/")
            self.known[base] = store, place.rstrip("/")
        store, place = self.known[base]
        return store, place + unquote(rest)


def _spread(df: DataFrame, *by: str) -> DataFrame:
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *by)


def folders(spark: SparkSession, root: str) -> DataFrame:
    """(folder): the addresses of what lies directly under the root."""
    top = address(spark, root).rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            store, place = Stores().find(top)
            found = store.get_file_info(pafs.FileSelector(place, allow_not_found=True))
            names = [f"{top}/{quoted(f.base_name)}" for f in found if f.type == pafs.FileType.Directory]
            for i in range(0, len(names), NAMES):
                yield pa.RecordBatch.from_pydict({"folder": names[i : i + NAMES]}, pa.schema([("folder", pa.string())]))

    return _spread(spark.range(1, numPartitions=1).mapInArrow(run, "folder string"), "folder")


def _mapped(df: DataFrame, column: str, work: Callable[[Stores, str], list[tuple[str, int]]]) -> DataFrame:
    """(path, size) of the files that ``work`` finds at each address."""
    schema = pa.schema([("path", pa.string()), ("size", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stores = Stores()
        for batch in batches:
            found = [f for uri in batch.column(0).to_pylist() for f in work(stores, uri)]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate(schema.types)], schema=schema)

    return df.select(column).mapInArrow(run, "path string, size long")


def _below(stores: Stores, uri: str, deep: int) -> list[tuple[str, int]]:
    """The files under a folder; names of folders count as hidden from ``deep`` levels below it on."""
    store, place = stores.find(uri)
    found = []
    for f in store.get_file_info(pafs.FileSelector(place, allow_not_found=True, recursive=True)):
        if f.type == pafs.FileType.File:
            inner = f.path[len(place) :].strip("/")
            *above, name = inner.split("/")
            if not hidden(name) and not any(map(hidden, above[deep:])):
                found.append((f"{uri}/{quoted(inner)}", f.size))
    return found


def files_below(folder_table: DataFrame) -> DataFrame:
    """(path, size) of all files in the folders."""
    return _mapped(folder_table, "folder", lambda stores, uri: _below(stores, uri, 1))


def named(spark: SparkSession, paths: str | list[str] | DataFrame, must: bool = False) -> DataFrame:
    """(path, size) of files by a pattern, a list, or a table of addresses (``path``); a folder stands for the files in it.

    What is not there is left out, or fails where it ``must`` be there.
    """
    if isinstance(paths, DataFrame):
        wanted = paths.select("path")
    elif isinstance(paths, str) and (split := PATTERN.match(paths)):
        wanted, must = folders(spark, split[1]).select(F.concat(F.col("folder"), F.lit(f"/{quoted(split[2])}")).alias("path")), False
    else:
        each = [paths] if isinstance(paths, str) else list(paths)
        listed = [p for path in each for p in (_globbed(spark, path) if GLOB.search(path) else [address(spark, path)])]
        wanted = spark.createDataFrame([(p,) for p in listed], "path string")

    def work(stores: Stores, uri: str) -> list[tuple[str, int]]:
        store, place = stores.find(uri)
        info = store.get_file_info(place)
        if info.type == pafs.FileType.Directory:
            return _below(stores, uri, 0)
        if info.type == pafs.FileType.File:
            return [(uri, info.size)]
        if must:
            raise FileNotFoundError(uri)
        return []

    return _mapped(_spread(wanted, "path"), "path", work)


def _globbed(spark: SparkSession, path: str) -> list[str]:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(place)
    return [_address(f.getPath().toUri()) for f in found or []]


def texts(files: DataFrame) -> DataFrame:
    """(path, value): each file whole."""
    schema = pa.schema([("path", pa.string()), ("value", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stores = Stores()
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                paths, values = batch.column(0).slice(i, 1000), []
                for uri in paths.to_pylist():
                    store, place = stores.find(uri)
                    with store.open_input_file(place) as file:
                        values.append(file.read())
                yield pa.RecordBatch.from_arrays([paths, pa.array(values, pa.binary())], schema=schema)

    return files.select("path").mapInArrow(run, "path string, value binary").withColumn("value", F.col("value").cast("string"))


def lines_of(file, start: int, end: int, size: int) -> list[bytes]:
    """The lines that begin in a range of a file, without their ends (\\n, \\r or \\r\\n)."""
    file.seek(max(start - 1, 0))
    data = file.read(end - max(start - 1, 0))
    if start:  # a line that began before belongs to the range before
        at = re.search(rb"[\r\n]", data)
        if not at:
            return []
        data = data[at.end() :]
    if data and not data.endswith((b"\n", b"\r")):
        more = []
        while end < size:
            piece = file.read(min(2**20, size - end))
            if not piece:
                break
            end += len(piece)
            at = re.search(rb"[\r\n]", piece)
            more.append(piece[: at.start()] if at else piece)
            if at:
                break
        data = b"".join([data, *more])
    return (data if start else data.removeprefix(b"\xef\xbb\xbf")).splitlines()


def lines(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(path, start, whole, row, value): the lines of files, long ones read in ranges by several tasks.

    ``start`` is where the range begins, ``whole`` that the file is one range, and ``row`` counts the lines of the range.
    """
    starts: Column = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))
    ranges = _spread(files.select("path", "size", F.explode(starts).alias("start")), "path", "start")
    schema = pa.schema([("path", pa.string()), ("start", pa.int64()), ("whole", pa.bool_()), ("row", pa.int64()), ("value", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stores = Stores()
        held: list[tuple[str, int, bool, int]] = []
        values: list[bytes] = []

        def flush() -> Iterator[pa.RecordBatch]:
            counts = np.array([h[3] for h in held])
            which = pa.array(np.repeat(np.arange(len(held)), counts))
            rows = np.arange(len(values)) - np.repeat(np.cumsum(counts) - counts, counts)
            columns = [pa.array([h[i] for h in held], schema.types[i]).take(which) for i in range(3)]
            made = pa.RecordBatch.from_arrays([*columns, pa.array(rows, pa.int64()), pa.array(values, pa.binary())], schema=schema)
            held.clear()
            values.clear()
            yield from (made.slice(i, BATCH_LINES) for i in range(0, made.num_rows, BATCH_LINES))

        for batch in batches:
            for uri, size, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, place = stores.find(uri)
                with store.open_input_file(place) as file:
                    found = lines_of(file, start, min(start + split_bytes, size), size)
                held.append((uri, start, size <= split_bytes, len(found)))
                values.extend(found)
                if len(values) >= BATCH_LINES:
                    yield from flush()
        if values:
            yield from flush()

    read = ranges.select("path", "size", "start").mapInArrow(run, "path string, start long, whole boolean, row long, value binary")
    return read.withColumn("value", F.col("value").cast("string"))
