"""WARC archives: written with an index, read back by coalesced byte ranges.

Records are gzip members of their own, so that any one of them can be read by its offset and length.
Archives lie in a folder that all executors share, and are reached through Arrow's file systems. A
task that runs again writes an archive of another name; the index names the one that counts.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nidalytics.llm.common import whole
from nidalytics.llm.repeats import FILTER_BITS, group_repeats, may_repeat, repeat_filter
from nidalytics.plans.stages import cut, shared_folder

#: A new archive begins after so many bytes.
ARCHIVE_BYTES = 64 * 2**20
#: Ranges of an archive closer than this are read as one, up to so many bytes at once.
GAP_BYTES = 64 * 2**10
READ_BYTES = 8 * 2**20
#: Shorter payloads are never replaced by a reference.
LEAST_BYTES = 100
DATE = "2000-01-01T00:00:00Z"
VERSION = b"WARC/1.1\r\n"

INDEX = (
    "page_id long, url string, record_type string, refers_to long, payload_digest string, "
    "archive string, offset long, length long"
)


def located(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder's address, and the folder's path in it."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def one_line(value: str | None) -> str:
    """A header value: line breaks are percent-encoded, as in addresses."""
    return (value or "").replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def original(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def name_of(page_id: int | None) -> str:
    return "<urn:page:%s>" % ("" if page_id is None else page_id)


def id_of(name: str) -> int | None:
    number = name.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record; a revisit has the digest of its payload and the name of the record that holds it."""
    head = [
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {name_of(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {one_line(url)}")
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: {name_of(refers_to)}")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (b"" if revisit else payload)
    head.append(f"Content-Length: {len(block)}")
    return VERSION + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields, by lower-case name, and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    block = rest[: int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def packed(raw: bytes) -> bytes:
    made = zlib.compressobj(6, zlib.DEFLATED, 31)
    return made.compress(raw) + made.flush()


def pages_with_digest(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html") -> DataFrame:
    payload = whole(payload_column)
    return pages.select(
        F.col(id_column).cast("long").alias("page_id"),
        F.col(url_column).alias("url"),
        payload.alias("payload"),
        F.sha2(payload, 256).alias("digest"),
    )


def with_revisits(rows: DataFrame, least_bytes: int = LEAST_BYTES, bits: int = FILTER_BITS) -> DataFrame:
    """Add ``revisit`` and ``refers_to``: equal payloads are stored once, under their smallest page_id.

    Only pages whose payload may be repeated are shuffled.
    """
    long_enough = F.octet_length("payload") >= least_bytes
    found = repeat_filter(rows.filter(long_enough).select("digest"), "digest", bits)
    flagged = may_repeat(rows, "digest", found, "flag", bits).withColumn("flag", F.col("flag") & long_enough)
    grouped = group_repeats(flagged, "digest", "page_id", "flag", F.min)
    revisit = (F.col("size") > 1) & ~F.col("page_id").eqNullSafe(F.col("keep"))
    return grouped.select(
        "page_id", "url", "digest", revisit.alias("revisit"),
        F.when(revisit, F.col("keep")).alias("refers_to"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def write(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the rows of :func:`with_revisits` as archives below ``folder``; returns the index.

    The index is made by the tasks that write and is itself a written table: once it is there, the
    archives it names are whole. Archives of tasks that were lost are in no index.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = located(folder)
        store.create_dir(base, recursive=True)
        out, path, offset = None, "", 0
        try:
            for batch in batches:
                index: list[tuple] = []
                columns = [batch.column(n) for n in ("page_id", "url", "payload", "digest", "refers_to", "revisit")]
                for i in range(batch.num_rows):
                    page_id, url, payload, digest, refers_to, revisit = (c[i].as_py() for c in columns)
                    raw = packed(record(page_id, url, (payload or "").encode(), digest, refers_to, revisit))
                    if out is None or offset >= archive_bytes:
                        if out is not None:
                            out.close()
                        path, offset = f"{base}/{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(path, compression=None)
                    out.write(raw)
                    kind = "revisit" if revisit else "response"
                    index.append((page_id, url, kind, refers_to, digest, path.rpartition("/")[2], offset, len(raw)))
                    offset += len(raw)
                names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "archive", "offset", "length"]
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                values = list(zip(*index, strict=True)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names)
        finally:
            if out is not None:
                out.close()

    return cut(rows.mapInArrow(run, INDEX))


def ranges(found: list[tuple], gap: int = GAP_BYTES, most: int = READ_BYTES) -> Iterator[tuple[int, int, list[tuple]]]:
    """Join (offset, length, ...) rows of one archive, sorted by offset, into (start, end, rows) to read at once."""
    held: list[tuple] = []
    start = end = 0
    for row in found:
        if held and (row[0] - end > gap or row[0] + row[1] - start > most):
            yield start, end, held
            held = []
        if not held:
            start = row[0]
            end = start
        held.append(row)
        end = max(end, row[0] + row[1])
    if held:
        yield start, end, held


def read(
    selected: DataFrame, folder: str, payloads: bool = True, gap: int = GAP_BYTES, most: int = READ_BYTES
) -> DataFrame:
    """The records that rows of the index name, read by byte ranges.

    Rows are laid out by archive and stretch of it, and sorted by offset, so that neighbours are read
    together. What comes back is taken from the archive alone. Without ``payloads`` only their length
    and digest are returned.
    """
    schema = (
        "page_id long, url string, record_type string, refers_to long, payload_bytes long, "
        "payload_digest string, stated_digest string" + (", payload binary" if payloads else "")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = located(folder)
        names = [part.split()[0] for part in schema.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]

        def made(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds, strict=False)], names)

        for batch in batches:
            rows = list(zip(*(batch.column(n).to_pylist() for n in ("archive", "offset", "length")), strict=True))
            at = 0
            while at < len(rows):
                to = at
                while to < len(rows) and rows[to][0] == rows[at][0]:
                    to += 1
                with store.open_input_file(f"{base}/{rows[at][0]}") as archive:
                    for start, end, held in ranges([r[1:] for r in rows[at:to]], gap, most):
                        raw = archive.read_at(end - start, start)
                        out = []
                        for offset, length in held:
                            fields, payload = parse(zlib.decompress(raw[offset - start : offset - start + length], 31))
                            url, refers_to = fields.get("warc-target-uri"), fields.get("warc-refers-to")
                            values = (
                                id_of(fields["warc-record-id"]),
                                None if url is None else original(url),
                                fields["warc-type"],
                                None if refers_to is None else id_of(refers_to),
                                len(payload),
                                hashlib.sha256(payload).hexdigest(),
                                fields["warc-payload-digest"].removeprefix("sha256:"),
                            )
                            out.append((*values, payload) if payloads else values)
                        yield made(out)
                at = to

    n = int(selected.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stretch = F.expr(f"offset div {4 * most}")
    placed = selected.select("archive", "offset", "length").repartition(n, "archive", stretch)
    return placed.sortWithinPartitions("archive", "offset").mapInArrow(run, schema)


def resolved(records: DataFrame) -> DataFrame:
    """Records with the length and digest of the full payload; a revisit takes those of the record it names.

    The digest that a revisit states leads to the response, so the lookup shares its key with nothing
    but revisits; payloads that a thousandth of them name are looked up in a broadcast of at most a
    thousand rows.
    """
    responses = records.filter("record_type = 'response'")
    revisits = records.filter("record_type = 'revisit'").drop("payload_bytes", "payload_digest")
    named = cut(revisits.groupBy("stated_digest", "refers_to").agg(F.count(F.lit(1)).alias("n")))
    least = max(2, (named.agg(F.sum("n")).first()[0] or 0) // 1000)
    target = responses.select(F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest").distinct()
    # a name may be used by pages of other payloads too: the digest must agree
    sizes = cut(named.join(target.withColumn("stated_digest", F.col("payload_digest")), ["refers_to", "stated_digest"]))
    keys = ["refers_to", "stated_digest"]
    hot, rest = F.broadcast(sizes.filter(F.col("n") >= least)), sizes.filter(F.col("n") < least)
    columns = responses.columns
    in_hot = revisits.join(hot, keys)
    in_rest = revisits.join(hot.select(*keys), keys, "left_anti").join(rest, keys, "left")
    return responses.unionByName(in_hot.select(*columns)).unionByName(in_rest.select(*columns))


def round_trip(
    pages: DataFrame,
    id_column: str = "page_id",
    url_column: str = "url",
    payload_column: str = "html",
    least_bytes: int = LEAST_BYTES,
    bits: int = FILTER_BITS,
) -> DataFrame:
    """Write all pages, read all archives back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A null payload counts as empty. Rows that share both the payload and its smallest page_id are all
    responses; a null page_id is never the smallest unless all are null, then all are responses. An
    empty table gives no rows.
    """
    folder = f"{shared_folder(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    index = write(with_revisits(pages_with_digest(pages, id_column, url_column, payload_column), least_bytes, bits), folder)
    records = cut(read(index, folder, payloads=False))
    out = resolved(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return out.withColumnRenamed("page_id", id_column)
