"""SimHash near-duplicates: fingerprints, bit-sliced comparison within buckets, components.

Fingerprints that agree on the bits of one of several tables share a bucket. Within a bucket all
fingerprints are compared at once: bit planes are stored vertically, 64 fingerprints to a word, and
vertical counters take up two planes at a time. Words whose fingerprints have all passed the radius
are abandoned. A bucket gives the links of a spanning forest, never all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nidalytics.llm.bpe import by_text
from nidalytics.llm.common import join_by_size, whole
from nidalytics.llm.repeats import drop_listed, row_key
from nidalytics.plans.stages import cut

SEED = 42
#: Larger buckets are split; every pair of parts is compared in a task of its own.
BUCKET_ROWS = 4096
#: One fingerprint in so many tells which buckets are large; only the size of their parts depends on it.
SAMPLED = 8
#: The table of large buckets is broadcast if it has no more rows than this.
BROADCAST_ROWS = 100_000
JOBS = 8192  # (fingerprint, word) comparisons that run together
LINKS = 2**20  # that a task contracts together
CHECK = 8  # planes between two looks for words to abandon


# --- fingerprints ---


def shingle_hashes(text: str, k: int) -> np.ndarray:
    """XXH64 of each shingle of k words, repeats included; fewer words: of all of them; none: empty."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    ends = ends.tolist()[min(k, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=False)], dtype=np.uint64)


def widened(hashes: np.ndarray, j: int) -> np.ndarray:
    """Further 64 bits from each hash (the splitmix64 finaliser); the first 64 are the hash itself."""
    if j == 0:
        return hashes
    z = hashes + np.uint64((j * 0x9E3779B97F4A7C15) % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprint(hashes: np.ndarray, bits: int = 64) -> bytes:
    """A bit is 1 if it is set in over half the hashes. Words of 64 bits, each with its largest bit first."""
    out = []
    for j in range(bits // 64):
        count = np.zeros(64, dtype=np.int64)
        for at in range(0, len(hashes), 4096):
            part = widened(hashes[at : at + 4096], j).astype(">u8")
            count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out.append(np.packbits(2 * count > len(hashes)).tobytes())
    return b"".join(out)


def fingerprints(
    docs: DataFrame, id_column: str, text_column: str, shingle: int, bits: int = 64, distinct: bool = False
) -> DataFrame:
    """id, fp (binary) of whole texts; null counts as empty and has fingerprint zero.

    With ``distinct`` repeated shingles count once, so that the distance tells the similarity of sets.
    """

    def make():
        once = np.unique if distinct else np.asarray
        return lambda text: (fingerprint(once(shingle_hashes(text, shingle)), bits),)

    rows = docs.select(F.col(id_column).alias("id"), whole(text_column).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(by_text(make, pa.schema([("fp", pa.binary())]), "text"), f"id {kind}, fp binary")


# --- bit-sliced comparison ---


class Planes:
    """Fingerprints in vertical form: plane b has bit b of 64 fingerprints in each word."""

    def __init__(self, fps: np.ndarray):
        """``fps``: one row of bytes per fingerprint."""
        self.bits = np.unpackbits(fps, axis=1)
        n = len(fps)
        padded = np.zeros((-(-n // 64) * 64, self.bits.shape[1]), dtype=np.uint8)
        padded[:n] = self.bits
        self.planes = np.packbits(padded.T.copy(), axis=1, bitorder="little").view("<u8")

    def within(self, query: np.ndarray, word: np.ndarray, lanes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, row) at most ``radius`` apart, for jobs of a query against the given lanes of a word."""
        depth = max(1, int(radius).bit_length())
        counter = [np.zeros(len(query), dtype=np.uint64) for _ in range(depth)]
        over = np.zeros(len(query), dtype=np.uint64)
        total = len(self.planes)
        for b in range(0, total, 2):
            x, y = self._differ(b, query, word), self._differ(b + 1, query, word) if b + 1 < total else 0
            # full adder: two planes and the lowest counter bit give its new value and a carry
            s = counter[0] ^ x
            carry = (counter[0] & x) | (s & y)
            counter[0] = s ^ y
            for k in range(1, depth):
                counter[k], carry = counter[k] ^ carry, counter[k] & carry
            over |= carry
            if (b + 2) % CHECK == 0 or b + 2 >= total:
                lanes = lanes & ~(over | _above(counter, radius))
                live = lanes != 0
                if not live.all():  # abandon words without a fingerprint in reach
                    query, word, lanes, over = query[live], word[live], lanes[live], over[live]
                    counter = [c[live] for c in counter]
                if not len(query):
                    break
        found = np.unpackbits(lanes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        job, lane = np.nonzero(found)
        return query[job], word[job] * 64 + lane

    def _differ(self, b: int, query: np.ndarray, word: np.ndarray) -> np.ndarray:
        return self.planes[b][word] ^ (np.uint64(0) - self.bits[query, b].astype(np.uint64))


def _above(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose vertical counter is above the radius."""
    above, equal = np.zeros_like(counter[0]), ~np.zeros_like(counter[0])
    for k in reversed(range(len(counter))):
        if radius >> k & 1:
            equal &= counter[k]
        else:
            above |= equal & counter[k]
            equal &= ~counter[k]
    return above


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of a and b; a label is the smallest row of its set."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label[:] = jumped


def near_pairs(fps: np.ndarray, unit: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For rows sorted by unit: all pairs of a unit at most ``radius`` apart, some at a time."""
    n = len(fps)
    if n < 2:
        return
    planes = Planes(fps)
    starts = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
    end = np.repeat(np.concatenate((starts[1:], [n])), np.diff(np.concatenate((starts, [n]))))
    row = np.arange(n)
    query = row[row + 1 < end]
    first, last = (query + 1) // 64, (end[query] - 1) // 64
    upto = np.cumsum(last - first + 1)
    at = 0
    while at < len(query):
        done = upto[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(upto, done + JOBS, side="right")))
        words = (last - first + 1)[at:to]
        q = np.repeat(query[at:to], words)
        word = np.repeat(first[at:to], words) + np.arange(len(q)) - np.repeat(np.cumsum(words) - words, words)
        low = np.maximum(q + 1 - word * 64, 0).astype(np.uint64)
        high = np.minimum(end[q] - word * 64, 64).astype(np.uint64)
        lanes = (~np.uint64(0) >> (np.uint64(64) - high)) & (~np.uint64(0) << low)
        yield planes.within(q, word, lanes, radius)
        at = to


def forest(fps: np.ndarray, unit: np.ndarray, radius: int) -> np.ndarray:
    """For rows sorted by unit: the smallest row of its unit that each row is linked to, by way of others."""
    label = np.arange(len(fps))
    for a, b in near_pairs(fps, unit, radius):
        unite(label, a, b)
    return label


# --- buckets ---


def blocks(bits: int, radius: int) -> list[np.ndarray]:
    """Tables that lose no link: of radius + 1 blocks of bits, one is equal in fingerprints within the radius."""
    return np.array_split(np.arange(bits), radius + 1)


def buckets(distinct: DataFrame, tables: Sequence[np.ndarray]) -> DataFrame:
    """(bucket, fp) for every table and fingerprint."""
    width = max(len(t) for t in tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        power = (1 << np.arange(width, dtype=np.int64))[::-1]
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                fp = batch.column("fp").slice(at, 4096)
                bits = np.unpackbits(np.array([np.frombuffer(x.as_py(), np.uint8) for x in fp]), axis=1).astype(np.int64)
                for t, table in enumerate(tables):
                    value = (t << width) + bits[:, table] @ power[-len(table) :]
                    yield pa.RecordBatch.from_arrays([pa.array(value), fp], ["bucket", "fp"])

    return distinct.select("fp").mapInArrow(run, "bucket long, fp binary")


def linked(distinct: DataFrame, tables: Sequence[np.ndarray], radius: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links (a, b) between distinct fingerprints that share a bucket and are within the radius, as forests.

    A bucket of more than about ``bucket_rows`` is dealt into parts by hash, and each pair of parts is
    compared on its own, so that no task holds more than two parts. Links of a part are found wherever
    it takes part.
    """
    members = buckets(distinct, tables)
    some = buckets(distinct.select("fp").filter(F.pmod(F.xxhash64("fp"), F.lit(SAMPLED)) == 0), tables)
    size = SAMPLED * F.count(F.lit(1))
    large = some.groupBy("bucket").agg(F.ceil(size / bucket_rows).cast("int").alias("parts")).filter("parts > 1")
    large = cut(large)
    found = large.count()
    if not found:
        units = members.withColumns({"i": F.lit(0), "j": F.lit(0)})
    else:
        part = F.pmod(F.xxhash64(F.lit(1), "fp"), F.col("parts")).cast("int")
        side = F.broadcast(large) if found <= BROADCAST_ROWS else large
        dealt = members.join(side, "bucket", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        dealt = dealt.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        units = dealt.select("bucket", "fp", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "i", "j"]
        held: pa.Table | None = None

        def compared(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            keys = np.stack([rows.column(n).to_numpy() for n in names], axis=1)
            unit = np.cumsum(np.concatenate(([False], (keys[1:] != keys[:-1]).any(axis=1))))
            raw = rows.column("fp").to_pylist()
            fps = np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1)
            label = forest(fps, unit, radius)
            rest = np.flatnonzero(label != np.arange(len(label)))
            ends = [pa.array([raw[i] for i in end.tolist()], pa.binary()) for end in (rest, label[rest])]
            yield pa.RecordBatch.from_arrays(ends, ["a", "b"])

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            if held.num_rows < 2:
                continue
            keys = np.stack([held.column(n).to_numpy() for n in names], axis=1)
            # the last unit may go on in the next batch
            first = int(np.flatnonzero((keys != keys[-1]).any(axis=1))[-1]) + 1 if (keys != keys[-1]).any() else 0
            if first:
                yield from compared(held.slice(0, first))
                held = held.slice(first)
        if held is not None and held.num_rows:
            yield from compared(held)

    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    units = units.select("bucket", "i", "j", "fp").repartition(n, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return units.mapInArrow(run, "a binary, b binary").distinct()


# --- components ---


def contracted(links: DataFrame) -> DataFrame:
    """Links (a, b) of the same components: what some links of a task connect is tied to its smallest node."""
    kind = links.schema["a"].dataType.simpleString()

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        ends = pa.chunked_array([*rows["a"].chunks, *rows["b"].chunks])
        nodes = ends.unique()
        nodes = nodes.take(pc.sort_indices(nodes))
        place = pc.index_in(ends, nodes).to_numpy()
        label = np.arange(len(nodes))
        unite(label, place[: len(rows)], place[len(rows) :])
        rest = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([nodes.take(pa.array(rest)), nodes.take(pa.array(label[rest]))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, LINKS):
                part = batch.slice(at, LINKS)
                if held and rows + part.num_rows > LINKS:
                    yield stars(held)
                    held, rows = [], 0
                held.append(part)
                rows += part.num_rows
        if held:
            yield stars(held)

    return links.select("a", "b").mapInArrow(run, f"a {kind}, b {kind}")


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of a link is connected to.

    Tasks contract some ``LINKS`` links each; if that is one task, its links are the result. Else two steps
    follow, and all three are repeated until the two change nothing: larger neighbours of a node are tied to
    the smallest one, then smaller neighbours are. Each step's links are written to the shared folder; minima
    are taken before the shuffle, and nodes with many links are looked up in a bounded broadcast.
    """
    edges = cut(links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def smallest(rows: DataFrame) -> DataFrame:
        least = rows.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        return join_by_size(rows, cut(least), ["u"], "n").select("u", "v", F.least("u", "m").alias("m"))

    def state(rows: DataFrame) -> tuple:
        row = rows.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return tuple(row)

    now = state(edges)
    while now[0]:
        tasks = -(-now[0] // LINKS)
        edges = cut(contracted(edges.coalesce(tasks)))
        if tasks == 1:
            break
        now = state(edges)
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        edges = cut(smallest(both).filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct())
        down = smallest(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
        tied = down.select(F.col("u").alias("a"), F.col("m").alias("b"))
        edges = cut(tied.unionByName(down.filter("v != m").select(F.col("v").alias("a"), F.col("m").alias("b"))).distinct())
        before, now = now, state(edges)
        if now == before:
            break
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
        roots.select("node", F.col("node").alias("label"))
    )


def classes(prints: DataFrame, key: str, tables: Sequence[np.ndarray], radius: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(fp, n, first): for each distinct fingerprint its rows and the smallest ``key`` of its component."""
    alike = distinct_prints(prints, key)
    return firsts(alike, linked(alike, tables, radius, bucket_rows))


def distinct_prints(prints: DataFrame, key: str) -> DataFrame:
    """(fp, least, n): each fingerprint with its smallest ``key`` and its rows; a written table."""
    return cut(prints.groupBy("fp").agg(F.min(key).alias("least"), F.count(F.lit(1)).alias("n")))


def firsts(alike: DataFrame, links: DataFrame) -> DataFrame:
    """(fp, n, first): the smallest ``least`` of the component that each fingerprint is linked to."""
    found = components(links)
    tied = cut(alike.join(found, alike["fp"] == found["node"]).select("fp", "n", "least", "label"))
    first = cut(tied.groupBy("label").agg(F.min("least").alias("first"), F.count(F.lit(1)).alias("members")))
    joined = join_by_size(tied, first, ["label"], "members").select("fp", F.col("first").alias("found"))
    return alike.join(joined, "fp", "left").select("fp", "n", F.coalesce("found", "least").alias("first"))


def near_groups(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    shingle: int = 3,
    radius: int = 3,
    bits: int = 64,
    tables: Sequence[np.ndarray] | None = None,
) -> DataFrame:
    """One row per input row: id, ``fingerprint`` (hex) and ``component_id``, the smallest id reachable.

    Without ``tables`` no link within the radius is lost. Texts without words have fingerprint zero and
    are linked like any other. A null id counts only where a component has no other. An empty table gives
    no rows.
    """
    prints = cut(fingerprints(docs, id_column, text_column, shingle, bits))
    table = cut(classes(prints, "id", tables or blocks(bits, radius), radius))
    out = join_by_size(prints, table, ["fp"], "n")
    return out.select(F.col("id").alias(id_column), F.lower(F.hex("fp")).alias("fingerprint"), F.col("first").alias("component_id"))


def drop_near_copies(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 3, radius: int = 3, bits: int = 64
) -> DataFrame:
    """The rows that stay, with all their columns: of each group the one with the smallest id.

    Groups are texts whose fingerprints are within the radius, by way of others, as in :func:`near_groups`; no
    link is lost. A null id is the smallest. Rows that repeat both id and text are one document and stay
    together. Texts without words are one group.
    """
    key = row_key(F.col(id_column), F.sha2(whole(text_column), 256)).alias("key")
    place = F.struct(F.col(id_column).alias("id"), key).alias("place")
    rows = docs.select(place, F.col(text_column).alias("text"))
    prints = cut(fingerprints(rows, "place", "text", shingle, bits).withColumnRenamed("id", "place"))
    table = cut(classes(prints, "place", blocks(bits, radius), radius))
    others = join_by_size(prints, table, ["fp"], "n").filter("place != first")
    gone = cut(others.select("place.key").distinct())
    keyed = docs.select(F.struct("*").alias("row"), key)
    return drop_listed(keyed, prints.select("place.key"), gone, "key").select("row.*")
