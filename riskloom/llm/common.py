"""Shared pieces of the text operators: shared folder, written tables, words as byte spans, components."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bytes that end a word in the two word rules of the contracts.
BLANKS = bytes([0x20, *range(0x09, 0x0E)])
NOT_WORD = bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])

TEXT_CHUNK = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    A session of one machine that names none (tests, local runs) gets a temporary folder; on a cluster that is an error,
    for executors don't see each other's folders.
    """
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="riskloom-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors.

    The shuffle files of the write go with its end, since nothing reads them after it.
    """
    spark = df.sparkSession
    path, before = new_path(spark, name), spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:  # so it is wherever the session was not given a value
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    _paths[id(table)] = (weakref.ref(table), path)
    if _scopes:
        _scopes[-1].append(table)
    return table


_paths: dict[int, tuple] = {}
_scopes: list[list[DataFrame]] = []


def discard(table: DataFrame) -> None:
    """Delete a table made by `written` that a later one has replaced."""
    known, name = _paths.pop(id(table), (None, None))
    if known is not None and known() is table:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch():
    """Tables written inside are deleted at the end, but for those that are appended to the list it gives."""
    kept: list[DataFrame] = []
    made: list[DataFrame] = []
    _scopes.append(made)
    try:
        yield kept
    finally:
        _scopes.remove(made)
        for table in made:
            if any(table is x for x in kept):
                if _scopes:
                    _scopes[-1].append(table)
            else:
                discard(table)


def bitmap(ids: DataFrame, column: str, most: int = 1 << 28) -> np.ndarray:
    """Bits, a power of two of them, set at the ids' remainders; at most `most`, however many ids there are."""
    count = ids.agg(F.approx_count_distinct(column)).first()[0]
    size = min(most, 1 << (16 * count + (1 << 18)).bit_length())
    place = F.pmod(F.col(column), F.lit(size)) + 1
    rows = ids.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    out = np.zeros(size // 8, np.uint8)
    for bucket, bits in rows.collect():  # of 4 kB each, `most` bits in all; fetching by partition would take a job for each
        out[(bucket - 1) * 4096 : bucket * 4096] = np.frombuffer(bits, np.uint8)
    return out


def in_bitmap(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which of the (signed) ids have their bit set."""
    place = ids % (8 * len(bits))
    return (bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)


def set_aside(df: DataFrame, *used: str):
    """df with all columns but the used ones under names of our own, and a function that gives a result their names back."""
    names = df.columns
    own = [c if c in used else f"__column_{i}" for i, c in enumerate(names)]
    return df.toDF(*own), lambda out: out.select(*own).toDF(*names)


def text_of(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def bucket_of_id(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def text_chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = TEXT_CHUNK):
    """Slices of the batches of about `limit` text bytes (one whole row at least), with the rows' texts as bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        marks = np.cumsum(lengths + 1) // limit
        cuts = [0, *(np.flatnonzero(np.diff(marks)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = batch.slice(a, b - a)
            yield part, [(x or "").encode() for x in part.column(column).to_pylist()]


class Words:
    """The words of some texts as spans of one lower-cased buffer.

    start, end: byte span of each word; doc: its text's place; counts: words per text;
    hash(): 64-bit hashes of the words, the same in every task.
    """

    _base, _inverse = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
    _powers = np.ones(1, np.uint64)
    _inverses = np.ones(1, np.uint64)
    _codes = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 63, 256, dtype=np.uint64)

    def __init__(self, texts: list[bytes], not_word: bytes):
        joined = b" ".join(texts).lower()
        self.joined = joined
        self.bytes = np.frombuffer(joined, np.uint8)
        table = np.ones(256, bool)
        table[np.frombuffer(not_word, np.uint8)] = False
        inside = np.zeros(len(joined) + 2, np.int8)
        inside[1:-1] = table[self.bytes]
        steps = np.diff(inside)
        self.start, self.end = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
        ends = np.cumsum(np.fromiter((len(x) + 1 for x in texts), np.int64, len(texts)))
        self.doc = np.searchsorted(ends, self.start, side="right")
        self.counts = np.bincount(self.doc, minlength=len(texts))

    def hash(self) -> np.ndarray:
        """Computed a block of words at a time, so that scratch memory is bounded by a block and the longest word."""
        out = np.empty(len(self.start), np.uint64)
        cuts = np.searchsorted(self.start, np.arange(0, len(self.bytes) + TEXT_CHUNK, TEXT_CHUNK))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if a < b:
                out[a:b] = self._hash(a, b)
        return out

    def _hash(self, a: int, b: int) -> np.ndarray:
        first = self.start[a]
        start, end = self.start[a:b] - first, self.end[a:b] - first
        n = int(end[-1]) + 1
        if len(Words._powers) < n:
            for name, value in (("_powers", self._base), ("_inverses", self._inverse)):
                grown = np.full(n, value, np.uint64)
                grown[0] = 1
                setattr(Words, name, np.cumprod(grown, dtype=np.uint64))
        sums = np.zeros(n, np.uint64)
        np.cumsum(self._codes[self.bytes[first : first + n - 1]] * Words._powers[: n - 1], out=sums[1:])
        h = (sums[end] - sums[start]) * Words._inverses[start]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def stars(edges: DataFrame, most: int = 1 << 17) -> DataFrame:
    """(a, b) edges of long ids that connect what these do, fewer and shallower: a task joins `most` of them at a time.

    So many are read by one task if there are so few; more go to more tasks, and what is left is for connected_components.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}

        def top(x: int) -> int:
            root.setdefault(x, x)
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        def out() -> pa.RecordBatch:
            found = [(x, top(x)) for x in root if top(x) != x]
            root.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

        held = 0
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                low, high = sorted((top(a), top(b)))
                root[high] = low
            held += batch.num_rows
            if held >= most:
                held = 0
                yield out()
        yield out()

    return edges.select("a", "b").coalesce(1 + edges.count() // most).mapInArrow(run, "a long, b long")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node in edges; component is the component's smallest node.

    Large-star and small-star steps (Kiveris et al. 2014): each is a grouped minimum and a join on the
    same key, written to the shared folder; a hub's many rows are split by adaptive skew joins. The loop
    ends when a round leaves the edges as they were, which a count and a hash tell. Self-links and nulls
    are dropped, so nodes without other links are not in the result.
    """
    x, y = F.col(a), F.col(b)
    e = edges.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).where("u <> v").distinct()
    e = written(e, "links")
    mark = None
    while True:
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == mark or now[0] == 0:
            break
        mark = now
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        small = small.union(least).where("u <> v").distinct()
        before, e = e, written(small, "links")
        discard(before)
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
