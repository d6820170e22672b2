"""Conversation prefix trie: every distinct sequence of first turns is a node, screened by a count-min sketch of digests.

1. Tasks turn a turn into a digest and a number of words; texts go no further. Rows of a block of conversations meet in
   one partition, sorted, and a stream over them chains the digests: the digest of a prefix is that of its turns in order.
2. A count-min sketch of ROWS rows counts the prefix digests. Cells stop at two, for the only question asked is whether
   the least of a digest's cells is one: then the prefix belongs to one conversation for certain. Each task sends the
   blocks of cells that it has touched; the merged bits are at most ROWS * MOST_CELLS / 8 bytes, whatever the corpus.
3. A turn whose prefix and whose parent prefix are both proven single is written at once, with no shuffle. All others
   (possibly shared ones, and the first turn of each single tail) are grouped exactly. A fuller sketch proves less and
   shuffles more; it changes no result.
4. A node's owner is its smallest member. Each node of a subtree is owned by exactly one member of its top, so sums over
   the subtree are sums over the members of what each owns below: one grouping, no walk up and down the trie.

Rows without a conv_id are no conversation. Null roles and texts are empty ones; turns of one place go by their digest, so
repeated rows are repeated turns; very long texts cost their task alone; an empty table has no nodes; other columns are
not read. Digests have 128 bits: for n different prefixes the chance of a clash is about n^2 / 2^129. SHA-256 has to see a
node's ids in order, so those that end in one node pass one task, as a stream that holds a digest state alone; likewise
the turns of one conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm.common import text_of, written

ROWS = 4
MOST_CELLS = 1 << 24
BLOCK = 1 << 15
CHUNK = 4096
ROOT = bytes(16)
#: Fixed value: SHA-256 of the empty text.
EMPTY_SHA = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def turn_digest(role: Column, text: Column) -> Column:
    return F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))


def shared_turns(conv_id: int, modulus: int = 4) -> int:
    return crc32(str(conv_id).encode()) % modulus


def prefix_chunks(turns: DataFrame, family: int = 0, modulus: int = 4) -> DataFrame:
    """Rows (conv_id, first, before, prefixes, words, last) of up to CHUNK consecutive turns of a conversation.

    before is the digest of the prefix that the chunk goes on from, first the depth of its first turn, last whether the
    conversation ends in it. With a family size f, the first h turns of conversation c, h = crc32(c) % modulus, are
    those of conversation c - c % f instead (as many as it has); f = 0 leaves conversations as they are.
    """
    own = F.col("conv_id").cast("long")
    role, text = text_of("role"), text_of("text")
    rows = turns.where("conv_id is not null").select(
        own.alias("conv_id"), (own - own % family if family else own).alias("base"), "turn", turn_digest(role, text).alias("digest"),
        F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).alias("words"),
    )
    order = ["base", F.col("conv_id") != F.col("base"), "conv_id", F.col("turn").asc_nulls_first(), "digest"]
    rows = rows.repartition("base").sortWithinPartitions(*order).select("base", "conv_id", "digest", "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = conv = None
        heads: list[tuple[bytes, int]] = []
        skip = at = depth = 0
        first, before, chain = 1, ROOT, ROOT
        prefixes: list[bytes] = []
        words: list[int] = []
        out: list[tuple] = []

        def close(last: bool) -> None:
            nonlocal first, before, prefixes, words
            out.append((conv, first, before, prefixes, words, last))
            first, before, prefixes, words = depth + 1, chain, [], []

        def add(digest: bytes, count: int) -> None:
            nonlocal chain, depth
            if len(prefixes) == CHUNK:
                close(False)
            chain = hashlib.blake2b(chain + digest, digest_size=16).digest()
            depth += 1
            prefixes.append(chain)
            words.append(count)

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            kinds = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.bool_()]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "first", "before", "prefixes", "words", "last"])

        for batch in batches:
            for b, c, digest, count in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if conv is None or c != conv:
                    if conv is not None:
                        close(True)
                    if b != base:
                        base, heads = b, []
                    conv, at, depth, chain, first, before = c, 0, 0, ROOT, 1, ROOT
                    skip = shared_turns(c, modulus) if family and c != b else 0
                    for head in heads[:skip]:
                        add(*head)
                at += 1
                if family and c == b and len(heads) < modulus - 1:
                    heads.append((digest, count))
                if at > skip:
                    add(digest, count)
                if len(out) >= 512:
                    yield flush()
        if conv is not None:
            close(True)
        if out:
            yield flush()

    return rows.mapInArrow(run, "conv_id long, first int, before binary, prefixes array<binary>, words array<int>, last boolean")


def _cells(digests: bytes, width: int) -> np.ndarray:
    """A row of the sketch's cells for each digest: its four 32-bit parts are as good as four hashes."""
    return (np.frombuffer(digests, "<u4").reshape(-1, ROWS) & np.uint32(width - 1)).astype(np.int64)


def _flat(column: pa.Array) -> bytes:
    return b"".join(column.flatten().to_pylist())


class Screen:
    """The merged sketch: for each cell, whether two or more prefixes were counted there."""

    def __init__(self, width: int, bits: np.ndarray):
        self.width, self.bits = width, bits

    def shared(self, digests: bytes) -> np.ndarray:
        """Whether the estimate of each digest is two or more; where it is not, the prefix is single for certain."""
        out = np.ones(len(digests) // 16, bool)
        for i, cells in enumerate(_cells(digests, self.width).T):
            out &= (self.bits[i][cells >> 3] >> (cells & 7).astype(np.uint8) & 1).astype(bool)
        return out


def screen(chunks: DataFrame, most_cells: int = MOST_CELLS) -> Screen:
    """The count-min sketch of all prefix digests, four cells a prefix and row, at most most_cells a row."""
    count = chunks.agg(F.sum(F.size("prefixes"))).first()[0] or 0
    width = min(most_cells, max(BLOCK, 1 << (4 * count).bit_length()))

    def count_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((ROWS, width), np.uint8)
        for batch in batches:
            for row, cells in zip(held, _cells(_flat(batch.column(0)), width).T, strict=True):
                found, times = np.unique(cells, return_counts=True)
                row[found] = np.minimum(row[found] + np.minimum(times, 2), 2)
        blocks = held.reshape(-1, BLOCK)
        for at in np.flatnonzero(blocks.any(axis=1)).tolist():
            one, two = (np.packbits(blocks[at] >= n, bitorder="little").tobytes() for n in (1, 2))
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([one], pa.binary()), pa.array([two], pa.binary())], ["block", "one", "two"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks come sorted: a cell is two if a task has counted two, or two tasks one each."""
        at, one, two = None, np.zeros(0, np.uint8), np.zeros(0, np.uint8)
        for batch in batches:
            for block, a, b in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
                if block != at:
                    if at is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([two.tobytes()], pa.binary())], ["block", "two"])
                    at, one, two = block, a, b
                else:
                    one, two = one | a, two | b | (one & a)
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([two.tobytes()], pa.binary())], ["block", "two"])

    parts = chunks.select("prefixes").mapInArrow(count_cells, "block int, one binary, two binary")
    merged = parts.repartition("block").sortWithinPartitions("block").mapInArrow(merge, "block int, two binary")
    bits = np.zeros(ROWS * width // 8, np.uint8)
    for block, two in merged.toLocalIterator():
        bits[block * BLOCK // 8 : (block + 1) * BLOCK // 8] = np.frombuffer(two, np.uint8)
    return Screen(width, bits.reshape(ROWS, -1))


def _screened(chunks: DataFrame, found: Screen, tails: bool) -> DataFrame:
    """Of all turns, either those proven single below a proven single one (conv_id, depth, last), or the others, with the
    depth-0 place of each conversation (conv_id, depth, prefix, words, last)."""
    shared = chunks.sparkSession.sparkContext.broadcast((found.width, found.bits))  # ROWS * MOST_CELLS / 8 bytes at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Screen(*shared.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            conv, first, before, prefixes, words, last = (batch.column(c) for c in ("conv_id", "first", "before", "prefixes", "words", "last"))
            sizes = np.asarray(prefixes.value_lengths(), np.int64)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            begin = np.cumsum(sizes) - sizes
            within = np.arange(len(owner)) - begin[owner]
            raw = _flat(prefixes)
            possibly = sketch.shared(raw)
            entry = sketch.shared(b"".join(before.to_pylist())) | (np.asarray(first) == 1)
            above = np.ones(len(owner), bool)
            above[1:] = possibly[:-1]
            above[within == 0] = entry[owner[within == 0]]
            single = ~possibly & ~above
            ends = (within == sizes[owner] - 1) & np.asarray(last)[owner]
            depth = np.asarray(first, np.int32)[owner] + within.astype(np.int32)
            ids = np.asarray(conv)[owner]
            if tails:
                yield pa.RecordBatch.from_arrays([pa.array(x[single]) for x in (ids, depth, ends)], ["conv_id", "depth", "last"])
                continue
            rest = np.flatnonzero(~single)
            counts = np.asarray(words.flatten(), np.int32)[rest]
            roots = np.flatnonzero(np.asarray(first) == 1)
            digests = [raw[16 * i : 16 * i + 16] for i in rest.tolist()] + [ROOT] * len(roots)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([ids[rest], np.asarray(conv)[roots]])), pa.array(np.concatenate([depth[rest], np.zeros(len(roots), np.int32)])), pa.array(digests, pa.binary()),
                 pa.array(np.concatenate([counts, np.zeros(len(roots), np.int32)])), pa.array(np.concatenate([ends[rest], (sizes[roots] == 0) & np.asarray(last)[roots]]))],
                ["conv_id", "depth", "prefix", "words", "last"],
            )

    return chunks.mapInArrow(run, "conv_id long, depth int, last boolean" if tails else "conv_id long, depth int, prefix binary, words int, last boolean")


def _id_hashes(ends: DataFrame) -> DataFrame:
    """(prefix, ends_sha256) of rows (prefix, conv_id): SHA-256 of a prefix's ids, ascending, joined by commas, as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, hashlib.sha256()
        out: list[tuple[bytes, str]] = []
        for batch in batches:
            for prefix, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if prefix != at:
                    if at is not None:
                        out.append((at, state.hexdigest()))
                    at, state = prefix, hashlib.sha256(str(conv).encode())
                else:
                    state.update(b",%d" % conv)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["prefix", "ends_sha256"])
                out = []
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([state.hexdigest()])], ["prefix", "ends_sha256"])

    return ends.select("prefix", "conv_id").repartition("prefix").sortWithinPartitions("prefix", "conv_id").mapInArrow(run, "prefix binary, ends_sha256 string")


def prefix_trie(turns: DataFrame, family: int = 0, modulus: int = 4, most_cells: int = MOST_CELLS) -> DataFrame:
    """A row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    chunks = written(prefix_chunks(turns, family, modulus), "prefixes")
    found = screen(chunks, most_cells)
    tails = _screened(chunks, found, True)
    rows = written(_screened(chunks, found, False), "shared-prefixes")
    inner = rows.where("depth > 0")
    groups = inner.groupBy("prefix").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n"), F.count_if("last").alias("enders"))
    least, count, enders = rows.where("depth = 0").agg(F.min("conv_id"), F.count("*"), F.count_if("last")).first()
    root = rows.where("depth = 0").select(*rows.columns, F.lit(least).cast("long").alias("owner"), F.lit(count).alias("n"), F.lit(enders).alias("enders"))
    known = inner.join(groups, "prefix").select(*rows.columns, "owner", "n", "enders").union(root)
    own = F.col("owner") == F.col("conv_id")
    known = known.withColumns({"own": own, "saved": F.when(own, (F.col("n") - 1) * F.col("words")).otherwise(0), "leaf": own & F.col("last") & (F.col("enders") == F.col("n"))})
    path, whole = Window.partitionBy("conv_id").orderBy("depth"), Window.partitionBy("conv_id")
    above, below = F.lag("depth").over(path) == F.col("depth") - 1, F.lead("depth").over(path) == F.col("depth") + 1
    placed = known.select(
        "conv_id", "depth", "prefix", "own",
        F.when(F.col("depth") > 0, F.when(above, F.lag("owner").over(path)).otherwise(F.col("conv_id"))).alias("parent"),
        F.when(F.col("last"), False).when(below, F.lead("own").over(path)).otherwise(True).alias("child"),
        (F.max("leaf").over(whole) | ~F.max("last").over(whole)).alias("leaf"),
        (F.sum("saved").over(whole) - F.sum("saved").over(path.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("saved")).alias("saved"),
    )
    nodes = placed.groupBy("prefix").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").cast("long").alias("depth"), F.max(F.when(F.col("own"), F.col("parent"))).alias("parent_conv_id"), F.count("*").alias("n_convs"),
        F.count_if("child").alias("n_children"), F.count_if("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"),
    )
    nodes = nodes.join(_id_hashes(rows.where("last")), "prefix", "left").drop("prefix").fillna(EMPTY_SHA, "ends_sha256")
    one = F.lit(1).cast("long")
    single = tails.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), F.col("conv_id").alias("parent_conv_id"), one.alias("n_convs"), F.when(F.col("last"), 0).otherwise(1).cast("long").alias("n_children"),
        one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.when(F.col("last"), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(EMPTY_SHA).alias("ends_sha256"),
    )
    return nodes.select(single.columns).union(single)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of the contract's rebuilt conversations: the first crc32 % 4 turns are those of the family of 20."""
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"), family=20)


OP11_SQL = """
WITH t AS (
    SELECT conv_id, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS k,
        len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
    FROM conversations WHERE conv_id IS NOT NULL),
c AS (
    SELECT conv_id, conv_id - conv_id % 20 AS base,
        xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
            lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 4 AS h
    FROM (SELECT DISTINCT conv_id FROM t)),
turns AS (
    SELECT conv_id, k, words, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth FROM (
        SELECT c.conv_id, t.k, t.words, 0 AS part, t.pos FROM c JOIN t ON t.conv_id = c.base AND t.pos <= c.h
        UNION ALL SELECT c.conv_id, t.k, t.words, 1, t.pos FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h)),
places AS (
    SELECT conv_id, depth, words, string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING) AS prefix FROM turns
    UNION ALL SELECT conv_id, 0, 0, '' FROM c),
ended AS (SELECT conv_id, max(depth) AS depth FROM places GROUP BY conv_id),
nodes AS (
    SELECT p.prefix, min(p.conv_id) AS conv_id, p.depth, count(*) AS n_convs, max(p.words) AS words,
        sha256(coalesce(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) FILTER (WHERE e.depth = p.depth), '')) AS ends_sha256
    FROM places p JOIN ended e USING (conv_id) GROUP BY p.prefix, p.depth),
children AS (SELECT left(prefix, 32 * (depth - 1)::INT) AS prefix, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
below AS (
    SELECT left(n.prefix, 32 * d::INT) AS prefix, sum(CASE WHEN ch.n IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((n.n_convs - 1) * n.words) AS saved
    FROM nodes n LEFT JOIN children ch USING (prefix), unnest(range(0, n.depth + 1)) AS u(d) GROUP BY 1)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(ch.n, 0)::BIGINT AS n_children, b.n_leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below b USING (prefix) LEFT JOIN children ch USING (prefix) LEFT JOIN nodes p ON n.depth > 0 AND p.prefix = left(n.prefix, 32 * (n.depth - 1)::INT)
"""
