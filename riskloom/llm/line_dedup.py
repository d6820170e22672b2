"""Line deduplication: exact copies and lines within a few edits, by a segment-partition join (Li et al. 2011).

How many edits a line of n characters may differ by is a step function of n, EDITS, and of two lines the shorter one's
number holds. A line is cut into t + 1 even segments; if another line of nearly its length is within t edits, one of
them stands in it unchanged, at one of the few places that the multi-match-aware rule leaves. So each line has t + 1
index keys (length, segment number, segment) and some probe keys for the shorter or equally long lines it may match.
Rows of (key, line hash) meet in one shuffle, once per task and line, so a line of every document brings a row per
task; keys that only one text has go at once. The texts of the lines that are left are fetched, with a bitmap filter
of bounded size that is built by Spark and an exact join after it. The lines on a key are compared in one task, those
of a crowded key in a task for every two of its blocks. An edit changes at most two and four bits of two 64-bit
signatures (parities of the counts of letters and of letter pairs): pairs that differ in more are passed over, and the
others are verified on the texts along the few diagonals that so many edits reach, at the least of the keys they share.
So every link is counted once, and no pairs are written: a task gives each line's number of links and a star of each
group that they connect.

Lines are told apart by 64-bit hashes: among n different lines two share one with chance n^2 / 2^65; clashes of keys
only cost a comparison. Blank lines, null texts and empty tables have no rows; trailing white space is no part of a
line; a line may be as long as its text. Rows repeated under one id are one document seen twice: each gets the same
classes, and both stay in `dedup_lines` or both go; null ids are passed over when the first place of a class is taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import bitmap, connected_components, in_bitmap, scratch, set_aside, stars, text_chunks, written

#: (characters, edits): lines of so many characters and more may differ by so many edits. Shorter ones match exactly.
EDITS = ((15, 1), (30, 2), (300, 3))

#: Most bits of the filter of candidate lines; 16 for each of them, if that is less.
FILTER_BITS = 1 << 28

#: Lines on one key that are compared in one task; more are dealt to blocks of about half as many.
BUCKET = 512

#: Line hashes that a task remembers, so as not to repeat a line's rows.
SEEN = 1 << 18


def edits_of(length: int, edits=EDITS) -> int:
    """Edits that a line of so many characters may differ by."""
    return max((t for n, t in edits if length >= n), default=0)


def line_hash(line: str) -> int:
    return xxhash.xxh64_intdigest(line) - (1 << 63)


def lines_of(text: str) -> list[tuple[int, str]]:
    """(number, line) of the lines that aren't blank, without trailing white space."""
    return [(i, x) for i, x in enumerate(y.rstrip() for y in text.split("\n")) if x]


def segments(length: int, edits: int) -> list[tuple[int, int]]:
    """(start, size) of the edits + 1 even segments of a line; the longer ones come last."""
    size, rest = divmod(length, edits + 1)
    out, at = [], 0
    for i in range(edits + 1):
        own = size + (i >= edits + 1 - rest)
        out.append((at, own))
        at += own
    return out


@lru_cache(maxsize=1 << 14)
def key_places(n: int, edits=EDITS) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(start, size, tag) of the keys of a line of n characters, index keys first, and the number of those.

    The tag is the length of the line that the key is of and the segment's number. For an equally long line the
    unshifted probes are the index keys themselves and aren't repeated.
    """
    own = edits_of(n, edits)
    out = [(a, s, n << 4 | i) for i, (a, s) in enumerate(segments(n, own))] if own else []
    for m in range(n, n - own - 1, -1):
        t, longer = edits_of(m, edits), n - m
        for i, (a, s) in enumerate(segments(m, t) if 0 < t >= longer else []):
            low = max(a - i, a + longer - (t - i), 0)
            high = min(a + i, a + longer + (t - i), n - s)
            out += [(at, s, m << 4 | i) for at in range(low, high + 1) if longer or at != a]
    return *(np.array(c, np.int64) for c in (zip(*out, strict=True) if out else ((), (), ()))), own + 1 if own else 0


class Substrings:
    """Hashes of substrings of one string: polynomials of mixed code points, by their prefix sums."""

    _base = np.uint64(0x9E3779B97F4A7C15)
    _inverse = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
    _powers, _inverses = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        n = len(codes) + 1
        if len(Substrings._powers) < n:
            for name, value in (("_powers", self._base), ("_inverses", self._inverse)):
                grown = np.full(n, value, np.uint64)
                grown[0] = 1
                setattr(Substrings, name, np.cumprod(grown, dtype=np.uint64))
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(mixed(codes + np.uint64(1)) * Substrings._powers[: n - 1], out=self.sums[1:])

    def hash(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (self.sums[start + size] - self.sums[start]) * Substrings._inverses[start]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finalizer of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def line_keys(lines: list[str], edits=EDITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, line number, own) of all keys of the lines; own marks index keys."""
    places = [key_places(len(x), edits) for x in lines]
    sizes = np.fromiter((len(p[0]) for p in places), np.int64, len(places))
    if not sizes.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    first = np.concatenate([[0], np.cumsum([len(x) for x in lines])[:-1]])
    start, size, tag = (np.concatenate(c) for c in zip(*(p[:3] for p in places), strict=True))
    line = np.repeat(np.arange(len(lines)), sizes)
    found = Substrings("".join(lines)).hash(start + first[line], size)
    rank = np.arange(len(line)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    own = rank < np.repeat([p[3] for p in places], sizes)
    return mixed(found ^ mixed(tag.astype(np.uint64))).view(np.int64), line, own


def common(a: str, i: int, b: str, j: int) -> int:
    """Letters that a from i on and b from j on begin with alike: growing slices are compared, then halves of the last."""
    most, at, step = min(len(a) - i, len(b) - j), 0, 16
    while at < most:
        step = min(step, most - at)
        if a[i + at : i + at + step] != b[j + at : j + at + step]:
            break
        at += step
        step *= 2
    else:
        return at
    while step > 1:
        half = step // 2
        if a[i + at : i + at + half] == b[j + at : j + at + half]:
            at += half
            step -= half
        else:
            step = half
    return at


def within(a: str, b: str, edits: int) -> bool:
    """Is the edit distance at most `edits`: the furthest places on each diagonal by so many edits (Landau and Vishkin 1989)."""
    goal = len(b) - len(a)
    if abs(goal) > edits:
        return False
    never = -edits - 2
    far: dict[int, int] = {}  # diagonal, b's place less a's: letters of a that are turned into as many of b and the diagonal
    for k in range(edits + 1):
        now = {}
        for d in range(-k, k + 1):
            # equal so far; a letter replaced, taken from a, put into a
            i = max(far.get(d, never) + 1, far.get(d + 1, never) + 1, far.get(d - 1, never)) if k else 0
            i = min(i, len(a), len(b) - d)
            if i < 0 or i + d < 0:
                continue
            i += common(a, i, b, i + d)
            if d == goal and i == len(a):
                return True
            now[d] = i
        far = now
    return False


_bits: dict[str, int] = {}


def signature(line: str, size: int) -> int:
    """64 parities of the counts of the line's runs of `size` letters, by hash, as a signed long.

    An edit takes away or adds at most two runs for each letter of their size: 2 * size bits flip at most.
    """
    out = 0
    for i in range(len(line) - size + 1):
        run = line[i : i + size]
        bit = _bits.get(run)
        if bit is None:
            bit = 1 << (xxhash.xxh64_intdigest(run) & 63)
            if len(_bits) < 1 << 16:
                _bits[run] = bit
        out ^= bit
    return out - (1 << 64) if out >> 63 else out


def document_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, h, n): every line that isn't blank, by hash and length in characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches, text):
            rows = [(d, i, line_hash(x), len(x)) for d, t in enumerate(texts) for i, x in lines_of(t.decode())]
            if rows:
                d, i, h, n = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(key).take(pa.array(d)), pa.array(i, pa.int32()), pa.array(h, pa.int64()), pa.array(n, pa.int32())], [key, "line_no", "h", "n"])

    return docs.select(key, text).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, line_no int, h long, n int")


def _once(batches: Iterator[pa.RecordBatch], text: str, least: int) -> Iterator[tuple[list[str], np.ndarray]]:
    """The lines of at least so many characters with their hashes, a slice at a time; few are given twice by one task."""
    seen: set[int] = set()
    for _, texts in text_chunks(batches, text):
        new = {h: x for x in {x for t in texts for _, x in lines_of(t.decode()) if len(x) >= least} if (h := line_hash(x)) not in seen}
        if len(seen) > SEEN:
            seen.clear()
        seen.update(new)
        if new:
            yield [*new.values()], np.fromiter(new, np.int64, len(new))


def _key_rows(docs: DataFrame, text: str, edits) -> DataFrame:
    """(key, h, own) of the lines of each task: own marks index keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lines, hashes in _once(batches, text, edits[0][0]):
            key, line, own = line_keys(lines, edits)
            if len(key):
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(hashes[line]), pa.array(own)], ["key", "h", "own"])

    return docs.select(text).mapInArrow(run, "key long, h long, own boolean")


def _texts(docs: DataFrame, text: str, least: int, bits: np.ndarray) -> DataFrame:
    """(h, line, one, two): the lines whose hash may be among the wanted ones, with their signatures."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lines, hashes in _once(batches, text, least):
            keep = np.flatnonzero(in_bitmap(shared.value, hashes))
            if len(keep):
                own = [lines[i] for i in keep]
                yield pa.RecordBatch.from_arrays([pa.array(hashes[keep]), pa.array(own), *(pa.array([signature(x, k) for x in own], pa.int64()) for k in (1, 2))], ["h", "line", "one", "two"])

    return docs.select(text).mapInArrow(run, "h long, line string, one long, two long")


def _cell_links(lines: list[dict], key: int, apart: bool, edits) -> tuple[list[int], list[tuple[int, int]]]:
    """Each line's number of links that are counted at this key, and pairs of places that connect what they connect, to the least hash.

    apart: only links between the two blocks are asked for.
    """
    most = max(t for _, t in edits)
    one, two = (np.array([x[c] for x in lines], np.int64).view(np.uint64) for c in ("one", "two"))
    own, block = np.array([x["own"] for x in lines], bool), np.array([x["block"] for x in lines])
    keys: dict[int, tuple[set[int], set[int]]] = {}

    def keys_of(i: int) -> tuple[set[int], set[int]]:
        if i not in keys:
            found, _, index = line_keys([lines[i]["line"]], edits)
            keys[i] = {*found[index].tolist()}, {*found.tolist()}
        return keys[i]

    number, root = [0] * len(lines), [*range(len(lines))]

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for i in range(1, len(lines)):
        near = (own[:i] | own[i]) & (np.bitwise_count(one[:i] ^ one[i]) <= 2 * most) & (np.bitwise_count(two[:i] ^ two[i]) <= 4 * most)
        if apart:
            near &= block[:i] != block[i]
        for j in np.flatnonzero(near).tolist():
            x, y = lines[i]["line"], lines[j]["line"]
            t = edits_of(min(len(x), len(y)), edits)
            if abs(len(x) - len(y)) > t:
                continue
            (index_x, all_x), (index_y, all_y) = keys_of(i), keys_of(j)
            if key == min((index_x & all_y) | (all_x & index_y)) and within(x, y, t):
                number[i] += 1
                number[j] += 1
                low, high = sorted((top(i), top(j)), key=lambda k: lines[k]["h"])
                root[high] = low
    return number, [(i, top(i)) for i in range(len(lines)) if top(i) != i]


def line_links(docs: DataFrame, text: str = "text", edits=EDITS) -> DataFrame:
    """(a, b, n): with b null, n links of the line with hash a; else a link of a and b (these connect what all links connect).

    A link is two different lines within the shorter one's number of edits.
    """
    if any(n <= t or not 0 < t < 8 for n, t in edits) or any(x[0] >= y[0] or x[1] >= y[1] for x, y in zip(edits, edits[1:], strict=False)):
        raise ValueError("steps of rising length and of 1 to 7 edits, and lines longer than that")
    rows = _key_rows(docs, text, edits).repartition("key")
    shared = rows.groupBy("key").agg(F.min("h").alias("least"), F.max("h").alias("most"), F.bool_or("own").alias("indexed")).where("least <> most and indexed").select("key")
    met = written(rows.join(shared, "key").groupBy("key", "h").agg(F.bool_or("own").alias("own")), "met")
    found = _texts(docs, text, edits[0][0], bitmap(met, "h", FILTER_BITS)).groupBy("h").agg(F.first("line").alias("line"), F.first("one").alias("one"), F.first("two").alias("two"))
    size = met.groupBy("key").agg(F.count("*").alias("size"))
    blocks = F.when(F.col("size") > BUCKET, F.ceil(2 * F.col("size") / BUCKET)).otherwise(1)
    met = met.join(size, "key").withColumn("blocks", blocks).withColumn("block", F.expr("pmod(xxhash64(h), blocks)"))
    met = written(met.join(written(found, "candidate-lines"), "h").select("key", "h", "own", "line", "one", "two", "block", "blocks"), "met")
    dealt = met.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    cells = dealt.groupBy("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")).agg(F.collect_list(F.struct("h", "own", "line", "one", "two", "block")).alias("lines"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                key, low, high, lines = (batch.column(c)[i].as_py() for c in ("key", "low", "high", "lines"))
                number, forest = _cell_links(lines, key, low != high, edits)
                counted = [(x["h"], None, n) for x, n in zip(lines, number, strict=True) if n]
                a, b, n = zip(*counted, *((lines[i]["h"], lines[j]["h"], 0) for i, j in forest), strict=True) if counted else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], ["a", "b", "n"])

    return cells.where(F.size("lines") > 1).mapInArrow(run, "a long, b long, n long")


def line_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", edits=EDITS) -> DataFrame:
    """A row per line: (key, line_no, h, n, n_copies, n_links, class_doc, class_line).

    n_copies: lines of this very text; n_links: other texts within the edits; class_doc, class_line: the first place,
    by key and line number, in the class that copies and links make.
    """
    lines = written(document_lines(docs, key, text), "lines")
    with scratch() as kept:
        links = written(line_links(docs, text, edits), "links")
        kept.append(links)
    number = links.where("b is null").groupBy(F.col("a").alias("h")).agg(F.sum("n").alias("n_links"))
    own = F.struct(F.col(key).alias("d"), F.col("line_no").alias("l"))
    texts = lines.groupBy("h").agg(F.count("*").alias("n_copies"), F.min(F.when(F.col(key).isNotNull(), own)).alias("first"))
    texts = texts.join(connected_components(stars(links.where("b is not null"))).withColumnRenamed("node", "h"), "h", "left").join(number, "h", "left")
    texts = texts.withColumn("root", F.coalesce("component", "h"))
    classed = texts.where("component is not null").groupBy("root").agg(F.min("first").alias("class"))
    info = texts.where("n_copies > 1 or component is not null").join(classed, "root", "left")
    info = info.select("h", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("class", "first").alias("class"))
    out = lines.join(info, "h", "left")
    place: Column = F.coalesce("class", own)
    return out.select(key, "line_no", "h", "n", F.coalesce("n_copies", F.lit(1)).alias("n_copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"), place["d"].alias("class_doc"), place["l"].alias("class_line"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", edits=EDITS) -> DataFrame:
    """docs without the lines that an earlier place of their class has; n_chars, if there, follows the new text.

    Documents of whose lines none is left are copies as a whole, and go; those that had none stay. Null ids keep all.
    """
    docs, restored = set_aside(docs, key, text, "n_chars")
    again = ~(F.col(key).eqNullSafe(F.col("class_doc")) & (F.col("line_no") == F.col("class_line")))
    later = line_classes(docs, key, text, edits).where(again & F.col(key).isNotNull()).select(key, "line_no", "h").distinct()
    drops = later.groupBy(key).agg(F.collect_list(F.struct("line_no", "h")).alias("_drops"))
    joined = docs.join(drops, key, "left").select(*docs.columns, "_drops")
    kinds = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).to_pylist()
            stay = np.ones(len(texts), bool)
            sizes = batch.column("n_chars").to_pylist() if "n_chars" in batch.schema.names else None
            for i, drops in enumerate(batch.column("_drops").to_pylist()):
                if not drops or texts[i] is None:
                    continue
                gone = {(d["line_no"], d["h"]) for d in drops}
                rows = texts[i].split("\n")
                kept = [x for n, x in enumerate(rows) if (n, line_hash(x.rstrip())) not in gone]
                left = "\n".join(kept)
                stay[i] = bool(left.strip())
                texts[i] = left
                if sizes is not None:
                    sizes[i] = len(left)
            out = {c: batch.column(c) for c in kinds.names}
            out[text] = pa.array(texts, out[text].type)
            if sizes is not None:
                out["n_chars"] = pa.array(sizes, out["n_chars"].type)
            yield pa.RecordBatch.from_arrays([*out.values()], [*out]).filter(pa.array(stay))

    return restored(joined.mapInArrow(run, kinds))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document with its class and its number of links."""
    found = line_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    first = (F.col("doc_id") == F.col("class_doc")) & (F.col("line_no") == F.col("class_line"))
    return found.select("doc_id", "line_no", F.col("n").alias("n_chars"), "n_copies", "n_links", "class_doc", "class_line", first.alias("kept"))
