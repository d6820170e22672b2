"""SimHash near-duplicates: 64-bit fingerprints, linked at a few differing bits, found by pigeonring filtering.

Two fingerprints cut into a ring of eight bytes that differ in at most t bits have a starting byte from which
every chain of l bytes differs in at most l * t / 8 bits (Qin and Xiao 2018). For t = 3 such a chain begins
with two equal bytes, and its next three bytes differ in one bit at most, so one half of them is equal: a
fingerprint has 16 keys of 28 bits, and only fingerprints that share a key are compared, first along the
chain, then as a whole. Buckets are counted before they are gathered: pairs are linked from the counts,
buckets of up to BUCKET fingerprints in a task each, and larger ones are cut by their other bits (three
differences leave one of four parts equal) until they fit. Distinct fingerprints that agree in all but nine
bits number at most 512, so that ends. Each bucket emits a spanning forest of its links, never all pairs.

Null and empty texts have fingerprint 0 and are linked like any other; repeated rows and copies share one
fingerprint; null ids are passed over when the smallest id of a component is taken; other columns are kept
by `near_dedup` and not read elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import bitmap, connected_components, in_bitmap, scratch, set_aside, text_chunks, written

#: Most fingerprints that are compared in one task at once; at least 512, see above.
BUCKET = 512

#: Near-duplicates in the pipeline: Jaccard similarity of the sets of shingles of so many words.
SIMILARITY, WIDTH = 0.8, 5

#: Sets on one shingle that are all verified with each other.
CROWD = 64


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """Bit by bit majority of the XXH64 of the text's word shingles; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - width + 1)
    stops = ends[min(width, len(words)) - 1 :].tolist()
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        bits = np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text: str = "text", keep: list[str] | None = None, width: int = 3) -> DataFrame:
    """The columns in keep (all but the text by default) and `fp`, the fingerprint as a signed long."""
    keep = [c for c in df.columns if c != text] if keep is None else keep
    carried = [c for c in keep if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches, text):
            found = np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(found)], [*keep, "fp"])

    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*carried, text).mapInArrow(run, f"{fields}, fp long" if keep else "fp long")


def _keys(fp: str) -> Column:
    """Per start of the ring: the two forms of a key (28 bits), with the other 36 bits as `rest`."""
    out = []
    for start in range(8):
        turned = f"(shiftleft({fp}, {8 * start}) | shiftrightunsigned({fp}, {64 - 8 * start}))" if start else fp
        first = f"named_struct('key', shiftrightunsigned({turned}, 36) | {2 * start}L << 28, 'rest', {turned} & {(1 << 36) - 1}L)"
        second = (
            f"named_struct('key', (shiftrightunsigned({turned}, 48) << 12) | (shiftrightunsigned({turned}, 24) & 4095) | {2 * start + 1}L << 28, "
            f"'rest', ((shiftrightunsigned({turned}, 36) & 4095) << 24) | ({turned} & 16777215L))"
        )
        out += [first, second]
    return F.explode(F.expr(f"array({', '.join(out)})"))


def _chain(a: str, b: str, distance: int) -> Column:
    """Some start of the ring keeps every chain of bytes within its share of the distance; the whole ring is the last."""
    starts = []
    for start in range(8):
        x = f"({a} ^ {b})"
        turned = f"(shiftleft({x}, {8 * start}) | shiftrightunsigned({x}, {64 - 8 * start}))" if start else x
        starts.append("(" + " and ".join(f"bit_count(shiftrightunsigned({turned}, {64 - 8 * n})) <= {n * distance // 8}" for n in range(1, 9)) + ")")
    return F.expr(" or ".join(starts))


def _forest(fps: np.ndarray, distance: int, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one bucket that connect all that its pairs connect whose chains from `start` keep within their shares."""
    root = np.arange(len(fps))
    turned = fps << np.uint64(8 * start) | fps >> np.uint64(64 - 8 * start) if start else fps
    lengths = [n for n in range(1, 9) if n == 8 or (n + 1) * distance // 8 > n * distance // 8]  # the others follow
    for i in range(1, len(fps)):
        near, unlike = None, turned[:i] ^ turned[i]
        for n in lengths:  # first along the chain, then as a whole
            fits = np.flatnonzero(np.bitwise_count(unlike >> np.uint64(64 - 8 * n)) <= n * distance // 8)
            near, unlike = fits if near is None else near[fits], unlike[fits]
        if len(near):
            met = np.unique(root[near])
            root[np.isin(root[: i + 1], met)[: i + 1].nonzero()[0]] = met[0]
            root[i] = met[0]
    other = np.flatnonzero(root != np.arange(len(fps)))
    return fps[root[other]].view(np.int64), fps[other].view(np.int64)


def hamming_links(distinct: DataFrame, fp: str = "fp", distance: int = 3, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect the same components as all pairs within the distance."""
    if not 0 <= distance <= 3:
        raise ValueError("the keys hold for distances up to 3")

    def bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [_forest(np.array(x, np.int64).view(np.uint64), distance, start) for x, start in zip(batch.column("fps").to_pylist(), batch.column("start").to_pylist(), strict=True)]
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*pairs, strict=True)], ["a", "b"])

    rows = distinct.select(F.col(fp).alias("fp"), _keys(fp).alias("k")).select("k.key", "fp", "k.rest", F.lit(36).alias("free"), F.expr("cast(k.key div (1 << 29) as int)").alias("start"))
    out = None
    while True:
        counts = written(rows.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"), "buckets")
        two = counts.where("n = 2").select("a", "b").where(_chain("a", "b", distance))
        more = rows.join(counts.where("n > 2").select("key", "n"), "key")
        few = more.where(F.col("n") <= bucket).groupBy("key").agg(F.collect_list("fp").alias("fps"), F.first("start").alias("start")).select("fps", "start")
        links = two.union(few.mapInArrow(bucket_links, "a long, b long"))
        out = links if out is None else out.union(links)
        if counts.where(F.col("n") > bucket).isEmpty():
            return out
        size = "(free div 4)"
        parts = ", ".join(
            f"named_struct('key', xxhash64(key, {j}, shiftrightunsigned(rest, cast({j} * {size} as int)) & (shiftleft(1L, cast({width} as int)) - 1)), "
            f"'rest', (rest & (shiftleft(1L, cast({j} * {size} as int)) - 1)) | shiftleft(shiftrightunsigned(rest, cast({j} * {size} + {width} as int)), cast({j} * {size} as int)), 'free', cast(free - {width} as int))"
            for j, width in enumerate([size, size, size, f"(free - 3 * {size})"])
        )
        hot = more.where(F.col("n") > bucket)
        rows = written(hot.select("fp", "start", F.explode(F.expr(f"array({parts})")).alias("k")).select("k.key", "fp", "k.rest", "k.free", "start"), "cut")


def near_components(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = 3, width: int = 3) -> DataFrame:
    """(key, fp, root, component_id) per row: root is one fingerprint of the component, component_id its smallest key."""
    return components_of(written(fingerprints(docs, text, [key], width), "fingerprints"), key, distance)


def components_of(rows: DataFrame, key: str = "doc_id", distance: int = 3) -> DataFrame:
    """near_components of rows that have their fingerprints in fp."""
    distinct = written(rows.groupBy("fp").agg(F.min(key).alias("least")), "distinct")
    parts = connected_components(hamming_links(distinct, distance=distance))
    rooted = distinct.join(parts, distinct.fp == parts.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = rooted.select("fp", "root").join(named, "root")
    return rows.select(key, "fp").join(labels, "fp").select(key, "fp", "root", "component_id")


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct XXH64 of the text's word shingles; none without words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - width + 1)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + width])) for i in range(n)), np.uint64, n))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """512 bits of a set, each the parity of the hashes that fall on it: no more differ between two sets than members do."""
    return np.packbits(np.bincount((hashes & np.uint64(511)).astype(np.int64), minlength=512) & 1).view(np.int64)


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of a set of shingle hashes, as a signed long; 0 of the empty set."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def _shingled(docs: DataFrame, text: str, similarity: float, width: int) -> DataFrame:
    """docs with `_set` (hash of the set of shingles), `_n` (its size), `_head` (its prefix for the similarity), `_sketch` and `_fp`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches, text):
            sets = [shingles(t, width) for t in texts]
            sizes = [len(s) for s in sets]
            heads = [s[: n - int(np.ceil(similarity * n - 1e-9)) + 1].view(np.int64) for s, n in zip(sets, sizes, strict=True)]
            ids = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            made = [pa.array(ids), pa.array(sizes, pa.int32()), pa.array(heads, pa.list_(pa.int64())), pa.array([sketch(s) for s in sets], pa.list_(pa.int64())), pa.array([majority(s) for s in sets], pa.int64())]
            yield pa.RecordBatch.from_arrays([*part.columns, *made], [*part.schema.names, "_set", "_n", "_head", "_sketch", "_fp"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, _set long, _n int, _head array<long>, _sketch array<long>, _fp long")


def _alike(pairs: DataFrame, rows: DataFrame, text: str, similarity: float, width: int) -> DataFrame:
    """The pairs (a, b) of sets whose Jaccard similarity, counted on the whole sets, is reached."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches, text):
            found = [shingles(t, width).view(np.int64) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column("_set"), pa.array(found, pa.list_(pa.int64()))], ["id", "s"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both + 1e-9 >= similarity * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = written(pairs.distinct(), "set-pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("_set")).distinct()
    wanted = _texts_of(rows, ids.withColumnRenamed("_set", "id"), text)
    known = written(wanted.mapInArrow(sets, "id long, s array<long>"), "sets")
    both = pairs.join(known.select(F.col("id").alias("a"), F.col("s").alias("x")), "a").join(known.select(F.col("id").alias("b"), F.col("s").alias("y")), "b")
    return written(both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long"), "alike")


def _texts_of(rows: DataFrame, ids: DataFrame, text: str) -> DataFrame:
    """(_set, text): one text of each of the sets in ids (id)."""
    return rows.select("_set", text).join(ids.select(F.col("id").alias("_set")), "_set", "left_semi").groupBy("_set").agg(F.first(text).alias(text))


def _prefixes(rows: DataFrame, text: str, similarity: float, width: int, crowd: int) -> DataFrame:
    """(id, at, key): the prefix of each set, by place, in one order of all shingles: by hash, but those of a bitmap come last.

    The bitmap, of bounded size, holds the shingles that more than `crowd` sets have: those crowded in the prefixes by
    hash, and those that tasks see crowded in the sets which hold such. So a passage that many documents share is in the
    prefix only of documents that hold little else. The order is the same for all sets, so whatever the bitmap holds,
    no pair is lost: it only spares work.
    """
    session = rows.sparkSession
    first_of = lambda x: x.groupBy(F.col("_set").alias("id")).agg(F.first("_head").alias("head")).select("id", F.posexplode("head").alias("at", "key"))
    told = first_of(rows)
    first = written(told.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > crowd).select("key"), "crowded")
    if first.isEmpty():
        return told
    early = session.sparkContext.broadcast(bitmap(first, "key"))

    def hot(part: pa.RecordBatch, bits: np.ndarray) -> list[bool]:
        heads = part.column("_head")
        marks = np.append(0, np.cumsum(in_bitmap(bits, heads.flatten().to_numpy(zero_copy_only=False))))
        ends = np.append(0, np.cumsum([len(x) for x in heads]))
        return (marks[ends[1:]] > marks[ends[:-1]]).tolist()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part, texts in text_chunks(batches, text, 16 << 20):
            own = [(i, t) for i, t, is_hot in zip(part.column("_set").to_pylist(), texts, hot(part, early.value), strict=True) if is_hot and i not in seen]
            if len(seen) > 1 << 18:
                seen.clear()
            seen.update(i for i, _ in own)
            if own:
                key, m = np.unique(np.concatenate([shingles(t, width).view(np.int64) for t in {i: t for i, t in own}.values()]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key[m > 1]), pa.array(m[m > 1])], ["key", "m"])

    columns = rows.select("_set", "_head", text)
    late = columns.mapInArrow(counted, "key long, m long").groupBy("key").agg(F.sum("m").alias("m")).where(F.col("m") > crowd).select("key")
    bits = session.sparkContext.broadcast(bitmap(written(late.union(first).distinct(), "crowded"), "key"))

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches, text):
            heads = [x.values.to_numpy() for x in part.column("_head")]
            for i, is_hot in enumerate(hot(part, bits.value)):
                if is_hot:
                    found = shingles(texts[i], width).view(np.int64)
                    last = in_bitmap(bits.value, found)
                    heads[i] = np.concatenate([found[~last], found[last]])[: len(heads[i])]
            yield pa.RecordBatch.from_arrays([part.column("_set"), pa.array(heads, pa.list_(pa.int64()))], ["_set", "_head"])

    return first_of(columns.mapInArrow(ordered, "_set long, _head array<long>"))


def simhash_links(rows: DataFrame, text: str = "text", similarity: float = SIMILARITY, width: int = WIDTH) -> DataFrame:
    """(a, b): links between the sets of _shingled rows whose fingerprints pigeonring filtering links, and which are similar.

    The least set of each fingerprint meets the others of it and, along each link of fingerprints, the least of the other.
    """
    sets = written(rows.groupBy(F.col("_set").alias("id")).agg(F.first("_fp").alias("fp")), "fingerprints")
    least = written(sets.groupBy("fp").agg(F.min("id").alias("a")), "distinct")
    equal = sets.join(least, "fp").where("id <> a").select("a", F.col("id").alias("b"))
    near = hamming_links(least).distinct().join(least.select(F.col("fp").alias("a"), F.col("a").alias("x")), "a").join(least.select(F.col("fp").alias("b"), F.col("a").alias("y")), "b")
    return _alike(equal.union(near.select("x", "y")), rows, text, similarity, width)


def jaccard_links(rows: DataFrame, text: str = "text", similarity: float = SIMILARITY, width: int = WIDTH, crowd: int = CROWD) -> DataFrame:
    """(a, b): links between the sets of _shingled rows that connect the same components as all pairs of the similarity.

    Fingerprints link first; what they reach is one component, whose pairs are not looked at again. The exact way for
    the rest, similar pairs whose fingerprints differ in more bits, is a join on shingles. Two sets of it share a shingle of their prefixes (the first n - ceil(similarity n) + 1 in an order of all shingles).
    All pairs of a shingle that up to 2 * `crowd` prefixes have are verified, if they share enough of the prefixes. On
    a crowded one, which is in prefixes of sets with little else, each set is verified with the least one first, and
    then the pairs that no link has brought into one component yet. Of these a pair is made only if the places of the
    shingle leave enough to share (of a similar pair's first shared shingle they do) and if the sketches differ in no
    more bits than its sets may in members.
    """
    near = simhash_links(rows, text, similarity, width)
    linked = written(connected_components(near), "parts")

    def apart_yet(pairs: DataFrame) -> DataFrame:
        of = lambda x: linked.select(F.col("node").alias(x), F.col("component").alias(f"_{x}"))
        return pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select("a", "b")

    heads = _prefixes(rows, text, similarity, width, crowd).select("key", "id", "at").repartition("key")
    crowd = 2 * crowd
    least = heads.groupBy("key").agg(F.count("*").alias("m"), F.min("id").alias("least")).where("m > 1")
    sizes = rows.select(F.col("_set").alias("id"), F.col("_n").alias("n")).distinct()
    met = written(written(heads.join(least, "key"), "shared").join(sizes, "id"), "met")
    sized = F.least("n", "o") + 1e-9 >= similarity * F.greatest("n", "o")
    both = F.ceil((F.col("n") + F.col("o")) * (similarity / (1 + similarity)) - 1e-9)  # members that a similar pair shares
    unlike = sum((F.bit_count(F.col("s")[i].bitwiseXOR(F.col("r")[i])) for i in range(8)), F.lit(0))
    possible = sized & (unlike <= F.col("n") + F.col("o") - 2 * both)

    marks = rows.groupBy(F.col("_set").alias("id")).agg(F.first("_sketch").alias("s"))
    many = written(met.where(F.col("m") > crowd).join(marks, "id"), "crowded")
    first = many.select(F.col("least").alias("id")).distinct().join(sizes, "id").join(marks, "id").toDF("a", "o", "r")
    stars = many.select(F.col("least").alias("a"), F.col("id").alias("b"), "n", "s").where("a <> b").dropDuplicates(["a", "b"]).join(first, "a").where(possible)
    # of the smaller prefix all shared shingles are seen, but for crowded ones; more than the rest cannot be shared
    hot = many.groupBy("id").agg(F.count("*").alias("hot"))
    few = met.where(F.col("m") <= crowd).join(hot, "id", "left").na.fill(0, ["hot"])
    left = few.select("key", F.col("id").alias("a"), "n", F.col("hot").alias("p"))
    right = few.select("key", F.col("id").alias("b"), F.col("n").alias("o"), F.col("hot").alias("q"))
    seen = left.join(right, "key").where((F.col("a") < F.col("b")) & sized).groupBy("a", "b", "n", "o", "p", "q").agg(F.count("*").alias("c"))
    most = F.col("c") + F.least("p", "q") + F.ceil(similarity * F.greatest("n", "o") - 1e-9) - 1
    enough = seen.where(most >= both).select("a", "b")

    links = near.union(_alike(apart_yet(enough.union(stars.select("a", "b"))), rows, text, similarity, width))
    if many.isEmpty():
        return links
    parts = connected_components(links).withColumnRenamed("node", "id")
    many = many.join(parts, "id", "left").withColumn("part", F.coalesce("component", "id"))
    many = written(many.select("key", "id", "at", "n", "s", "part"), "parted")
    split = many.groupBy("key").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p <> q").select("key")
    rest = many.join(split, "key")
    left = rest.select("key", F.col("id").alias("a"), F.col("at").alias("i"), "n", "s", "part")
    right = rest.select("key", F.col("id").alias("b"), F.col("at").alias("j"), F.col("n").alias("o"), F.col("s").alias("r"), F.col("part").alias("other"))
    early = (F.col("i") <= F.col("n") - both) & (F.col("j") <= F.col("o") - both)
    apart = left.join(right, "key").where((F.col("a") < F.col("b")) & (F.col("part") != F.col("other")) & early & possible).select("a", "b")
    return links.union(_alike(apart, rows, text, similarity, width))


def near_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, width: int = WIDTH) -> DataFrame:
    """docs with one row of each component of near-duplicates: that of the smallest key (one of them, if repeated).

    Near-duplicates are documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, all of
    them. The fingerprints of the sets are linked at three bits by pigeonring filtering, and what they link is checked
    on the sets. Similar pairs may differ in 12 of 64 bits or more, too many for keys that tell pairs apart; those are
    found by a join on the shingles themselves. The set's hash is written beside the rows; the rows that stay alone in
    their component pass an anti-join with the others' places, and only components of several rows are dealt again.
    """
    docs, restored = set_aside(docs, key, text)
    rows = written(_shingled(docs, text, similarity, width), "shingled")
    with scratch() as kept:
        parts = written(connected_components(jaccard_links(rows, text, similarity, width)).select(F.col("node").alias("_set"), "component"), "parts")
        kept.append(parts)
    copies = rows.groupBy("_set").agg(F.count("*").alias("_n"), F.min(key).alias("least")).join(parts, "_set", "left")
    copies = written(copies.where("_n > 1 or component is not null").withColumn("root", F.coalesce("component", "_set")), "copies")
    least = copies.groupBy("root").agg(F.min("least").alias("component_id"))
    several = copies.join(least, "root").where(F.col("least").eqNullSafe(F.col("component_id"))).select("_set", "root", "component_id")
    here = rows.select("_set", *docs.columns)
    alone = here.join(copies.select("_set"), "_set", "left_anti").select(*docs.columns)
    kept = here.join(several, "_set").where(F.col(key).eqNullSafe(F.col("component_id"))).dropDuplicates(["root"]).select(*docs.columns)
    return restored(alone.unionByName(kept))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = near_components(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
