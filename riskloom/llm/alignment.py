"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, and how common each such pair is.

Tasks encode a batch of texts with both tokenizers, turn tokens into byte spans and look up, with pandas merge_asof keyed
by document, the other side's token that covers each token's start. A pair of tokens overlaps exactly if one of the two
starts inside the other, so the union of both directions holds every overlapping pair, once where both start together.
Bytes where a token of either side ends cut the text into groups.

A pair of ids counts the documents that hold it linked. Documents are written with their distinct pairs, counts are a
grouping over them. A pair missing in a table of the common pairs (TABLE of them at most: those of a count no smaller
than a bound that a histogram of the counts gives) has the count one, if all pairs of count two and more are in the
table; else the rest are joined by pair, from those documents that hold them. So what is broadcast is bounded, and the
shuffle holds rare pairs alone. The highest count of each A id is a table of the vocabulary's size.

Texts null, empty, or not given back by the tokens of either side have no tokens: zeros and an empty groups_sha256.
Repeated rows are documents of their own; a null doc_id is kept; other columns are not read; an empty table has no rows.
A text is encoded as a whole: a task holds some 200 bytes for each byte of its longest text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import text_chunks, written
from riskloom.llm.packing import encoder

TABLE = 1 << 22
#: Steps of the histogram of counts, an octave.
STEPS = 8
TEXT = 1 << 20


class Side:
    """A tokenizer: encode(texts) gives a list of ids each; pieces are the bytes of each id, sizes their lengths."""

    def __init__(self, encode, pieces: list[bytes]):
        self.encode, self.pieces = encode, pieces
        self.sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))


def byte_level_side(ranks: str | None = None, file: str | None = None) -> Side:
    """The byte-level vocabulary; ids are those of the tokenizers file, special strings are ordinary text."""
    import base64

    import public_tokenizers

    ranks = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(ranks, "rb") as lines:
        known = {int(b): base64.b64decode(a) for a, b in map(bytes.split, lines)}
    encode = encoder(ranks, file=file)
    return Side(lambda texts: [encode(" " + t) for t in texts], [known.get(i, b"") for i in range(max(known) + 1)])


def piece_side(file: str | None = None) -> Side:
    """The sentencepiece vocabulary; pieces are UTF-8 with U+2581 for a space, or single bytes."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=file or public_tokenizers.path("piece_bpe_32k.model"))
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    pieces = [bytes([int(x[3:5], 16)]) if model.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
    return Side(lambda texts: model.encode(texts, num_threads=1), pieces)


@cache
def sides(ranks: str | None = None, file: str | None = None, model: str | None = None) -> tuple[Side, Side]:
    """Both tokenizers, once a process."""
    return byte_level_side(ranks, file), piece_side(model)


@cache
def _names(separator: str, size: int) -> list[bytes]:
    return [b"%s%d" % (separator.encode(), i) for i in range(size)]


class Spans:
    """Tokens of some texts on one axis: ids, text (its place), start and end in bytes, texts a byte apart."""

    def __init__(self, side: Side, found: list[list[int]], sizes: np.ndarray):
        self.counts = np.fromiter(map(len, found), np.int64, len(found))
        self.ids = np.fromiter((i for x in found for i in x), np.int64, int(self.counts.sum()))
        self.text = np.repeat(np.arange(len(found)), self.counts)
        base = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]).astype(np.int64) if len(sizes) else np.zeros(0, np.int64)
        lengths = side.sizes[self.ids]
        ends = np.cumsum(lengths)
        before = np.concatenate([[0], ends])[np.cumsum(self.counts) - self.counts]
        self.end = ends - np.repeat(before, self.counts) + base[self.text]
        self.start = self.end - lengths


def links(a: Spans, b: Spans) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of all tokens of a and b whose spans overlap, each pair once."""
    left = pd.DataFrame({"at": a.start, "text": a.text, "i": np.arange(len(a.ids))})
    right = pd.DataFrame({"at": b.start, "text": b.text, "j": np.arange(len(b.ids))})
    j = pd.merge_asof(left, right, on="at", by="text")["j"].to_numpy(np.int64)
    i = pd.merge_asof(right, left, on="at", by="text")["i"].to_numpy(np.int64)
    own = a.start[i] != b.start
    return np.concatenate([left["i"].to_numpy(), i[own]]), np.concatenate([j, right["j"].to_numpy()[own]])


def group_texts(a: Spans, b: Spans, texts: int) -> tuple[np.ndarray, list[bytes]]:
    """The number of groups of each text, and the groups' written form: `a1,a2|b1;a3|b2,b3`."""
    def closing(x: np.ndarray, other: np.ndarray) -> np.ndarray:
        return other[np.minimum(np.searchsorted(other, x), len(other) - 1)] == x if len(other) else np.zeros(len(x), bool)

    shut_a, shut_b = closing(a.end, b.end), closing(b.end, a.end)
    of_a, of_b = np.cumsum(shut_a) - shut_a, np.cumsum(shut_b) - shut_b
    groups = np.bincount(a.text[shut_a], minlength=texts)
    size = int(max(a.ids.max(initial=0), b.ids.max(initial=0))) + 1
    table = [*_names(";", size), *_names(",", size), *_names("|", size)]
    first_a, first_b = np.diff(of_a, prepend=-1) != 0, np.diff(of_b, prepend=-1) != 0
    codes = np.empty(len(a.ids) + len(b.ids), np.int64)
    codes[np.arange(len(a.ids)) + np.searchsorted(of_b, of_a)] = a.ids + np.where(first_a, 0, size)
    codes[np.arange(len(b.ids)) + np.searchsorted(of_a, of_b, side="right")] = b.ids + np.where(first_b, 2 * size, size)
    cuts = np.concatenate([[0], np.cumsum(a.counts + b.counts)]).tolist()
    return groups, [b"".join(map(table.__getitem__, codes[x:y].tolist()))[1:] for x, y in zip(cuts, cuts[1:], strict=False)]


def _encoded(side: Side, texts: list[str], raw: list[bytes]) -> tuple[list[list[int]], np.ndarray]:
    found = side.encode(texts)
    return found, np.fromiter((b"".join(map(side.pieces.__getitem__, ids)) == b" " + r for ids, r in zip(found, raw, strict=True)), bool, len(raw))


ALIGNED = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>, times array<int>"


def aligned(docs: DataFrame, key: str = "doc_id", text: str = "text", ranks: str | None = None, file: str | None = None, model: str | None = None) -> DataFrame:
    """A row per document: key, n_a, n_b, n_groups, n_links, groups_sha256, and its distinct linked pairs with their number
    of links. A pair is a * (ids of the second vocabulary) + b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = sides(ranks, file, model)
        wide = len(two.pieces)
        for part, raw in text_chunks(batches, text, TEXT):
            n = len(raw)
            texts = [x.decode() for x in raw]
            found_a, ok = _encoded(one, texts, raw)
            found_b, also = _encoded(two, texts, raw)
            ok &= also & (np.fromiter(map(len, raw), np.int64, n) > 0)
            sizes = np.fromiter((len(x) + 1 for x in raw), np.int64, n)
            a, b = (Spans(s, [x if k else [] for x, k in zip(f, ok.tolist(), strict=True)], sizes) for s, f in ((one, found_a), (two, found_b)))
            i, j = links(a, b)
            groups, written_groups = group_texts(a, b, n)
            marks, times = np.unique((a.text[i] << 32) | (a.ids[i] * wide + b.ids[j]), return_counts=True)
            offsets = np.searchsorted(marks >> 32, np.arange(n + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (marks & 0xFFFFFFFF, times)]
            sha = [hashlib.sha256(x).hexdigest() if k else "" for x, k in zip(written_groups, ok.tolist(), strict=True)]
            columns = [part.column(key), *(pa.array(x, pa.int64()) for x in (a.counts, b.counts, groups, np.bincount(a.text[i], minlength=n))), pa.array(sha, pa.string()), *lists]
            yield pa.RecordBatch.from_arrays(columns, [key, "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, {ALIGNED}")


def align(docs: DataFrame, key: str = "doc_id", text: str = "text", table: int = TABLE, ranks: str | None = None, file: str | None = None, model: str | None = None) -> DataFrame:
    """A row per document: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    rows = written(aligned(docs, key, text, ranks, file, model), "aligned")
    wide, size = (len(x.pieces) for x in sides(ranks, file, model)[::-1])
    step = F.floor(F.log2("n") * STEPS).cast("int")
    counts = written(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pair-counts")
    steps = counts.where("n > 1").groupBy(step.alias("s")).agg(F.count("*").alias("k")).orderBy(F.desc("s")).collect()  # STEPS an octave at most
    held, bound = 0, 1 << 30
    for s, k in steps:
        if held + k > table:
            break
        held, bound = held + k, s
    rest = bool(steps) and bound > steps[-1][0]
    common = counts.where((F.col("n") > 1) & (step >= bound)).toArrow().sort_by("pair")
    best = np.zeros(size, np.int64)
    for a, n in counts.groupBy(F.expr(f"pair div {wide}").alias("a")).agg(F.max("n")).collect():  # a row an id of the vocabulary
        best[a] = n
    shared = docs.sparkSession.sparkContext.broadcast((common["pair"].to_numpy(), common["n"].to_numpy(), best))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, numbers, best = shared.value
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            n = batch.num_rows
            pairs, times = (np.asarray(batch.column(c).flatten()) for c in ("pairs", "times"))
            owner = np.repeat(np.arange(n), np.asarray(batch.column("pairs").value_lengths()))
            at = np.minimum(np.searchsorted(keys, pairs), len(keys) - 1)
            hit = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
            number = np.where(hit, numbers[at] if len(keys) else 1, 1)
            left = ~hit & rest
            number[left] = 0
            top = ~left & (number == best[pairs // wide])
            sums = [np.bincount(owner, w, n).astype(np.int64) for w in (times * top, times * number)]
            offsets = np.concatenate([[0], np.cumsum(np.bincount(owner[left], minlength=n))]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x[left])) for x in (pairs, times)]
            kept = [batch.column(c) for c in (key, "n_a", "n_b", "n_groups", "n_links", "groups_sha256")]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(x) for x in sums), *lists, pa.array(np.arange(row, row + n))], [key, "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum", "pairs", "times", "row"])
            row += n

    kind = docs.schema[key].dataType.simpleString()
    scored = rows.mapInArrow(run, f"`{key}` {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, pairs array<int>, times array<int>, row long")
    out = [key, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if not rest:
        return scored.select(*out)
    scored = written(scored, "aligned-rest")
    tops = docs.sparkSession.createDataFrame([(int(a), int(best[a])) for a in np.flatnonzero(best)], "a int, top long")  # of the vocabulary's size
    open_pairs = scored.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", "p.pairs", "p.times")
    found = open_pairs.join(counts, open_pairs["pairs"] == counts["pair"]).withColumn("a", F.expr(f"pair div {wide}").cast("int")).join(F.broadcast(tops), "a")
    found = found.groupBy("row").agg(F.sum(F.when(F.col("n") == F.col("top"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    total = scored.join(found, "row", "left")
    return total.withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))}).select(*out)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's tokens of byte_bpe_50k.json aligned with those of piece_bpe_32k.model, with corpus-wide counts."""
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"))
