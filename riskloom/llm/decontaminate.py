"""Benchmark decontamination with training suffix arrays.

Each task cuts its documents into shards of bounded size and sorts a shard's word suffixes (prefix doubling over
64-bit word hashes, as deep as the longest benchmark item, ties only after the first round). Every benchmark
suffix is then narrowed word by word with binary searches in the suffix array; what stays after a window's words
are the places where it occurs, and neighbouring windows join into longest verbatim matches, of which only the
item's places that still agree are held. The benchmark goes to the tasks in blocks of about BLOCK_BYTES, some eight
times that as flat arrays; each block is a pass over the documents, which are written after it and hashed again for
the next, so what driver and tasks hold does not grow with the benchmark. No shuffle.

Items without words and items with a null id are passed over, items shorter than a window are one window; null
texts have no words; repeated rows are judged alike; empty tables give none or clean rows; other columns of the
documents are carried along. A text of any length is one shard at least, some fifty bytes a word. Words are told apart
by 64-bit hashes: among n different words two share one with chance n^2 / 2^65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import NOT_WORD, Words, discard, set_aside, text_chunks, written

WINDOW = 13
BLOCK_BYTES = 2 << 20


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """Start places of the suffixes of words (small non-negative ints), in order of their first `depth` words at least."""
    n = len(words)
    first = np.zeros(n + 1, np.int64)
    first[:n] = words + 1
    key = first[:n] * (int(first.max()) + 1) + first[1:]
    order = np.argsort(key, kind="stable")
    near = np.zeros(n, bool)
    near[1:] = key[order][1:] == key[order][:-1]
    rank = np.zeros(n + 1, np.int64)  # one more than the place of the group's first suffix; 0 past the end
    rank[order] = np.maximum.accumulate(np.where(near, 0, np.arange(n))) + 1
    tied = near.copy()
    tied[:-1] |= near[1:]
    slots, h = np.flatnonzero(tied), 2
    while len(slots) and h < depth:
        at = order[slots]
        key = rank[at] * (n + 2) + rank[np.minimum(at + h, n)]
        by = np.argsort(key, kind="stable")
        key, at = key[by], at[by]
        order[slots] = at
        near = np.zeros(len(slots), bool)
        near[1:] = key[1:] == key[:-1]
        rank[at] = slots[np.maximum.accumulate(np.where(near, 0, np.arange(len(slots))))] + 1
        near[:-1] |= near[1:]
        slots, h = slots[near], 2 * h
    return order


def _narrow(words: np.ndarray, order: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges [low, high) of suffixes cut to those whose word at depth is the wanted one; all searched at once."""
    n, ends = len(words), []
    for right in (False, True):
        a, b = low.copy(), high.copy()
        while (open_ := a < b).any():
            mid = (a + b) // 2
            at = order[np.minimum(mid, n - 1)] + depth
            seen = np.where(at < n, words[np.minimum(at, n - 1)], -1)
            after = (seen <= want) if right else (seen < want)
            a = np.where(open_ & after, mid + 1, a)
            b = np.where(open_ & ~after, mid, b)
        ends.append(a)
    return ends[0], ends[1]


class Windows:
    """The distinct windows of a block of benchmark items as flat arrays, with the items and places that hold each.

    words: hashes of the items' words; start, size: each window's first holder in them; holders from `first` on are
    (item, place) rows in order of window, item and place.
    """

    def __init__(self, texts: list[str], width: int):
        words = Words([t.encode() for t in texts], NOT_WORD)
        self.words, self.depth = words.hash(), width
        bounds = np.concatenate([[0], np.cumsum(words.counts)])
        own = np.minimum(words.counts, width)[words.doc]
        places = np.flatnonzero(np.arange(len(self.words)) + own <= bounds[1:][words.doc])
        item, size = words.doc[places], own[places]
        at = places[:, None] + np.arange(width)
        rows = np.where(np.arange(width) < size[:, None], self.words[np.minimum(at, max(len(self.words) - 1, 0))] if len(self.words) else 0, 0)
        rows = np.column_stack([size.astype(np.uint64), rows])
        order = np.lexsort((*rows.T[::-1],)) if len(rows) else np.zeros(0, np.int64)  # stable: items and places stay in order
        rows = rows[order]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
        starts = np.flatnonzero(new)
        self.first = np.append(starts, len(rows))
        self.start, self.size = places[order][starts], size[order][starts]
        self.item, self.place = item[order], (places - bounds[item])[order]

    def __len__(self) -> int:
        return len(self.start)

    def held(self, window: int) -> list[tuple[int, np.ndarray]]:
        """(item, places) of the items that hold the window."""
        a, b = self.first[window], self.first[window + 1]
        item, place = self.item[a:b], self.place[a:b]
        cuts = np.flatnonzero(np.diff(item)) + 1
        return list(zip(item[np.append(0, cuts)].tolist(), np.split(place, cuts), strict=True))


def shard_matches(words: Words, windows: Windows) -> list[tuple[int, int, int, int, int]]:
    """(document, document start, item, item start, words) of the longest matches of a window's length or more.

    A match begins where no earlier one goes on and ends where none of its places in the item agrees any more; of
    several places the first is told.
    """
    if not len(words.start) or not len(windows):
        return []
    known, ids = np.unique(words.hash(), return_inverse=True)
    at = np.arange(len(ids)) + words.doc  # a 0 after each document keeps matches inside it
    text = np.zeros(len(ids) + int(words.doc[-1]) + 1, np.int64)
    text[at] = ids + 1
    order = suffix_array(text, windows.depth)
    place = np.minimum(np.searchsorted(known, windows.words), len(known) - 1)
    wanted = np.where(known[place] == windows.words, place + 1, -2)
    live = np.arange(len(windows))
    low, high = np.zeros(len(live), np.int64), np.full(len(live), len(text), np.int64)
    whole: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for depth in range(windows.depth + 1):
        done = windows.size[live] == depth
        whole.append((live[done], low[done], high[done]))
        live, low, high = live[~done], low[~done], high[~done]
        if not len(live):
            break
        want = wanted[windows.start[live] + depth]
        live, low, high, want = (x[want > 0] for x in (live, low, high, want))
        low, high = _narrow(text, order, low, high, depth, want)
        live, low, high = (x[low < high] for x in (live, low, high))
    found, low, high = (np.concatenate(c) for c in zip(*whole, strict=True))
    if not len(found):
        return []
    counts = high - low
    hits = order[np.repeat(low - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())]
    window = np.repeat(found, counts)
    size = windows.size[window]
    by = np.lexsort((hits, size))
    held: dict[int, list[tuple[int, np.ndarray]]] = {}
    running: dict[tuple[int, int], tuple[int, int, np.ndarray]] = {}
    out: list[tuple[int, int, int, int, int]] = []
    bounds = np.concatenate([[0], np.cumsum(words.counts)])

    def ended(size: int, item: int, first: int, last: int, places: np.ndarray) -> None:
        start = int(np.searchsorted(at, first))
        doc = int(words.doc[start])
        out.append((doc, start - int(bounds[doc]), item, int(places[0]) - (last - first), size + last - first))

    for hit, w, n in zip(hits[by].tolist(), window[by].tolist(), size[by].tolist(), strict=True):
        if w not in held:
            held[w] = windows.held(w)
        for item, places in held[w]:
            before = running.get((n, item))
            if before and before[1] == hit - 1:
                going = before[2] + 1 if len(before[2]) == 1 and len(places) == 1 and before[2][0] + 1 == places[0] else np.intersect1d(before[2] + 1, places, assume_unique=True)
                if len(going):
                    running[n, item] = (before[0], hit, going)
                    continue
            if before:
                ended(n, item, *before)
            running[n, item] = (hit, hit, places)
    for (n, item), before in running.items():
        ended(n, item, *before)
    return sorted(out)


def benchmark_matches(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", keep: list[str] | None = None, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The columns in keep (all by default), n_words, and matches: array of (item_id, item_start, start, words) longest matches."""
    keep = docs.columns if keep is None else keep
    items = items.select(F.col(item_key).cast("string").alias("item"), F.col(item_text).alias("body")).where("item is not null and body is not null")
    total = items.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    blocks = -(-2 * total // block_bytes) if total > block_bytes else 1
    matched = docs.select(*keep, F.lit(0).cast("long").alias("n_words"), F.expr("cast(array() as array<struct<item_id:string,item_start:long,start:long,words:long>>)").alias("matches"), F.col(text).alias("_text"))
    for block in range(blocks):
        if block:  # what the blocks before have found; the table before that is of no more use
            found = written(matched, "matched")
            if block > 1:
                discard(last)
            matched = last = found
        mine = items.where(F.pmod(F.xxhash64("item", "body"), F.lit(blocks)) == block) if blocks > 1 else items
        rows = mine.collect()
        matched = _pass(matched, [r[0] for r in rows], Windows([r[1] for r in rows], window))
    return matched.drop("_text")


def _pass(docs: DataFrame, names: list[str], windows: Windows) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches, "_text"):
            words = Words(texts, NOT_WORD)
            found = part.column("matches").to_pylist()
            for doc, start, item, item_start, size in shard_matches(words, windows):
                found[doc] = [*found[doc], {"item_id": names[item], "item_start": item_start, "start": start, "words": size}]
            out = dict(zip(part.schema.names, part.columns, strict=True))
            out |= {"n_words": pa.array(words.counts.astype(np.int64)), "matches": pa.array(found, part.schema.field("matches").type)}
            yield pa.RecordBatch.from_arrays(list(out.values()), schema=part.schema)

    return docs.mapInArrow(run, docs.schema)


def n_hit(matches: str = "matches") -> Column:
    """Words of the document inside any match."""
    return F.expr(
        f"aggregate(array_sort(transform({matches}, m -> struct(m.start as a, m.start + m.words as b))), struct(0L as n, 0L as e),"
        " (s, m) -> struct(s.n + greatest(0L, m.b - greatest(m.a, s.e)) as n, greatest(s.e, m.b) as e), s -> s.n)"
    )


def judged(matched: DataFrame) -> DataFrame:
    """matched with n_hit, items (sorted as strings) and contaminated: a twentieth of the words, or more, are hit."""
    out = matched.withColumn("n_hit", n_hit()).withColumn("items", F.array_sort(F.array_distinct("matches.item_id")))
    return out.withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the contaminated ones."""
    own, restored = set_aside(docs, "text")
    return restored(judged(benchmark_matches(own, items)).where(~F.col("contaminated")))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words, words hit, items found in it, and whether it is contaminated."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = judged(benchmark_matches(docs, items, keep=["doc_id"]))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
iw AS (SELECT item_id, w, least(13, len(w)) AS size, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS k0 FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, size, array_to_string(w[k0:k0 + size - 1], ' ') AS body FROM iw),
dw AS (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS k0 FROM d, (SELECT DISTINCT size FROM win) s WHERE len(w) >= size),
hit AS (SELECT r, k0, dw.size, item_id FROM dw JOIN win ON win.size = dw.size AND win.body = array_to_string(w[k0:k0 + dw.size - 1], ' ')),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k0, k0 + size)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""
