"""Language-model scoring with a hierarchical Pitman-Yor model learned from all training documents.

Every word is a dish and, as the token before, a context: each context has a restaurant, all share one parent, whose
base is uniform over the words, the end token and one unknown. No word, context or pair is left out or folded.

The HELD most frequent words have places in a sorted array that is sent to the tasks, so a pair of them is a key of 40
bits. Tasks count their pairs, and packed keys and counts are dealt out by ranges of keys: each part is put in order once,
and no pair is a row of a shuffle. Pairs with another word are dealt out as both words' hashes, and are rows from there on.
A pair that occurs once has one table whatever the sample, so only pairs that occur twice or more have a state; what the
single ones add to their context's and their word's tables follows from the word counts (a word is a context as often as
it occurs, for the end token begins the next text). Seating is sampled by Gibbs steps on the number of tables of each pair:
with the parent's predictive p and the context's other tables T, p(t) is proportional to S(c, t) (theta + T d | d)_t p^t,
with generalised Stirling numbers S (Teh 2006); pairs with more than EXACT customers seat them in turn, in growing groups.
A sweep seats the parent, then the pairs, given their words' predictives and their contexts' tables. For held words, tasks
sum a sweep's tables into arrays, tasks by SPAN of places add those up and seat the parent, and the new values are sent to
the tasks; other words and pairs are grouped and joined. Predictive probabilities are averaged over SAMPLES sweeps after
BURN_IN. Draws are seeded by words and sweep, so they don't hang on partitions or on what is held.

Scoring deals the texts' pairs out in the same way, a key and a text's place packed into one integer, to meet the learned
pairs in tasks of at most about PART of them, which sum by text: a row a part and flush (some FLUSH tokens), not a pair. A
pair not learned twice is seen once, if a text learned from has it, or never, and meets the words' tables: those of held
words in the task, of others by joins. The PAIRS most frequent pairs are scored by the tasks that read the texts, and
held words are counted there; that spares rows and changes none.

Words and texts are told apart by 64-bit hashes: two of n clash with a chance of about n^2 / 2^65 (3e-8 at a million).
Pairs are kept apart by both words' hashes. Null and empty texts are the end token alone; null ids are hashed as an
empty text for the split and kept; repeated rows are learned and scored each; a text is held whole in its task,
whatever its length; if nothing is learned from, every probability is that of the base.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import BLANKS, Words, bucket_of_id, discard, scratch, text_chunks, text_of, written

PAIRS = 1 << 18
HELD = 1 << 20
PART = 1 << 21
SPAN = 1 << 17
COUNTED = 3 << 19
FLUSH = 1 << 20
BLOCK = 1 << 16
EXACT = 512
BURN_IN = 3
SAMPLES = 4
STRENGTH = 1.0

END = np.int64(0x5EED << 8)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every token in order, the end token after each text."""
    words = Words(texts, BLANKS)
    h = words.hash().view(np.int64)
    at = np.arange(len(h)) + words.doc
    n = len(texts)
    out, doc = np.full(len(h) + n, END, np.int64), np.zeros(len(h) + n, np.int64)
    out[at], doc[at] = h, words.doc
    ends = np.cumsum(words.counts + 1) - 1
    doc[ends] = np.arange(n)
    return out, doc


def mixed(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A 64-bit key of each pair, to sort by."""
    x = u.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) + w.view(np.uint64)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _summed(h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(h, kind="stable")
    h, c = h[order], c[order]
    starts = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    return h[starts], np.add.reduceat(c, starts) if len(h) else c


def word_counts(docs: DataFrame, text: str = "text", most: int = 750_000) -> DataFrame:
    """(h, c): tokens of docs and their counts, summed in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def out(h: np.ndarray, c: np.ndarray):
            for i in range(0, len(h), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(h[i : i + (1 << 17)]), pa.array(c[i : i + (1 << 17)])], ["h", "c"])

        for _, texts in text_chunks(batches, text):
            h, c = np.unique(tokens(texts)[0], return_counts=True)
            held.append((h, c.astype(np.int64)))
            size += len(h)
            if size > 2 * most:
                held = [_summed(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                size = len(held[0][0])
                if size > most:
                    yield from out(*held.pop())
                    size = 0
        if held:
            yield from out(*_summed(*(np.concatenate(x) for x in zip(*held, strict=True))))

    return docs.select(text).mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def _grouped(u: np.ndarray, w: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct pairs and the sums of their values; pairs of one key that differ stay apart, at worst in several rows."""
    order = np.argsort(mixed(u, w))
    u, w = u[order], w[order]
    starts = np.flatnonzero(np.append(True, (u[1:] != u[:-1]) | (w[1:] != w[:-1]))) if len(u) else np.zeros(0, np.int64)
    return u[starts], w[starts], *(np.add.reduceat(x[order], starts) if len(u) else x for x in values)


class Places:
    """Places of integers in a sorted array; -1 of those that are not there. Most are found by one look at a table of slots."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.slots = None

    def __getstate__(self):
        return {"keys": self.keys, "slots": None}

    def _slot(self, x: np.ndarray) -> np.ndarray:
        return (x.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def place(self, x: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(x), -1)
        if self.slots is None:
            bits = max(8, (4 * len(self.keys) - 1).bit_length())
            self.shift = np.uint64(64 - bits)
            slot = self._slot(self.keys)
            slots = np.full(1 << bits, -1, np.int32)
            slots[slot] = np.arange(len(self.keys), dtype=np.int32)
            self.shared = np.zeros(1 << bits, bool)
            self.shared[slot[slots[slot] != np.arange(len(self.keys))]] = True
            self.slots = slots
        slot = self._slot(x)
        out = self.slots[slot].astype(np.int64)
        out[self.keys[out] != x] = -1
        left = np.flatnonzero((out < 0) & self.shared[slot])
        at = np.minimum(np.searchsorted(self.keys, x[left]), len(self.keys) - 1)
        out[left] = np.where(self.keys[at] == x[left], at, -1)
        return out


_KEY, _REST = 40, 23  # bits of a key, and of what is packed below it
_MIX = np.int64(0x9E3779B97F)
_UNMIX = np.int64(pow(0x9E3779B97F, -1, 1 << _KEY))
_MASK, _LOW, _WORD = np.int64((1 << _KEY) - 1), np.int64((1 << _REST) - 1), np.int64((1 << 20) - 1)


def near_key(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A key of 40 bits of two places of held words, one to one, and evenly spread."""
    return ((u << np.int64(20) | w) * _MIX) & _MASK


def places_of(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = (key * _UNMIX) & _MASK
    return x >> np.int64(20), x & _WORD


def _cuts(packed: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """(part, slice) of sorted packed keys: parts are ranges of keys."""
    bounds = np.array([-(-(i << _KEY) // parts) << _REST for i in range(parts)], np.int64)
    cuts = np.append(np.searchsorted(packed, bounds), len(packed))
    for i in np.flatnonzero(np.diff(cuts)).tolist():
        yield i, packed[cuts[i] : cuts[i + 1]]


def _pairs_of(texts: list[bytes], held: Places):
    """Of the tokens: the texts' places, both words, both places among the held, and whether both are held."""
    h, doc = tokens(texts)
    w = held.place(h)
    first = np.array([END])
    u, iu = np.concatenate([first, h[:-1]]), np.concatenate([held.place(first), w[:-1]])
    return doc, u, h, iu, w, (iu >= 0) & (w >= 0)


def _batches(rows: list[tuple], names: list[str], kinds: list, limit: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Batches of the rows, of about `limit` bytes."""
    size, some = 0, []
    for i, row in enumerate(rows):
        some.append(row)
        size += sum(len(x) for x in row if isinstance(x, bytes))
        if size > limit or i == len(rows) - 1:
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in some], k) for j, k in enumerate(kinds)], names)
            size, some = 0, []


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """A row at a time, for blocks are large."""
    for i in range(batch.num_rows):
        yield tuple(x[i].as_py() for x in batch.columns)


def _longs(*columns: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(x, np.int64).tobytes() for x in columns)


def _columns(packed: bytes, n: int) -> np.ndarray:
    return np.frombuffer(packed, np.int64).reshape(n, -1)


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int32) if len(x) and x.max() < 1 << 31 else x


def _wide(packed: bytes, n: int) -> np.ndarray:
    """n integers that were packed as they are or by _narrow."""
    return np.frombuffer(packed, np.int32 if len(packed) == 4 * n else np.int64).astype(np.int64)


_STATE = ["kind", "range", "key", "c", "t", "sum", "far", "idx", "x", "y", "total", "twos"]
_STATE_KINDS = "kind int, range int, key binary, c binary, t binary, sum binary, far binary, idx binary, x binary, y binary, total long, twos long"
_STATE_TYPES = [pa.int32(), pa.int32(), *[pa.binary()] * 8, pa.int64(), pa.int64()]


def pair_counts(rows: DataFrame, held, parts: int) -> DataFrame:
    """Blocks of the pairs that texts have twice or more and their counts: kind 0 with both words held, kind 1 of others.

    Tasks count first; packed keys and counts are dealt out by ranges of keys, and each part is put in order once.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near: list[np.ndarray] = []
        far: list[tuple] = []

        def out() -> Iterator[pa.RecordBatch]:
            if not near:
                return
            key = np.concatenate(near)
            near.clear()
            key.sort()
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
            key, c = key[starts], np.diff(np.append(starts, len(key)))
            while len(c) and c.max() > _LOW:  # of one text of millions of tokens: in several entries
                more = np.flatnonzero(c > _LOW)
                key, c = np.concatenate([key, key[more]]), np.concatenate([np.minimum(c, _LOW), c[more] - _LOW])
                order = np.argsort(key, kind="stable")
                key, c = key[order], c[order]
            packed = key << np.int64(_REST) | c
            del key, c, starts
            found = [(i, x.tobytes(), None) for i, x in _cuts(packed, parts)]
            u, w = (np.concatenate(x) for x in zip(*far, strict=True))
            u, w, c = _grouped(u, w, np.ones(len(u), np.int64))
            found += [(i, None, _longs(u[x], w[x], c[x])) for i, x in _blocks(u, w, parts)]
            far.clear()
            del packed
            yield from _batches(found, ["part", "near", "far"], [pa.int32(), pa.binary(), pa.binary()])

        size = 0
        for _, texts in text_chunks(batches, "_text"):
            _, u, w, iu, iw, both = _pairs_of(texts, held.value)
            near.append(near_key(iu[both], iw[both]))
            far.append((u[~both], w[~both]))
            size += len(u)
            if size > COUNTED:
                yield from out()
                size = 0
        yield from out()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, far = [], []
        for batch in batches:
            near += [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist() if x is not None]
            far += [_columns(x, 3) for x in batch.column(2).to_pylist() if x is not None]
        if near:
            packed = np.concatenate(near)
            near.clear()
            packed.sort()
            key = packed >> np.int64(_REST)
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            key, c = key[starts], np.add.reduceat(packed & _LOW, starts)
            key, c = key[c > 1], c[c > 1]
            for i in range(0, len(key), BLOCK):
                k, n = key[i : i + BLOCK], c[i : i + BLOCK]
                row = (0, None, _longs(k), _longs(n), np.ones(len(k), np.int32).tobytes(), *[None] * 5, int(n.sum()), int((n == 2).sum()))
                yield from _batches([row], _STATE, _STATE_TYPES)
        if far:
            u, w, c = _grouped(*np.concatenate(far, axis=1))
            u, w, c = (x[c > 1] for x in (u, w, c))
            if len(u):
                yield from _batches([(1, *[None] * 5, _longs(u, w, c), *[None] * 3, int(c.sum()), int((c == 2).sum()))], _STATE, _STATE_TYPES)

    dealt = rows.select("_text").mapInArrow(deal, "part int, near binary, far binary")
    return dealt.repartition(parts, "part").mapInArrow(merge, _STATE_KINDS)


def far_rows(counted: DataFrame) -> DataFrame:
    """(u, w, c) of the blocks of kind 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(y) for y in _columns(x, 3)], ["u", "w", "c"])

    return counted.where("kind = 1").select("far").mapInArrow(run, "u long, w long, c long")


_P = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return x << np.uint64(bits) | x >> np.uint64(64 - bits)


def seeds_of(longs: list[np.ndarray], ints: list[int]) -> np.ndarray:
    """What Spark's xxhash64 gives for columns of longs and then literal ints."""
    p1, p2, p3, p4, p5 = _P
    h = np.full(len(longs[0]), 42, np.uint64)
    for i, x in enumerate([*longs, *ints]):
        if i < len(longs):
            h = h + p5 + np.uint64(8) ^ _turned(x.astype(np.int64).view(np.uint64) * p2, 31) * p1
            h = _turned(h, 27) * p1 + p4
        else:
            h = h + p5 + np.uint64(4) ^ np.array([x & 0xFFFFFFFF], np.uint64) * p1
            h = _turned(h, 23) * p2 + p3
        h ^= h >> np.uint64(33)
        h *= p2
        h ^= h >> np.uint64(29)
        h *= p3
        h ^= h >> np.uint64(32)
    return h.view(np.int64)


def log_stirling(n: int, d: float) -> np.ndarray:
    """Logs of the generalised Stirling numbers S(c, t) of discount d, for c and t up to n."""
    out = np.full((n + 1, n + 1), -np.inf)
    out[0, 0] = 0.0
    t = np.arange(n + 1)
    for c in range(n):
        with np.errstate(divide="ignore"):
            stay = out[c] + np.log(np.maximum(c - t * d, 0))
        out[c + 1] = np.logaddexp(stay, np.append(-np.inf, out[c, :-1]))
    return out


def seat(c: np.ndarray, others: np.ndarray, p: np.ndarray, d: float, strength: float, stirling: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Table counts of dishes with c customers, each given its restaurant's other tables, the parent's predictive p and a seed."""
    out = np.ones(len(c), np.int64)
    few = np.flatnonzero((c > 1) & (c <= EXACT))
    few = few[np.argsort(c[few].astype(np.int16), kind="stable")]
    linear = np.exp(stirling[:17, :17])
    ends = np.searchsorted(c[few], np.arange(1, 17), side="right").tolist()
    for size, a, b in zip(range(2, 17), ends[:-1], ends[1:], strict=True):
        part = few[a:b]
        if len(part):  # products of so few are far from a double's ends
            before, own, product = others[part], p[part], 1.0
            weight = [np.full(len(part), linear[size, 1])]
            for k in range(1, size):
                product = product * ((strength + d * (before + k)) * own)
                weight.append(weight[-1] + linear[size, k + 1] * product)
            drawn = (seeds[part].view(np.uint64) >> np.uint64(11)).astype(float) / (1 << 53) * weight[-1]
            out[part] = 1 + np.minimum(sum((x <= drawn).astype(np.int64) for x in weight), size - 1)
    i = ends[-1]
    while i < len(few):  # rows of at most twice the customers of the first
        part = few[i : int(np.searchsorted(c[few], 2 * c[few[i]], side="right"))][: max(1, (1 << 18) // int(c[few[i]]))]
        i += len(part)
        size = int(c[part[-1]])
        k = np.arange(size)
        step = np.log(strength + d * (others[part, None] + k)) + np.log(p[part])[:, None]
        logits = stirling[c[part], 1 : size + 1] + np.cumsum(step, axis=1)
        weight = np.cumsum(np.exp(logits - logits.max(axis=1, keepdims=True)), axis=1)
        drawn = (seeds[part].view(np.uint64) >> np.uint64(11)).astype(float) / (1 << 53)
        out[part] = 1 + np.minimum((weight <= drawn[:, None] * weight[:, -1:]).sum(axis=1), c[part] - 1)
    for i in np.flatnonzero(c > EXACT):
        rng, tables, seated, total = np.random.default_rng(int(seeds[i]) & (1 << 63) - 1), 1.0, 1.0, float(c[i])
        while total > seated:
            group = min(max(1.0, seated // 4), total - seated)
            new = (strength + d * (others[i] + tables)) * p[i]
            tables += min(rng.poisson(group * new / (new + seated + group / 2 - d * tables)), group)
            seated += group
        out[i] = tables
    return out


_WORDS = ["range", "idx", "c", "ctx", "su", "sw", "t0", "x", "y", "c0", "tu"]
_WORDS_KINDS = "range int, " + ", ".join(f"{x} binary" for x in _WORDS[1:])


def _sums(iu: np.ndarray, iw: np.ndarray, t: np.ndarray, into: np.ndarray) -> None:
    """Adds t to the words' (row 0) and the contexts' (row 1) sums."""
    for row, i in ((0, iw), (1, iu)):
        here = i >= 0
        np.add.at(into[row], i[here], t[here])


def _sum_rows(sums: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of kind 2: sums by held word that are not zero, a row a range."""
    found = np.flatnonzero(sums.any(axis=0))
    rows = []
    for i in np.unique(found // SPAN).tolist():
        at = found[found // SPAN == i]
        rows.append((2, i, *[None] * 5, at.astype(np.int32).tobytes(), _longs(sums[0][at]), _longs(sums[1][at]), None, None))
    yield from _batches(rows, _STATE, _STATE_TYPES)


def _sums_of_rows(rows: DataFrame, held, value: str, sign: int = 1) -> DataFrame:
    """Rows of kind 2 of rows (u, w, value)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, len(held.value.keys)), np.int64)
        for batch in batches:
            u, w, t = (x.to_numpy() for x in batch.columns)
            _sums(held.value.place(u), held.value.place(w), t, sums)
        yield from _sum_rows(sign * sums)

    return rows.select("u", "w", value).mapInArrow(run, _STATE_KINDS)


def _sums_of_blocks(blocks: DataFrame, held, value: str, sign: int = 1) -> DataFrame:
    """Rows of kind 2 of blocks of kind 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, len(held.value.keys)), np.int64)
        for batch in batches:
            for key, t in _rows(batch):
                _sums(*places_of(np.frombuffer(key, np.int64)), _wide(t, len(key) // 8), sums)
        yield from _sum_rows(sign * sums)

    return blocks.where("kind = 0").select("key", value).mapInArrow(run, _STATE_KINDS)


def _word_rows(words: DataFrame, held) -> DataFrame:
    """Blocks of held words from rows (h, c, ctx): all their customers are of pairs seen once, till the others are taken off."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, c, ctx = (x.to_numpy() for x in batch.columns)
            idx = held.value.place(h)
            rows = []
            for i in np.unique(idx // SPAN).tolist():
                at = np.flatnonzero(idx // SPAN == i)
                rows.append((i, idx[at].astype(np.int32).tobytes(), _longs(c[at]), _longs(ctx[at]), _longs(ctx[at]), _longs(c[at]), *[None] * 5))
            yield from _batches(rows, _WORDS, [pa.int32(), *[pa.binary()] * 10])

    return words.select("h", "c", "ctx").mapInArrow(run, _WORDS_KINDS)


def _as_words(sums: DataFrame, x: str, y: str) -> DataFrame:
    """Rows of kind 2 as rows of words, to be added to the columns x and y."""
    name = {x: "x", y: "y"}
    columns = [F.col(name[k]).alias(k) if k in name else F.lit(None).cast("binary").alias(k) for k in _WORDS[2:9]]
    return sums.where("kind = 2").select("range", "idx", *columns)


def seatings(near: DataFrame | None, far: DataFrame | None, words: DataFrame, held, often: Column, size: int, d: float, d0: float = 0.5, burn_in: int = BURN_IN, samples: int = SAMPLES, strength: float = STRENGTH, seed: int = 11) -> tuple[DataFrame | None, DataFrame | None, "WordTables", DataFrame, list[float]]:
    """The averaged predictives of pairs that occur twice or more, as blocks and as rows (u, w, c, p, cw: customers of w, if it is not held), and the words' tables:
    of the held words; of others as rows (h, ctx, q0.., k0..); the predictives of an unknown word.

    near: blocks of kind 0, of held words; far: rows (u, w, c) of the others. words (h, c, ctx): customers as a dish and as a
    context. q are the parent's predictives of a word and k its tables as a context, by sample.
    """
    stirling, stirling0 = log_stirling(EXACT, d), log_stirling(EXACT, d0)
    spark, many = words.sparkSession, len(held.value.keys)
    send, zero = spark.sparkContext.broadcast, F.lit(0).cast("long")

    def seat_held(total: int, sweep: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[int, dict[str, np.ndarray]] = {}
            for batch in batches:
                for row in batch.to_pylist():
                    first = row["range"] * SPAN
                    n = min(SPAN, many - first)
                    own = found.setdefault(row["range"], {k: np.zeros(n, np.int64) for k in _WORDS[2:9]})
                    at = np.frombuffer(row["idx"], np.int32) - first
                    for k in _WORDS[2:9]:
                        if row[k] is not None:
                            own[k][at] += np.frombuffer(row[k], np.int64)
            for i, own in found.items():
                idx = np.arange(i * SPAN, i * SPAN + len(own["c"]), dtype=np.int32)
                c0, tu = own["sw"] + own["x"], own["su"] + own["y"]
                r = seeds_of([held.value.keys[idx]], [sweep, seed])
                t0 = seat(c0, np.maximum(total - own["t0"], 0), np.full(len(c0), 1 / size), d0, strength, stirling0, r) * (c0 > 0)
                row = (i, idx.tobytes(), *(_longs(own[k]) for k in ("c", "ctx", "su", "sw")), _longs(t0), None, None, _longs(c0), _longs(tu))
                yield from _batches([row], _WORDS, [pa.int32(), *[pa.binary()] * 10])

        return run

    def seat_parent(total: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                c, t, r = (batch.column(x).to_numpy() for x in ("c0", "t0", "_r"))
                new = seat(c, np.maximum(total - t, 0), np.full(len(c), 1 / size), d0, strength, stirling0, r) * (c > 0)
                yield batch.set_column(batch.schema.get_field_index("t0"), "t0", pa.array(new)).drop_columns(["_r"])

        return run

    def seat_near(sent, sweep: int, add: bool, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (q_of, tu_of), ctx_of = sent.value, customers_of.value
            h = held.value.keys
            sums = np.zeros((2, 0 if last else many), np.int64)
            for batch in batches:
                for key, c, t, total in _rows(batch):
                    k = np.frombuffer(key, np.int64)
                    n, t = (_wide(x, len(k)) for x in (c, t))
                    iu, iw = places_of(k)
                    q, tu = q_of[iw], tu_of[iu]
                    if add:
                        total = (0.0 if total is None else np.frombuffer(total)) + (n - d * t + (strength + d * tu) * q) / (strength + ctx_of[iu])
                    if not last:
                        t = seat(n, tu - t, q, d, strength, stirling, seeds_of([h[iu], h[iw]], [sweep, seed]))
                        _sums(iu, iw, t, sums)
                    row = (0, None, key, _narrow(n).tobytes(), None if last else _narrow(t).tobytes(), (total / samples if last else total).tobytes() if add else None, *[None] * 6)
                    yield from _batches([row], _STATE, _STATE_TYPES)
            if not last:
                yield from _sum_rows(sums)

        return run

    def with_held(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (q_of, tu_of), ctx_of = sent.value, customers_of.value
            for batch in batches:
                iu, iw = (held.value.place(batch.column(x).to_numpy()) for x in ("u", "w"))
                columns = [pa.array(x[i], k, mask=i < 0) if many else pa.nulls(len(i), k) for x, i, k in ((q_of, iw, pa.float64()), (tu_of, iu, pa.int64()), (ctx_of, iu, pa.int64()))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "q", "tu", "ctx"])

        return run

    def seat_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, t, q, tu, r = (batch.column(x).to_numpy() for x in ("c", "t", "q", "tu", "_r"))
            new = seat(c, tu - t, q, d, strength, stirling, r)
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("u", "w", "c")), pa.array(new), batch.column("sum")], ["u", "w", "c", "t", "sum"])

    def by_word(value: str, x: str, y: str) -> DataFrame:
        both = far.select(F.col("w").alias("h"), F.col(value).alias(x), zero.alias(y)).union(far.select("u", zero, value))
        return both.groupBy("h").agg(F.sum(x).alias(x), F.sum(y).alias(y))

    fixed = "c <= 1 and ctx <= 1"  # a word that occurs once, or never, has no table to draw
    rest = words.where(~often)
    once = rest.where(fixed)
    alone = once.agg(F.coalesce(F.sum("c"), zero)).first()[0]
    seated = rest.where(f"not ({fixed})")
    if far is not None:
        seated = seated.join(by_word("c", "dw", "du"), "h", "left")
        seated = seated.select("h", "c", "ctx", (F.col("ctx") - F.coalesce("du", zero)).alias("su"), (F.col("c") - F.coalesce("dw", zero)).alias("sw"), zero.alias("t0"))
    else:
        seated = seated.select("h", "c", "ctx", F.col("ctx").alias("su"), F.col("c").alias("sw"), zero.alias("t0"))
    seated = written(seated, "words")
    rest_table = seated
    if seated.isEmpty():
        seated = None
    blocks = None
    if many:
        blocks = _word_rows(words.where(often), held).select(*_WORDS[:9])
        minus = [] if near is None else [_sums_of_blocks(near, held, "c", -1)]
        minus += [] if far is None else [_sums_of_rows(far, held, "c", -1)]
        for one in minus:
            blocks = blocks.union(_as_words(one, "sw", "su"))
    if far is not None:
        far = written(far.select("u", "w", "c", F.lit(1).cast("long").alias("t"), F.lit(0.0).alias("sum")), "seating")
    sums = None if near is None else _sums_of_blocks(near, held, "t")
    total, drawn_of, taken, table, customers_of = 0, [], [], None, None
    for sweep in range(burn_in + samples + 1):
        add, last = sweep > burn_in, sweep == burn_in + samples
        customers = tables = alone
        if many:
            now = blocks
            if sums is not None:
                now = now.union(_as_words(sums, "x", "y"))
            if far is not None:
                now = now.union(_as_words(_sums_of_rows(far, held, "t"), "x", "y"))
            now = written(now.repartition(-(-many // SPAN), "range").mapInArrow(seat_held(total, sweep), _WORDS_KINDS), "words")
            if table is not None:
                discard(table)
            table, blocks = now, now.select(*_WORDS[:9])
            c0, t0, tu, ctx = (np.zeros(many, np.int64) for _ in range(4))
            for i, *packed in zip(*(x.to_pylist() for x in now.select("range", "c0", "t0", "tu", "ctx").toArrow().columns), strict=True):
                for into, x in zip((c0, t0, tu, ctx), packed, strict=True):
                    into[i * SPAN : i * SPAN + SPAN] = np.frombuffer(x, np.int64)
            customers, tables = customers + int(c0.sum()), tables + int(t0.sum())
        if seated is not None:
            now = seated.select("h", "c", "ctx", "su", "sw", "t0", *[x for x in seated.columns if x[0] in "abk" and x[1:].isdigit()])
            if far is not None:
                now = now.join(by_word("t", "x", "y"), "h", "left")
            else:
                now = now.withColumn("x", zero).withColumn("y", zero)
            now = now.withColumn("c0", F.col("sw") + F.coalesce("x", zero)).withColumn("tu", F.col("su") + F.coalesce("y", zero)).drop("x", "y")
            fields = ", ".join(f"{x} long" for x in now.columns)
            now = written(now.withColumn("_r", F.xxhash64("h", F.lit(sweep), F.lit(seed))).mapInArrow(seat_parent(total), fields), "words")
            found = now.agg(F.coalesce(F.sum("c0"), zero), F.coalesce(F.sum("t0"), zero)).first()
            customers, tables = customers + found[0], tables + found[1]
            discard(rest_table)
            rest_table = seated = now
        total = tables
        if customers_of is None:
            customers_of = send(_narrow(ctx) if many else np.zeros(0, np.int32))
        smooth = (strength + d0 * total) / size
        q = (c0 - d0 * t0 + smooth) / (strength + customers) if many else np.zeros(0)
        sent = send((q, _narrow(tu) if many else np.zeros(0, np.int32)))
        if add:
            taken.append(sent)
            drawn_of.append((customers, total))
        words_now = None
        if seated is not None:
            words_now = seated.withColumn("q", (F.col("c0") - d0 * F.col("t0") + smooth) / (strength + customers))
            if add:
                s = sweep - burn_in - 1
                seated = seated.withColumn(f"a{s}", F.col("c0")).withColumn(f"b{s}", F.col("t0")).withColumn(f"k{s}", F.col("tu"))
        if near is not None:
            new = near.where("kind = 0").select("key", "c", "t", "sum").mapInArrow(seat_near(sent, sweep, add, last), _STATE_KINDS)
            new = written(new, "seating")
            discard(near)
            near = sums = new
        if far is not None:
            met = far.select("u", "w", "c", "t", "sum").mapInArrow(with_held(sent), "u long, w long, c long, t long, sum double, q double, tu long, ctx long")
            if words_now is not None:
                met = met.join(words_now.select(F.col("h").alias("w"), F.col("q").alias("_q"), *([F.col("c").alias("cw")] if last else [])), "w", "left").join(words_now.select(F.col("h").alias("u"), F.col("tu").alias("_tu"), F.col("ctx").alias("_ctx")), "u", "left")
                for x in ("q", "tu", "ctx"):
                    met = met.withColumn(x, F.coalesce(x, f"_{x}"))
            if add:
                met = met.withColumn("sum", F.col("sum") + (F.col("c") - d * F.col("t") + (strength + d * F.col("tu")) * F.col("q")) / (strength + F.col("ctx")))
            if last:
                new = met.select("u", "w", "c", (F.col("sum") / samples).alias("p"), F.col("cw") if words_now is not None else zero.alias("cw"))
            else:
                seeded = F.xxhash64("u", "w", F.lit(sweep), F.lit(seed)).alias("_r")
                new = met.select("u", "w", "c", "t", "sum", "q", "tu", seeded).mapInArrow(seat_pairs, "u long, w long, c long, t long, sum double")
            new = written(new, "seating")
            discard(far)
            far = new
        if not add:
            sent.destroy()
    unknown = [(strength + d0 * t) / size / (strength + n) for n, t in drawn_of]
    tables = WordTables(customers_of, taken)
    least = [((1 - d0) / (strength + n) * F.col("c") + x).alias(f"q{s}") for s, ((n, _), x) in enumerate(zip(drawn_of, unknown, strict=True))]
    names = [f"k{s}" for s in range(samples)]
    others = once.select("h", "ctx", *least, *(F.col("ctx").alias(x) for x in names))
    if seated is not None:
        parent = [((F.col(f"a{s}") - d0 * F.col(f"b{s}") + (strength + d0 * t) / size) / (strength + n)).alias(f"q{s}") for s, (n, t) in enumerate(drawn_of)]
        others = others.union(seated.select("h", "ctx", *parent, *names))
    return near, far, tables, others, unknown


def averaged_predictive(counts: DataFrame, m: int) -> np.ndarray:
    """m x m matrix of log10 P(dish | context) of counts (u, w, c) of dishes below m: the model of a small vocabulary, whole."""
    sums = lambda x: counts.groupBy(F.col(x).cast("long").alias("h")).agg(F.sum("c").alias(f"n_{x}"))
    words = counts.sparkSession.range(m).toDF("h").join(sums("w"), "h", "left").join(sums("u"), "h", "left").na.fill(0)
    words = words.select("h", F.col("n_w").alias("c"), F.col("n_u").alias("ctx"))
    pairs = counts.select(F.col("u").cast("long").alias("u"), F.col("w").cast("long").alias("w"), "c")
    d = discount(*counts.agg(F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first())
    none = counts.sparkSession.sparkContext.broadcast(Places(np.zeros(0, np.int64)))
    _, known, _, stats, _ = seatings(None, written(pairs.where("c > 1"), "pairs"), words, none, F.lit(False), m, d)
    every = stats.select(F.col("h").alias("u")).crossJoin(stats.select(F.col("h").alias("w")))
    other = with_words(every.join(pairs, ["u", "w"], "left").withColumn("one", F.coalesce(F.col("c") == 1, F.lit(False))), stats, d, [0.0] * SAMPLES)
    out = np.zeros((m, m))
    for u, w, p in other.join(known, ["u", "w"], "left").select("u", "w", F.coalesce("p", "other")).toLocalIterator():
        out[u, w] = p
    return np.log10(out)


def discount(ones: int, twos: int) -> float:
    return float(np.clip(ones / max(ones + 2 * twos, 1), 0.1, 0.9))


def with_words(rows: DataFrame, words: DataFrame, d: float, unknown: list[float]) -> DataFrame:
    """rows (u, w, one) with `other`: the averaged predictive of a pair seen once (one) or never, from both words' samples;
    and `cw`, how often w is seen as a context."""
    k, q = [f"k{s}" for s in range(len(unknown))], [f"q{s}" for s in range(len(unknown))]
    met = rows.join(words.select(F.col("h").alias("u"), F.col("ctx").alias("_ctx"), *k), "u", "left").join(words.select(F.col("h").alias("w"), F.col("ctx").alias("cw"), *q), "w", "left")
    from_parent = sum(((STRENGTH + d * F.coalesce(a, F.lit(0))) * F.coalesce(b, F.lit(x)) for a, b, x in zip(k, q, unknown, strict=True)), F.lit(0.0)) / len(unknown)
    return met.withColumn("other", (F.when(F.col("one"), 1 - d).otherwise(0.0) + from_parent) / (STRENGTH + F.coalesce("_ctx", F.lit(0)))).withColumn("cw", F.coalesce("cw", F.lit(0))).drop("_ctx", *k, *q)


class Frequent:
    """Keys of pairs that are sent to the tasks, with the log10 of their probability."""

    def __init__(self, key: np.ndarray, log_p: np.ndarray):
        order = np.argsort(key)
        self.places, self.log_p = Places(key[order]), log_p[order]


class WordTables:
    """Of the held words, as sent to the tasks: customers as a context, and each sample's predictives and tables."""

    def __init__(self, ctx, samples: list):
        self.ctx, self.samples = ctx, samples

    def other(self, u: np.ndarray, w: np.ndarray, one: np.ndarray, d: float) -> np.ndarray:
        """with_words of pairs of places."""
        parent = sum((STRENGTH + d * x.value[1][u]) * x.value[0][w] for x in self.samples) / len(self.samples)
        return (np.where(one, 1 - d, 0.0) + parent) / (STRENGTH + self.ctx.value[u])


def held_rows(spark: SparkSession, held, tables) -> DataFrame:
    """The held words' tables as rows (h, ctx, q0.., k0..), made in tasks."""
    names = [f"{x}{s}" for x in "qk" for s in range(SAMPLES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                span = slice(i, i + SPAN)
                columns = [held.value.keys[span], tables.ctx.value[span].astype(np.int64)]
                columns += [x.value[0][span] for x in tables.samples] + [x.value[1][span].astype(np.int64) for x in tables.samples]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["h", "ctx", *names])

    kinds = ", ".join(f"{x} {'double' if x[0] == 'q' else 'long'}" for x in names)
    return spark.range(0, len(held.value.keys), SPAN).mapInArrow(run, f"h long, ctx long, {kinds}")


def most_frequent(near: DataFrame | None) -> Frequent:
    """The most frequent pairs of the blocks, PAIRS of them at most."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, n in _rows(batch):
                c, m = np.unique(_wide(x, n), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(m)], ["c", "m"])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, c, p in _rows(batch):
                at = _wide(c, len(key) // 8) >= least
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(key, np.int64)[at]), pa.array(np.log10(np.frombuffer(p)[at]))], ["k", "lp"])

    least = None
    if near is not None:
        near = near.where("kind = 0")
        least = _least(near.select("c", (F.length("key") / 8).cast("int")).mapInArrow(counts, "c long, m long").groupBy("c").agg(F.sum("m").alias("m")), PAIRS)
    if least is None:
        return Frequent(np.zeros(0, np.int64), np.zeros(0))
    got = near.select("key", "c", "sum").mapInArrow(found, "k long, lp double").toArrow()
    return Frequent(got["k"].to_numpy(), got["lp"].to_numpy())


def _blocks(u: np.ndarray, w: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """(part, places) of the pairs of each part of the pairs, by their key."""
    part = (mixed(u, w) >> np.uint64(33)) % np.uint64(parts)
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))
    for i in np.flatnonzero(np.diff(cuts)).tolist():
        yield i, order[cuts[i] : cuts[i + 1]]


_ASKED = ["part", "flush", "near", "far", "ids", "value", "scored"]
_ASKED_KINDS = "part int, flush long, near binary, far binary, ids binary, value binary, scored binary"
_ASKED_TYPES = [pa.int32(), pa.int64(), *[pa.binary()] * 5]
_MET = ["flush", "ids", "scored", "value", "id", "s", "u", "w", "one", "known", "base"]
_MET_KINDS = "flush long, ids binary, scored binary, value binary, id long, s double, u long, w long, one boolean, known long, base double"
_MET_TYPES = [pa.int64(), *[pa.binary()] * 3, pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.float64()]


def asked_pairs(rows: DataFrame, kept: list[str], held, frequent, counts, base_of: float, parts: int) -> DataFrame:
    """Blocks of the texts' pairs: of held words the key, the text's place in its flush and _learn, packed; of others all
    four columns; and a row a flush with its texts' numbers, sums over frequent pairs, what held words give and the kept columns.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flush, row = TaskContext.get().partitionId() << 32, TaskContext.get().partitionId() << 36
        near, far, ids, scored, sums, stats, own = [], [], [], [], [], [], []
        size = texts_held = 0

        def out() -> Iterator[pa.RecordBatch]:
            if not ids:
                return
            one = pa.concat_arrays(own)
            total = np.concatenate([np.concatenate(sums), np.concatenate(stats, axis=1).ravel()])
            first = [flush % parts, flush, None, None, _longs(*ids), total.tobytes(), np.concatenate(scored).tobytes()]
            arrays = [pa.array([x], k) for x, k in zip(first, _ASKED_TYPES, strict=True)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.ListArray.from_arrays(pa.array([0, len(one)], pa.int32()), one)], [*_ASKED, "kept"])
            packed = np.concatenate(near)
            near.clear()
            packed.sort()
            found = [(i, flush, x.tobytes(), *[None] * 4) for i, x in _cuts(packed, parts)]
            columns = [np.concatenate(x) for x in zip(*far, strict=True)]
            found += [(i, flush, None, _longs(*(x[at] for x in columns)), *[None] * 3) for i, at in _blocks(*columns[:2], parts)]
            kind = pa.list_(one.type)
            for x in (far, ids, scored, sums, stats, own):
                x.clear()
            del packed, columns, one
            for x in _batches(found, _ASKED, _ASKED_TYPES):
                yield pa.RecordBatch.from_arrays([*x.columns, pa.nulls(x.num_rows, kind)], [*_ASKED, "kept"])

        for batch, texts in text_chunks(batches, "_text"):
            doc, u, w, iu, iw, both = _pairs_of(texts, held.value)
            learn, score = (batch.column(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("_learn", "_score"))
            n = len(texts)
            number = row + np.arange(n)
            row += n
            here = iw >= 0
            base = np.log10(counts.value[iw[here]].astype(np.int64) + 1) - base_of
            stats.append([np.bincount(doc, minlength=n).astype(float), np.bincount(doc[here], minlength=n).astype(float), np.bincount(doc[here], base, n).astype(float)])
            key, at = near_key(iu[both], iw[both]), doc[both]
            place = frequent.value.places.place(key)
            hit = place >= 0
            sums.append(np.bincount(at[hit], frequent.value.log_p[place[hit]], n).astype(float))
            key, at = key[~hit], at[~hit]
            near.append(key << np.int64(_REST) | (at + texts_held) << np.int64(1) | learn[at])
            u, w, at, new = u[~both], w[~both], doc[~both], ~here[~both]
            far.append((u, w, number[at], learn[at] | score[at] << 1 | new.astype(np.int64) << 2))
            ids.append(number)
            scored.append(score.astype(bool))
            own.append(pa.StructArray.from_arrays([batch.column(x) for x in kept], kept))
            size += len(doc)
            texts_held += n
            if size > FLUSH:
                yield from out()
                size = texts_held = 0
                flush += 1
        yield from out()

    fields = ", ".join(f"{x}: {rows.schema[x].dataType.simpleString()}" for x in kept)
    return rows.select("_text", "_learn", "_score", *kept).mapInArrow(run, f"{_ASKED_KINDS}, kept array<struct<{fields}>>")


def known_near(near: DataFrame, parts: int) -> DataFrame:
    """Blocks of the learned pairs of held words: keys and log10 probabilities; flush is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, p in _rows(batch):
                key, lp, at, rows = np.frombuffer(key, np.int64), np.log10(np.frombuffer(p)), 0, []
                for i, x in _cuts(key << np.int64(_REST), parts):
                    rows.append((i, None, key[at : at + len(x)].tobytes(), None, None, lp[at : at + len(x)].tobytes(), None))
                    at += len(x)
                yield from _batches(rows, _ASKED, _ASKED_TYPES)

    return near.where("kind = 0").select("key", "sum").mapInArrow(run, _ASKED_KINDS)


def known_far(far: DataFrame, parts: int) -> DataFrame:
    """Blocks of the learned pairs of other words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, w, p, c = (x.to_numpy(zero_copy_only=False) for x in batch.columns)
            rows = [(i, None, None, _longs(u[at], w[at], c[at]), None, np.log10(p[at]).tobytes(), None) for i, at in _blocks(u, w, parts)]
            yield from _batches(rows, _ASKED, _ASKED_TYPES)

    return far.select("u", "w", "p", F.coalesce("cw", F.lit(0).cast("long"))).mapInArrow(run, _ASKED_KINDS)


def scored_pairs(asked: DataFrame, parts: int, tables, d: float, base_of: float) -> DataFrame:
    """By flush, its texts' sums over the pairs of a part; for pairs of words not held what they give (id, s, known, base) or,
    if their probability is not known here, (id, u, w, one), with known if w is to be counted. Rows with the texts of a flush go
    through.

    Blocks of one part meet in one task. A pair not learned twice is seen once, if a text learned from has it, or never.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, blocks, known_of, others = [], [], [], []
        kind = None
        for batch in batches:
            kept = batch.column(len(_ASKED))
            kind = kept.type
            for at, (_, flush, near, far, ids, value, scored) in enumerate(_rows(batch.select(_ASKED))):
                if ids is not None:
                    arrays = [pa.array([x], k) for x, k in zip((flush, ids, scored, value, *[None] * 7), _MET_TYPES, strict=True)]
                    yield pa.RecordBatch.from_arrays([*arrays, kept.slice(at, 1)], [*_MET, "kept"])
                elif flush is None and near is not None:
                    known.append((np.frombuffer(near, np.int64), np.frombuffer(value)))
                elif flush is None:
                    known_of.append((*_columns(far, 3), np.frombuffer(value)))
                elif near is not None:
                    blocks.append((flush, np.frombuffer(near, np.int64)))
                else:
                    others.append(_columns(far, 4))
        found = [near_sums(known, blocks)]
        if others:
            found.append(far_values(known_of, *np.concatenate(others, axis=1)))
        for some in found:
            for x in some:
                yield pa.RecordBatch.from_arrays([*x.columns, pa.nulls(x.num_rows, kind)], [*_MET, "kept"])

    def near_sums(known: list, blocks: list) -> Iterator[pa.RecordBatch]:
        key, lp = (np.concatenate(x) for x in zip(*known, strict=True)) if known else (np.zeros(0, np.int64), np.zeros(0))
        order = np.argsort(key, kind="stable")
        key, lp = key[order], lp[order]
        end = max(len(key) - 1, 0)

        def at(asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            place = np.minimum(np.searchsorted(key, asked), end)
            return place, key[place] == asked if len(key) else np.zeros(len(asked), bool)

        once = [np.zeros(0, np.int64)]
        for _, x in blocks:
            x = x[(x & 1).astype(bool)] >> np.int64(_REST)
            once.append(x[~at(x)[1]])
        once = np.sort(np.concatenate(once))
        for flush, packed in blocks:
            text = (packed & _LOW) >> np.int64(1)
            sums = np.zeros(int(text.max()) + 1)
            for i in range(0, len(packed), BLOCK):
                x = packed[i : i + BLOCK]
                asked, one = x >> np.int64(_REST), (x & 1).astype(bool)
                place, hit = at(asked)
                value = np.empty(len(x))
                value[hit] = lp[place[hit]]
                miss = ~hit
                asked, one = asked[miss], one[miss]
                if len(once):
                    one = one | (once[np.minimum(np.searchsorted(once, asked), len(once) - 1)] == asked)
                value[miss] = np.log10(tables.other(*places_of(asked), one, d))
                sums += np.bincount(text[i : i + BLOCK], value, len(sums))
            yield from _batches([(flush, None, None, sums.tobytes(), *[None] * 7)], _MET, _MET_TYPES)

    def far_values(known: list, u: np.ndarray, w: np.ndarray, ids: np.ndarray, flags: np.ndarray) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        ku, kw, kc, lp = (np.concatenate(x) for x in zip(*known, strict=True)) if known else (none, none, none, np.zeros(0))
        learned, asked, new = (flags & 1) > 0, (flags & 2) > 0, (flags & 4) > 0

        def at(ku: np.ndarray, kw: np.ndarray, order: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            if not len(key):
                return np.zeros(len(u), np.int64), np.zeros(len(u), bool)
            place = order[np.minimum(np.searchsorted(key, mixed(u, w)), len(key) - 1)]
            return place, (ku[place] == u) & (kw[place] == w)

        key = mixed(ku, kw)
        order = np.argsort(key)
        place, hit = at(ku, kw, order, key[order])
        single = learned & ~hit
        key = mixed(u[single], w[single])
        order = np.argsort(key)
        one = at(u[single], w[single], order, key[order])[1]
        met = hit & asked
        own, inverse = np.unique(ids[met], return_inverse=True)
        place, new_met = place[met], new[met]
        sums = [np.bincount(inverse, x, len(own)).astype(float) for x in (lp[place], new_met, np.where(new_met, np.log10(kc[place] + 1) - base_of, 0))]
        nulls = lambda n: [pa.nulls(n, k) for k in _MET_TYPES]
        columns = nulls(len(own))
        columns[4], columns[5], columns[9], columns[10] = pa.array(own), pa.array(sums[0]), pa.array(sums[1].astype(np.int64)), pa.array(sums[2])
        yield pa.RecordBatch.from_arrays(columns, _MET)
        rest = np.flatnonzero(~hit & asked)
        for i in range(0, len(rest), BLOCK):
            x = rest[i : i + BLOCK]
            columns = nulls(len(x))
            columns[4], columns[6], columns[7], columns[8], columns[9] = (pa.array(y[x]) for y in (ids, u, w, one, new.astype(np.int64)))
            yield pa.RecordBatch.from_arrays(columns, _MET)

    fields = asked.schema["kept"].dataType.simpleString()
    return asked.repartition(parts, "part").mapInArrow(run, f"{_MET_KINDS}, kept {fields}")


def summed_flushes(met: DataFrame, parts: int) -> DataFrame:
    """(kept columns, _row, n_tokens, n_known, base_score, s) of the texts of every flush that are scored."""
    fields = met.schema["kept"].dataType.elementType.fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts_of, sums_of = {}, {}
        for batch in batches:
            kept = batch.column(4)
            for at, (flush, ids, scored, value) in enumerate(_rows(batch.select(["flush", "ids", "scored", "value"]))):
                value = np.frombuffer(value)
                if ids is not None:
                    ids = np.frombuffer(ids, np.int64)
                    texts_of[flush] = ids, np.frombuffer(scored, bool), value[len(ids) :].reshape(3, -1), kept.slice(at, 1)
                    value = value[: len(ids)]
                old = sums_of.get(flush, np.zeros(0))
                if len(value) > len(old):
                    old = np.append(old, np.zeros(len(value) - len(old)))
                old[: len(value)] += value
                sums_of[flush] = old
        for flush, (ids, scored, (tokens_of, known, base), kept) in texts_of.items():
            columns = kept.flatten().filter(pa.array(scored)).flatten()
            columns += [pa.array(x[scored]) for x in (ids, tokens_of.astype(np.int64), known.astype(np.int64), base, sums_of[flush])]
            yield pa.RecordBatch.from_arrays(columns, [*(x.name for x in fields), "_row", "n_tokens", "n_known", "base_score", "s"])

    kinds = ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in fields)
    found = met.where("flush is not null").select("flush", "ids", "scored", "value", "kept")
    return found.repartition(parts, "flush").mapInArrow(run, f"{kinds}, _row long, n_tokens long, n_known long, base_score double, s double")


def score_texts(docs: DataFrame, train: DataFrame | Column, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(key, keep, n_tokens, n_known, train_tokens, base_score, score) of docs by the model of train.

    train is a table of texts to learn from, or a condition on docs: the pairs of docs learned from are known to occur.
    """
    keep = [key, *(keep or [])]
    with scratch() as kept:
        scored, sums, n = _scored(docs, train, keep, text)
        kept += [scored, sums]
    zero = F.lit(0)
    out = scored.join(sums, "_row", "left")
    names = [F.col(f"k{i}").alias(x) for i, x in enumerate(keep)]
    return out.select(*names, "n_tokens", (F.col("n_known") + F.coalesce("known", zero)).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("base_score") + F.coalesce("base", zero)).alias("base_score"), (F.col("s") + F.coalesce("far", zero)).alias("score"))


def _scored(docs: DataFrame, train: DataFrame | Column, keep: list[str], text: str) -> tuple[DataFrame, DataFrame, int]:
    """A row per row of docs with what held words and their pairs give, the sums of other words and pairs by _row, and N."""
    given = isinstance(train, DataFrame)
    learn = F.lit(False) if given else F.coalesce(train, F.lit(False))
    own = [f"k{i}" for i in range(len(keep))]
    every = docs.select(text_of(text).alias("_text"), learn.alias("_learn"), F.lit(True).alias("_score"), *(F.col(x).alias(k) for k, x in zip(own, keep, strict=True)))
    if given:
        every = every.union(train.select(text_of(text), F.lit(True), F.lit(False), *(F.lit(None).cast(docs.schema[x].dataType) for x in keep)))
    vocab = written(word_counts(every.where("_learn"), "_text"), "vocabulary")
    n, v = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    size = max(v, 1) + 1  # the end token is a word even of an empty table; one unknown

    send = docs.sparkSession.sparkContext.broadcast
    least, parts = least_count(vocab), 1 + n // PART
    often = F.lit(False) if least is None else F.col("c") >= least
    held = send(Places(np.sort(vocab.where(often).select("h").toArrow()["h"].to_numpy())))
    counted = written(pair_counts(every.where("_learn"), held, parts), "pairs")
    of = {kind: found for kind, *found in counted.groupBy("kind").agg(F.sum("total"), F.sum("twos")).collect()}
    d = discount(n - sum(x for x, _ in of.values()), sum(x for _, x in of.values()))
    words = vocab.select("h", "c", F.col("c").alias("ctx"))
    near, far, tables, others, unknown = seatings(counted if 0 in of else None, far_rows(counted) if 1 in of else None, words, held, often, size, d)
    frequent = send(most_frequent(near))
    base_of = float(np.log10(n + v + 1))

    asked = asked_pairs(every, own, held, frequent, tables.ctx, base_of, parts)
    for one in (None if near is None else known_near(near, parts), None if far is None else known_far(far, parts)):
        asked = asked if one is None else asked.unionByName(one, allowMissingColumns=True)
    met = written(scored_pairs(asked, parts, tables, d, base_of), "met")
    for one in (near, far):
        if one is not None:
            discard(one)
    misses = met.where("u is not null").select("id", "u", "w", "one", "known")
    new = with_words(misses, held_rows(docs.sparkSession, held, tables).union(others), d, unknown)
    counted_now = F.col("known") > 0
    base = F.when(counted_now, F.log10(F.col("cw") + 1) - base_of).otherwise(0.0)
    new = new.select("id", F.log10("other").alias("s"), F.when(counted_now & (F.col("cw") > 0), 1).otherwise(0).cast("long").alias("known"), base.alias("base"))
    now = met.where("s is not null").select("id", "s", "known", "base").union(new)
    sums = now.groupBy(F.col("id").alias("_row")).agg(F.sum("s").alias("far"), F.sum("known").alias("known"), F.sum("base").alias("base"))
    return written(summed_flushes(met, parts), "scores"), written(sums, "sums"), n


def _least(counts: DataFrame, most: int) -> int | None:
    """The least count c that at most `most` reach, of rows (c, how many have it); None if those of the highest are more."""
    counts, held, least = sorted(map(tuple, counts.select("c", "m").collect())), 0, None
    while counts and held + counts[-1][1] <= most:
        least, m = counts.pop()
        held += m
    return least


def least_count(words: DataFrame) -> int | None:
    """The least count c that at most HELD words reach; None if words of the highest are more."""
    return _least(words.groupBy("c").agg(F.count("*").alias("m")), HELD)


def perplexity(scored: DataFrame) -> DataFrame:
    """scored with perplexity: ten to the mean negative log10 probability of a token."""
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.withColumn("held_out", bucket_of_id("doc_id", 7) == 2)
    scored = score_texts(docs, ~F.col("held_out"), keep=["held_out"])
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
