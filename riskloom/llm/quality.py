"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)): pairs are scored in time
linear in a text's features by the sum-of-squares identity. Features: words hashed to WORDS places, by the root
of their share of the text's words; STATS statistics of the text's structure and metadata (its length in words and in
characters, counted from the whole text), each as a value and as one of BINS steps. The model is fitted on a sample of at most SAMPLE labelled rows, chosen by hash
and sent to the driver as features; every row is scored, in tasks that hold about a megabyte of text.

Null and empty texts have the statistics of an empty text; rows whose label is null are not learned from; an
id that has several labels counts as 1 if at least half are; without labelled rows every score is 0.5; repeated
rows are scored alike; labels, lang, source and ids are never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import BLANKS, Words, bucket_of_id, set_aside, text_chunks

WORDS = 1 << 15
STATS = 12
BINS = 10
RANK = 4
SAMPLE = 8000
THRESHOLD = 0.7
FEATURES = WORDS + STATS * (BINS + 1)

_UPPER, _DIGIT, _MARK, _HIGH, _LETTER, _LINE, _STOP = (np.zeros(256, bool) for _ in range(7))
_UPPER[65:91] = _DIGIT[48:58] = _HIGH[128:] = True
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_STOP[[33, 44, 46, 58, 59, 63, 39, 34, 45]] = True
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER |= _HIGH
_LINE[10] = True


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, value) of every feature that is not zero, texts in order."""
    n = len(texts)
    words = Words(texts, BLANKS)
    raw = np.frombuffer(b" ".join(texts), np.uint8)
    sizes = np.fromiter((len(t) for t in texts), np.int64, n)
    ends = np.cumsum(sizes + 1)[:-1] if n else np.zeros(0, np.int64)
    first = np.concatenate([[0], ends]).astype(np.int64)

    def total(values: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return sums[np.minimum(first + sizes, len(values))] - sums[np.minimum(first, len(values))]

    count = words.counts
    places = (words.hash() >> np.uint64(40)).astype(np.int64) % WORDS
    pairs, times = np.unique(words.doc * WORDS + places, return_counts=True)
    doc, place = pairs // WORDS, pairs % WORDS
    share = times / count[doc]
    distinct = np.bincount(doc, minlength=n)
    most = np.zeros(n)
    np.maximum.at(most, doc, share)
    lengths = np.bincount(words.doc, words.end - words.start, minlength=n)
    last = raw[words.end - 1] if len(raw) else np.zeros(0, np.uint8)
    odd_end = np.bincount(words.doc, _MARK[last] & ~_STOP[last], minlength=n)
    bang_end = np.bincount(words.doc, last == 33, minlength=n)
    letters = total(_LETTER[raw])
    per = lambda a, b: a / np.maximum(b, 1)
    expected = np.sqrt(np.maximum(count, 1))
    chars = sizes - total((raw & 0xC0) == 0x80)
    stats = np.column_stack([
        per(total(_UPPER[raw]), letters), per(total(_MARK[raw]), sizes), per(total(_MARK[raw] & ~_STOP[raw]), sizes), per(total(_DIGIT[raw]), sizes),
        per(odd_end, count), per(bang_end, count), np.minimum(per(lengths, count) / 20, 1), per(distinct, count),
        most, np.log1p(count) / 12, np.minimum(per(total(_LINE[raw]), expected), 1), np.log1p(chars) / 14,
    ])
    stats = np.clip(stats, 0, 1)
    bins = np.minimum((np.sqrt(stats) * BINS).astype(np.int64), BINS - 1)
    rows = np.repeat(np.arange(n), STATS)
    by_value = WORDS + np.tile(np.arange(STATS), n)
    by_bin = WORDS + STATS + np.tile(np.arange(STATS) * BINS, n) + bins.ravel()
    doc = np.concatenate([doc, rows, rows])
    place = np.concatenate([place, by_value, by_bin])
    value = np.concatenate([np.sqrt(share), stats.ravel(), np.full(len(rows), 0.5)])
    order = np.lexsort((place, doc))
    return doc[order], place[order], value[order].astype(np.float32)


@dataclass
class FactorisationMachine:
    w0: float
    w: np.ndarray
    v: np.ndarray

    def scores(self, n: int, doc: np.ndarray, place: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Scores of n texts, each with at least one feature, from their features in order."""
        if not n:
            return np.zeros(0)
        starts = np.searchsorted(doc, np.arange(n))
        xv = value[:, None] * self.v[place]
        sums, squares = np.add.reduceat(xv, starts, axis=0), np.add.reduceat(xv * xv, starts, axis=0)
        z = self.w0 + np.add.reduceat(value * self.w[place], starts) + 0.5 * (sums * sums - squares).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))

    @classmethod
    def fit(cls, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seen_rows: int = 64_000, rate: float = 0.08, penalty: float = 2e-5, seed: int = 7) -> FactorisationMachine:
        """AdaGrad on the logistic loss, in small batches of texts, over about seen_rows rows in all; words move at a fifth of the statistics' rate."""
        rng = np.random.default_rng(seed)
        model = cls(0.0, np.zeros(FEATURES, np.float32), rng.normal(0, 0.01, (FEATURES, RANK)).astype(np.float32))
        if not len(rows):
            return model
        mean = np.clip(labels.mean(), 0.01, 0.99)
        model.w0 = float(np.log(mean / (1 - mean)))
        seen = [np.full(1, 1e-2), np.full(FEATURES, 1e-2, np.float32), np.full((FEATURES, RANK), 1e-2, np.float32)]
        speed = np.full(FEATURES, rate, np.float32)
        speed[:WORDS] /= 5
        for _ in range(max(1, -(-seen_rows // len(rows)))):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), 64):
                batch = order[at : at + 64]
                place = np.concatenate([rows[i][0] for i in batch])
                value = np.concatenate([rows[i][1] for i in batch])
                doc = np.repeat(np.arange(len(batch)), [len(rows[i][0]) for i in batch])
                error = (model.scores(len(batch), doc, place, value) - labels[batch]) / len(batch)
                xv = value[:, None] * model.v[place]
                sums = np.add.reduceat(xv, np.searchsorted(doc, np.arange(len(batch))), axis=0)
                e = error[doc].astype(np.float32)
                own, where = np.unique(place, return_inverse=True)
                gw = np.bincount(where, e * value, len(own)).astype(np.float32) + penalty * model.w[own]
                gv = np.stack([np.bincount(where, e * value * (sums[doc, f] - xv[:, f]), len(own)) for f in range(RANK)], axis=1).astype(np.float32) + penalty * model.v[own]
                g0 = error.sum()
                seen[0] += g0 * g0
                seen[1][own] += gw * gw
                seen[2][own] += gv * gv
                model.w0 -= rate * float(g0 / np.sqrt(seen[0][0]))
                model.w[own] -= speed[own] * gw / np.sqrt(seen[1][own])
                model.v[own] -= speed[own, None] * gv / np.sqrt(seen[2][own])
        return model


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> FactorisationMachine:
    """The model of a sample of at most `sample` labelled ids, those of smallest hash; the caller has left the held-out ids out."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("float").alias("_label"))
    known = known.orderBy(F.xxhash64(key), key).limit(sample)
    chosen = docs.select(key, text).join(F.broadcast(known), key).dropDuplicates([key])  # `sample` rows at most are broadcast

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches, text):
            doc, place, value = features(texts)
            cuts = np.searchsorted(doc, np.arange(1, len(texts)))
            lists = [pa.array([x.tolist() for x in np.split(c, cuts)], pa.list_(t)) for c, t in ((place.astype(np.int32), pa.int32()), (value, pa.float32()))]
            yield pa.RecordBatch.from_arrays([part.column("_key"), part.column("_label"), *lists], ["_key", "_label", "place", "value"])

    rows = chosen.select(F.xxhash64(key).alias("_key"), "_label", text).mapInArrow(run, "_key long, _label float, place array<int>, value array<float>")
    found = rows.toArrow().sort_by("_key")
    places, values = (found[c].combine_chunks() if found.num_rows else None for c in ("place", "value"))
    if places is None:
        return FactorisationMachine.fit([], np.zeros(0))
    ends = np.asarray(places.offsets)
    place, value = np.asarray(places.values), np.asarray(values.values)
    return FactorisationMachine.fit([(place[a:b], value[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], found["_label"].to_numpy().astype(np.float64))


def score_quality(docs: DataFrame, model: FactorisationMachine, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns in keep (all by default) and score, between 0 and 1."""
    keep = docs.columns if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES x (RANK + 1) floats, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches, "_text"):
            scores = shared.value.scores(len(texts), *features(texts))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(scores, pa.float64())], [*keep, "score"])

    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, f"{fields}score double")


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs whose score is at least the threshold, by the model that op9 fits."""
    learned = labels.where(bucket_of_id("doc_id", 4) != 2)
    own, restored = set_aside(docs, "doc_id", "text")
    return restored(score_quality(own, fit_quality(own, learned)).where(F.col("score") >= threshold))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit_quality(docs, labels.where(bucket_of_id("doc_id", 4) != 2))
    found = score_quality(docs, model, keep=["doc_id"])
    return found.select("doc_id", (bucket_of_id("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
