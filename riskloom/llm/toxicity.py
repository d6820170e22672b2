"""Toxicity: a lexicon trie intersected with Levenshtein automata finds terms and misspelled ones, windows tell quotation.

Lexicon. Over a sample of at most SAMPLE labelled rows of each class (those of smallest hash), a word counts the different
pairs of neighbours that it has in toxic and in clean texts, so that copies of a passage count once. Words, and stems of
STEM characters with three forms or more, whose toxic share is beyond chance (a binomial tail bound of 1 / e over all words
together) are the terms, LEXICON of them at most, the surest first.

Automaton. All terms are one trie. Its product with the Levenshtein automaton of one edit (terms from 5 characters on) or
two (from 9 on) is a set of (trie node, edits) pairs; the sets are made into states as texts need them, and a batch's
different words walk the table together, a character a step. Edits are of characters.

Evidence of a word is its log odds of being toxic over the sample's, at least 0, from the counts of the word as written;
a form not in the sample has its term's counts at that distance. A window of six words on each side of a term (quotation
marks around it, words of saying before it, words of address) gives the probability that it is quoted: a logistic model
whose weights start from fixed ones and move with the sample. A text's score is a logistic model of its sum of
evidence and of that sum for the length, less what is quoted, with no weight below 0; each text of the sample is fitted without
its own counts.

Null and empty texts have no words; rows whose label is null are not learned from; an id with several labels counts as
toxic if at least half are; without toxic or without clean rows there are no terms, and all scores are (toxic + 1) /
(labelled + 2) of the sample; repeated rows are scored alike; a text costs a few times its size in a task; an empty table
has no rows; labels, lang, source and ids are never inputs. Words are told apart by 64-bit hashes within a batch.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import NOT_WORD, Words, bucket_of_id, text_chunks, written

SAMPLE = 4000, 12000
LEXICON = 1024
STEM = range(4, 8)
STATES = 100_000
AROUND = 6
THRESHOLD = 0.5

#: Signs that may stand for a letter inside a word; marks that open and close a quotation, besides ".
INNER = b"*@$"
QUOTES = "“”„«»"
#: Words of saying and words of address.
SAYING = frozenset(
    "said says say saying wrote writes written called calls quote quoted quotes word words term terms phrase reported "
    "sagte sagt schrieb nannte zitat wort dit écrit mot citation dijo dice escribió llamó palabra cita".split()
)
ADDRESS = frozenset("you your yours you're u du dich dein ihr euch tu toi te vous ton tú eres usted vos".split())
#: Weights of a window before any learning: constant, marks around, saying, address.
WINDOW = np.array([-3.0, 3.0, 1.5, -1.5])

EXACT, STEMMED = 0, 3


def edits_of(length: int) -> int:
    return 0 if length < 5 else 1 if length < 9 else 2


class Automaton:
    """States of the product of a lexicon trie with Levenshtein automata, made when first needed."""

    def __init__(self, terms: list[tuple[str, bool]]):
        self.terms = terms
        self.children: list[dict[int, int]] = [{}]
        self.word: list[int] = [-1]
        self.stem: list[int] = [-1]
        self.limit: list[int] = [0]
        for t, (term, stem) in enumerate(terms):
            node, limit = 0, 0 if stem else edits_of(len(term))
            self.limit[0] = max(self.limit[0], limit)
            for ch in map(ord, term):
                if ch not in self.children[node]:
                    self.children[node][ch] = len(self.children)
                    self.children.append({})
                    self.word.append(-1)
                    self.stem.append(-1)
                    self.limit.append(0)
                node = self.children[node][ch]
                self.limit[node] = max(self.limit[node], limit)
            (self.stem if stem else self.word)[node] = t
        self.letters = np.array(sorted({c for x in self.children for c in x}), np.uint32)
        self.longest = max((len(t) for t, stem in terms), default=0) + 2
        self.clear()

    def clear(self) -> None:
        self.known: dict[frozenset, int] = {}
        self.sets: list[dict] = []
        self.found: list[tuple[int, int, int]] = []
        self.table = np.full((1024, len(self.letters) + 1), -1, np.int32)
        self._state({})
        self.start = self._state(self._closed({0: 0}))

    def _closed(self, held: dict[int, int]) -> dict[int, int]:
        """A state with the nodes that a missing letter reaches; stems in it are kept for good, as node -1 - term."""
        todo = list(held)
        for node in todo:
            if node < 0:
                continue
            used = held[node] + 1
            for child in self.children[node].values():
                if used <= self.limit[child] and used < held.get(child, 9):
                    held[child] = used
                    todo.append(child)
        for node, used in list(held.items()):
            if node >= 0 and used == 0 and self.stem[node] >= 0:
                held[-1 - self.stem[node]] = 0
        return held

    def _state(self, held: dict[int, int]) -> int:
        mark = frozenset(held.items())
        if mark not in self.known:
            self.known[mark] = len(self.sets)
            whole = min(((used, self.word[n]) for n, used in held.items() if n >= 0 and self.word[n] >= 0 and used <= edits_of(len(self.terms[self.word[n]][0]))), default=(9, -1))
            stem = max((-1 - n for n in held if n < 0), default=-1, key=lambda t: len(self.terms[t][0]))
            self.sets.append(held)
            self.found.append((*whole, stem))
            if len(self.sets) > len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
        return self.known[mark]

    def _step(self, state: int, letter: int) -> int:
        ch = int(self.letters[letter - 1]) if letter else -1
        out: dict[int, int] = {}
        for node, used in self.sets[state].items():
            if node < 0:
                out[node] = 0
                continue
            if used < self.limit[node]:
                out[node] = min(out.get(node, 9), used + 1)
            for c, child in self.children[node].items():
                cost = used + (c != ch)
                if cost <= self.limit[child] and cost < out.get(child, 9):
                    out[child] = cost
        return self._state(self._closed(out))

    def match(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each word the term that it meets, -1 if none, and how: 0 to 2 edits, or STEMMED."""
        n, width = len(words), self.longest
        if not n or not self.terms:
            return np.full(n, -1), np.zeros(n, np.int64)
        if len(self.sets) > STATES:
            self.clear()
        lengths = np.fromiter(map(len, words), np.int64, n)
        chars = np.array(words, f"U{width}").view(np.uint32).reshape(n, width)
        at = np.searchsorted(self.letters, chars)
        letters = np.where(self.letters[np.minimum(at, len(self.letters) - 1)] == chars, at + 1, 0)
        state = np.full(n, self.start, np.int64)
        for i in range(width):
            live = np.flatnonzero((lengths > i) & (state > 0))
            then = self.table[state[live], letters[live, i]]
            if (then < 0).any():
                new = np.unique(np.column_stack([state[live], letters[live, i]])[then < 0], axis=0)
                for s, c in new.tolist():
                    to = self._step(s, c)
                    self.table[s, c] = to
                then = self.table[state[live], letters[live, i]]
            state[live] = then
        used, whole, stem = np.array(self.found)[state].T
        whole = np.where(lengths <= width, whole, -1)
        exact = (whole >= 0) & (used == 0)
        term = np.where(exact | (stem < 0), whole, stem)
        return term, np.where(exact | (stem < 0), used, STEMMED)


def _words(texts: list[bytes]) -> Words:
    """Words of letters, digits and the signs of INNER between them; marks of QUOTES become " and keep their width."""
    for mark in QUOTES:
        raw = mark.encode()
        texts = [t.replace(raw, b'"'.ljust(len(raw))) for t in texts]
    words = Words(texts, bytes(x for x in NOT_WORD if x not in INNER))
    plain = np.ones(256, bool)
    plain[np.frombuffer(NOT_WORD, np.uint8)] = False
    places = np.flatnonzero(plain[words.bytes])
    first, last = np.searchsorted(places, words.start), np.searchsorted(places, words.end) - 1
    some = first <= last
    words.start, words.end, words.doc = places[first[some]], places[last[some]] + 1, words.doc[some]
    words.counts = np.bincount(words.doc, minlength=len(texts))
    return words


def _strings(words: Words, at: np.ndarray, longest: int = 64) -> list[str]:
    """The words as text; of longer ones the first bytes, which no whole term matches then."""
    return [words.joined[a : min(b, a + 4 * longest)].decode(errors="ignore") for a, b in zip(words.start[at].tolist(), words.end[at].tolist(), strict=True)]


def _logit(x: np.ndarray) -> np.ndarray:
    return np.log(x) - np.log1p(-x)


def ridge_logistic(x: np.ndarray, y: np.ndarray, mean: np.ndarray, precision: float) -> np.ndarray:
    """Weights of the highest posterior under a normal prior, by Newton steps with halving."""
    w = mean.astype(float).copy()

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.logaddexp(0, z).sum() - y @ z + precision / 2 * ((w - mean) ** 2).sum())

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + precision * (w - mean)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + precision * np.eye(len(w)), slope)
        size = 1.0
        while loss(w - size * step) > loss(w) and size > 1e-6:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return w


@dataclass
class ToxicModel:
    """base: log odds of the sample's contexts; surfaces: counts of the forms seen; spread: those of (term, how)."""

    terms: list[tuple[str, bool]] = field(default_factory=list)
    base: float = 0.0
    surfaces: dict[str, tuple[int, int]] = field(default_factory=dict)
    spread: dict[tuple[int, int], tuple[int, int]] = field(default_factory=dict)
    window: np.ndarray = field(default_factory=lambda: WINDOW)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(3))

    def evidence(self, word: str, term: int, how: int, label: int = -1) -> float:
        """Log odds of the form over the sample's; label: of the text whose own context is not to count."""
        sums = np.array(self.spread.get((term, how), (0, 0)), float)
        a, b = self.surfaces.get(word, (0, 0))
        if label >= 0 and a + b:
            own = np.array([label, 1 - label])
            sums, (a, b) = np.maximum(sums - own, 0), (max(a - label, 0), max(b - 1 + label, 0))
        share = (sums[0] + 1) / (sums.sum() + 2)
        share = (a + share) / (a + b + 1)
        return max(0.0, math.log(share / (1 - share)) - self.base)


def _window(words: Words, i: int) -> np.ndarray:
    """Of word i: constant, marks around it, saying before it, address on either side."""
    lo = max(i - AROUND, int(np.searchsorted(words.doc, words.doc[i])))
    hi = min(i + AROUND, int(np.searchsorted(words.doc, words.doc[i], side="right")) - 1)
    start, end = words.start[lo : hi + 1].tolist(), words.end[lo : hi + 1].tolist()
    at = i - lo
    first = max(start[0] - 4, 0)
    before, after = (words.joined[a:b].decode(errors="ignore") for a, b in ((first, start[at]), (end[at], end[-1] + 4)))
    near = [words.joined[a:b].decode(errors="ignore") for a, b in zip(start, end, strict=True)]
    return np.array([1, before.count('"') % 2 == 1 and '"' in after, not SAYING.isdisjoint(near[:at]), not ADDRESS.isdisjoint(near)], float)


class Finder:
    """Terms in texts, by a model."""

    def __init__(self, model: ToxicModel):
        self.model, self.automaton = model, Automaton(model.terms)

    def hits(self, texts: list[bytes], labels: list[int] | None = None) -> list[tuple[int, int, int, str, str, int, float, np.ndarray]]:
        """(text, start, end, word, term, how, evidence, window) of each term with evidence; places are bytes in the text."""
        words = _words(texts)
        if not len(words.start) or not self.model.terms:
            return []
        _, at, which = np.unique(words.hash(), return_index=True, return_inverse=True)
        strings = _strings(words, at)
        term, how = self.automaton.match(strings)
        plain = np.array([t >= 0 and self.model.evidence(s, t, h) > 0 for s, t, h in zip(strings, term.tolist(), how.tolist(), strict=True)])
        begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
        out = []
        for i in np.flatnonzero(plain[which]).tolist():
            d, u = int(words.doc[i]), int(which[i])
            t, h = int(term[u]), int(how[u])
            found = self.model.evidence(strings[u], t, h, labels[d] if labels else -1)
            out.append((d, int(words.start[i] - begin[d]), int(words.end[i] - begin[d]), strings[u], self.model.terms[t][0], h, found, _window(words, i)))
        return out

    def features(self, sizes: np.ndarray, hits: list) -> np.ndarray:
        """A row a text: constant, the log of 1 + the sum of evidence that is not quoted, and the same for a hundred bytes
        of text (and some more, for short texts)."""
        total = np.zeros(len(sizes))
        for d, *_, found, window in hits:
            total[d] += found / (1 + math.exp(float(window @ self.model.window)))
        return np.column_stack([np.ones(len(sizes)), np.log1p(total), np.log1p(100 * total / (sizes + 300))])


def _sample(docs: DataFrame, labels: DataFrame, label: str, key: str, text: str, sample: tuple[int, int]) -> DataFrame:
    """(label, text) of the sampled rows, one a labelled id: those of smallest hash in each class."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("_label"))
    parts = [known.where(F.col("_label") == c).orderBy(F.xxhash64(key), key).limit(sample[1 - c]) for c in (1, 0)]
    chosen = parts[0].union(parts[1])  # the sample's ids at most are broadcast
    found = docs.select(key, F.col(text).alias("_text")).join(F.broadcast(chosen), key).groupBy(key).agg(F.first("_label").alias("_label"), F.min("_text").alias("_text"))
    return written(found.select("_label", "_text"), "toxic-sample")


def _counts(rows: DataFrame) -> DataFrame:
    """(word, a, b): between how many different pairs of neighbours toxic and clean texts have the word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches, "_text"):
            words = _words(texts)
            if not len(words.start):
                continue
            hashes = words.hash()
            near = np.zeros(len(hashes), np.uint64)
            same = words.doc[1:] == words.doc[:-1]
            near[1:][same] = hashes[:-1][same]
            near[:-1][same] += hashes[1:][same] * np.uint64(0x9E3779B97F4A7C15)
            label = np.asarray(part.column("_label"))[words.doc]
            _, at = np.unique(hashes * np.uint64(3) + near * np.uint64(6) + label.astype(np.uint64), return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(_strings(words, at)), pa.array(near[at].view(np.int64)), pa.array(label[at])], ["word", "near", "label"])

    rows = rows.mapInArrow(run, "word string, near long, label int")
    places = rows.groupBy("word", "near").agg(F.max("label").alias("a"), F.max(1 - F.col("label")).alias("b"))
    return written(places.groupBy("word").agg(F.sum("a").cast("int").alias("a"), F.sum("b").cast("int").alias("b")), "toxic-words")


def _terms(counts: DataFrame, most: int) -> tuple[list[tuple[str, bool]], float]:
    """Words and stems whose toxic share is beyond chance, and the log odds of a toxic context."""
    size, a, b = counts.agg(F.count("*"), F.sum("a"), F.sum("b")).first()
    if not a or not b:
        return [], 0.0
    share, (x, y) = a / (a + b), (F.col("a"), F.col("b"))
    part = lambda k, p: F.when(k > 0, k * F.log(k / (x + y) / p)).otherwise(0.0)
    gain = F.when(x > share * (x + y), part(x, share) + part(y, 1 - share)).otherwise(0.0)
    sure = counts.where("a > 2").withColumn("gain", gain).where(F.col("gain") > math.log(size) + 1)
    words = sure.where("a > b and length(word) between 3 and 32").orderBy(F.desc("gain"), "word").limit(most).select("word").collect()
    stems = counts.where("a > 0 or b > 0").select("a", "b", F.explode(F.array(*[F.when(F.length("word") > n, F.substring("word", 1, n)) for n in STEM])).alias("word")).where("word is not null")
    stems = stems.groupBy("word").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.count_if(F.col("a") > 0).alias("forms")).where("forms > 2 and a > 4 * b")
    stems = stems.withColumn("gain", gain).where(F.col("gain") > math.log(size) + 1).orderBy(F.desc("gain"), "word").limit(most // 4).select("word").collect()
    return [(w, False) for (w,) in words] + [(w, True) for (w,) in stems], math.log(a / b)


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", sample: tuple[int, int] = SAMPLE, lexicon: int = LEXICON) -> ToxicModel:
    """The model of a sample of labelled ids; the caller has left the held-out ids out."""
    rows = _sample(docs, labels, label, key, text, sample)
    n, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("_label"), F.lit(0))).first()
    model = ToxicModel(weights=np.array([math.log((toxic + 1) / (n - toxic + 1)), 0, 0]))
    if toxic in (0, n):
        return model
    counts = _counts(rows)
    model.terms, model.base = _terms(counts, lexicon)
    if not model.terms:
        return model
    spark = docs.sparkSession
    terms = spark.sparkContext.broadcast(model.terms)  # `lexicon` terms and a quarter as many stems at most

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(terms.value)
        for batch in batches:
            term, how = automaton.match(batch.column("word").to_pylist())
            met = pa.array(term >= 0)
            columns = [*(batch.column(c) for c in ("word", "a", "b")), pa.array(term.astype(np.int32)), pa.array(how.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["word", "a", "b", "term", "how"]).filter(met)

    for word, a, b, term, how in counts.mapInArrow(matched, "word string, a int, b int, term int, how int").toLocalIterator():  # forms in the sample that a term meets
        model.surfaces[word] = (a, b)
        sums = model.spread.get((term, how), (0, 0))
        model.spread[term, how] = (sums[0] + a, sums[1] + b)
    shared = spark.sparkContext.broadcast(model)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(shared.value)
        for part, texts in text_chunks(batches, "_text"):
            labels = part.column("_label").to_pylist()
            hits, sizes = [[] for _ in texts], [len(t) for t in texts]
            for d, _, _, _, _, how, found, window in finder.hits(texts, labels):
                hits[d].append([found, how, *window[1:].tolist()])
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(sizes, pa.int32()), pa.array(hits, pa.list_(pa.list_(pa.float64())))], ["label", "size", "hits"])

    found = rows.mapInArrow(windows, "label int, size int, hits array<array<double>>").toArrow().to_pydict()  # a row a sampled text
    y = np.array(found["label"], float)
    hits = [(d, int(h[1]), h[0], np.array([1.0, *h[2:]])) for d, hs in enumerate(found["hits"]) for h in hs]
    seen = [(w, 1 - y[d]) for d, how, _, w in hits if how == EXACT]
    if seen:
        model.window = ridge_logistic(np.stack([w for w, _ in seen]), np.array([q for _, q in seen]), WINDOW, 25.0)
    x = Finder(model).features(np.array(found["size"]), hits)
    weights = ridge_logistic(x, y, np.zeros(3), 0.1)
    while (weights[1:] < 0).any():
        x = x * np.array([True, *(weights[1:] > 0)])
        weights = ridge_logistic(x, y, np.zeros(3), 0.1)
    model.weights = weights
    return model


HITS = "array<struct<start:int,end:int,found:string,term:string,edits:int,evidence:double,quoted:double>>"


def score_toxicity(docs: DataFrame, model: ToxicModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns in keep (all by default), score between 0 and 1, and hits: byte places of terms, the form found, the
    term, its edits (null for a form of a stem), evidence and the probability that it is quoted."""
    keep = docs.columns if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the lexicon and the sample's forms of it, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        finder = Finder(model)
        for part, texts in text_chunks(batches, "_text"):
            hits = finder.hits(texts)
            z = finder.features(np.array([len(t) for t in texts]), hits) @ model.weights
            spans: list[list[dict]] = [[] for _ in texts]
            for d, a, b, word, term, how, found, window in hits:
                quoted = 1 / (1 + math.exp(-float(window @ model.window)))
                spans[d].append({"start": a, "end": b, "found": word, "term": term, "edits": None if how == STEMMED else how, "evidence": found, "quoted": quoted})
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("found", pa.string()), ("term", pa.string()), ("edits", pa.int32()), ("evidence", pa.float64()), ("quoted", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30)))), pa.array(spans, kind)], [*keep, "score", "hits"])

    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, f"{fields}score double, hits {HITS}")


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model that learns from the labelled ids whose crc32 % 5 is not 0."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit_toxicity(docs, labels.where(bucket_of_id("doc_id", 5) != 0))
    found = score_toxicity(docs, model, keep=["doc_id"])
    return found.select("doc_id", (bucket_of_id("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
