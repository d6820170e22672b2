"""Best-fit packing of token sequences: bounded-space, online, one pass per task.

A task keeps a fixed number of open bins. A bitset has a bit for each free space that some open bin has; the lowest
set bit at or above a piece's length is its best fit. When no bin fits and all are open, the fullest closes.
Documents longer than a bin are cut from their end, so that only the first piece may be shorter than a bin.
State is the open bins alone; tasks share nothing, so there is no shuffle and lost tasks are simply run again.

Null and empty texts are the end token alone; repeated rows are packed each; other columns are not read; an empty table
has no rows. A text is encoded as a whole, so a task holds some 50 bytes for each byte of its longest text.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator
import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

CAPACITY = 2048
OPEN_BINS = 256

#: From this length on, a run of white space is more than tiktoken's pattern may have to go back over.
LONG_RUN = 100_000
_LONG_BLANK = re.compile(r"\s{%d}" % LONG_RUN)

_encoders: dict[tuple, object] = {}


def encoder(path: str | None = None, pattern: str | None = None, added: str | None = None, file: str | None = None):
    """A function from text to ids of the public byte-level vocabulary at path (ranks in tiktoken's format).

    It gives the ids that the tokenizers library gives with the same vocabulary, in a third of the time. The added
    tokens of the tokenizers file `added` are matched in the text, as that library does; without it their strings
    are ordinary text. A text with a run of white space too long for the pattern goes to that library itself, with the
    vocabulary in `file` (the public one by default).
    """
    import public_tokenizers
    import tiktoken

    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    if (path, added) not in _encoders:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        special = {}
        if added:
            with open(added, encoding="utf-8") as file:
                special = {x["content"]: x["id"] for x in json.load(file)["added_tokens"]}
        _encoders[path, added] = tiktoken.Encoding("packing", pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    found = _encoders[path, added]

    def encode(text: str) -> list[int]:
        if len(text) >= LONG_RUN and _LONG_BLANK.search(text):
            from tokenizers import Tokenizer

            slow = Tokenizer.from_file(added or file or public_tokenizers.path("byte_bpe_50k.json"))
            slow.encode_special_tokens = not added
            return slow.encode(text, add_special_tokens=False).ids
        return found.encode(text, allowed_special="all") if added else found.encode_ordinary(text)

    return encode


def contract_encoder(path: str | None = None):
    """The encoder of byte_bpe_50k.json with its added tokens; of the ranks alone, if another path is given."""
    import public_tokenizers

    return encoder(path, added=None if path else public_tokenizers.path("byte_bpe_50k.json"))


class OpenBins:
    """Bounded-space best fit: place(length) gives (bin, offset)."""

    def __init__(self, capacity: int = CAPACITY, most: int = OPEN_BINS):
        self.capacity, self.most = capacity, most
        self.bits, self.open, self.made = 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        held = self.by_free[free]
        found = held.pop()
        if not held:
            self.bits &= ~(1 << free)
        self.open -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            found = self._take(free)
        else:
            if length < self.capacity and self.open == self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, found = self.capacity, self.made
            self.made += 1
        left = free - length
        if left:
            self.by_free[left].append(found)
            self.bits |= 1 << left
            self.open += 1
        return found, self.capacity - free


PIECES = "piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, open_bins: int = OPEN_BINS, end: int = 0, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """A row per piece: key, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked for)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, bins = contract_encoder(path), OpenBins(capacity, open_bins)
        base = TaskContext.get().partitionId() << 36
        for batch in batches:
            rows: list[tuple] = []
            for k, t in zip(batch.column(key), batch.column(text), strict=True):
                ids = np.array([*encode(t.as_py() or ""), end], "<u4")
                raw, cut = ids.tobytes(), len(ids) % capacity or capacity
                for piece, (a, b) in enumerate([(0, min(cut, len(ids))), *((i, i + capacity) for i in range(cut, len(ids), capacity))]):
                    found, offset = bins.place(b - a)
                    rows.append((k.as_py(), piece, a, b - a, zlib.crc32(raw[4 * a : 4 * b]), base + found, offset, ids[a:b].tolist() if with_ids else None))
            for i in range(0, len(rows), 4096):
                columns = list(zip(*rows[i : i + 4096], strict=True))
                kinds = [batch.column(key).type, pa.int32(), *[pa.int64()] * 5, pa.list_(pa.int32())][: 7 + with_ids]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=False)], [key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids"][: 7 + with_ids])

    schema = f"{key} {docs.schema[key].dataType.simpleString()}, {PIECES}" + ", ids array<int>" * with_ids
    return docs.select(key, text).mapInArrow(run, schema)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
