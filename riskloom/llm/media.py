"""Media columns: Netpbm and BMP bytes to numpy arrays, area resizing by integral images, NPY tiles, difference hashes.

Rows are independent, so every step is a narrow mapInArrow: no shuffle, and a task holds one slice of about
one megabyte (or one row, if that is larger). Null media gives null features, bytes that are no known image
give null features too and `ok` false; repeated rows give repeated results; an empty table gives an empty one; a text or image
may be as long as memory for a few copies of it allows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import TEXT_CHUNK, text_chunks, written

_NETPBM = re.compile(rb"P([1-6])((?:\s|#[^\n]*\n)+)(\d+)((?:\s|#[^\n]*\n)+)(\d+)")


def encode_pgm(pixels: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + pixels.tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """8-bit grey BMP, rows bottom up and padded to four bytes."""
    h, w = pixels.shape
    rows = np.zeros((h, (w + 3) // 4 * 4), np.uint8)
    rows[:, :w] = pixels[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4).copy()
    palette[:, 3] = 0
    head = np.array([40, w, h], "<u4").tobytes() + np.array([1, 8], "<u2").tobytes() + np.array([0, rows.size, 2835, 2835, 256, 0], "<u4").tobytes()
    start = 14 + len(head) + 1024
    return b"BM" + np.array([start + rows.size, 0, start], "<u4").tobytes() + head + palette.tobytes() + rows.tobytes()


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6, as height x width (x 3) of uint8 or, above 255, uint16; bitmaps give 0 for black, 1 for white."""
    m = _NETPBM.match(data)
    if not m:
        raise ValueError("not a Netpbm file")
    kind, w, h = int(m[1]), int(m[3]), int(m[5])
    at, most = m.end(), 1
    if kind not in (1, 4):
        top = re.compile(rb"(?:\s|#[^\n]*\n)+(\d+)").match(data, at)
        if not top or not 0 < len(top[1]) < 6 or not 0 < int(top[1]) < 65536:
            raise ValueError("no greatest value from 1 to 65535")
        at, most = top.end(), int(top[1])
    depth = 3 if kind in (3, 6) else 1
    if kind == 1:
        digits = np.frombuffer(re.sub(rb"#[^\n]*\n|\s", b"", data[at:]), np.uint8)[: w * h]
        out = 1 - (digits - 48)
    elif kind == 4:
        row = (w + 7) // 8
        bits = np.unpackbits(np.frombuffer(data, np.uint8, row * h, at + 1).reshape(h, row), axis=1)[:, :w]
        out = 1 - bits
    elif kind in (2, 3):
        words = re.sub(rb"#[^\n]*\n", b" ", data[at:]).split()[: w * h * depth]
        if any(len(x) > 5 or int(x) > most for x in words):
            raise ValueError("a sample above the greatest value")
        out = np.array(words, dtype=np.int64).astype(np.uint16 if most > 255 else np.uint8)
    else:
        out = np.frombuffer(data, ">u2" if most > 255 else np.uint8, w * h * depth, at + 1)
        out = out.astype(np.uint16) if most > 255 else out
    return out.reshape((h, w, 3) if depth == 3 else (h, w))


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 24 or 32 bits: grey palettes and RGB as height x width (x 3) of uint8."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP file")
    start, size = (int.from_bytes(data[i : i + 4], "little") for i in (10, 14))
    w, h = (int.from_bytes(data[i : i + 4], "little", signed=True) for i in (18, 22))
    bits, packing = int.from_bytes(data[28:30], "little"), int.from_bytes(data[30:34], "little")
    if packing not in (0, 3) or bits not in (1, 4, 8, 24, 32):
        raise ValueError("BMP of a kind that is not read")
    if packing == 3:  # masks of the usual order alone
        masks = np.frombuffer(data, "<u4", 3, 54).tolist()
        if bits != 32 or masks != [0xFF0000, 0xFF00, 0xFF]:
            raise ValueError("BMP of a kind that is not read")
    row = (w * bits + 31) // 32 * 4
    rows = np.frombuffer(data, np.uint8, row * abs(h), start).reshape(abs(h), row)
    rows = rows[::-1] if h > 0 else rows
    if bits >= 24:
        return rows[:, : w * bits // 8].reshape(abs(h), w, bits // 8)[:, :, 2::-1]
    if bits == 8:
        places = rows[:, :w]
    else:
        places = np.unpackbits(rows, axis=1)
        if bits == 4:
            places = rows.repeat(2, axis=1)
            places[:, ::2] >>= 4
            places[:, 1::2] &= 15
        places = places[:, :w]
    palette = np.frombuffer(data, np.uint8, (start - 14 - size) // 4 * 4, 14 + size).reshape(-1, 4)[:, 2::-1]
    grey = (palette == palette[:, :1]).all()
    return palette[:, 0][places] if grey else palette[places]


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def resize_area(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each target cell's exact area: the integral image, interpolated at the cell borders, differenced."""
    grey = pixels.astype(np.float64)
    grey = grey.mean(axis=2) if grey.ndim == 3 else grey
    h, w = grey.shape
    total = np.zeros((h + 1, w + 1))
    np.cumsum(np.cumsum(grey, axis=0), axis=1, out=total[1:, 1:])

    def at(axis_sums: np.ndarray, size: int, cells: int) -> np.ndarray:
        border = np.arange(cells + 1) * (size / cells)
        low = np.minimum(border.astype(np.int64), size - 1)
        part = (border - low)[:, None]
        return axis_sums[low] * (1 - part) + axis_sums[low + 1] * part

    cells = at(at(total, h, height).T, w, width).T
    return np.diff(np.diff(cells, axis=0), axis=1) / ((h / height) * (w / width))


def difference_hash(pixels: np.ndarray) -> int:
    """64 bits: in an 8 x 9 area thumbnail, is each cell darker than the next one to its right."""
    small = np.round(resize_area(pixels, 8, 9), 6)
    return int.from_bytes(np.packbits(small[:, :-1] < small[:, 1:]).tobytes(), "big")


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    return out.getvalue()


def text_media(df: DataFrame, key: str = "doc_id", text: str = "text", form: str | None = None) -> DataFrame:
    """One 64-wide 8-bit image of each text's UTF-8 bytes, padded with 0: (key, n_bytes, media); null text is empty.

    form: pgm or bmp; without it the crc32 of the padded bytes decides, its even values for pgm.
    """
    forms = {"pgm": encode_pgm, "bmp": encode_bmp}
    kind = df.schema[key].dataType.simpleString()

    def images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches, text):
            media = []
            for t in texts:
                padded = t + bytes(-len(t) % 64 if t else 64)
                encode = forms[form or ("bmp" if zlib.crc32(padded) & 1 else "pgm")]
                media.append(encode(np.frombuffer(padded, np.uint8).reshape(-1, 64)))
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(key), sizes, pa.array(media, pa.binary())], [key, "n_bytes", "media"])

    return df.select(key, text).mapInArrow(images, f"{key} {kind}, n_bytes long, media binary")


#: What a decoder raises on bytes that are no image.
_UNREADABLE = (ValueError, AttributeError, IndexError, TypeError, OverflowError, MemoryError)


def _slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = TEXT_CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of the batches of about `limit` bytes of the column, one whole row at least."""
    for batch in batches:
        marks = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64) + 1) // limit
        cuts = [0, *(np.flatnonzero(np.diff(marks)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a < b:
                yield batch.slice(a, b - a)


def media_features(df: DataFrame, key: str = "doc_id", media: str = "media", tile: int = 32, keep: list[str] | None = None) -> DataFrame:
    """Decode each image; give its payload digests, a tile x tile area thumbnail as NPY bytes and its difference hash.

    The payload is the decoded samples' bytes; the columns in keep are carried along.
    """
    carried = [key, *(keep or [])]
    kind = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in carried)
    names = [*carried, "ok", "height", "width", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "tile_npy", "dhash"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, media):
            rows: list[list] = []
            for data in batch.column(media).to_pylist():
                try:
                    pixels = decode(data) if data is not None else None
                except _UNREADABLE:
                    pixels = None
                whole = [None, None] if data is None else [len(data), hashlib.sha256(data).hexdigest()]
                if pixels is None or not pixels.size:
                    rows.append([False, None, None, None, None, None, *whole, None, None])
                    continue
                payload = pixels.tobytes()
                small = np.clip(np.rint(resize_area(pixels, tile, tile)), 0, 255).astype(np.uint8)
                rows.append([True, pixels.shape[0], pixels.shape[1], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), *whole, npy(small), f"{difference_hash(pixels):016x}"])
            kinds = [pa.bool_(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()]
            columns = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), *columns], names)

    schema = f"{kind}, ok boolean, height int, width int, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, tile_npy binary, dhash string"
    return df.select(*carried, media).mapInArrow(read, schema)


def npy_tiles(df: DataFrame, key: str = "doc_id", media: str = "media", scale: int = 1, tile: int = 256) -> DataFrame:
    """Images shrunk by `scale` with area means and cut into tiles: (key, tile_row, tile_col, npy), one row per tile."""
    kind = df.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, media):
            for k, data in zip(batch.column(key), batch.column(media).to_pylist(), strict=True):
                try:
                    pixels = decode(data)
                except _UNREADABLE:
                    continue
                if not pixels.size:
                    continue
                h, w = (max(1, -(-x // scale)) for x in pixels.shape[:2])
                small = pixels if scale == 1 else np.clip(np.rint(resize_area(pixels, h, w)), 0, 65535).astype(pixels.dtype)
                cells = [(r // tile, c // tile, npy(small[r : r + tile, c : c + tile])) for r in range(0, h, tile) for c in range(0, w, tile)]
                rows, cols, files = zip(*cells, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * len(cells), k.type), pa.array(rows, pa.int32()), pa.array(cols, pa.int32()), pa.array(files, pa.binary())], [key, "tile_row", "tile_col", "npy"])

    return df.select(key, media).mapInArrow(cut, f"{key} {kind}, tile_row int, tile_col int, npy binary")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as PGM or BMP in a column of a written table, read back, decoded, shrunk to an NPY tile and hashed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stored = written(text_media(docs), "media")
    found = media_features(stored, keep=["n_bytes"])
    feature = F.concat_ws(":", "dhash", F.left(F.sha2("tile_npy", 256), F.lit(16)))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"), "tile_npy")
