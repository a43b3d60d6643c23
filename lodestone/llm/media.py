"""Media columns: bytes as grey PNG images in a binary column, read back with all tests, and hashed.

The writer makes one grey image of 8-bit samples: signature, IHDR, IDAT chunks of a zlib stream, IEND.
The reader takes any such image: it tests signature, chunk order, every chunk's CRC-32, the stream's own
checksum and its length, and undoes all five row filters with numpy.  The hash is of the image's
low-frequency cosine transform.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map

SIGNATURE = b"\x89PNG\r\n\x1a\n"
UNIT = 576


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes, padded by bytes 255 to a positive multiple of UNIT, and how many there were."""
    raw = (text or "").encode()
    return raw + b"\xff" * (UNIT - len(raw) % UNIT if len(raw) % UNIT or not raw else 0), len(raw)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def write_png(samples: np.ndarray, level: int = 6, chunk: int = 1 << 16) -> bytes:
    """A grey image.  Rows are left as they are or stored as differences to the row above, whichever
    sums smaller in magnitude."""
    height, width = samples.shape
    up = samples.copy()
    up[1:] -= samples[:-1]
    cost = lambda rows: np.abs(rows.view(np.int8).astype(np.int16)).sum(axis=1)
    choose = cost(up) < cost(samples)
    rows = np.empty((height, width + 1), np.uint8)
    rows[:, 0] = np.where(choose, 2, 0)
    rows[:, 1:] = np.where(choose[:, None], up, samples)
    stream = zlib.compress(rows.tobytes(), level)
    return b"".join(
        [SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)), *(_chunk(b"IDAT", stream[k : k + chunk]) for k in range(0, len(stream), chunk)), _chunk(b"IEND", b"")]
    )


def _paeth(a: int, b: int, c: int) -> int:
    p = a + b - c
    pa_, pb, pc = abs(p - a), abs(p - b), abs(p - c)
    return a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c


def unfilter(rows: np.ndarray) -> np.ndarray:
    """Undo the row filters; ``rows`` has the filter's number in its first column.

    Runs of rows with filter 0, 1 or 2 are undone at once (sums modulo 256 along or across the rows);
    filters 3 and 4 depend on single samples before and are undone one by one.
    """
    kinds, out = rows[:, 0], rows[:, 1:].copy()
    if kinds.size and kinds.max() > 4:
        raise ValueError("unknown row filter")
    borders = np.flatnonzero(np.diff(kinds)) + 1
    for start, stop in zip([0, *borders], [*borders, len(kinds)], strict=True):
        kind, part = kinds[start], out[start:stop]
        if kind == 1:
            part[:] = np.cumsum(part, axis=1, dtype=np.uint8)
        elif kind == 2:
            if start:
                part[0] += out[start - 1]
            part[:] = np.cumsum(part, axis=0, dtype=np.uint8)
        elif kind > 2:
            for y in range(start, stop):
                above = out[y - 1].tolist() if y else [0] * out.shape[1]
                row, left, corner = out[y].tolist(), 0, 0
                for x, (value, b) in enumerate(zip(row, above, strict=True)):
                    left = (value + ((left + b) // 2 if kind == 3 else _paeth(left, b, corner))) & 255
                    row[x], corner = left, b
                out[y] = row
    return out


def read_png(data: bytes) -> np.ndarray:
    """The samples of a grey 8-bit image that is not interlaced; ValueError for anything damaged."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, kinds, stream, head = 8, [], [], b""
    while at < len(data):
        if at + 12 > len(data):
            raise ValueError("chunk is cut short")
        size = int.from_bytes(data[at : at + 4], "big")
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if len(body) < size or data[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(kind + body)):
            raise ValueError("chunk checksum differs")
        kinds.append(kind)
        if kind == b"IHDR":
            head = body
        elif kind == b"IDAT":
            stream.append(body)
        elif kind[0] < 97 and kind not in (b"PLTE", b"IEND"):
            raise ValueError("unknown critical chunk")
        at += 12 + size
    if not kinds or kinds[0] != b"IHDR" or kinds[-1] != b"IEND" or kinds.count(b"IHDR") != 1 or not stream:
        raise ValueError("chunks are missing or out of order")
    width, height, *rest = struct.unpack(">IIBBBBB", head)
    if rest != [8, 0, 0, 0, 0]:
        raise ValueError("only grey 8-bit images that are not interlaced")
    try:
        raw = zlib.decompress(b"".join(stream))
    except zlib.error as e:
        raise ValueError(f"image data: {e}") from None
    if len(raw) != height * (width + 1):
        raise ValueError("image data has another length")
    return unfilter(np.frombuffer(raw, np.uint8).reshape(height, width + 1))


def _cosines(n: int, low: int) -> np.ndarray:
    k, x = np.arange(low)[:, None], np.arange(n)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * n)) * np.where(k == 0, np.sqrt(1 / n), np.sqrt(2 / n))


_SIDE, _LOW = 24, 8
_BASIS = _cosines(_SIDE, _LOW)


def cosine_hash(samples: np.ndarray) -> bytes:
    """64 bits: the image, averaged to 24 x 24, its 8 x 8 lowest cosine coefficients, each above their
    median (the constant one aside) or not."""
    height, width = samples.shape
    cells = np.add.reduceat(samples.astype(np.float64), np.arange(_SIDE) * height // _SIDE, axis=0) if height >= _SIDE else np.repeat(samples.astype(np.float64), -(-_SIDE // height), axis=0)[:_SIDE]
    cells = np.add.reduceat(cells, np.arange(_SIDE) * width // _SIDE, axis=1) if width >= _SIDE else np.repeat(cells, -(-_SIDE // width), axis=1)[:, :_SIDE]
    tall, wide = (np.diff([*(np.arange(_SIDE) * n // _SIDE), n]) if n >= _SIDE else np.ones(_SIDE) for n in (height, width))
    low = np.round(_BASIS @ (cells / tall[:, None] / wide[None, :]) @ _BASIS.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``n_bytes`` (of the text alone) and ``media``, a binary column of PNG images 24 samples wide.

    A null text counts as an empty one: 576 bytes 255.  Equal texts give equal bytes.  Other columns are
    ignored; rows stand alone, so there is no shuffle.
    """
    kind = dict(docs.dtypes)[id_col]

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [payload_of(t) for t in batch.column(1).to_pylist()]
        media = [write_png(np.frombuffer(p, np.uint8).reshape(-1, _SIDE)) for p, _ in made]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for _, n in made], pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])

    return arrow_map(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), each, f"id {kind}, n_bytes long, media binary", 500).withColumnRenamed("id", id_col)


def load(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What :func:`store` wrote, read back: id, ``n_bytes``, ``media``, ``payload`` and ``phash`` (8 bytes).

    A damaged image raises; a null one has a null payload and hash.
    """
    kind = dict(stored.dtypes)[id_col]

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        images = [None if m is None else read_png(m) for m in batch.column(2).to_pylist()]
        payload = pa.array([None if x is None else x.tobytes() for x in images], pa.binary())
        hashes = pa.array([None if x is None else cosine_hash(x) for x in images], pa.binary())
        return pa.RecordBatch.from_arrays([*batch.columns, payload, hashes], ["id", "n_bytes", "media", "payload", "phash"])

    return arrow_map(stored.select(stored[id_col].alias("id"), "n_bytes", "media"), each, f"id {kind}, n_bytes long, media binary, payload binary, phash binary", 500).withColumnRenamed("id", id_col)
