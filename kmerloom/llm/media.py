"""Media columns: lossless PNG of 8-bit samples and perceptual hashes.

A payload is a greyscale image 64 samples wide. The encoder writes the PNG
signature, IHDR, IDAT and IEND chunks with zlib; the decoder checks every
chunk's checksum and undoes all five row filters with numpy. The feature is
the sign pattern of the low frequencies of the cosine transform of the image
shrunk to 32 by 32 means.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.llm.tokens import drop_heavy

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SIDE, LOW = 32, 8
_IHDR = struct.Struct(">IIBBBBB")


def pad(data: bytes, multiple: int = WIDTH) -> bytes:
    """``data`` with zero bytes up to a positive multiple."""
    return data + bytes(multiple - len(data) if not data else -len(data) % multiple)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def filtered(image: np.ndarray) -> np.ndarray:
    """Rows with their filter byte: none, or the row above subtracted where that is smaller."""
    above = np.zeros_like(image)
    above[1:] = image[:-1]
    up = image - above
    cost = lambda x: np.abs(x.view(np.int8).astype(np.int16)).sum(1)
    use = cost(up) * 2 < cost(image)
    out = np.empty((image.shape[0], image.shape[1] + 1), np.uint8)
    out[:, 0] = 2 * use
    out[:, 1:] = np.where(use[:, None], up, image)
    return out


def encode_png(payload: bytes, width: int = WIDTH, level: int = 6) -> bytes:
    """The PNG of a payload whose length is a positive multiple of ``width``."""
    image = np.frombuffer(payload, np.uint8).reshape(-1, width)
    head = _IHDR.pack(width, len(image), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(filtered(image).tobytes(), level)) + _chunk(b"IEND", b"")


def unfiltered(rows: np.ndarray) -> np.ndarray:
    """Samples of 8-bit greyscale rows that still carry their filter byte."""
    kinds, data = rows[:, 0], rows[:, 1:]
    out = np.zeros((len(rows) + 1, data.shape[1]), np.uint8)  # row 0: nothing above the first
    at = 0
    while at < len(rows):
        kind, end = int(kinds[at]), at + 1
        while end < len(rows) and kinds[end] == kind:
            end += 1
        part = data[at:end]
        if kind == 0:
            out[at + 1 : end + 1] = part
        elif kind == 1:
            out[at + 1 : end + 1] = np.cumsum(part, 1, dtype=np.uint8)
        elif kind == 2:
            out[at + 1 : end + 1] = np.cumsum(np.vstack([out[at], part]), 0, dtype=np.uint8)[1:]
        elif kind in (3, 4):
            for y in range(at, end):
                _unfilter_by_neighbours(kind, data[y], out[y], out[y + 1])
        else:
            raise ValueError(f"unknown filter {kind}")
        at = end
    return out[1:]


def _unfilter_by_neighbours(kind: int, coded: np.ndarray, above: np.ndarray, out: np.ndarray) -> None:
    left = corner = 0
    for x, (c, up) in enumerate(zip(coded.tolist(), above.tolist(), strict=True)):
        if kind == 3:
            guess = (left + up) // 2
        else:
            p = left + up - corner
            guess = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
        left, corner = (c + guess) & 255, up
        out[x] = left


def decode_png(png: bytes) -> np.ndarray:
    """The image of an 8-bit greyscale PNG without interlace; damaged data is an error."""
    if png[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, head, packed, ended = 8, None, [], False
    while at < len(png) and not ended:
        (size,), kind = struct.unpack_from(">I", png, at), png[at + 4 : at + 8]
        data, (crc,) = png[at + 8 : at + 8 + size], struct.unpack_from(">I", png, at + 8 + size)
        if zlib.crc32(kind + data) != crc:
            raise ValueError(f"checksum of chunk {kind!r}")
        if kind == b"IHDR":
            head = _IHDR.unpack(data)
        elif kind == b"IDAT":
            packed.append(data)
        ended, at = kind == b"IEND", at + 12 + size
    if not ended or head is None or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("cut off, or not 8-bit greyscale")
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(head[1], head[0] + 1)
    return unfiltered(rows)


def _shrink(n: int) -> tuple[np.ndarray, np.ndarray]:
    """For SIDE bins over n rows: where each begins, and its share of rows (rows repeat where n < SIDE)."""
    begin = np.arange(SIDE) * n // SIDE
    end = np.maximum(begin + 1, (np.arange(SIDE) + 1) * n // SIDE)
    return begin, end


_COSINES = np.cos(np.pi * np.outer(np.arange(LOW), 2 * np.arange(SIDE) + 1) / (2 * SIDE)).astype(np.float64)


def cosine_hash(image: np.ndarray) -> bytes:
    """64 bits: which of the 8 by 8 lowest frequencies lie above their median."""
    sums = np.vstack([np.zeros((1, image.shape[1]), np.int64), np.cumsum(image, 0, dtype=np.int64)])
    begin, end = _shrink(image.shape[0])
    tall = (sums[end] - sums[begin]) / (end - begin)[:, None]
    sums = np.hstack([np.zeros((SIDE, 1)), np.cumsum(tall, 1)])
    begin, end = _shrink(image.shape[1])
    small = (sums[:, end] - sums[:, begin]) / (end - begin)
    low = _COSINES @ small @ _COSINES.T
    low[0, 0] = 0  # the mean brightness says nothing about structure
    return np.packbits(np.round(low, 6) > np.median(np.round(low, 6))).tobytes()


def media_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media binary): every text stored as a PNG.

    Null text counts as empty: one row of zeros. Texts of any length are one
    image. Repeated rows are stored each for itself, null ids are kept, other
    columns are not read. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_heavy()
        for batch in batches:
            data = [(t or "").encode() for t in batch.column(1).to_pylist()]
            pngs = [encode_png(pad(d)) for d in data]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(d) for d in data], pa.int64()), pa.array(pngs, pa.binary())], names=["id", "n_bytes", "media"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, n_bytes long, media binary").withColumnRenamed("id", id_col)


def media_features(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) from the stored images.

    Rows that share an id are read each for itself; null ids are kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_heavy()
        for batch in batches:
            rows = []
            for png in batch.column(2).to_pylist():
                image = decode_png(png)
                payload = image.tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(png), hashlib.sha256(png).hexdigest(), cosine_hash(image).hex()))
            columns = [[r[i] for r in rows] for i in range(6)]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                names=["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    schema = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select(F.col(id_col).alias("id"), "n_bytes", "media").mapInArrow(run, schema).withColumnRenamed("id", id_col)
