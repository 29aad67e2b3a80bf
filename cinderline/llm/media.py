"""Media columns (operator 5): payloads as PNG images in a binary column, read back with every checksum tested.

Writing: 8-bit greyscale of 64 samples a row, one filter for the whole image (none, left or up,
whichever leaves the lowest entropy), zlib-compressed chunks. Reading: chunk by chunk with CRC tests,
zlib, numpy unfiltering of all five filter types. Feature: signs of the low frequencies of a
two-dimensional cosine transform of the image shrunk to 32 x 32, as 16 hex digits.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderline.llm.common import documents, id_and_text, map_batches

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SIDE, LOW = 32, 8
#: The cosine transform's first LOW rows: frequency by position.
COSINE = np.cos(np.pi * np.arange(LOW)[:, None] * (2 * np.arange(SIDE) + 1)[None, :] / (2 * SIDE))


def entropy(samples: np.ndarray) -> float:
    p = np.bincount(samples.ravel(), minlength=256) / samples.size
    p = p[p > 0]
    return float(-(p * np.log2(p)).sum())


def png_encode(payload: bytes, width: int = WIDTH, level: int = 1) -> bytes:
    """payload: a positive multiple of width bytes."""
    image = np.frombuffer(payload, np.uint8).reshape(-1, width)
    left, up = image.copy(), image.copy()
    left[:, 1:] -= image[:, :-1]
    up[1:] -= image[:-1]
    kind, rows = min(enumerate((image, left, up)), key=lambda x: entropy(x[1]))
    body = np.empty((len(image), width + 1), np.uint8)
    body[:, 0], body[:, 1:] = kind, rows

    def chunk(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(image), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body.tobytes(), level)) + chunk(b"IEND", b"")


def unfilter(body: np.ndarray) -> np.ndarray:
    """Rows with a filter type in front -> samples, one byte a pixel. Runs of rows of one type are done at once where rows allow it."""
    kinds, rows = body[:, 0], body[:, 1:].copy()
    edges = np.flatnonzero(np.diff(kinds)) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(kinds)], strict=True):
        kind, part = int(kinds[a]), rows[a:b]
        above = rows[a - 1] if a else np.zeros(rows.shape[1], np.uint8)
        if kind == 1:
            part[:] = np.cumsum(part, axis=1, dtype=np.uint8)
        elif kind == 2:
            part[0] += above
            part[:] = np.cumsum(part, axis=0, dtype=np.uint8)
        elif kind in (3, 4):
            for row in part:
                before = corner = 0
                for x in range(len(row)):
                    high = int(above[x])
                    if kind == 3:
                        guess = (before + high) // 2
                    else:
                        p = before + high - corner
                        guess = min((abs(p - before), 0, before), (abs(p - high), 1, high), (abs(p - corner), 2, corner))[2]
                    before, corner = (int(row[x]) + guess) & 255, high
                    row[x] = before
                above = row
        elif kind:
            raise ValueError(f"no filter type {kind}")
    return rows


def png_decode(data: bytes) -> np.ndarray:
    """The samples of an 8-bit greyscale image without interlace; ValueError on a wrong signature, checksum or size."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, size, idat, ended = 8, None, [], False
    while at < len(data):
        n, name = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        if data[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(name + body)):
            raise ValueError(f"checksum of {name!r}")
        if name == b"IHDR":
            size = struct.unpack(">IIBBBBB", body)
        elif name == b"IDAT":
            idat.append(body)
        elif name == b"IEND":
            ended = True
        at += 12 + n
    if not ended or not size or size[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not a whole 8-bit greyscale image")
    width, height = size[:2]
    raw = np.frombuffer(zlib.decompress(b"".join(idat)), np.uint8)
    if raw.size != height * (width + 1):
        raise ValueError("number of samples")
    return unfilter(raw.reshape(height, width + 1))


def cosine_hash(image: np.ndarray) -> str:
    """64 bits: which of the LOW x LOW lowest frequencies, without the mean's own, are above their median."""
    rows = np.arange(SIDE) * len(image) // SIDE
    cols = np.arange(SIDE) * image.shape[1] // SIDE

    def shrink(a: np.ndarray, at: np.ndarray, axis: int) -> np.ndarray:
        if a.shape[axis] < SIDE:
            return np.take(a, at, axis)
        n = np.diff(np.append(at, a.shape[axis]))
        return np.add.reduceat(a, at, axis) / (n[:, None] if axis == 0 else n)

    # Columns are summed exactly first: long images stay integers while they are large.
    small = shrink(shrink(image.astype(np.int64), cols, 1), rows, 0)
    low = (COSINE @ small @ COSINE.T).ravel()
    low[np.abs(low) < 1e-6 * (1 + abs(low[0]))] = 0  # rounding noise
    bits = low > np.median(low[1:])
    return np.packbits(bits).tobytes().hex()


def payload_of(text: str) -> bytes:
    raw = text.encode()
    return raw + bytes(-len(raw) % WIDTH if raw else WIDTH)


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, png (binary), and of the payload as read back from it: payload_bytes, payload_sha256, tail_crc32, feature.

    A null text is the empty one: 64 zero bytes. Texts are stored whole, equal ones alike; repeated
    rows stay, an empty table gives an empty one, other columns go. Frequencies that tie with the
    median count as not above it.
    """

    def made(b: pa.RecordBatch) -> pa.RecordBatch:
        cols: dict[str, list] = {k: [] for k in ("n_bytes", "png", "payload_bytes", "payload_sha256", "tail_crc32", "feature")}
        for text in b.column("text").to_pylist():
            payload = payload_of(text)
            png = png_encode(payload)
            image = png_decode(png)
            back = image.tobytes()
            row = (len(text.encode()), png, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), cosine_hash(image))
            for c, v in zip(cols.values(), row, strict=True):
                c.append(v)
        kinds = {"png": pa.binary(), "payload_sha256": pa.string(), "feature": pa.string()}
        return pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(v, kinds.get(k, pa.int64())) for k, v in cols.items())], ["doc_id", *cols])

    return map_batches(id_and_text(docs, id_col, text_col), made, "doc_id long, n_bytes long, png binary, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string")


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns of every whole text: sizes and hashes of the payload as read back and of the PNG, and the feature."""
    m = text_media(documents(spark, sf_dir))
    return m.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.length("png").cast("long").alias("media_bytes"), F.sha2("png", 256).alias("media_sha256"), "feature")
