"""SentencePiece encoding and decoding (operator 9) that keeps source offsets.

The text is normalised by the longest prefix that the model's compiled character map knows, and each
normalised byte remembers the source byte it came from; every piece is so projected to the span of
source bytes that it stands for. The normalised text is what is encoded: the library merges it by a
copy of the model that changes nothing before. Ids go back to text by the pieces' surfaces, bytes
where the model fell back to them.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderline.llm.common import documents, id_and_text, map_batches, tokenizer_path

MARK = "▁"


def fields(data: bytes):
    """(number, value) of each field of a protocol-buffer message: an int, or the bytes of a length-delimited or fixed field."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[i]
            value |= (b & 127) << shift
            i, shift = i + 1, shift + 7
            if b < 128:
                return value, i

    i = 0
    while i < len(data):
        key, i = varint(i)
        if key & 7 == 0:
            value, i = varint(i)
        else:
            n, i = varint(i) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], i)
            value, i = data[i : i + n], i + n
        yield key >> 3, value


def without_normaliser(model: bytes) -> bytes:
    """The same pieces and settings for text that is normalised already: no character map, no blank in front, none dropped."""

    def field(number: int, data: bytes) -> bytes:
        n, size = len(data), bytearray()
        while n > 127:
            size.append(n & 127 | 128)
            n >>= 7
        return bytes([number << 3 | 2, *size, n]) + data

    plain = field(1, b"identity") + bytes([3 << 3, 0, 4 << 3, 0, 5 << 3, 1])
    return b"".join([field(n, value) for n, value in fields(model) if n in (1, 2)]) + field(3, plain)


class CharacterMap:
    """The compiled map: a double-array trie from source prefixes to replacement strings."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.strings = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """The replacement of the longest prefix of data[at:] that the map knows, and that prefix's length."""
        jump = lambda u: (u >> 10) << ((u & 512) >> 6)
        node, found = jump(self.units[0]), None
        for i in range(at, len(data)):
            node ^= data[i]
            unit = self.units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= jump(unit)
            if unit >> 8 & 1:
                found = (self.units[node] & 0x7FFFFFFF, i + 1 - at)
        if found is None:
            return None
        return self.strings[found[0] : self.strings.index(b"\0", found[0])], found[1]


class PieceCodec:
    def __init__(self, path: str):
        pieces, flags = [], {3: 1, 4: 1, 5: 1}
        kind, fallback, suffix, chars = 1, 0, 0, b""
        with open(path, "rb") as f:
            model = f.read()
        for n, value in fields(model):
            if n == 1:
                p = dict(fields(value))
                pieces.append((p[1].decode(), struct.unpack("<f", p.get(2, b"\0\0\0\0"))[0], p.get(3, 1)))
            elif n == 2:
                t = dict(fields(value))
                kind, fallback, suffix = t.get(3, 1), t.get(35, 0), t.get(24, 0)
            elif n == 3:
                t = dict(fields(value))
                chars, flags = t.get(2, b""), flags | {k: t[k] for k in (3, 4, 5) if k in t}
        if kind != 2 or not fallback or suffix or not flags[5] or any(k == 4 for _, _, k in pieces):
            raise ValueError("only merge models with byte fallback, blank marks in front and no user-defined pieces")
        self.dummy, self.squeeze, self.map = flags[3], flags[4], CharacterMap(chars)
        self.surface = [bytes([int(s[3:5], 16)]) if k == 6 else b"" if k == 3 else s.replace(MARK, " ").encode() for s, _, k in pieces]
        self.width = np.array([1 if k == 6 else len(s.encode()) for s, _, k in pieces], np.int64)
        self.begin = struct.pack("<I", next(i for i, (s, _, k) in enumerate(pieces) if k == 3 and s == "<s>"))
        self.end = struct.pack("<I", next(i for i, (s, _, k) in enumerate(pieces) if k == 3 and s == "</s>"))
        self.model = sentencepiece.SentencePieceProcessor(model_proto=without_normaliser(model))

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The text with blank marks, and for each of its UTF-8 bytes, and its end, the source byte that it comes from."""
        data = text.encode()
        if not data:
            return "", np.zeros(1, np.int64)
        mark = MARK.encode()
        if not self.map.units and not self.squeeze:
            source = np.frombuffer(data, np.uint8)
            align = np.repeat(np.arange(len(data)), np.where(source == 32, len(mark), 1))
            out = text.replace(" ", MARK)
            return (MARK + out, np.concatenate([np.zeros(len(mark), np.int64), align, [len(data)]])) if self.dummy else (out, np.append(align, len(data)))
        out, align, at = bytearray(), [], 0

        def put(raw: bytes, where: int) -> None:
            for b in raw:
                new = mark if b == 32 else bytes([b])
                out.extend(new)
                align.extend([where] * len(new))

        def prefix(i: int) -> tuple[bytes, int]:
            found = self.map.longest(data, i) if self.map.units else None
            if found:
                return found
            n = 1
            while i + n < len(data) and data[i + n] & 0xC0 == 0x80:
                n += 1
            return data[i : i + n], n

        while self.squeeze and at < len(data) and prefix(at)[0] == b" ":
            at += prefix(at)[1]
        if at == len(data):
            return "", np.zeros(1, np.int64)
        if self.dummy:
            put(b" ", at)
        blank = bool(self.squeeze)
        while at < len(data):
            raw, n = prefix(at)
            if blank:
                raw = raw.lstrip(b" ")
            put(raw, at)
            if raw:
                blank = raw.endswith(b" ")
            at, blank = at + n, blank and bool(self.squeeze)
        while self.squeeze and out.endswith(mark):
            at = align[-1]
            del out[-len(mark) :], align[-len(mark) :]
        return out.decode(), np.array([*align, at], np.int64)

    def encode(self, text: str) -> tuple[bytes, bytes, bytes]:
        """Ids with begin and end, each piece's first source byte (a piece goes to where the next begins; begin and end are empty), decoded bytes."""
        plain, align = self.normalise(text)
        pieces = self.model.encode(plain)
        ids = np.array(pieces, "<u4")
        width = self.width[ids]
        starts = np.concatenate([[0], align[np.cumsum(width) - width], [align[-1]]]).astype("<u4")
        return self.begin + ids.tobytes() + self.end, starts.tobytes(), self.decoded(b"".join([self.surface[i] for i in pieces]))

    def decoded(self, surface: bytes) -> bytes:
        return surface[1:] if self.dummy and surface[:1] == b" " else surface

    def decode(self, ids: bytes) -> str:
        return self.decoded(b"".join([self.surface[i] for i in np.frombuffer(ids, "<u4").tolist()])).decode("utf-8", "replace")


@lru_cache(2)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def encode_pieces(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit, begin and end included), starts (each id's first source byte, likewise; it ends where the next begins), decoded.

    A null or empty text has only the begin and end ids. Repeated rows stay, an empty table gives an empty one, other columns go.
    Texts are encoded whole, however long; no choice depends on ties.
    """
    where = path or tokenizer_path("piece_bpe_32k.model")

    def encoded(b: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(where)
        ids, starts, decoded = zip(*map(c.encode, b.column("text").to_pylist()), strict=True)
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.binary()), pa.array(starts, pa.binary()), pa.array(decoded, pa.binary()).cast(pa.string())], ["doc_id", "ids", "starts", "decoded"])

    return map_batches(id_and_text(docs, id_col, text_col), encoded, "doc_id long, ids binary, starts binary, decoded string")


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns of every whole text: number and hash of the ids with begin and end, hash of the decoded text; also the hash of the source offsets."""
    e = encode_pieces(documents(spark, sf_dir))
    return e.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), F.sha2("starts", 256).alias("spans_sha256"))
