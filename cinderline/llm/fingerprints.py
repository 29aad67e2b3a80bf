"""Document fingerprints (operator 7) by content-defined chunking.

A gear hash runs over the UTF-8 bytes (each step doubles the hash and adds a table value, so it
knows the last 32 bytes). A chunk ends where its leading bits are zero: more bits before the normal
size, fewer after it, which keeps sizes near the normal one. Boundaries depend on nearby bytes only,
so an insertion moves text without changing the chunks behind it. A fingerprint is the set of chunk
digests, each with its length; likeness is the share of a fingerprint's bytes that the other contains.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderline.llm.common import documents

LEAST, NORMAL, MOST = 16, 64, 256
#: Boundaries before and after the normal size: so many leading zero bits of 32.
STRICT, LOOSE = 8, 4
#: Ranges of ids for each partition, so that partitions are even; at most so many in all, as their bounds are on the driver.
RANGES, MOST_RANGES = 4, 20_000
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 7) for b in range(256)], np.uint32)


def gear(data: bytes) -> np.ndarray:
    """The rolling hash after each byte, by doubling: the hash of 2k bytes is that of the last k plus the shifted one of the k before."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8, 16):
        if len(h) > k:
            older = h[:-k] << np.uint32(k)
            h = h.copy()
            h[k:] += older
    return h


def chunks(data: bytes) -> list[int]:
    """Ends of the chunks."""
    h = gear(data)
    at = np.flatnonzero(h < 1 << (32 - LOOSE))
    strict = (at[h[at] < 1 << (32 - STRICT)] + 1).tolist()
    loose = (at + 1).tolist()
    ends, pos, n = [], 0, len(data)
    i = j = 0
    while pos < n:
        i = bisect_left(strict, pos + LEAST, i)
        if i < len(strict) and strict[i] < pos + NORMAL:
            pos = strict[i]
        else:
            j = bisect_left(loose, pos + NORMAL, j)
            pos = loose[j] if j < len(loose) and loose[j] <= pos + MOST else min(n, pos + MOST)
        ends.append(pos)
    return ends


def digests(text: str) -> dict[str, int]:
    """Chunk digest (12 hex digits) -> length in bytes."""
    data, out, start = text.encode(), {}, 0
    for end in chunks(data):
        out[xxhash.xxh64_hexdigest(data[start:end])[:12]] = end - start
        start = end
    return out


def render(chunk_set: dict[str, int]) -> str:
    return ",".join([f"{d}.{n}" for d, n in sorted(chunk_set.items())])


def likeness(a: dict[str, int], b: dict[str, int]) -> float:
    """The share of a's bytes whose chunks b has too; two empty fingerprints are alike."""
    total = sum(a.values())
    return sum(n for d, n in a.items() if d in b) / total if total else float(not b)


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, bucket, borrowed: buckets are ranges of ids, and each also borrows the first document after it (the last bucket: the very first).

    So each document meets its successor in one task, and texts move once. The bounds are
    approximate quantiles of the ids; only they and each bucket's first id come to the driver.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = min(RANGES * parts, MOST_RANGES)
    cuts = rows.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0] or []
    bounds = np.unique(np.array(cuts, np.int64))

    @F.pandas_udf("int")
    def bucket_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.where(ids.isna(), 0, np.searchsorted(bounds, ids.fillna(0).to_numpy(np.int64), "left")).astype(np.int32))

    firsts = sorted((r["bucket"], r["first"]) for r in rows.select("doc_id", bucket_of("doc_id").alias("bucket")).groupBy("bucket").agg(F.min("doc_id").alias("first")).collect())
    lends = {first: firsts[i - 1][0] for i, (_, first) in enumerate(firsts)}  # at most one row a bucket
    lend_ids = np.array(sorted(k for k in lends if k is not None), np.int64)
    lend_to = np.array([lends[k] for k in lend_ids.tolist()], np.int32)

    @F.pandas_udf("array<int>")
    def targets(ids: pd.Series) -> pd.Series:
        own = np.where(ids.isna(), 0, np.searchsorted(bounds, ids.fillna(0).to_numpy(np.int64), "left"))
        at = np.minimum(np.searchsorted(lend_ids, ids.fillna(0).to_numpy(np.int64)), max(0, len(lend_ids) - 1))
        lent = (lend_ids[at] == ids.fillna(0)).to_numpy() & ids.notna().to_numpy() if len(lend_ids) else np.zeros(len(ids), bool)
        return pd.Series([[o, int(lend_to[a])] if x else [o] for o, a, x in zip(own.tolist(), at.tolist(), lent.tolist(), strict=True)])

    spread = rows.select("doc_id", "text", F.posexplode(targets("doc_id")).alias("borrowed", "bucket"))
    return spread.repartition(parts, "bucket").sortWithinPartitions("bucket", "borrowed", "doc_id", "text")


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's fingerprint, that of its edited text (its last half replaced by the next document's beginning), and their likeness.

    A null text is the empty one, with the empty fingerprint. Rows of one id follow each other in
    the order of their texts, and rows without an id come first; a single row is its own successor.
    An empty table gives an empty one. Other columns go.
    """

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # (bucket, borrowed, doc_id, text, chunk set)
        for b in batches:
            out = []
            for doc, text, borrowed, bucket in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "borrowed", "bucket")), strict=True):
                own = digests(text)
                if before is not None and before[0] == bucket and not before[1]:
                    out.append(compared(before[2], before[3], before[4], text, own))
                before = (bucket, borrowed, doc, text, own)
            yield pa.RecordBatch.from_pylist([dict(zip(SCHEMA.names, row, strict=True)) for row in out], SCHEMA)

    def compared(doc, text: str, own: dict, after: str, others: dict) -> tuple:
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        changed = digests(edited)
        return (doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), render(own), render(changed), likeness(own, changed), likeness(own, others))

    return neighbours(docs, id_col, text_col).mapInArrow(paired, OUT)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns of every whole text and its edited text."""
    return fingerprints(documents(spark, sf_dir))
