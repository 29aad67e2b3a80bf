"""Best-fit packing (operator 4): a configuration linear program over the histogram of piece lengths.

A configuration is a multiset of lengths that fits one sequence. The covering program (as few
configurations as give every length its count) begins with the configurations of best-fit decreasing.
Each length has a price; a knapsack dynamic program over all lengths finds the configurations of the
highest price, which join the program, and bounds the number of sequences from below. Multiplicative
weights then solve the program over the configurations found so far: those of the highest price are
used a little, and the lengths they serve become cheaper by a factor; the shares used give a fractional
solution, the mean of the prices the next ones. This ends when the solution is near the bound, or
pricing finds nothing new. The solution is rounded to whole copies, what is left over is packed by the
program again, and by best-fit at last; the result is never more than best-fit's own. All of this works
on the histogram alone (as many numbers as the sequence has tokens); the pieces get their places by
their rank among the pieces of their length, which Spark counts in salted groups.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinderline.llm.common import documents, id_and_text, map_batches, materialise, tokenizer_path

CAPACITY = 4096
#: Rows of one length that share a rank counter, on average.
GROUP = 100_000
#: Rounds of pricing at most, configurations a round adds at most (and an eighth of the lengths' number), and how near the bound the program is left.
ROUNDS, ADDED, NEAR = 12, 64, 0.001
#: Steps of the multiplicative weights a round, entries of the program that they may pass in all, and how much a step changes a price.
STEPS, PASSED, RATE = (1500, 10_000), 30_000_000, 0.05


class WordTokens(dict):
    """A piece of text without ASCII white space, its ASCII letters lower -> its ids as little-endian 32-bit integers.

    Words of Latin letters, also before one sign, go to the library's model by themselves, for nothing
    else changes or splits them; all others of a text go through the whole library at once. LIMIT words
    are kept, among which the frequent ones are soon.
    """

    LIMIT = 300_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        self.tokenizer = Tokenizer.from_file(path)
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
        kinds = [x.get("type") for x in spec["normalizer"]["normalizers"]] + [x.get("type") for x in spec["pre_tokenizer"]["pretokenizers"]]
        if kinds != ["NFC", "Replace", "Lowercase", "Split", "ByteLevel"] or spec["model"]["end_of_word_suffix"] != "</w>":
            raise ValueError("only lower-casing tokenizers that drop white space and mark word ends")
        from cinderline.llm.token_counts import byte_symbols

        by_byte = {ord(b): c for c, b in byte_symbols().items()}
        self.symbols = [by_byte[k] for k in range(256)]
        self.model = self.tokenizer.model
        self.signs = {c: self.library([c])[0] for c in ".,;:!?"}

    def library(self, words: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def plain(self, word: str) -> bytes | None:
        """The ids of a word of Latin letters, or of one and a sign; None for any other."""
        if word.isalpha():
            if word.isascii():
                return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()
            if max(word) <= "\xff":
                return array("I", [t.id for t in self.model.tokenize("".join([self.symbols[b] for b in word.lower().encode()]))]).tobytes()
            return None
        end = self.signs.get(word[-1])
        return self.plain(word[:-1]) + end if end and word[:-1].isalpha() and max(word) <= "\xff" else None

    def ids(self, text: str) -> bytes:
        """Ids of a whole text. Nothing crosses white space in this kind of tokenizer, so the words' ids are strung together."""
        if self.special.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words = text.encode().lower().split()
        found = list(map(self.get, words))
        if None in found:
            own = {w: self.plain(w.decode()) for w in {w for w, f in zip(words, found, strict=True) if f is None}}
            if odd := [w for w, f in own.items() if f is None]:
                own.update(zip(odd, self.library([w.decode() for w in odd]), strict=True))
            if len(self) < self.LIMIT:
                self.update(own)
            found = [own[w] if f is None else f for w, f in zip(words, found, strict=True)]
        return b"".join(found)


@lru_cache(2)
def word_tokens(path: str) -> WordTokens:
    return WordTokens(path)


def token_pieces(docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and end_id, cut at multiples of the capacity."""

    def cut(b: pa.RecordBatch) -> pa.RecordBatch:
        words, end = word_tokens(path), np.array([end_id], "<u4").tobytes()
        rows = []
        for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            ids = words.ids(text) + end
            for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
        return pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"piece": "int32", "doc_id": "Int64"}), preserve_index=False)

    return map_batches(id_and_text(docs, id_col, text_col), cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


#: (index of a length, copies) of the lengths in a configuration, by index.
Config = tuple[tuple[int, int], ...]


def knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """best[c]: the highest price of any filling of c tokens, copies unlimited, by dynamic programming over all lengths; take[c]: a length that it holds (0: a token stays free)."""
    price = np.zeros(capacity + 1)
    price[lengths] = prices
    back = price[::-1].copy()  # back[capacity - l] is the price of length l
    best, take = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(int(lengths[0]), capacity + 1):
        values = best[:c] + back[capacity - c : capacity]
        k = int(values.argmax())  # of equal prices the longest length
        best[c] = best[c - 1]
        if values[k] > best[c]:
            best[c], take[c] = values[k], c - k
    return best, take


def filled(first: int, lengths: np.ndarray, take: np.ndarray, capacity: int) -> Config:
    """The configuration of the highest price that holds the length of index first."""
    config, room = Counter([first]), capacity - int(lengths[first])
    while room > 0:
        if n := int(take[room]):
            config[int(np.searchsorted(lengths, n))] += 1
        room -= n or 1
    return tuple(sorted(config.items()))


def weighed(pool: list[Config], demand: np.ndarray, prices: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multiplicative weights over some configurations: copies (fractions) of each, which serve every length's demand in full, and the mean prices.

    In a step all configurations near the highest price are used alike, until some length has gained a
    small part of its demand; the prices fall with what lengths have gained. The first half of the
    steps only finds the prices.
    """
    index, copies = np.array([k for c in pool for k, _ in c]), np.array([n for c in pool for _, n in c], float)
    size = np.array([len(c) for c in pool])
    start = np.cumsum(size) - size
    steps = min(STEPS[1], max(STEPS[0], PASSED // len(index)))
    part = max(2.0, len(demand) / 2) / steps
    used, served, half, mean = np.zeros(len(pool)), np.zeros(len(demand)), np.zeros(len(demand)), np.zeros(len(demand))
    level = np.log(np.maximum(prices, 1e-12))
    for t in range(steps):
        if t == steps // 2:
            used[:], mean[:], half = 0, 0, served.copy()
        now = np.exp(level - RATE / part * (served - served.min()))
        worth = np.add.reduceat(now[index] * copies, start)
        best = worth >= worth.max() * (1 - part)
        gain = np.bincount(index, copies * np.repeat(best, size), len(demand))
        step = part * (demand[gain > 0] / gain[gain > 0]).min()
        used[best] += step
        served += step * gain / demand
        mean += now / (demand @ now) * step * best.sum()
    least = (served - half).min()
    return used / least if least > 0 else np.full(len(pool), np.inf), mean / mean.sum()


def fractional(lengths: np.ndarray, counts: np.ndarray, capacity: int, start: dict[Config, float], rounds: int = ROUNDS) -> tuple[dict[Config, float], float]:
    """Copies (fractions) of configurations that hold every length as often as it is there, near as few as any, and a number that none can go below. start: a solution to begin with."""
    demand, prices = counts.astype(float), lengths / capacity
    pool, known = list(start), set(start)
    best, fewest, bound, idle = start, sum(start.values()), 0.0, 0
    for _ in range(rounds):
        worth, take = knapsack(lengths, prices, capacity)
        own = prices + worth[capacity - lengths]
        bound = max(bound, float(demand @ prices / own.max()))
        if fewest <= bound * (1 + NEAR) or np.ceil(bound - 1e-6) >= fewest:
            break
        new = [c for k in np.argsort(-own, kind="stable")[: max(ADDED, len(lengths) // 8)].tolist() if (c := filled(k, lengths, take, capacity)) not in known]
        idle = 0 if new else idle + 1
        if idle > 1:  # the program is complete, and its prices have been refined once more
            break
        pool += dict.fromkeys(new)
        known.update(new)
        used, prices = weighed(pool, demand, prices)
        if used.sum() < fewest:
            best, fewest = dict(zip(pool, used.tolist(), strict=True)), float(used.sum())
    return best, bound


def rounded(solution: dict[Config, float], counts: np.ndarray) -> list[tuple[Config, int]]:
    """Whole copies of the configurations, the most used first, none more often than lengths are left; the fraction that one loses is carried on to the next. counts are reduced by what they hold."""
    out, carry = [], 0.0
    for config, x in sorted(solution.items(), key=lambda c: (-c[1], c[0])):
        carry += x
        copies = min(int(carry + 1e-9), *(int(counts[k]) // n for k, n in config))
        carry = min(1.0, carry - copies)
        if copies:
            out.append((config, copies))
            for k, n in config:
                counts[k] -= n * copies
    return out


def best_fit(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing, a configuration at a time: the longest that is left, then always the longest that still fits. counts are used up."""
    out = []
    while counts.any():
        room, config = capacity, {}
        while True:
            fits = [k for k in np.flatnonzero(counts[: np.searchsorted(lengths, room, "right")])[::-1][: len(config) + 1] if counts[k] > config.get(int(k), 0)]
            if not fits:
                break
            config[int(fits[0])] = config.get(int(fits[0]), 0) + 1
            room -= int(lengths[fits[0]])
        copies = max(1, min(int(counts[k] // a) for k, a in config.items()))
        out.append((config, copies))
        for k, a in config.items():
            counts[k] -= a * copies
    return out


def configurations(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one sequence, number of such sequences), which use up the histogram exactly and are never more than best-fit decreasing gives."""
    lengths = np.array(sorted(histogram), np.int64)
    counts = np.array([histogram[x] for x in lengths.tolist()], np.int64)
    plain = [(tuple(sorted(c.items())), n) for c, n in best_fit(lengths, counts.copy(), capacity)]
    run, left = [], counts.copy()
    there = np.flatnonzero(left)
    while there.size:
        start: dict[Config, float] = {}
        back = {int(k): i for i, k in enumerate(there)}
        fit = plain if not run else [(tuple(sorted(c.items())), n) for c, n in best_fit(lengths, left.copy(), capacity)]
        for c, n in fit:
            own = tuple((back[k], a) for k, a in c)
            start[own] = start.get(own, 0.0) + n
        solution, _ = fractional(lengths[there], left[there], capacity, start, rounds)
        some = left[there]
        took = rounded(solution, some)
        run += [(tuple((int(there[k]), a) for k, a in c), n) for c, n in took]
        before, left[there] = int(left.sum()), some
        there = np.flatnonzero(left)
        if solution is start or 2 * int(left.sum()) > before:  # best-fit is as good as the program here, or rounding finds little
            break
    run += [(tuple(sorted(c.items())), n) for c, n in best_fit(lengths, left, capacity)]
    best = min(run, plain, key=lambda r: sum(n for _, n in r)) if run else plain
    return [(tuple(int(lengths[k]) for k, a in reversed(config) for _ in range(a)), int(n)) for config, n in best]


def places(configs: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For every length the ranks that each configuration takes: sorted by (length, first rank), with the configuration's first sequence, pieces a sequence, and offset."""
    rows, seen, first = [], {}, 0
    for lengths, copies in configs:
        at = 0
        for x in dict.fromkeys(lengths):
            n = lengths.count(x)
            rows.append((x, seen.get(x, 0), first, n, at))
            seen[x] = seen.get(x, 0) + n * copies
            at += x * n
        first += copies
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return {"key": (table[:, 0] << 44) + table[:, 1], "first": table[:, 2], "each": table[:, 3], "at": table[:, 4]}


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document.

    A null or empty text is the end id alone. Rows that repeat are packed as often as they come; of
    equal pieces any may take any of their places. An empty table gives an empty one.
    """
    pieces = materialise(token_pieces(docs, path or tokenizer_path("word_bpe_49k.json"), capacity, end_id, id_col, text_col))
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    if not histogram:
        return pieces.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    salts = max(64, -(-sum(histogram.values()) // GROUP))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    keys = ["length", "salt"]
    before = salted.groupBy(*keys).count().select(*keys, (F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")).alias("before"))
    ranked = salted.withColumn("own", F.row_number().over(Window.partitionBy(*keys).orderBy("doc_id", "piece"))).join(before, keys)
    table = docs.sparkSession.sparkContext.broadcast(places(configurations(histogram, capacity)))  # bounded by the capacity, not by the rows

    @F.pandas_udf("sequence_id long, offset long")
    def placed(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        t, n, r = table.value, length.to_numpy(), rank.to_numpy()
        i = np.searchsorted(t["key"], (n << 44) + r, "right") - 1
        copy, slot = np.divmod(r - (t["key"][i] & ((1 << 44) - 1)), t["each"][i])
        return pd.DataFrame({"sequence_id": t["first"][i] + copy, "offset": t["at"][i] + slot * n})

    return ranked.withColumn("p", placed("length", F.col("before") + F.col("own") - 1)).select("doc_id", "piece", "start", "length", "ids_crc32", "p.sequence_id", "p.offset")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns of every piece of all documents."""
    return pack(documents(spark, sf_dir))
