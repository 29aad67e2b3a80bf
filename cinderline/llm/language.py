"""Language identification (operator 2) by interpolated Kneser-Ney character models.

Texts become letters and single blanks. For each language the four-character counts of a bounded
sample give interpolated Kneser-Ney probabilities of every character after three others, stored for
all languages together: sorted arrays of n-gram hashes, each with one log-probability a language.
What no language has seen backs off through the shorter arrays. The language with the lowest
cross-entropy a character wins; texts whose cross-entropy is far above what the sample's own held-back
texts of that language and length show are rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderline.llm.common import documents, id_and_text, map_batches

ORDER = 4
#: Labelled documents a language that the models are fitted on, as expected number; a fifth of them calibrates.
PER_LANGUAGE = 1500
#: A text is rejected beyond MARGIN times this quantile of the excess of its language's held-back texts, and never below LEAST_LIMIT.
QUANTILE, MARGIN, LEAST_LIMIT = 0.98, 3.0, 16.0
#: Held-back texts that calibrate a language by itself; with fewer it has the spread and limit of all together.
ENOUGH = 10
#: Characters scored at a time; a character takes some hundred bytes meanwhile.
SLICE = 1 << 17
MIX = np.uint64(0x9E3779B97F4A7C15)  # odd, so multiplying is one-to-one
SPLIT = re.compile(r"[\W\d_]+")


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def padded(text: str) -> str:
    return f"   {SPLIT.sub(' ', text.lower()).strip()} "


def portions(texts: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """The padded texts, about SLICE characters at a time, with the text that each part is from. Long texts are cut; parts overlap, so that each window is in one of them."""
    owners, parts, n = [], [], 0
    for i, text in enumerate(texts):
        p = padded(text)
        for a in range(0, len(p) - ORDER + 1, SLICE):
            owners.append(i)
            parts.append(p[a : a + SLICE + ORDER - 1])
            n += len(parts[-1])
            if n >= SLICE:
                yield np.array(owners), parts
                owners, parts, n = [], [], 0
    if parts:
        yield np.array(owners), parts


def windows(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Packed four-character windows of all parts, 16 bits a character, and each part's number of them."""
    sizes = np.array([len(p) for p in parts], np.int64)
    # UTF-32 has one unit a character; rare ones beyond 16 bits share a code.
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "replace"), "<u4")
    c = np.where(codes > 0xFFFF, 0xFFFF, codes).astype(np.uint64)
    packed = np.zeros(max(0, len(c) - ORDER + 1), np.uint64)
    for k in range(ORDER):
        packed = (packed << np.uint64(16)) | c[k : len(c) - ORDER + 1 + k]
    ends = np.cumsum(sizes)
    keep = np.ones(len(packed), bool)
    for k in range(1, ORDER):  # windows across two parts
        keep[np.clip(ends[:-1] - k, 0, None)] = False
    return packed[keep], sizes - ORDER + 1


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The windows of whole texts."""
    return windows([padded(t) for t in texts])


def kneser_ney(counts: pd.Series) -> list[dict]:
    """counts: packed four-grams of one language -> count. For orders 1 to 4: p, the interpolated probability of each n-gram, and weight, by context, of the order below."""
    level = counts.astype(np.float64)
    stack = []
    for n in range(ORDER, 0, -1):
        stack.append((n, level))
        # The next lower counts are of different characters that precede.
        tail = level.index.to_numpy() & np.uint64((1 << 16 * (n - 1)) - 1)
        level = pd.Series(1.0, index=pd.Index(tail)).groupby(level=0).sum()
    out, below = [], None
    for n, level in reversed(stack):
        keys = level.index.to_numpy()
        once, twice = float((level == 1).sum()), float((level == 2).sum())
        discount = once / (once + 2 * twice) if once and twice else 0.5
        context = keys >> np.uint64(16)
        by = pd.DataFrame({"n": level.to_numpy(), "one": 1.0}).groupby(context).sum()
        total, kinds = by["n"].reindex(context).to_numpy(), by["one"].reindex(context).to_numpy()
        lower = below.reindex(keys & np.uint64((1 << 16 * (n - 1)) - 1)).to_numpy() if below is not None else np.full(len(keys), 1.0 / (len(keys) + 1))
        p = np.maximum(level.to_numpy() - discount, 0) / total + discount * kinds / total * lower
        below = pd.Series(p, index=keys)
        out.append({"p": below, "weight": discount * by["one"] / by["n"], "unseen": 1.0 / (len(keys) + 1)})
    return out


@dataclass
class Models:
    """levels: for orders 4 down to 1 the sorted n-gram hashes with log-probabilities (a column a language), and the sorted context hashes with the logarithms of the weights. unseen: log-probability of a character that a language never has."""

    langs: list[str]
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    unseen: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    most: np.ndarray

    def find(self, keys: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return at, table[at] == keys

    def log_p(self, packed: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Rows: n-grams, columns: languages."""
        if not order:
            return np.broadcast_to(self.unseen, (len(packed), len(self.langs)))
        hashes, values, contexts, weights = self.levels[ORDER - order]
        at, there = self.find(packed * MIX, hashes)
        out = values[at]
        if not there.all():
            miss = packed[~there]
            at, known = self.find((miss >> np.uint64(16)) * MIX, contexts)
            out[~there] = np.where(known[:, None], weights[at], 0) + self.log_p(miss & np.uint64((1 << 16 * (order - 1)) - 1), order - 1)
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy a character in bits (a column a language), and each text's characters."""
        sizes = np.zeros(len(texts), np.int64)
        total = np.zeros((len(texts), len(self.langs)))
        for owners, parts in portions(texts):
            packed, n = windows(parts)
            np.add.at(sizes, owners, n)
            np.add.at(total, owners, np.add.reduceat(self.log_p(packed), np.cumsum(n) - n, axis=0, dtype=np.float64))
        return -total / sizes[:, None] / np.log(2), sizes

    def excess(self, ce: np.ndarray, sizes: np.ndarray, best: np.ndarray) -> np.ndarray:
        """How many times the usual spread at this length the cross-entropy is above the language's mean."""
        return (ce - self.mean[best]) / (self.spread[best] * (1 / np.sqrt(sizes) + 0.02))

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language (und without a letter), score, cross-entropy, rejected."""
        ce, sizes = self.entropies(texts)
        best = ce.argmin(1)
        lowest = ce[np.arange(len(ce)), best]
        score = 1 / np.exp2(-(ce - lowest[:, None]) * np.minimum(sizes, 60)[:, None]).sum(1)
        letters = np.array([has_letter(t) for t in texts], bool)
        over = self.excess(lowest, sizes, best) > self.most[best]
        return [self.langs[b] if x else "und" for b, x in zip(best.tolist(), letters.tolist(), strict=True)], np.where(letters, score, 0.0), np.where(letters, lowest, np.nan), over | ~letters


def fit_languages(labelled: DataFrame, lang_col: str = "lang", per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text") -> Models | None:
    """Models of the languages among the labelled rows; None without any.

    At most about per_language rows a language are used, chosen by their ids' hash; their counts come
    to the driver, so the number of languages is taken to be some hundred at most.
    """
    rows = labelled.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return None
    share = F.create_map(*(x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1_000_000, -(-1_000_000 * per_language // n))))))
    sample = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) < share[F.col("lang")]).withColumn("aside", F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(5)) == 0)

    def counted(b: pa.RecordBatch) -> pa.RecordBatch:
        texts, langs = np.array(b.column("text").to_pylist(), object), np.array(b.column("lang").to_pylist(), object)
        parts = []
        for lang in sorted(set(langs.tolist())):
            for _, some in portions(texts[langs == lang].tolist()):
                keys, n = np.unique(windows(some)[0], return_counts=True)
                parts.append(pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys.view(np.int64)), pa.array(n)], ["lang", "gram", "n"]))
        return pa.concat_batches(parts)

    fitting = map_batches(sample.where("not aside").select("lang", "text"), counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(fitting["lang"].unique())
    if not langs:
        return None
    fits = {}
    for lang in langs:
        own = fitting[fitting["lang"] == lang]
        fits[lang] = kneser_ney(pd.Series(own["n"].to_numpy(), index=pd.Index(own["gram"].to_numpy(np.int64).view(np.uint64))).sort_index())
    unseen = np.log(np.array([fits[x][0]["unseen"] for x in langs]))
    models = Models(langs, [], unseen, np.zeros(len(langs)), np.ones(len(langs)), np.full(len(langs), LEAST_LIMIT))
    for n in range(1, ORDER + 1):  # each order's values back off to those before
        keys = np.unique(np.concatenate([fits[x][n - 1]["p"].index.to_numpy() for x in langs]))
        contexts = np.unique(np.concatenate([fits[x][n - 1]["weight"].index.to_numpy() for x in langs]).astype(np.uint64))
        weights = np.stack([np.log(fits[x][n - 1]["weight"].reindex(contexts).fillna(1.0).to_numpy()) for x in langs], 1)
        models.levels = [(np.array([2**64 - 1], np.uint64), np.zeros((1, len(langs))), np.array([2**64 - 1], np.uint64), np.zeros((1, len(langs))))] * (ORDER - n + 1) + models.levels
        own = np.stack([fits[x][n - 1]["p"].reindex(keys).to_numpy() for x in langs], 1)
        back = models.log_p(keys & np.uint64((1 << 16 * (n - 1)) - 1), n - 1) if n > 1 else np.broadcast_to(unseen, own.shape)
        back = back + weights[np.searchsorted(contexts, keys >> np.uint64(16))]
        values = np.where(np.isnan(own), back, np.log(np.where(np.isnan(own), 1.0, own)))
        models.levels = models.levels[ORDER - n + 1 :]
        a, b = np.argsort(keys * MIX), np.argsort(contexts * MIX)
        models.levels.insert(0, ((keys * MIX)[a], values[a].astype(np.float32), (contexts * MIX)[b], weights[b].astype(np.float32)))
    return calibrated(models, sample.where("aside").select("lang", "text"))


def calibrated(models: Models, aside: DataFrame) -> Models:
    """Sets means, spreads and limits of rejection, by language, from texts that were held back and whose best language is their label.

    Medians and quantiles are used, so that single garbled texts move nothing.
    """
    index = {x: i for i, x in enumerate(models.langs)}
    shared = aside.sparkSession.sparkContext.broadcast(models)

    def scored(b: pa.RecordBatch) -> pa.RecordBatch:
        texts, langs = b.column("text").to_pylist(), b.column("lang").to_pylist()
        ce, sizes = shared.value.entropies(texts)
        own = np.array([index.get(x, -1) for x in langs])
        ok = (own == ce.argmin(1)) & np.array([has_letter(t) for t in texts], bool)
        return pa.RecordBatch.from_arrays([pa.array(own[ok]), pa.array(ce[np.arange(len(ce)), own][ok]), pa.array(sizes[ok])], ["own", "ce", "size"])

    held = map_batches(aside, scored, "own long, ce double, size long").toPandas()
    if held.empty:  # nothing to tell by: nothing is rejected
        models.spread[:] = 1e9
        return models
    own, ce, sizes = (held[c].to_numpy() for c in ("own", "ce", "size"))

    def middle(rows: np.ndarray) -> float:
        order = np.argsort(ce[rows])
        weight = np.cumsum(sizes[rows][order])
        return float(ce[rows][order][np.searchsorted(weight, weight[-1] / 2)])

    each = [np.flatnonzero(own == i) for i in range(len(models.langs))]
    models.mean[:] = max(middle(rows) for rows in each if len(rows))
    for i, rows in enumerate(each):
        if len(rows):
            models.mean[i] = middle(rows)
    off = (ce - models.mean[own]) / (1 / np.sqrt(sizes) + 0.02)
    for i, rows in enumerate(each):
        some = off if len(rows) < ENOUGH else off[rows]
        models.spread[i] = max(0.05, float(np.quantile(np.abs(some), 0.6827)))
        models.most[i] = max(LEAST_LIMIT, MARGIN * float(np.quantile(some, QUANTILE, method="lower")) / models.spread[i])
    return models


def identify(docs: DataFrame, models: Models | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (0 to 1), cross_entropy (bits a character), rejected.

    A text without a letter, or null, is und with score 0, as is every text if there are no models.
    Texts are read whole, in parts of bounded size; of languages that tie the first in order wins.
    Repeated rows stay, an empty table gives an empty one, other columns go.
    """
    rows = id_and_text(docs, id_col, text_col)
    if models is None:
        return rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("cross_entropy"), F.lit(True).alias("rejected"))
    shared = docs.sparkSession.sparkContext.broadcast(models)  # bounded by the sample

    def told(b: pa.RecordBatch) -> pa.RecordBatch:
        langs, score, ce, rejected = shared.value.predict(b.column("text").to_pylist())
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(langs), pa.array(score), pa.array(ce, from_pandas=True), pa.array(rejected)], ["doc_id", "lang_pred", "score", "cross_entropy", "rejected"])

    return map_batches(rows, told, "doc_id long, lang_pred string, score double, cross_entropy double, rejected boolean")


def remainder(modulus: int, id_col: str = "doc_id"):
    """The fold of an id; -1 without one, which is no fold."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(modulus)), F.lit(-1))


def learned_languages(docs: DataFrame) -> Models | None:
    """Models from the rows with an id outside the fold whose crc32(doc_id) leaves 2 of 4."""
    return fit_languages(docs.where(~remainder(4).isin(-1, 2)))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and score of every whole text, and whether its row was kept from the models; rows without an id were too, but are in no fold (false)."""
    docs = documents(spark, sf_dir)
    return identify(docs, learned_languages(docs)).withColumn("held_out", remainder(4) == 2)


def keep_languages(docs: DataFrame) -> DataFrame:
    """The documents that are not rejected, all columns kept.

    Null and empty texts and those without a letter are rejected. Without any labelled row there is
    nothing to tell by, and all stay. Repeated rows have one fate; an empty table gives an empty one.
    """
    models = learned_languages(docs)
    if models is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(models)

    @F.pandas_udf("boolean")
    def kept(texts: pd.Series) -> pd.Series:
        return pd.Series(~shared.value.predict(texts.tolist())[3])

    return docs.where(kept(F.coalesce("text", F.lit(""))))
