"""Toxicity (operator 3): boosted trees over dense text features, calibrated by isotonic regression.

Features: densities of a stated lexicon and of stems learned from the labels, how near second-person
words stand to hits, capitals, punctuation and obfuscated spellings. The trees (logistic loss,
histogram splits) and the calibration are fitted on a bounded sample of the labelled rows, whose
features alone come to the driver; every text is then scored in place.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderline.llm.common import documents, id_and_text, map_batches, materialise
from cinderline.llm.language import remainder

#: Labelled rows that the trees and the calibration are fitted on, as expected number.
SAMPLE = 12_000
#: Insults, and words that address the reader, in the corpus's languages.
INSULTS = frozenset("idiot idiots moron morons stupid scum trash loser losers pathetic worthless disgusting clown clowns dumb fool jerk bastard asshole bitch shit fuck fucking idiota estúpido imbécil basura asqueroso payaso idiote stupide connard imbécile salaud minable dégoûtant dumm dummkopf arschloch abschaum versager widerlich wertlos".split())
SECOND_PERSON = frozenset("you your yours yourself u ur tú tu te ti usted ustedes vosotros toi ton ta tes vous votre vos du dich dir dein deine ihr euch".split())
#: Characters that stand for letters.
LEET = str.maketrans("013457@$!|", "oieastasil")
EDGES = ".,;:!?\"'()[]{}<>*#$%&|-_/\\…«»„“”"
#: Signs inside or before letters, and words in capitals.
SIGNS = re.compile(r"[0-9@$!|*]+(?=[^\W\d_])")
LOUD = re.compile(r"\b[A-Z]{4,}\b")
UPPER = bytes(range(65, 91))
NEAR = 4
STEMS = (4, 5, 6)
NAMES = ("length", "insults", "insult_count", "learned", "learned_count", "learned_weight", "address", "address_near", "capitals", "shouted", "exclaim", "punctuation", "mixed", "mixed_insults")


def stems(word: str) -> list[str]:
    """A word and its first letters, as the learned lexicon may hold them."""
    return [word, *(word[:k] + "-" for k in STEMS if len(word) >= k)] if len(word) > 2 else []


class Words(dict):
    """A lower-case word as it stands in the text -> None, or (insult, learned weight, second person)."""

    LIMIT = 200_000

    def __init__(self, weights: dict[str, float]):
        self.weights = weights

    def __missing__(self, word: str):
        w = word.strip(EDGES)
        found = (w in INSULTS, max((self.weights.get(s, 0.0) for s in stems(w)), default=0.0), w in SECOND_PERSON)
        found = found if any(found) else None
        if len(self) < self.LIMIT:
            self[word] = found
        return found

    def features(self, text: str) -> list[float]:
        low = text.lower()
        marks = [(i, m) for i, m in enumerate(map(self.__getitem__, low.split())) if m]
        words = low.count(" ") + low.count("\n") + 1
        hits, own, told = [i for i, m in marks if m[0]], [m[1] for _, m in marks if m[1]], [i for i, m in marks if m[2]]
        near = 0
        if told:
            at = np.array(told)
            near = sum(bool((np.abs(at - i) <= NEAR).any()) for i, m in marks if m[0] or m[1])
        raw = text.encode()
        chars = max(1, len(raw))
        mixed = hidden = end = 0
        word_hit = False
        for m in SIGNS.finditer(low):
            if m.start() >= end:  # the signs of one word have one look at it
                a, end = low.rfind(" ", 0, m.start()) + 1, low.find(" ", m.end())
                end = end if end >= 0 else len(low)
                found = self[low[a:end].strip(EDGES).translate(LEET).replace("*", "")]
                word_hit = bool(found and (found[0] or found[1]))
            mixed += 1
            hidden += word_hit
        capitals = len(raw) - len(raw.translate(None, UPPER))
        loud = len(LOUD.findall(text)) if capitals > 3 else 0
        plain = sum(map(text.count, ".,;:?"))
        return [math.log(words), len(hits) / words, min(len(hits), 20), len(own) / words, min(len(own), 20), sum(own) / words, len(told) / words, near / words, capitals / chars, loud / words, text.count("!") / chars, plain / chars, mixed / words, hidden / words]


@dataclass
class Trees:
    """Boosted trees of a fixed depth as arrays: at each inner node a feature and a limit, at each leaf a value."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    limit: np.ndarray
    leaf: np.ndarray  # trees x leaves

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        inner = self.feature.shape[1]
        for f, t, v in zip(self.feature, self.limit, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while node.size and node[0] < inner:
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - inner]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.25, bins: int = 32, ridge: float = 1.0) -> Trees:
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
    # Rare features are zero almost everywhere; their own positive quantiles are cuts too.
    cuts = [np.unique(np.concatenate([q, np.quantile(c[c > 0], np.linspace(0, 1, 9)[:-1], method="lower") * 0.999 if (c > 0).any() else []])) for q, c in zip(cuts, x.T, strict=True)]
    code = np.stack([np.searchsorted(q, c, "left") for q, c in zip(cuts, x.T, strict=True)], 1)  # c > q[k] exactly if code > k
    mean = min(max(float(y.mean()), 1e-4), 1 - 1e-4)
    base = math.log(mean / (1 - mean))
    margin = np.full(len(y), base)
    inner, leaves = 2**depth - 1, 2**depth
    fs, ts, vs = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        f, t = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for at in range(inner):
            here = np.flatnonzero(node == at)
            best = 1e-6
            cut_code = None
            if len(here) >= 2:
                total_g, total_h = g[here].sum(), h[here].sum()
                for k, q in enumerate(cuts):
                    gl = np.cumsum(np.bincount(code[here, k], g[here], len(q) + 1))[:-1]
                    hl = np.cumsum(np.bincount(code[here, k], h[here], len(q) + 1))[:-1]
                    gain = gl**2 / (hl + ridge) + (total_g - gl) ** 2 / (total_h - hl + ridge) - total_g**2 / (total_h + ridge)
                    if len(gain) and gain.max() > best:
                        best, f[at], cut_code = gain.max(), k, int(gain.argmax())
                        t[at] = q[cut_code]
            right = np.zeros(len(here), bool) if cut_code is None else code[here, f[at]] > cut_code
            node[here] = 2 * at + 1 + right
        leaf = node - inner
        value = rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + ridge)
        margin += value[leaf]
        fs.append(f), ts.append(t), vs.append(value)
    return Trees(base, np.array(fs), np.array(ts), np.array(vs))


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of a rising function from margins to frequencies: neighbours that fall are pooled; a pool's value holds from its least to its greatest margin, with straight lines between pools."""
    order = np.argsort(score, kind="stable")
    pools: list[list[float]] = []  # sum, number, least, greatest
    for x, v in zip(score[order].tolist(), y[order].tolist(), strict=True):
        pools.append([v, 1.0, x, x])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            v2, n2, _, top = pools.pop()
            pools[-1] = [pools[-1][0] + v2, pools[-1][1] + n2, pools[-1][2], top]
    return np.array([x for p in pools for x in p[2:]]), np.array([p[0] / p[1] for p in pools for _ in (0, 1)])


@dataclass
class Scorer:
    words: Words
    trees: Trees
    at: np.ndarray
    value: np.ndarray

    def score(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        margin = self.trees.margin(np.array([self.words.features(t) for t in texts]))
        # Beside the calibrated frequency a trace of the margin keeps the order within a pool.
        return np.clip(0.999 * np.interp(margin, self.at, self.value) + 0.001 / (1 + np.exp(-margin)), 0, 1)


def learn_lexicon(sample: DataFrame, most: int = 500) -> dict[str, float]:
    """Words, and stems with a dash, that stand in at least 1.5 % of the toxic texts (and five) and are twenty times as frequent there, with their log odds."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for b in batches:
            for text, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                count[y].update({x for w in set(text.lower().split()) for x in stems(w.strip(EDGES))})
        rows = [(w, y, n) for y in (0, 1) for w, n in count[y].items()]
        yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["word", "toxic", "n"]).astype({"word": "str", "toxic": "int64", "n": "int64"}), pa.schema([("word", pa.string()), ("toxic", pa.int64()), ("n", pa.int64())]), preserve_index=False)

    size = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    pos, neg = size.get(1, 0), size.get(0, 0)
    if not pos or not neg:
        return {}
    by = sample.select("text", "toxic").mapInArrow(seen, "word string, toxic long, n long").groupBy("word").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("q"))
    odds = F.log((F.col("p") + 0.5) / (pos + 1)) - F.log((F.col("q") + 0.5) / (neg + 1))
    found = by.where(F.col("p") >= max(5, 0.015 * pos)).select("word", odds.alias("w")).where(f"w > {math.log(20)}").orderBy(F.desc("w"), "word").limit(most)
    return {r["word"]: float(r["w"]) for r in found.collect()}


def fit_toxicity(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> Scorer | None:
    """Fits on about `rows` of the labelled documents, chosen by their ids' hash; a quarter of them calibrates. None without labels."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = known.count()
    if not total:
        return None
    share = min(1_000_000, -(-1_000_000 * rows // total))
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit(21)), F.lit(1_000_000)) < share)
    sample = materialise(id_and_text(docs).join(F.broadcast(chosen), "doc_id"))  # bounded by `rows`; written, as it is read three times
    sample = sample.withColumn("aside", F.pmod(F.xxhash64("doc_id", F.lit(22)), F.lit(4)) == 0)
    words = Words(learn_lexicon(sample.where("not aside")))

    def made(b: pa.RecordBatch) -> pa.RecordBatch:
        x = [words.features(t) for t in b.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), b.column("aside"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "toxic", "aside", "x"])

    pdf = map_batches(sample, made, "doc_id long, toxic int, aside boolean, x array<double>").toPandas().sort_values("doc_id")
    if pdf.empty:
        return None
    x, y, aside = np.stack(pdf["x"].to_list()), pdf["toxic"].to_numpy(float), pdf["aside"].to_numpy(bool)
    if aside.all() or not aside.any():
        aside = np.arange(len(y)) % 4 == 0
    trees = boost(x[~aside], y[~aside]) if (~aside).any() else boost(x, y)
    return Scorer(words, trees, *isotonic(trees.margin(x[aside]), y[aside]))


def score_toxicity(docs: DataFrame, scorer: Scorer | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score. A null text counts as empty and has a score like any other; without a model all scores are 0.

    Texts are read whole. Repeated rows stay and tie, an empty table gives an empty one, other columns go.
    """
    rows = id_and_text(docs, id_col, text_col)
    if scorer is None:
        return rows.select("doc_id", F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(scorer)  # trees and at most some hundred words

    def scored(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(shared.value.score(b.column("text").to_pylist()))], ["doc_id", "score"])

    return map_batches(rows, scored, "doc_id long, score double")


def learned_toxicity(docs: DataFrame, labels: DataFrame) -> Scorer | None:
    """Fitted on the labelled rows with an id outside the fold whose crc32(doc_id) leaves 1 of 3."""
    return fit_toxicity(docs, labels.where(~remainder(3).isin(-1, 1)))


LIMIT = 0.7


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and prediction of every whole text, and whether its labels were kept from the model; rows without an id are in no fold (false)."""
    docs = documents(spark, sf_dir)
    scorer = learned_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, scorer).select("doc_id", (remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= LIMIT).cast("int").alias("predicted"))


def keep_harmless(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score is below the limit, all columns kept.

    Null and empty texts are scored as the empty text. Without any label all stay. Repeated rows have
    one fate; an empty table gives an empty one.
    """
    scorer = learned_toxicity(docs, labels)
    if scorer is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    @F.pandas_udf("boolean")
    def kept(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(texts.tolist()) < LIMIT)

    return docs.where(kept(F.coalesce("text", F.lit(""))))
