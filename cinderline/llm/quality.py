"""Quality (operator 12): a generalised additive model with pairwise interactions over text features.

Each feature is cut into bins and has a lookup table; some pairs of features have a table of two
dimensions. The tables are learned by cyclic boosting: round after round every feature in turn (then
every pair) gets a shallow tree over its bins, fitted to what the others leave, a small part of which
is added to its table. A score is the sum of a text's table entries, by isotonic calibration taken to
a probability. The features of a bounded sample of labelled rows alone come to the driver; every text
is then scored in place, by vectorised additions of bins.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderline.llm.common import documents, id_and_text, map_batches, materialise
from cinderline.llm.language import remainder
from cinderline.llm.toxicity import isotonic

#: Labelled rows that the tables and the calibration are fitted on, as expected number.
SAMPLE = 12_000
#: Bins of a feature, rounds over all features and over all pairs, part of a tree that is added, pairs with a table of their own.
BINS, ROUNDS, PAIR_ROUNDS, RATE, RIDGE, PAIRS = 32, 120, 40, 0.1, 4.0, 8
#: Frequent function words of the corpus's languages.
FUNCTION_WORDS = frozenset("the of and to in is it that was for on are as with be by at this from or an not der die das und ist nicht ein eine zu den mit von für auf dem sich el la los las un una de que y en se del por con para al lo su le les des et est une du dans qui pas pour ce il au sur ne".split())
NAMES = ("words", "word_length", "longest", "capitals", "digits", "marks", "signs", "bars", "exclaim", "stops", "lines", "distinct", "commonest", "function_words", "repeated_lines", "wide", "ends")

UPPER, DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
MARKS, SIGNS = b",;:?\"'()-", b"#$%&*@~^=+<>_\\/{}[]"


def features(text: str) -> list[float]:
    """As NAMES: sizes as logarithms, everything else as shares of the text's bytes, words or lines."""
    raw = text.encode()
    size = max(1, len(raw))
    words = text.split()
    n = max(1, len(words))
    by = Counter(words)
    lines = [x for x in text.split("\n") if x]
    seen = Counter(lines)
    own = lambda chars: (len(raw) - len(raw.translate(None, chars))) / size
    letters = sum(map(len, words))
    return [
        math.log(n), letters / n, math.log(max(map(len, by), default=0) + 1), own(UPPER), own(DIGITS), own(MARKS), own(SIGNS), raw.count(b"|") / n, raw.count(b"!") / n, raw.count(b".") / n, len(lines) / n,
        len(by) / n, max(by.values(), default=0) / n, sum(by[w] for w in FUNCTION_WORDS if w in by) / n, 1 - len(seen) / max(1, len(lines)), (len(raw) - len(text)) / size, float(bool(text) and text.rstrip()[-1:] in ".!?\"»"),
    ]


def edges_of(x: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Limits between bins: quantiles of all values, and of the positive ones, which are rare in some features."""
    all_ = np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="lower")
    some = np.quantile(x[x > 0], np.linspace(0, 1, 9)[:-1], method="lower") * 0.999 if (x > 0).any() else []
    return np.unique(np.concatenate([all_, some]))


def best_cut(g: np.ndarray, h: np.ndarray) -> tuple[int, float]:
    """Where histograms of gradients and weights are cut best in two, and what that gains; axis 0 are bins."""
    a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(a):
        return 0, 0.0
    gain = a**2 / (b + RIDGE) + (g.sum() - a) ** 2 / (h.sum() - b + RIDGE) - g.sum() ** 2 / (h.sum() + RIDGE)
    k = int(gain.argmax())
    return k + 1, float(gain[k])


def value(g: np.ndarray, h: np.ndarray) -> float:
    return float(g.sum() / (h.sum() + RIDGE))


def tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of depth two over the bins of one feature: its value for each bin."""
    out = np.zeros(len(g))
    middle, gain = best_cut(g, h)
    if gain <= 0:
        return out
    for lo, hi in ((0, middle), (middle, len(g))):
        k, more = best_cut(g[lo:hi], h[lo:hi])
        for a, b in ((lo, lo + k), (lo + k, hi)) if more > 0 else ((lo, hi),):
            out[a:b] = value(g[a:b], h[a:b])
    return out


def grid_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """A tree of depth two over the bins of two features, first cut by one, then each side by the other: its value for each cell, and its gain. All first cuts are tried with the best ones that follow."""

    def second(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of histograms the best cut and what both sides then add up to."""
        left, weight = np.cumsum(a, 1)[:, :-1], np.cumsum(b, 1)[:, :-1]
        both = left**2 / (weight + RIDGE) + (a.sum(1)[:, None] - left) ** 2 / (b.sum(1)[:, None] - weight + RIDGE)
        k = both.argmax(1)
        return k + 1, both[np.arange(len(both)), k]

    best, most = np.zeros(g.shape), 0.0
    if min(g.shape) < 2:
        return best, most
    for turn in (False, True):
        a, b = (g.T, h.T) if turn else (g, h)
        upper, weight = np.cumsum(a, 0)[:-1], np.cumsum(b, 0)[:-1]
        (k, x), (m, y) = second(upper, weight), second(a.sum(0) - upper, b.sum(0) - weight)
        at = int((x + y).argmax())
        gain = float((x + y)[at] - a.sum() ** 2 / (b.sum() + RIDGE))
        if gain > most:
            out = np.zeros(a.shape)
            for rows, cut in ((slice(0, at + 1), k[at]), (slice(at + 1, len(a)), m[at])):
                for cols in (slice(0, cut), slice(cut, a.shape[1])):
                    out[rows, cols] = value(a[rows, cols], b[rows, cols])
            best, most = out.T if turn else out, gain
    return best, most


@dataclass
class Additive:
    """base plus a table for each feature, by its bin, plus a table for each pair (i, j, cells), by both bins."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T, strict=True)], 1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        code = self.bins(x)
        out = np.full(len(x), self.base)
        for k, t in enumerate(self.tables):
            out += t[code[:, k]]
        for i, j, t in self.pairs:
            out += t[code[:, i], code[:, j]]
        return out


def boosted(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, rounds: int = ROUNDS, pair_rounds: int = PAIR_ROUNDS) -> Additive:
    """Learns single tables first; then those pairs that a tree over both finds most left in get their tables. All tables have the mean 0 over the rows."""
    mean = min(max(float(y.mean()), 1e-4), 1 - 1e-4)
    model = Additive(math.log(mean / (1 - mean)), [edges_of(c) for c in x.T], [], [])
    code = model.bins(x)
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    margin = np.full(len(y), model.base)

    def left() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for k, table in enumerate(model.tables):
            g, h = left()
            step = RATE * tree(np.bincount(code[:, k], g, len(table)), np.bincount(code[:, k], h, len(table)))
            table += step
            margin += step[code[:, k]]
    shape = lambda i, j: (len(model.tables[i]), len(model.tables[j]))

    def grid(i: int, j: int, weights: np.ndarray) -> np.ndarray:
        rows, cols = shape(i, j)
        return np.bincount(code[:, i] * cols + code[:, j], weights, rows * cols).reshape(rows, cols)

    g, h = left()
    gains = sorted(((grid_tree(grid(i, j, g), grid(i, j, h))[1], i, j) for i, j in combinations(range(x.shape[1]), 2)), key=lambda t: (-t[0], t[1:]))
    model.pairs = [(i, j, np.zeros(shape(i, j))) for gain, i, j in gains[:pairs] if gain > 0]
    for _ in range(pair_rounds):
        for i, j, table in model.pairs:
            g, h = left()
            step = RATE * grid_tree(grid(i, j, g), grid(i, j, h))[0]
            table += step
            margin += step[code[:, i], code[:, j]]
    for k, table in enumerate(model.tables):
        middle = float(table[code[:, k]].mean())
        table -= middle
        model.base += middle
    for i, j, table in model.pairs:
        middle = float(table[code[:, i], code[:, j]].mean())
        table -= middle
        model.base += middle
    return model


@dataclass
class Scorer:
    model: Additive
    at: np.ndarray
    value: np.ndarray

    def score(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        margin = self.model.margin(np.array([features(t) for t in texts]))
        # Beside the calibrated frequency a trace of the margin keeps the order within a pool.
        return np.clip(0.999 * np.interp(margin, self.at, self.value) + 0.001 / (1 + np.exp(-margin)), 0, 1)


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> Scorer | None:
    """Fits on about `rows` of the labelled documents, chosen by their ids' hash; a quarter of them calibrates. Of several labels of an id the greatest counts. None without labels."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    total = known.count()
    if not total:
        return None
    share = min(1_000_000, -(-1_000_000 * rows // total))
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit(31)), F.lit(1_000_000)) < share)
    sample = id_and_text(docs).join(F.broadcast(chosen), "doc_id")  # bounded by `rows`

    def made(b: pa.RecordBatch) -> pa.RecordBatch:
        x = [features(t) for t in b.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "quality", "x"])

    table = materialise(map_batches(sample, made, "doc_id long, quality int, x array<double>"))
    pdf = table.withColumn("aside", F.pmod(F.xxhash64("doc_id", F.lit(32)), F.lit(4)) == 0).toPandas().sort_values("doc_id", kind="stable")
    if pdf.empty:
        return None
    x, y, aside = np.stack(pdf["x"].to_list()), pdf["quality"].to_numpy(float), pdf["aside"].to_numpy(bool)
    if aside.all() or not aside.any():
        aside = np.arange(len(y)) % 4 == 0
    model = boosted(x[~aside], y[~aside]) if (~aside).any() else boosted(x, y)
    return Scorer(model, *isotonic(model.margin(x[aside]), y[aside]))


def score_quality(docs: DataFrame, scorer: Scorer | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score. A null text counts as empty and has a score like any other; without a model all scores are 0.

    Texts are read whole. Repeated rows stay and tie, an empty table gives an empty one, other columns go.
    """
    rows = id_and_text(docs, id_col, text_col)
    if scorer is None:
        return rows.select("doc_id", F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(scorer)  # tables of a fixed number of bins

    def scored(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(shared.value.score(b.column("text").to_pylist()))], ["doc_id", "score"])

    return map_batches(rows, scored, "doc_id long, score double")


def learned_quality(docs: DataFrame, labels: DataFrame) -> Scorer | None:
    """Fitted on the labelled rows with an id outside the fold whose crc32(doc_id) leaves 0 of 5."""
    return fit_quality(docs, labels.where(~remainder(5).isin(-1, 0)))


LIMIT = 0.3


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and prediction of every whole text, and whether its labels were kept from the model; rows without an id are in no fold (false)."""
    docs = documents(spark, sf_dir)
    scorer = learned_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, scorer).select("doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= LIMIT).cast("int").alias("predicted"))
