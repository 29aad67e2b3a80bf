"""Language scores of every row from plain counts; operators and stages beside columns whose names clash with their own; rejection beside held-back text."""

import re
from collections import Counter, defaultdict
from math import log2

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinderline.llm import collocations, common, fingerprints, language, media, packing, piece_codec, pseudonyms, quality, queries, secrets, simhash, spelling, token_counts, toxicity
from tests.conftest import SMALL


class KneserNey:
    """One language's four-gram model by the textbook: dictionaries, a character at a time."""

    def __init__(self, texts):
        level = Counter(p[i : i + 4] for t in texts for p in [padded(t)] for i in range(len(p) - 3))
        self.levels = {}
        for n in (4, 3, 2, 1):
            once, twice = sum(v == 1 for v in level.values()), sum(v == 2 for v in level.values())
            total, kinds = defaultdict(int), defaultdict(int)
            for g, v in level.items():
                total[g[:-1]] += v
                kinds[g[:-1]] += 1
            self.levels[n] = (dict(level), total, kinds, once / (once + 2 * twice) if once and twice else 0.5)
            level = Counter(g[1:] for g in level)  # of how many different characters each is preceded
        self.unseen = 1 / (len(self.levels[1][0]) + 1)

    def p(self, gram):
        if not gram:
            return self.unseen
        counts, total, kinds, discount = self.levels[len(gram)]
        if gram[:-1] not in total:
            return self.p(gram[1:])
        n = total[gram[:-1]]
        return max(counts.get(gram, 0) - discount, 0) / n + discount * kinds[gram[:-1]] / n * self.p(gram[1:])


def padded(t):
    return f"   {re.sub(r'[\W\d_]+', ' ', t.lower()).strip()} "


def test_language_of_every_row(spark):
    """op2's prediction and score of all documents, recomputed from the rows that its models are fitted on."""
    d = common.documents(spark, SMALL)
    fitting = d.where(~language.remainder(4).isin(-1, 2) & F.col("lang").isNotNull() & (F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(5)) != 0))
    by = defaultdict(list)
    for r in fitting.collect():  # fewer than the sample's size, so all are in it
        by[r.lang].append(r.text or "")
    models = {x: KneserNey(ts) for x, ts in sorted(by.items())}
    memo = {x: {} for x in models}

    def bits(lang, gram):
        m = memo[lang]
        if gram not in m:
            m[gram] = -log2(models[lang].p(gram))
        return m[gram]

    got = {r.doc_id: r for r in queries.QUERIES["op2_language"](spark, SMALL).collect()}
    texts = {r.doc_id: r.text or "" for r in d.collect()}
    assert got.keys() == texts.keys()
    for doc, text in texts.items():
        p = padded(text)
        n = len(p) - 3
        if not any(map(str.isalpha, text)):
            assert got[doc].lang_pred == "und" and got[doc].score == 0
            continue
        ce = {x: sum(bits(x, p[i : i + 4]) for i in range(n)) / n for x in models}
        best = min(ce, key=ce.get)
        score = 1 / sum(2 ** (-(c - ce[best]) * min(n, 60)) for c in ce.values())
        assert got[doc].lang_pred == best and abs(got[doc].score - score) < 1e-3 and abs(got[doc].cross_entropy - ce[best]) < 1e-3


def test_rejection_of_held_back_text(spark):
    """Of the languages' own texts that no model saw, of any length, at most one in a hundred is rejected."""
    d = common.documents(spark, SMALL.replace("sf0.001", "sf0.1"))
    models = language.learned_languages(d)
    held = [r.text for r in d.where((language.remainder(4) == 2) & (F.length("text") > 40)).select("text").collect()]
    cut = [t[:n] for t in held[:400] for n in (40, 100, 300) if len(t) >= n]
    assert len(held) > 1000 and np.mean(models.predict(held)[3]) < 0.01 and np.mean(models.predict(cut)[3]) < 0.02


CLASHING = ("count", "row", "_print", "print", "rules", "salt", "component_id", "word", "n", "phrase", "id", "block", "lists", "found", "score", "piece", "start", "length", "bucket", "gram", "key", "part", "size", "data", "spans", "a", "b", "u", "v", "m")
TEXTS = ["one two three four. one two three four", "One two three four. one two three four", "mail jo@x.com or token = abcdefgh12345", "", None, "idiot you 1d10t fool", "abcdefg abcdefh abcdefg abcdefg"]


NAMES = ["simhash", "keep_one", "identify", "keep_languages", "toxicity", "keep_harmless", "packing", "media", "tokens", "fingerprints", "pseudonyms", "without_private", "pieces", "secrets", "spelling", "quality", "collocations"]


def operators(spark):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(7)], "doc_id long, quality long, toxic long")
    return {
        "simhash": simhash.simhash_components, "keep_one": simhash.keep_one, "identify": lambda d: language.identify(d, language.fit_languages(d)), "keep_languages": language.keep_languages,
        "toxicity": lambda d: toxicity.score_toxicity(d, toxicity.fit_toxicity(d, labels)), "keep_harmless": lambda d: toxicity.keep_harmless(d, labels), "packing": packing.pack, "media": media.text_media,
        "tokens": token_counts.count_tokens, "fingerprints": fingerprints.fingerprints, "pseudonyms": pseudonyms.pseudonyms, "without_private": pseudonyms.without_private, "pieces": piece_codec.encode_pieces,
        "secrets": secrets.scan_secrets, "spelling": spelling.spelling_variants, "quality": lambda d: quality.score_quality(d, quality.fit_quality(d, labels)), "collocations": lambda d: collocations.collocations(d, often=2),
    }


@pytest.mark.parametrize("name", NAMES)
def test_clashing_columns(spark, name):
    """Extra columns, whatever their names, change no row of a result, and a stage keeps them."""
    rows = [(i, t, "en" if i % 3 else "de") for i, t in enumerate(TEXTS)]
    plain = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, lang string")
    mixed = plain.select("*", *(F.lit(f"mine {c}").alias(c) for c in CLASHING))
    run = operators(spark)[name]
    want, got = run(plain), run(mixed)
    own = want.columns
    assert sorted(map(repr, got.select(*own).collect())) == sorted(map(repr, want.collect()))
    if name.startswith("keep_") or name == "without_private":
        assert got.columns == mixed.columns and all(r["count"] == "mine count" for r in got.collect())
