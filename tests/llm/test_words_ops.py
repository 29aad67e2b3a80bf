"""Spelling variants, quality and collocations against plain re-implementations."""

import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from cinderline.llm import collocations, quality, queries, spelling
from tests.conftest import SMALL
from tests.test_queries import rows

DOCS = "doc_id long, text string, lang string, word string, phrase string, n long, score double"


def frame(spark, docs):
    """(doc_id, text, lang), with extra columns whose names clash."""
    return spark.createDataFrame([(*d, "mine", "mine", 7, 0.5) for d in docs], DOCS)


def noise(n, alphabet, longest, seed):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randrange(longest))) for _ in range(n)]


@pytest.mark.parametrize("name", ["op11_spelling", "op13_collocations"])
def test_against_sql(spark, name):
    got = queries.QUERIES[name](spark, SMALL).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    want = con.sql(queries.ORACLE_SQL[name]).df()
    whole = lambda df: df.assign(**{c: df[c].astype("Int64") for c in df.columns if df[c].dtype.kind in "fiu"})  # noqa: E731 - counts, some of them null
    assert len(got) and sorted(got.columns) == sorted(want.columns)
    assert rows(whole(got)) == rows(whole(want))


def edits(a, b):
    """0, 1, or 2 for more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > 1:
        return 2
    if len(a) == len(b):
        return min(2, sum(x != y for x, y in zip(a, b, strict=True)))
    long, short = sorted((a, b), key=len, reverse=True)
    return 1 if any(long[:k] + long[k + 1 :] == short for k in range(len(long))) else 2


def plain_spelling(docs):
    n = Counter()
    for doc, text in docs:
        for run in spelling.RUN.findall((text or "").translate({c: c + 32 for c in range(65, 91)})):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            word = run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]
            n[word] += len(word) >= 7
    n = {w: k for w, k in n.items() if k >= 2}
    near = {w: [x for x in n if edits(w, x) == 1] for w in n}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= 10 * n[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n}


def variants(seed):
    """Words of a small alphabet, so that most are near others; a chain of forms, very long words, capitals, letters beyond ASCII."""
    r = random.Random(seed)
    words = [w for w in noise(400, "aab", 11, seed) if len(w) >= 6] + ["abcdefg"] * 300 + ["abcdefh"] * 20 + ["abcdeih"] * 2 + ["Äbcdefgé", "Äbcdefge", "ÄBcdefgé"] * 2
    words += ["x" * 3000, "x" * 3000, "x" * 1500 + "y" + "x" * 1499, "x" * 1500 + "y" + "x" * 1499, "x" * 2999, "x" * 2999]
    r.shuffle(words)
    texts = [" ".join(words[i::9]) + ".×÷ 12 ß" for i in range(9)]
    return [*enumerate(texts), (None, texts[0]), (4, texts[1]), (5, None), (6, ""), (7, "abcdefg,abcdefg;ABCDEFG")]


@pytest.mark.parametrize("group", [2, 30, spelling.GROUP])
def test_spelling_cases(spark, group):
    """Cells cut to the end, some times, and never."""
    docs = variants(3)
    got = spelling.spelling_variants(frame(spark, [(i, t, "en") for i, t in docs]), group=group).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert {tuple(x) for x in got} == plain_spelling(docs) and len(got) == len({x.word for x in got})
    assert any(x.root != x.form for x in got if x.form) and any(len(x.word) > 2000 and x.n_near for x in got)


def test_spelling_empty(spark):
    assert spelling.spelling_variants(frame(spark, [])).count() == 0
    assert spelling.spelling_variants(frame(spark, [(1, None, None), (2, "12 .", "x"), (None, "short", None)])).count() == 0


def test_near_words():
    """A cell's tries against all pairs, where many words end inside others."""
    r = random.Random(1)
    for _ in range(60):
        length, below = r.randrange(7), r.choice([99, 2])
        words = list({"".join(r.choice("abc") for _ in range(length + r.randrange(2))) for _ in range(60)})
        first = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        near = [[j for j, b in enumerate(words) if min(len(a), len(b)) == length and edits(a, b) == 1 and first(a, b) < below] for a in words]
        assert spelling.near_words(words, length, below) == ([len(x) for x in near], [min(x, default=-1) for x in near])


def plain_collocations(docs, first, often):
    f = defaultdict(Counter)
    for lang, text in docs:
        for piece in collocations.CUT.split((text or "").translate({c: c + 32 for c in range(65, 91)})):
            w = [x for x in piece.replace("\t", " ").split(" ") if x]
            f[lang or "und"].update(tuple(w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= often}
        ranked = []
        for p, a in found.items():
            if any(100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in found.items() if len(q) > len(p)):
                continue
            score, _, left, right = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), a, left, right, score))
        n = sum(a for p, a in c.items() if len(p) == 1)
        out += [(lang, i + 1, p.decode(), a, left, right, n, score) for i, (_, _, p, a, left, right, score) in enumerate(sorted(ranked)[:first])]
    return sorted(out)


def chatter(seed):
    r = random.Random(seed)
    words = ["of", "the", "The", "new", "york", "New", "é😀", "\xa0x", "a"]
    text = lambda n: "".join(r.choice(words) + r.choice([" ", " ", " ", "\t", ", ", ".", "\n", "  "]) for _ in range(n))
    return [(r.choice(["en", "de", None]), text(r.randrange(400))) for _ in range(30)] + [("en", None), ("en", ""), ("fr", "one two"), ("de", "long word " * 3000)]


@pytest.mark.parametrize("size", [10, 1000, collocations.SHARD])
def test_collocations_cases(spark, size):
    """In shards of any size, also smaller than a piece."""
    docs = chatter(4)
    df = frame(spark, [(None if i % 3 else 1, t, lang) for i, (lang, t) in enumerate(docs)])
    got = collocations.collocations(df, first=40, often=5, size=size).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    want = plain_collocations(docs, 40, 5)
    assert sorted(map(tuple, got)) == want and len({x[0] for x in want}) == 3


def test_collocations_empty(spark):
    assert collocations.collocations(frame(spark, [])).count() == 0
    assert collocations.collocations(frame(spark, [(1, None, None), (1, "a b c", "en")])).count() == 0


def full_sieves():
    return {n: np.full(1 << (collocations.SIEVE - 3), 255, np.uint8) for n in range(1, 5)}


def mined(docs, size, sieve):
    """f by (lang, phrase) over all shards."""
    batch = pa.RecordBatch.from_arrays([pa.array([d[0] or "und" for d in docs], pa.string()), pa.array([d[1] or "" for d in docs], pa.string())], ["lang", "text"])
    out = Counter()
    for shard in collocations.shards(iter([batch]), size):
        for b in collocations.Miner(shard, sieve).counted():
            for lang, phrase, f in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                out[lang, phrase] += f
    return out


def plain_counts(docs):
    out = Counter()
    for lang, text in docs:
        for piece in collocations.CUT.split((text or "").lower()):
            w = [x for x in piece.replace("\t", " ").split(" ") if x]
            out.update((lang or "und", " ".join(w[i : i + k])) for k in range(2, 5) for i in range(len(w) - k + 1))
    return out


def test_collocation_blocks(monkeypatch):
    """Shards, blocks of words and of pairs of any size give the same counts."""
    docs, full = chatter(5)[:12], full_sieves()
    want = plain_counts(docs)
    for size, entries, pairs in ((500, 1, 1), (3, 7, 30), (50, 100, 10_000), (10**6, 10**6, 10**6)):
        monkeypatch.setattr(collocations, "ENTRIES", entries)
        monkeypatch.setattr(collocations, "PAIRS", pairs)
        assert mined(docs, size, full) == want


def test_sieves_hold_back_rare_phrases(spark):
    """All frequent phrases pass, hardly any rare one does; with few slots more pass, and none of the frequent ones is lost."""
    docs = [("en", " ".join(noise(400, "abcd", 4, seed))) for seed in range(30)]
    want = plain_counts(docs)
    rows = [(i, t, x) for i, (x, t) in enumerate(docs)]
    for bits in (collocations.SIEVE, 12):
        _, every = collocations.frequent_phrases(frame(spark, rows), often=20, size=700, bits=bits)
        got = {(r.lang, r.phrase): r.f for r in every.collect() if " " in r.phrase}
        assert got == {k: f for k, f in want.items() if f >= 20} and len(got) > 20
    # The tallies themselves: a slot passes at the wanted count, not below, whatever the shards.
    hashes = np.arange(1, 2001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    parts = [collocations.tallies(2, np.repeat(hashes[:n], 3), 1, 6, 20) for n in (2000, 900)]
    df = spark.createDataFrame(pa.Table.from_batches(parts))
    sieve = collocations.sieves(df, 6, 20)[2]
    assert collocations.passes(sieve, hashes[:900]).all() and collocations.passes(sieve, hashes[900:]).mean() < 0.01


def test_collocation_scores_beyond_64_bits(spark):
    """Integer division of the products is exact."""
    from pyspark.sql import functions as F

    a, total = 9_000_000_000_000_000, 9_000_000_000_000_001
    product = F.lit(2_000_000).cast("decimal(7,0)") * collocations.whole(F.lit(a))
    got = spark.range(1).select(((product - product % collocations.whole(F.lit(total))) / collocations.whole(F.lit(total))).cast("long").alias("s")).first().s
    assert got == 2_000_000 * a // total


def test_quality_held_out():
    """On the fold that the model never sees, from the larger table."""
    where = SMALL.replace("sf0.001", "sf0.1")
    data = duckdb.sql(f"SELECT doc_id, coalesce(text, '') AS text, quality FROM '{where}/documents.parquet' JOIN '{where}/labels.parquet' USING (doc_id) ORDER BY doc_id").fetchall()
    out = np.array([zlib.crc32(str(d).encode()) % 5 == 0 for d, _, _ in data])
    x, y = np.array([quality.features(t) for _, t, _ in data]), np.array([q for *_, q in data], float)
    model = quality.boosted(x[~out], y[~out])
    bare = quality.boosted(x[~out], y[~out], pairs=0)
    assert model.pairs and not bare.pairs
    for m in (model, bare):
        p = 1 / (1 + np.exp(-m.margin(x[out])))
        assert ((p >= 0.3) == y[out]).mean() > 0.97


def test_quality_tables():
    """A score is the sum of table entries; what needs two features together is found in a pair's table."""
    r = np.random.default_rng(2)
    x = r.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0)).astype(float)
    model = quality.boosted(x, y)
    code = model.bins(x[:50])
    want = [model.base + sum(t[b[k]] for k, t in enumerate(model.tables)) + sum(t[b[i], b[j]] for i, j, t in model.pairs) for b in code]
    assert np.allclose(model.margin(x[:50]), want)
    assert model.pairs[0][:2] == (0, 2) and ((model.margin(x) > 0) == y).mean() > 0.95
    assert ((quality.boosted(x, y, pairs=0).margin(x) > 0) == y).mean() < 0.7
    assert all(abs(t[model.bins(x)[:, k]].mean()) < 1e-9 for k, t in enumerate(model.tables))


def test_quality_query(spark):
    """Every document once, labels of the fold without influence, and scores equal to a plain sum over the fitted tables."""
    got = queries.QUERIES["op12_quality"](spark, SMALL).toPandas().sort_values("doc_id", ignore_index=True)
    docs = pd.read_parquet(f"{SMALL}/documents.parquet").sort_values("doc_id", ignore_index=True)
    assert got["doc_id"].tolist() == docs["doc_id"].tolist()
    assert got["held_out"].tolist() == [zlib.crc32(str(d).encode()) % 5 == 0 for d in docs["doc_id"]]
    assert got["predicted"].tolist() == (got["score"] >= 0.3).astype(int).tolist()
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    scorer = quality.learned_quality(spark.read.parquet(f"{SMALL}/documents.parquet"), labels)
    assert np.allclose(scorer.score(docs["text"].tolist()), got["score"])
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    assert np.allclose(quality.learned_quality(spark.read.parquet(f"{SMALL}/documents.parquet"), turned).score(docs["text"].tolist()), got["score"])


def test_quality_cases(spark):
    docs = frame(spark, [(1, None, "en"), (2, "", "en"), (2, "", "en"), (None, "word " * 50_000, None), (3, "é😀", "x")])
    labels = spark.createDataFrame([(1, 0), (2, 1), (None, 1), (3, None), (9, 1)], "doc_id long, quality long")
    scorer = quality.fit_quality(docs, labels)
    got = quality.score_quality(docs, scorer).collect()
    assert len(got) == 5 and all(0 <= x.score <= 1 for x in got) and len({x.score for x in got if x.doc_id in (1, 2)}) == 1
    assert quality.score_quality(docs.limit(0), scorer).count() == 0
    none = quality.fit_quality(docs, labels.limit(0))
    assert none is None and {x.score for x in quality.score_quality(docs, none).collect()} == {0.0}
