"""Phrase collocations (operator 13): counts by position bitmaps of words, then scores in tables.

A task lays the words of its texts one after another, with gaps between pieces, in shards of a bounded
number of positions. A word's bitmap has a bit for each position of the word and is held compressed:
only blocks with a bit set are there. A phrase grows by a word when its bitmap, shifted by one position,
and that of the word have common bits; their number is the phrase's count in the shard, and Spark adds
up the shards' counts. Phrases grow depth-first: a block of words is extended to the full length before
the next block begins. Before that, sieves tell which phrases can be frequent at all: tables of a fixed
number of slots, to which phrases are hashed and in which the counts of all shards are added up. A slot
that does not reach the wanted count holds no frequent phrase; what passes is counted exactly. (In
corpora of far more words than slots the sieves let most phrases pass, which costs time, not results.)
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinderline.llm.common import documents, materialise

#: Words of a phrase at most, its occurrences at least, percent of them in a longer phrase that make it redundant, phrases a language.
LONGEST, OFTEN, HELD_PERCENT, FIRST = 4, 30, 80, 2000
#: Positions of a shard, pairs of blocks compared at once, blocks of words extended at once, distinct words that a task counts before it passes them on.
SHARD, PAIRS, ENTRIES, HELD = 1_000_000, 1_000_000, 200_000, 400_000
#: Slots of a sieve, as a power of 2 (2**27 bits are 16 MB), and the parts, again as a power, in which they are added up.
SIEVE, PARTS = 27, 8
#: Parts of what is joined to, or ranked in, one key.
SALTS = 16
#: Where pieces end, and the mark that then stands for it: no word holds it.
CUT, GAP = re.compile("[.,;:!?\n\x0b\x0c\r]"), "\n"
#: Positions in a block of a bitmap.
BLOCK = 16
#: An odd multiplier: the hash of a phrase is that of its words in this base, modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)


def portions(text: str, size: int) -> Iterator[Iterator[str]]:
    """The words of a text and the gaps between its pieces, about `size` characters at a time."""
    low = CUT.sub(f" {GAP} ", text.encode().lower().decode()).replace("\t", " ")
    at = 0
    while at < len(low):
        end = low.find(" ", at + size)
        end = len(low) if end < 0 else end
        yield filter(None, low[at:end].split(" "))
        at = end


class Words(dict):
    """The words of one language in a shard -> numbers, which all languages of the shard share; -1 is a gap."""

    def __init__(self, lang: str, names: list[str], langs: list[str]):
        self.lang, self.names, self.langs = lang, names, langs
        self[GAP] = -1

    def __missing__(self, word: str) -> int:
        self[word] = out = len(self.names)
        self.names.append(word)
        self.langs.append(self.lang)
        return out


class Shard:
    """Word numbers by position, -1 in gaps. Its first positions may be `repeated`: they were in the shard before and only give the next ones their context."""

    def __init__(self, lang: str = "", context: list[str] | None = None):
        self.at, self.names, self.langs, self.repeated = array("i"), [], [], len(context or [])
        self.words: dict[str, Words] = {}
        self.add(lang, context or [])

    def add(self, lang: str, words) -> None:
        if lang not in self.words:
            self.words[lang] = Words(lang, self.names, self.langs)
        self.at.extend(map(self.words[lang].__getitem__, words))

    def context(self) -> list[str]:
        """The last words that a phrase of the next shard can begin with."""
        out = []
        while len(out) < min(LONGEST - 1, len(self.at)) and self.at[-1 - len(out)] >= 0:
            out.append(self.names[self.at[-1 - len(out)]])
        return out[::-1]


def shards(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[Shard]:
    """All texts of lang, text, in shards of about `size` positions; a text that is longer goes on in the next one, behind its last words."""
    now = Shard()
    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
            for part in portions(text, size):
                now.add(lang, part)
                if len(now.at) >= size:
                    yield now
                    now = Shard(lang, now.context())
            now.at.append(-1)
    yield now


class Bitmaps:
    """Compressed bitmaps: for each entry whose it is, the number of its block and the block's bits. Entries of one owner lie together."""

    def __init__(self, owner: np.ndarray, block: np.ndarray, bits: np.ndarray):
        self.owner, self.block, self.bits = owner, block, bits

    def __len__(self) -> int:
        return len(self.owner)

    def of(self, kept: np.ndarray) -> Bitmaps:
        return Bitmaps(self.owner[kept], self.block[kept], self.bits[kept])

    def shifted(self) -> Bitmaps:
        """All bits one position on; what leaves a block is an entry of the next one."""
        over = np.flatnonzero(self.bits >> np.uint16(BLOCK - 1))
        out = Bitmaps(np.concatenate([self.owner, self.owner[over]]), np.concatenate([self.block, self.block[over] + 1]), np.concatenate([self.bits << np.uint16(1), np.ones(len(over), np.uint16)]))
        return out.of(np.flatnonzero(out.bits))


def bitmaps(at: np.ndarray, kept: np.ndarray) -> Bitmaps:
    """Of the words by position, at the positions that are kept."""
    position = np.flatnonzero(kept)
    owner, block = at[position], position // BLOCK
    order = np.lexsort((block, owner))
    owner, block = owner[order], block[order]
    bits = np.left_shift(np.uint16(1), (position[order] % BLOCK).astype(np.uint16))
    first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (block[1:] != block[:-1])])) if len(owner) else np.zeros(0, np.int64)
    return Bitmaps(owner[first], block[first], np.bitwise_or.reduceat(bits, first) if len(first) else bits)


def common(a: Bitmaps, words: Bitmaps, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Owner in a, word, block and bits wherever the bitmaps AND to something. words are in the order of blocks; start: each block's first entry."""
    size = start[a.block + 1] - start[a.block]
    ends = np.cumsum(size)
    found = []
    low = 0
    while low < len(a):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + PAIRS, "right")))
        n = size[low:high]
        left = np.repeat(np.arange(low, high), n)
        right = np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[a.block[low:high]], n)
        both = a.bits[left] & words.bits[right]
        hit = np.flatnonzero(both)
        left, right = left[hit], right[hit]
        found.append((a.owner[left], words.owner[right], a.block[left], both[hit]))
        low = high
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (a.owner, a.owner, a.block, a.bits)


def slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Places in a sieve of 2**bits: the hash's bits mixed, the upper ones taken."""
    h = hashes ^ (hashes >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return (h * np.uint64(0x94D049BB133111EB)) >> np.uint64(64 - bits)


def passes(sieve: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    s = slots(hashes, 3 + (len(sieve) - 1).bit_length())
    return (sieve[s >> np.uint64(3)] >> (s & np.uint64(7)).astype(np.uint8)) & 1 > 0


def word_hashes(langs: list[str], words: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(f"{x}\0{w}") for x, w in zip(langs, words, strict=True)], np.uint64)


def tallies(n: int, hashes: np.ndarray, times: int, often: int, bits: int = SIEVE) -> pa.RecordBatch:
    """How often each slot is met, by parts of the slots: distinct slots as differences, then their counts, compressed."""
    slot, count = np.unique(slots(hashes, bits), return_counts=True)
    part = (slot >> np.uint64(bits - PARTS)).astype(np.int64)
    own = (slot & np.uint64((1 << bits - PARTS) - 1)).astype(np.uint32)
    edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else part
    rows = [(int(part[a]), np.concatenate([np.diff(own[a:b], prepend=np.uint32(0)), np.minimum(count[a:b] * times, often).astype(np.uint32)])) for a, b in zip(edge, np.append(edge[1:], len(part))[: len(edge)], strict=True)]
    data = [pa.compress(x.tobytes(), "zstd", asbytes=True) for _, x in rows]
    kinds = ((n for _ in rows), (p for p, _ in rows), (x.nbytes for _, x in rows))
    return pa.RecordBatch.from_arrays([*(pa.array(list(k), pa.int64()) for k in kinds), pa.array(data, pa.binary())], ["n", "part", "size", "data"])


TALLIES = "n long, part long, size long, data binary"


def sieves(rows: DataFrame, often: int, bits: int = SIEVE) -> dict[int, np.ndarray]:
    """n -> the bits of the slots whose tallies reach the count. One part is added up at a time, and what comes to the driver has a fixed size."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None

        def out() -> pa.RecordBatch:
            held = np.packbits(total >= often, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([held], pa.binary())], ["n", "part", "bits"])

        for b in batches:
            for n, part, size, data in zip(*(b.column(c).to_pylist() for c in ("n", "part", "size", "data")), strict=True):
                if key != (n, part):
                    if key:
                        yield out()
                    key, total = (n, part), np.zeros(1 << bits - PARTS, np.uint32)
                step, count = np.frombuffer(pa.decompress(data, size, "zstd", asbytes=True), np.uint32).reshape(2, -1)
                at = np.cumsum(step, dtype=np.uint32)
                total[at] = np.minimum(total[at] + count, often)
        if key:
            yield out()

    dealt = rows.repartition("n", "part").sortWithinPartitions("n", "part")
    found = dealt.mapInArrow(added, "n long, part long, bits binary").toArrow().to_pylist()
    out: dict[int, np.ndarray] = {}
    width = 1 << bits - PARTS - 3
    for r in found:
        out.setdefault(r["n"], np.zeros(1 << bits - 3, np.uint8))[r["part"] * width : (r["part"] + 1) * width] = np.frombuffer(r["bits"], np.uint8)
    return out


class Phrases:
    """Phrases of one length in a shard: the numbers of their words (a row each), and their hashes."""

    def __init__(self, words: np.ndarray, hashes: np.ndarray):
        self.words, self.hashes = words, hashes


class Miner:
    """Phrases of a shard that the sieves let pass: by their length, from 1 on; a missing sieve lets nothing pass."""

    def __init__(self, shard: Shard, sieve: dict[int, np.ndarray]):
        self.sieve = sieve
        self.at = np.frombuffer(shard.at, np.int32) if shard.at else np.zeros(0, np.int32)
        self.names, self.langs = pa.array(shard.names, pa.string()), pa.array(shard.langs, pa.string())
        self.hash = word_hashes(shard.langs, shard.names)
        self.repeated = shard.repeated
        #: Whether a frequent word stands at a position, and the hashes of the words there.
        self.good = self.at >= 0
        self.good[self.good] = self.passing(1, self.hash)[self.at[self.good]]
        self.here = np.zeros(len(self.at), np.uint64)
        self.here[self.good] = self.hash[self.at[self.good]]

    def passing(self, n: int, hashes: np.ndarray) -> np.ndarray:
        return passes(self.sieve[n], hashes) if n in self.sieve else np.zeros(len(hashes), bool)

    def tallied(self, often: int, bits: int = SIEVE) -> Iterator[pa.RecordBatch]:
        """Tallies of all runs of two and more frequent words that end behind the repeated positions."""
        hashes, ok = self.here, self.good
        for n in range(2, LONGEST + 1):
            hashes, ok = hashes[:-1] * BASE + self.here[n - 1 :], ok[:-1] & self.good[n - 1 :]
            fresh = max(0, self.repeated - n + 1)
            yield tallies(n, hashes[fresh:][ok[fresh:]], 1, often, bits)

    def counted(self) -> Iterator[pa.RecordBatch]:
        """lang, phrase, f of all phrases of two and more words that pass."""
        pair = np.flatnonzero(self.good[:-1] & self.good[1:])
        pair = pair[self.passing(2, self.here[pair] * BASE + self.here[pair + 1])]
        live = np.zeros(len(self.at), bool)  # positions in a pair that passes
        live[pair] = live[pair + 1] = True
        words = bitmaps(self.at, live)
        self.words = words.of(np.argsort(words.block, kind="stable"))
        self.start = np.searchsorted(self.words.block, np.arange(len(self.at) // BLOCK + 3))
        # Phrases that end at repeated positions were counted in the shard before.
        self.old = np.zeros(len(self.at) // BLOCK + 2, np.uint16)
        for p in range(self.repeated):
            self.old[p // BLOCK] |= np.uint16(1 << p % BLOCK)
        yield from self.grown(words, Phrases(np.arange(len(self.names))[:, None], self.hash))

    def grown(self, maps: Bitmaps, phrases: Phrases) -> Iterator[pa.RecordBatch]:
        """Extends the phrases by a word, and those that pass again, block by block; a block holds whole phrases."""
        n = phrases.words.shape[1] + 1
        edges = np.flatnonzero(np.concatenate([[True], maps.owner[1:] != maps.owner[:-1]])) if len(maps) else np.zeros(0, np.int64)
        low = 0
        while low < len(maps):
            cut = edges[np.searchsorted(edges, low + ENTRIES, "right") - 1] if low + ENTRIES < len(maps) else len(maps)
            high = int(cut) if cut > low else int(edges[np.searchsorted(edges, low, "right")]) if edges[-1] > low else len(maps)
            owner, word, block, bits = common(Bitmaps(maps.owner[low:high], maps.block[low:high], maps.bits[low:high]).shifted(), self.words, self.start)
            low = high
            if not len(owner):
                continue
            both = owner.astype(np.int64) * len(self.names) + word
            order = np.argsort(both, kind="stable")
            both, block, bits = both[order], block[order], bits[order]
            first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
            parent, last = np.divmod(both[first], len(self.names))
            hashes = phrases.hashes[parent] * BASE + self.hash[last]
            ok = self.passing(n, hashes)
            new = Phrases(np.column_stack([phrases.words[parent[ok]], last[ok]]), hashes[ok])
            count = np.add.reduceat(np.bitwise_count(bits & ~self.old[block]).astype(np.int64), first)[ok]
            if len(count):
                yield self.batch(new.words[count > 0], count[count > 0])
            if n < LONGEST:
                owner = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(both))))
                kept = ok[owner]
                yield from self.grown(Bitmaps((np.cumsum(ok) - 1)[owner[kept]], block[kept], bits[kept]), new)

    def batch(self, words: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        text = pc.binary_join_element_wise(*(self.names.take(pa.array(c)) for c in words.T), " ")
        return pa.RecordBatch.from_arrays([self.langs.take(pa.array(words[:, 0])), text, pa.array(n, pa.int64())], ["lang", "phrase", "f"])


COUNTS = "lang string, phrase string, f long"


def word_counts(rows: DataFrame, size: int) -> DataFrame:
    """lang, phrase, f of all single words."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[str, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, n in by.items():
                n.pop(GAP, None)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["lang", "phrase", "f"])
            by.clear()

        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                for part in portions(text, size):
                    by.setdefault(lang, Counter()).update(part)
                if sum(map(len, by.values())) >= HELD:
                    yield from flush()
        yield from flush()

    return rows.mapInArrow(counted, COUNTS).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def frequent_phrases(docs: DataFrame, often: int = OFTEN, size: int = SHARD, lang_col: str = "lang", text_col: str = "text", bits: int = SIEVE) -> tuple[DataFrame, DataFrame]:
    """(lang, n: its words), and lang, phrase, f of all phrases, single words too, that occur often enough. bits: the size of the sieves, as a power of 2, 11 at least."""
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    context = docs.sparkSession.sparkContext
    words = materialise(word_counts(rows, size))
    frequent = words.where(F.col("f") >= often)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield tallies(1, word_hashes(b.column("lang").to_pylist(), b.column("phrase").to_pylist()), often, often, bits)

    single = sieves(frequent.mapInArrow(known, TALLIES), often, bits)
    first = context.broadcast(single)  # of a fixed size, as the next ones

    def tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches, size):
            yield from Miner(shard, first.value).tallied(often, bits)

    all_ = context.broadcast(single | sieves(rows.mapInArrow(tallied, TALLIES), often, bits))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches, size):
            yield from Miner(shard, all_.value).counted()

    longer = rows.mapInArrow(counted, COUNTS).groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= often)
    return words.groupBy("lang").agg(F.sum("f").alias("n")), materialise(frequent.unionByName(longer))


def whole(c: Column) -> Column:
    """For products beyond 64 bits."""
    return c.cast("decimal(27,0)")


def joined_words(words: Column, start: Column, n: Column) -> Column:
    return F.array_join(F.slice(words, start, n), " ")


def collocations(docs: DataFrame, first: int = FIRST, often: int = OFTEN, size: int = SHARD, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first phrases by score, then frequency, then bytes.

    A null language is `und`, a null text empty; repeated rows count as often as they come, an empty
    table gives an empty one, other columns do not matter. Texts and pieces are read whole, however
    long. A language none of whose phrases is frequent has no row.
    """
    totals, every = frequent_phrases(docs, often, size, lang_col, text_col)
    cut = every.withColumn("words", F.split("phrase", " "))
    known, found = cut.where(F.size("words") < LONGEST).drop("words"), cut.where(F.size("words") > 1)

    # Both parts of each cut, joined with their counts; a part may be that of many phrases, so its count is there several times.
    cuts = F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda k: F.struct(k.alias("k"), joined_words(F.col("words"), F.lit(1), k).alias("l"), joined_words(F.col("words"), k + 1, F.size("words")).alias("r")))
    sides = found.select("lang", "phrase", F.col("f").alias("a"), F.explode(cuts).alias("c")).select("lang", "phrase", "a", "c.k", F.posexplode(F.array("c.l", "c.r")).alias("side", "part")).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    salted = known.select("lang", F.col("phrase").alias("part"), "f", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    part = lambda side: F.sum(F.when(F.col("side") == side, F.col("f")))
    both = sides.join(salted, ["lang", "part", "salt"]).groupBy("lang", "phrase", "a", "k").agg(part(0).alias("l"), part(1).alias("r"))
    product, total = F.lit(2_000_000).cast("decimal(7,0)") * whole(F.col("a")), whole(F.col("l")) + whole(F.col("r"))
    score = F.floor((product - product % total) / total).cast("long")
    scored = both.select("lang", "phrase", "a", F.struct(score.alias("score"), "k", "l", "r").alias("c")).groupBy("lang", "phrase", "a").agg(F.min("c").alias("c"))

    # The most frequent longer phrase around each phrase.
    inside = F.flatten(F.transform(F.sequence(F.lit(2), F.size("words") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size("words") - n + 1), lambda at: joined_words(F.col("words"), at, n))))
    around = found.where(F.size("words") > 2).select("lang", F.explode(inside).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    held = scored.join(around, ["lang", "phrase"], "left")
    left = held.where(F.col("longer").isNull() | (100 * whole(F.col("longer")) < HELD_PERCENT * whole(F.col("a"))))

    flat = left.select("lang", "phrase", "a", "c.l", "c.r", "c.score").withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    some = flat.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= first).drop("salt")
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= first)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns: the first phrases of each language of all documents."""
    return collocations(documents(spark, sf_dir))


def _oracle() -> str:
    gram = " UNION ALL ".join(f"SELECT lang, {k} AS k, array_to_string(w[unnest(range(1, len(w) - {k - 2}))::INT:][:{k}], ' ') AS phrase FROM p WHERE len(w) >= {k}" for k in range(1, LONGEST + 1))
    inside = "list_distinct(flatten(list_transform(range(2, k), lambda n: list_transform(range(1, k - n + 2), lambda s: array_to_string(w[s:s + n - 1], ' ')))))"
    return f"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^ \\t]+') AS w FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\n\\x0B\\f\\r]')) AS piece FROM d)),
g AS MATERIALIZED (SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM ({gram}) GROUP BY ALL),
t AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS w FROM g WHERE k >= 2 AND f >= {OFTEN}),
cuts AS (SELECT *, array_to_string(w[:i], ' ') AS x, array_to_string(w[i + 1:], ' ') AS y FROM (SELECT lang, k, phrase, f, w, unnest(range(1, k)) AS i FROM c)),
s AS (SELECT cuts.lang, cuts.phrase, cuts.f AS a, i, l.f AS l, r.f AS r, (2000000 * cuts.f) // (l.f + r.f) AS score
    FROM cuts JOIN g l ON l.lang = cuts.lang AND l.phrase = x AND l.k = i JOIN g r ON r.lang = cuts.lang AND r.phrase = y AND r.k = cuts.k - i),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
o AS (SELECT lang, phrase, max(f) AS longer FROM (SELECT lang, f, unnest({inside}) AS phrase FROM c WHERE k > 2) GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM b JOIN t ON t.lang = b.lang LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase WHERE longer IS NULL OR 100 * longer < {HELD_PERCENT} * a QUALIFY rank <= {FIRST}"""


ORACLE_SQL = _oracle()
