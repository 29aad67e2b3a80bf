"""Token counts (operator 6) by finite-state compilation of a byte-level merge tokenizer.

The pre-tokenizer's split rules and the merges are one deterministic transducer over characters,
compiled while it reads. After each prefix the sum of the transitions' counts is the number of
tokens that this prefix has by itself, so nothing is pending at a text's end. A long text is cut into
blocks, which are rows of their own. A block's map goes from the states in which it can be entered to
the state in which it is left and the tokens it adds; maps of neighbours compose associatively, and
Spark composes them by a tree over the block numbers. The states entered are guessed from the
characters before a block and tested against what the block before leaves; missing ones are added to
the map until none is, so counts are exact for any way of cutting.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderline.llm.common import documents, id_and_text, map_batches, materialise, tokenizer_path
from cinderline.llm.merge_automaton import MergeAutomaton, State

#: Characters of a block; characters before it that tell the state in which it is entered; neighbours that are composed at a time.
BLOCK, LOOK, FAN = 1 << 16, 256, 16
#: The entry of a block that every state enters alike: a text's first one, and those behind special tokens.
ANY = "*"
#: Fixed values of Unicode: the characters that have the property White_Space.
WHITE = frozenset("\t\n\v\f\r \x85\xa0                　")
#: Fixed values of the format: endings that are split off after an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def byte_symbols() -> dict[str, str]:
    """The format's printable stand-in for each byte -> the byte as a one-character string."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): chr(b) for b in plain} | {chr(256 + i): chr(b) for i, b in enumerate(rest)}


def char_class(c: str) -> str:
    if c in WHITE:
        return "white"
    kind = unicodedata.category(c)[0]
    return kind if kind in "LN" else "other"


class Reading(dict):
    """A state of the whole transducer: character -> Reading. add: tokens that its incoming transition adds."""

    __slots__ = ("counter", "mode", "merge", "held", "shown", "add", "kept")

    def __missing__(self, c):
        after = self.counter.step(self, c)
        if after.kept:
            self[c] = after
        return after


class Words(dict):
    """A word after a blank -> its tokens with the blank."""

    def __init__(self, run):
        self.run = run

    def __missing__(self, word):
        n = self.run(" " + word)
        if len(self) < TokenCounter.LIMIT:
            self[word] = n
        return n


class TokenCounter:
    """mode: start; L, N or other (a run of that class); white (a run whose last character, held, may belong to what comes); quote (an apostrophe that opened a token, then the letters of a possible ending, held).

    merge is the merge state within the open token. shown: how many tokens the open part counts as, from its own start.
    Tables stop growing at LIMIT entries: what is rarer is then worked out anew each time.
    """

    LIMIT = 150_000

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        back = byte_symbols()
        plain = lambda s: "".join(back[c] for c in s)
        special = {t["id"]: t["content"] for t in spec["added_tokens"]}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.bpe = MergeAutomaton({i: plain(s) for s, i in spec["model"]["vocab"].items() if i not in special}, {(plain(a), plain(b)): r for r, (a, b) in enumerate(pairs)})
        self.special = re.compile("|".join(map(re.escape, sorted(special.values(), key=len, reverse=True)))) if special else None
        self.utf8: dict[str, str] = {}
        self.states: dict[tuple, Reading] = {}
        self.words = Words(self.run)
        self.start = self.at("start", self.bpe.start, "", 0, 0)

    def at(self, mode: str, merge: State, held: str, shown: int, add: int) -> Reading:
        key = (mode, id(merge), held, shown, add)
        found = self.states.get(key)
        if found is None:
            found = Reading()
            found.kept = len(self.states) < self.LIMIT and merge.kept
            if found.kept:
                self.states[key] = found
            found.counter, found.mode, found.merge, found.held, found.shown, found.add = self, mode, merge, held, shown, add
        return found

    def feed(self, merge: State, c: str) -> tuple[State, int]:
        """The merge state after one more character, and the tokens it adds."""
        add = 0
        for b in c.encode("utf-8", "replace").decode("latin-1"):
            merge = merge[b]
            add += merge.add
        return merge, add

    def step(self, s: Reading, c: str) -> Reading:
        kind = char_class(c)
        if s.mode == kind and kind != "white":
            merge, add = self.feed(s.merge, c)
            return self.at(kind, merge, "", 0, add)
        if s.mode == "white":
            merge, shown = self.feed(s.merge, s.held)  # the run with its last character; shown is that character's part
            if kind == "white":
                after, add = self.feed(merge, c)
                return self.at("white", merge, c, add, add)
            # The run ends before its last character, which a blank gives to the next token.
            if s.held == " ":
                merge, one = self.feed(self.bpe.start, " ")
                merge, add = self.feed(merge, c)
                return self.at(kind, merge, "", 0, one + add - shown)
            _, alone = self.feed(self.bpe.start, s.held)
            return self.open(c, kind, alone - shown)
        if s.mode == "quote":
            if (whole := s.held + c) in ENDINGS:
                merge = self.bpe.start
                for x in "'" + whole:
                    merge, _ = self.feed(merge, x)
                return self.at("start", self.bpe.start, "", 0, self.tokens("'" + whole) - s.shown)
            if any(e.startswith(whole) for e in ENDINGS):
                merge, n = self.bpe.start, self.tokens("'") + self.tokens(whole)
                return self.at("quote", merge, whole, n, n - s.shown)
            if s.held:  # the apostrophe stands alone, and the letters are a run
                merge, n = self.bpe.start, 0
                for x in s.held:
                    merge, add = self.feed(merge, x)
                    n += add
                return self.step(self.at("L", merge, "", 0, 0), c)
            merge, _ = self.feed(self.bpe.start, "'")
            return self.step(self.at("other", merge, "", 0, 0), c)
        return self.open(c, kind, 0)

    def tokens(self, text: str) -> int:
        merge, n = self.bpe.start, 0
        for x in text:
            merge, add = self.feed(merge, x)
            n += add
        return n

    def open(self, c: str, kind: str, add: int) -> Reading:
        """A new token begins with c."""
        if kind == "white":
            _, one = self.feed(self.bpe.start, c)
            return self.at("white", self.bpe.start, c, one, add + one)
        if c == "'":
            one = self.tokens("'")
            return self.at("quote", self.bpe.start, "", one, add + one)
        merge, one = self.feed(self.bpe.start, c)
        return self.at(kind, merge, "", 0, add + one)

    def run(self, text: str) -> int:
        """Tokens of a text that is read from the start state."""
        state, n = self.start, 0
        for c in text:
            state = state[c]
            n += state.add
        return n

    #: White space beside white space: blanks there are no resets.
    DOUBLE = re.compile(r"[\s\x1c-\x1f]{2}")

    def spread(self, text: str) -> int:
        """As run(), by the state maps of the blank-separated words: each begins with a reset, so its map is one count, kept for the next time."""
        if self.DOUBLE.search(text) or text[:1].isspace():
            return self.run(text)
        first, *rest = text.split(" ")
        if rest and not rest[-1]:
            first, *rest = [first, *rest[:-2], f"{rest[-2]} "] if len(rest) > 1 else [f"{first} "]
        return self.run(first) + sum(map(self.words.__getitem__, rest))

    def count(self, text: str) -> int:
        parts = self.special.split(text) if self.special else [text]
        return sum(map(self.spread, parts)) + len(parts) - 1

    def name(self, s: Reading) -> str:
        """A state as text, the same in every process: all that later characters can depend on."""
        return json.dumps([s.mode, s.merge.alive, s.held, s.shown])

    def named(self, name: str) -> Reading:
        mode, alive, held, shown = json.loads(name)
        return self.at(mode, self.bpe.state(tuple(map(tuple, alive)), 0, None, 0), held, shown, 0)

    def blocks(self, text: str, block: int, look: int) -> Iterator[tuple[str | None, str, int]]:
        """(characters before, characters, special tokens before) of each block; None before those that every state enters alike."""
        for k, part in enumerate(self.special.split(text) if self.special else [text]):
            for at in range(0, max(1, len(part)), block):
                yield (part[max(0, at - look) : at] if at else None), part[at : at + block], int(k > 0 and not at)

    def guess(self, before: str | None) -> str:
        """The state behind these characters, read from the start; right unless what stood before them still matters."""
        if before is None:
            return ANY
        state = self.start
        for c in before:
            state = state[c]
        return self.name(state)

    def block_map(self, entry: str, text: str) -> tuple[str, int]:
        """The state in which a block is left that is entered so, and the tokens it adds."""
        state, n = self.start if entry == ANY else self.named(entry), 0
        for c in text:
            state = state[c]
            n += state.add
        return self.name(state), n


@lru_cache(2)
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


MAP = "key string, no int, entry string, exit string, n long"


def long_counts(texts: DataFrame, where: str, block: int = BLOCK, look: int = LOOK, fan: int = FAN) -> DataFrame:
    """key, n_tokens of texts (key: the text's hash, text) that are cut into blocks. Equal blocks of equal texts are read once."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = counter(where)
        for b in batches:
            for key, text in zip(b.column("key").to_pylist(), b.column("text").to_pylist(), strict=True):
                for no, (before, part, special) in enumerate(machine.blocks(text, block, look)):
                    yield pa.RecordBatch.from_pylist([{"key": key, "no": no, "before": before, "part": part, "special": special}], CUT)

    blocks = materialise(texts.mapInArrow(cut, "key string, no int, before string, part string, special int").dropDuplicates(["key", "no"]))

    def mapped(b: pa.RecordBatch) -> pa.RecordBatch:
        machine, rows = counter(where), []
        for r in b.to_pylist():
            entry = r["entry"] if "entry" in r else machine.guess(r["before"])
            left, n = machine.block_map(entry, r["part"])
            rows.append({"key": r["key"], "no": r["no"], "entry": entry, "exit": left, "n": n + r["special"]})
        return pa.RecordBatch.from_pylist(rows, MAPPED)

    maps = materialise(map_batches(blocks, mapped, MAP))
    while True:  # every round makes all maps that the rounds before asked for
        ends = maps.groupBy("key").agg(F.max("no").alias("last"))
        asked = maps.join(ends, "key").where("no < last").select("key", (F.col("no") + 1).alias("no"), F.col("exit").alias("entry")).distinct()
        there = maps.select("key", "no", "entry")
        open_ = materialise(asked.join(there.where(F.col("entry") == ANY).select("key", "no"), ["key", "no"], "left_anti").join(there, ["key", "no", "entry"], "left_anti"))
        if open_.isEmpty():
            break
        maps = materialise(maps.unionByName(map_batches(blocks.join(open_, ["key", "no"]), mapped, MAP)))
    # A block's map, and then that of 1, 16, 256 ... neighbours, is one row.
    now = maps.groupBy("key", "no").agg(F.map_from_entries(F.collect_list(F.struct("entry", F.struct("exit", "n")))).alias("map"))
    top = maps.agg(F.max("no")).first()[0] or 0
    after = lambda m, v: F.coalesce(m[v["exit"]], m[F.lit(ANY)])
    join = lambda a, p: F.transform_values(a, lambda k, v: F.struct(after(p["map"], v)["exit"].alias("exit"), (v["n"] + after(p["map"], v)["n"]).alias("n")))
    while top:
        now = now.groupBy("key", F.floor(F.col("no") / fan).cast("int").alias("no")).agg(F.array_sort(F.collect_list(F.struct("no", "map")), lambda a, b: a["no"] - b["no"]).alias("parts"))
        now = materialise(now.select("key", "no", F.aggregate(F.slice("parts", 2, fan), F.col("parts")[0]["map"], join).alias("map")))
        top //= fan
    return now.select("key", F.col("map")[ANY]["n"].alias("n_tokens"))


CUT = pa.schema([("key", pa.string()), ("no", pa.int32()), ("before", pa.string()), ("part", pa.string()), ("special", pa.int32())])
MAPPED = pa.schema([("key", pa.string()), ("no", pa.int32()), ("entry", pa.string()), ("exit", pa.string()), ("n", pa.int64())])


def count_tokens(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of every text.

    Texts over `block` characters are counted block by block in parallel, all others whole. A null
    text counts as empty (0, 0), repeated rows stay, an empty table gives an empty one, other columns go.
    """
    where = path or tokenizer_path("byte_bpe_50k.json")
    rows = id_and_text(docs, id_col, text_col)

    def counted(b: pa.RecordBatch) -> pa.RecordBatch:
        machine = counter(where)
        texts = b.column("text")
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.compute.binary_length(texts).cast(pa.int64()), pa.array([machine.count(t) for t in texts.to_pylist()], pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    short = map_batches(rows.where(F.length("text") <= block), counted, "doc_id long, n_bytes long, n_tokens long")
    long = rows.where(F.length("text") > block).withColumn("key", F.sha2("text", 256))
    counts = long_counts(long.select("key", "text"), where, block)
    return short.unionByName(long.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "key").join(counts, "key").select("doc_id", "n_bytes", "n_tokens"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns: doc_id, n_bytes, n_tokens, over_limit (more than 512 tokens) of every whole text."""
    return count_tokens(documents(spark, sf_dir)).withColumn("over_limit", F.col("n_tokens") > 512)
