"""SimHash near-copies (operator 1): fingerprints of word shingles, linked by a binary trie's self-join.

Two fingerprints of 64 bits that differ in at most 3 agree in one of four blocks of 16. So the join
walks four tries, each beginning with another block, and there only the pairs of equal 16-bit
prefixes: every subtree is one group, and pairs of its nodes are traversed together bit by bit, with
the bits in which they differ accumulated and pairs dropped that exceed the budget, or whose prints are all
connected already. Groups that are large are first cut into pairs of deeper nodes, again and again
until none is. Each group gives the edges of a spanning forest of its links, not all pairs, and the
forests' components are found in tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderline.llm.common import documents, id_and_text, map_batches, materialise
from cinderline.llm.components import components

SHINGLE, BUDGET, BITS, BLOCK = 3, 3, 64, 16
#: A group of more fingerprints is cut into pairs of nodes DEEPER bits further down, which copies each print 15 times at most.
GROUP, DEEPER = 20_000, 4
#: Node pairs that are walked at a time.
WALK = 1 << 17


def fingerprint(text: str) -> int:
    """A bit is set if over half the shingles' hashes have it; no words give 0."""
    words = text.encode().lower().split()  # bytes: only A-Z is lowered, only ASCII white space splits
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(line, 42)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(line[a:b], 42) for a, b in zip(starts.tolist(), ends[SHINGLE - 1 :].tolist())])  # noqa: B905
    n = len(hashes) // 8
    votes = np.zeros(BITS, np.int64)
    rows = np.frombuffer(hashes, np.uint8).reshape(n, 8)
    for at in range(0, n, 4096):
        votes += np.unpackbits(rows[at : at + 4096], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def fingerprint_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, print: the fingerprint as a signed 64-bit number."""

    def hashed(b: pa.RecordBatch) -> pa.RecordBatch:
        prints = np.array([fingerprint(t) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(prints)], ["doc_id", "print"])

    return map_batches(id_and_text(docs, id_col, text_col), hashed, "doc_id long, print long")


def trie_links(keys: np.ndarray, pairs: np.ndarray, budget: int = BUDGET, forest: Forest | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Yields arrays (i, j), i < j, of the positions of linked prints.

    keys: unsigned prints, sorted within each run that a pair names. pairs: rows (first, end, first,
    end, differing bits, depth): two trie nodes as runs of prints with a common prefix of that depth,
    the same run twice or the left one first. A pair splits into the pairs of their children one bit
    further down; those over the budget are dropped. With a forest, to which the caller adds what is
    yielded, pairs of nodes whose prints it connects already are dropped too.
    """
    stack = [pairs[pairs[:, 5] == d] for d in np.unique(pairs[:, 5])]
    while stack:
        pairs = stack.pop()
        if len(pairs) > WALK:
            stack += np.array_split(pairs, -(-len(pairs) // WALK))
            continue
        if forest is not None and len(pairs):
            root = forest.labels()
            changes = np.concatenate([[0], np.cumsum(root[1:] != root[:-1])])
            one = lambda a, b: changes[pairs[:, b] - 1] == changes[pairs[:, a]]  # noqa: B023, E731
            pairs = pairs[~(one(0, 1) & one(2, 3) & (root[pairs[:, 0]] == root[pairs[:, 2]]))]
        if not len(pairs):
            continue
        bit = int(pairs[0, 5])
        # Two leaves (or equal prints at the bottom): all remaining bits at once.
        leaf = (pairs[:, 1] - pairs[:, 0] == 1) & (pairs[:, 3] - pairs[:, 2] == 1)
        if leaf.any():
            i, j = pairs[leaf, 0], pairs[leaf, 2]
            rest = (keys[i] ^ keys[j]) & np.uint64((1 << (BITS - bit)) - 1)
            near = (i < j) & (np.bitwise_count(rest) + pairs[leaf, 4] <= budget)
            if near.any():
                yield i[near], j[near]
            pairs = pairs[~leaf]
            if not len(pairs):
                continue
        at = np.uint64(BITS - 1 - bit)
        ml, mr = first_one(keys, pairs[:, 0], pairs[:, 1], at), first_one(keys, pairs[:, 2], pairs[:, 3], at)
        children = []
        for x, (l0, l1) in enumerate(((pairs[:, 0], ml), (ml, pairs[:, 1]))):
            for y, (r0, r1) in enumerate(((pairs[:, 2], mr), (mr, pairs[:, 3]))):
                spent = pairs[:, 4] + (x != y)
                keep = (l1 > l0) & (r1 > r0) & (spent <= budget) & (l0 <= r0)
                children.append(np.stack([l0[keep], l1[keep], r0[keep], r1[keep], spent[keep], pairs[keep, 5] + 1], 1))
        stack.append(np.concatenate(children))


def first_one(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, at: np.uint64) -> np.ndarray:
    """Where in each run the prints with a one at this bit begin, by bisection of all runs together."""
    lo, hi = lo.copy(), hi.copy()
    for _ in range(int((hi - lo).max()).bit_length()):
        mid = (lo + hi) >> 1
        one = ((keys[np.minimum(mid, len(keys) - 1)] >> at) & np.uint64(1)).astype(bool) | (mid >= hi)
        hi, lo = np.where(one, mid, hi), np.where(one, lo, mid + 1)
    return lo


class Forest:
    """Union-find over positions, with the spanning edges that joined something."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.edges: list[np.ndarray] = []

    def labels(self) -> np.ndarray:
        while True:
            up = self.root[self.root]
            if (up == self.root).all():
                return self.root
            self.root = up

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        """Hooks the larger root of each link to the smaller, in rounds, until the links join nothing new."""
        while True:
            roots = self.labels()
            a, b = np.minimum(roots[i], roots[j]), np.maximum(roots[i], roots[j])
            open_ = a < b
            if not open_.any():
                return
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            _, first = np.unique(b, return_index=True)
            self.root[b[first]] = a[first]
            self.edges.append(np.stack([i[first], j[first]], 1))


def near_links(prints: DataFrame) -> DataFrame:
    """Edges (a, b) between the nodes of distinct prints (columns print, node) that differ in at most BUDGET bits: enough of them to connect what all links connect.

    A cell is a pair of nodes at one depth, given by the bits below the block on its two sides (equal
    ones: a node with itself). While cells hold more than GROUP prints, these are dealt to cells
    DEEPER bits further down, each print to the nodes that the rest of the budget can reach.
    """
    turns = F.explode(F.array(*(F.struct(F.lit(k).alias("turn"), (F.shiftleft("print", BLOCK * k).bitwiseOR(F.shiftrightunsigned("print", BITS - BLOCK * k)) if k else F.col("print")).alias("key")) for k in range(BITS // BLOCK))))
    cells = prints.select("node", turns.alias("t")).select("node", "t.turn", "t.key", F.shiftrightunsigned("t.key", BITS - BLOCK).alias("block"))
    cells = cells.select("turn", "block", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("high"), "key", "node")
    group, done = ["turn", "block", "depth", "low", "high"], []
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for depth in range(0, BITS - BLOCK, DEEPER):
        large = materialise(cells.groupBy(*group).count().where(F.col("count") > GROUP).select(*group))
        if large.isEmpty():
            break
        done.append(cells.join(large, group, "left_anti"))
        cells = materialise(deeper(cells.join(large, group, "left_semi"), depth))
    done.append(cells)
    dealt = reduce(DataFrame.unionByName, done)

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole groups together, some ten thousand rows at a time; rows come in the order of the groups, and of the prints in each."""
        held = None
        for b in batches:
            cols = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (*group, "key", "node")])
            held = cols if held is None else np.concatenate([held, cols], 1)
            change = np.flatnonzero((held[:5, 1:] != held[:5, :-1]).any(0))
            if len(change) and held.shape[1] >= 20_000:
                yield links_of_cells(held[:, : change[-1] + 1])
                held = held[:, change[-1] + 1 :]
        if held is not None:
            yield links_of_cells(held)

    return dealt.repartition(parts, *group).sortWithinPartitions(*group, "key").mapInArrow(linked, "a long, b long")


def deeper(cells: DataFrame, depth: int) -> DataFrame:
    """The cells' prints dealt to the pairs of nodes DEEPER bits below, by what the bits that differ above leave of the budget."""
    spent = F.bit_count(F.col("low").bitwiseXOR(F.col("high")))
    at_low = F.shiftrightunsigned("key", BITS - BLOCK - depth).bitwiseAND((1 << depth) - 1) == F.col("low")
    own = F.shiftrightunsigned("key", BITS - BLOCK - depth - DEEPER).bitwiseAND((1 << DEEPER) - 1)
    flips = F.array(*(F.lit(x).cast("long") for x in range(1 << DEEPER)))
    reach = F.filter(flips, lambda f: F.bit_count(f) + spent <= BUDGET)
    dealt = cells.select("*", spent.alias("spent"), at_low.alias("at_low"), own.alias("own"), F.explode(reach).alias("flip")).withColumn("other", F.col("own").bitwiseXOR(F.col("flip")))
    # In a node with itself the smaller side is the low one; in two nodes each print keeps its side.
    first = F.when(F.col("low") == F.col("high"), F.least("own", "other")).when(F.col("at_low"), F.col("own")).otherwise(F.col("other"))
    second = F.when(F.col("low") == F.col("high"), F.greatest("own", "other")).when(F.col("at_low"), F.col("other")).otherwise(F.col("own"))
    below = lambda side, bits: F.shiftleft(side, DEEPER).bitwiseOR(bits)
    return dealt.select("turn", "block", F.lit(depth + DEEPER).alias("depth"), below("low", first).alias("low"), below("high", second).alias("high"), "key", "node")


def links_of_cells(rows: np.ndarray) -> pa.RecordBatch:
    """Spanning edges of the links in whole cells. rows: turn, block, depth, low, high, key, node; a cell's prints are neighbours and sorted, so the low side's come first."""
    n = rows.shape[1]
    prints, nodes = rows[5].view(np.uint64), rows[6]
    starts = np.concatenate([[0], np.flatnonzero((rows[:5, 1:] != rows[:5, :-1]).any(0)) + 1])
    ends = np.append(starts[1:], n)
    depth, low, high = rows[2, starts], rows[3, starts], rows[4, starts]
    cell = np.repeat(np.arange(len(starts)), ends - starts)
    side = (prints >> (BITS - BLOCK - depth[cell]).astype(np.uint64)) & ((np.uint64(1) << depth[cell].astype(np.uint64)) - np.uint64(1))
    split = starts + np.add.reduceat((side < high[cell].astype(np.uint64)).astype(np.int64), starts)
    cross = low != high
    pairs = np.stack([starts, np.where(cross, split, ends), np.where(cross, split, starts), ends, np.where(cross, np.bitwise_count(low ^ high), 0), BLOCK + depth], 1).astype(np.int64)
    pairs = pairs[(pairs[:, 1] > pairs[:, 0]) & (pairs[:, 3] > pairs[:, 2]) & ((pairs[:, 3] - pairs[:, 0]) > 1)]
    found = Forest(n)
    for i, j in trie_links(prints, pairs, forest=found):
        found.add(i, j)
    edges = np.concatenate(found.edges) if found.edges else np.zeros((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(nodes[edges[:, 0]]), pa.array(nodes[edges[:, 1]])], ["a", "b"])


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, print, fingerprint (16 hex digits), component_id: the smallest id among all documents reachable by links.

    A null text counts as empty; all texts without words share the fingerprint of zeros and link like any other. Repeated rows
    stay; rows without an id have one too, but name no component (it is null where no row of the print has an id). An empty table
    gives an empty one, other columns go. Texts are read whole, however long; a bit that half the shingles have (a tie) is not set.
    """
    table = materialise(fingerprint_table(docs, id_col, text_col))
    prints = materialise(table.groupBy("print").agg(F.min("doc_id").alias("node")))
    found = components(near_links(prints.where("node is not null")))
    named = prints.join(found, "node", "left").select("print", F.coalesce("component", "node").alias("component_id"))
    return table.join(named, "print").select("doc_id", "print", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint and component_id of every whole text."""
    return simhash_components(documents(spark, sf_dir)).drop("print")


#: Ids that may be broadcast (8 bytes each).
FEW_IDS = 2_000_000


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of near copies, all columns kept: the one whose id names the component.

    Of rows that repeat an id, the one with the smallest text stays, of equal texts any. Rows without
    an id go where a row with one has the same fingerprint; else one row of each fingerprint stays.
    Null and empty texts are copies of each other. An empty table gives an empty one.
    """
    table = materialise(simhash_components(docs, id_col, text_col))
    gone = materialise(table.where("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct())
    kept = docs.join(F.broadcast(gone) if gone.count() <= FEW_IDS else gone, id_col, "left_anti")
    again = table.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(id_col))
    nameless = table.where("doc_id is null")
    if again.isEmpty() and nameless.isEmpty():
        return kept
    least = F.min_by(F.struct(*docs.columns), F.coalesce(F.col(text_col), F.lit(""))).alias("row")
    single = kept.where(F.col(id_col).isNotNull()).join(again, id_col, "left_anti")
    repeated = kept.join(again, id_col, "left_semi").groupBy(id_col).agg(least).select("row.*")

    @F.pandas_udf("long")
    def print_of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))

    # Whole rows are one column here, so that no name can clash.
    text = F.coalesce(F.col(text_col), F.lit(""))
    without = docs.where(F.col(id_col).isNull()).select(F.struct(*docs.columns).alias("row"), text.alias("text"), print_of(text).alias("print"))
    named = table.where("doc_id is not null").select("print").distinct()
    without = without.join(named, "print", "left_anti").groupBy("print").agg(F.min_by("row", "text").alias("row")).select("row.*")
    return reduce(DataFrame.unionByName, [x.select(*docs.columns) for x in (single, repeated, without)])
