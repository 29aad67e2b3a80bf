"""Spelling variants (operator 11): words one edit apart, by merging the subtrees of tries.

Two words one edit apart agree before the edit and behind it, so they share either the first half or
the last half of the shorter one. Cells are words that share such halves; a cell of too many words is
cut again by halves of what lies between, down to single characters. In a cell a trie holds what lies
between. At each of its nodes the child with the most words is heavy; the light ones are merged, their
first character skipped, and where terminals of the merged trie coincide with each other or with those
below the heavy child, a character is replaced; with those below the node itself, one is inserted. A
word is in a light subtree at most as often as the logarithm of the cell's size, which bounds the work.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderline.llm.common import documents, id_and_text, materialise

#: Code points and occurrences of a word at least; every so-manieth run is misspelt; how much more frequent a form is.
LEAST, SEEN, EVERY, TIMES = 7, 2, 31, 10
#: Words of one cell at most, unless nothing is left between its halves.
GROUP = 20_000
#: Distinct words that a task counts before it passes them on, and characters whose runs are listed at once.
HELD, PORTION = 400_000, 1 << 20
RUN = re.compile("[A-Za-zÀ-ÿ]+")
NO_LETTER = re.compile("[^A-Za-zÀ-ÿ]")


def runs(text: str) -> Counter:
    """Maximal runs of letters, A-Z lowered, with their numbers."""
    low, out, at = text.encode().lower().decode(), Counter(), 0
    while at < len(low):
        end = NO_LETTER.search(low, at + PORTION)
        end = end.start() if end else len(low)
        out.update(RUN.findall(low, at, end))
        at = end
    return out


def misspelt(run: str, h: int) -> str:
    """The run, or if h is a multiple of EVERY, without one of its code points."""
    k = h % len(run)
    return run if h % EVERY else run[:k] + run[k + 1 :]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n of all words that are long and frequent enough. A row without an id counts as one whose id is the empty text."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], ["word", "n"])
            count.clear()
            return out

        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for run, n in runs(text).items():
                    if len(run) >= LEAST and len(word := misspelt(run, zlib.crc32(run.encode(), start))) >= LEAST:
                        count[word] += n
                if len(count) >= HELD:
                    yield flush()
        yield flush()

    parts = id_and_text(docs, id_col, text_col).mapInArrow(counted, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= SEEN)


class Node:
    """Inner node of a trie: children by character, and the words that end here."""

    __slots__ = ("kids", "here", "size")

    def __init__(self, kids: dict, here: tuple[int, ...], size: int = 0):
        self.kids, self.here, self.size = kids, here, size


#: A subtree with one ending is its characters from a position on, and the words that end there.
Leaf = tuple[str, int, tuple[int, ...]]


def opened(t: Node | Leaf) -> Node:
    if type(t) is Node:
        return t
    s, at, ids = t
    return Node({s[at]: (s, at + 1, ids)}, (), len(ids)) if at < len(s) else Node({}, ids, len(ids))


def trie(words: list[str]) -> Node:
    """The trie of distinct words, which are known by their positions."""
    root = Node({}, ())
    for i, s in enumerate(words):
        node, at = root, 0
        while True:
            node.size += 1
            if at == len(s):
                node.here = (i,)
                break
            child = node.kids.get(s[at])
            if child is None:
                node.kids[s[at]] = (s, at + 1, (i,))
                break
            if type(child) is tuple:
                child = node.kids[s[at]] = opened(child)
            node, at = child, at + 1
    return root


def same_leaf(a: Leaf, b: Leaf) -> bool:
    return len(a[0]) - a[1] == len(b[0]) - b[1] and a[0][a[1] :] == b[0][b[1] :]


def merged(a: Node | Leaf, b: Node | Leaf) -> Node | Leaf:
    """One trie of two, which stay as they are; what only one has is shared. The work is that of the smaller one."""
    if type(a) is tuple and type(b) is tuple and same_leaf(a, b):
        return a[0], a[1], a[2] + b[2]
    a, b = opened(a), opened(b)
    top = Node({}, ())
    todo = [(top, "", a, b)]
    while todo:
        into, key, a, b = todo.pop()
        if type(a) is tuple and type(b) is tuple and same_leaf(a, b):
            into.kids[key] = (a[0], a[1], a[2] + b[2])
            continue
        a, b = opened(a), opened(b)
        if len(a.kids) < len(b.kids):
            a, b = b, a
        out = into.kids[key] = Node(dict(a.kids), a.here + b.here)
        for c, x in b.kids.items():
            if c in a.kids:
                todo.append((out, c, a.kids[c], x))
            else:
                out.kids[c] = x
    return top.kids[""]


def endings(t: Node | Leaf) -> Iterator[tuple[int, ...]]:
    """The words at each terminal."""
    todo = [t]
    while todo:
        t = todo.pop()
        if type(t) is tuple:
            yield t[2]
        else:
            if t.here:
                yield t.here
            todo += t.kids.values()


def coinciding(a: Node | Leaf, b: Node | Leaf) -> Iterator[tuple[tuple[int, ...], tuple[int, ...]]]:
    """The words of both at each terminal that both have."""
    todo = [(a, b)]
    while todo:
        a, b = todo.pop()
        if type(a) is tuple and type(b) is tuple:
            if same_leaf(a, b):
                yield a[2], b[2]
            continue
        a, b = opened(a), opened(b)
        if a.here and b.here:
            yield a.here, b.here
        few, many = (a.kids, b.kids) if len(a.kids) <= len(b.kids) else (b.kids, a.kids)
        for c in few:
            if c in many:
                todo.append((a.kids[c], b.kids[c]))


def near_words(words: list[str], length: int, below: int) -> tuple[list[int], list[int]]:
    """For each word its number of near words and the first of them in the list (-1: none).

    words: distinct, of length or length + 1 characters; two of the longer kind are not compared.
    Only pairs that differ first at a position under `below` count.
    """
    n, best = [0] * len(words), [len(words)] * len(words)

    def link(x: int, y: int) -> None:
        n[x] += 1
        n[y] += 1
        best[x], best[y] = min(best[x], y), min(best[y], x)

    todo = [(trie(words), 0)]
    while todo:
        v, depth = todo.pop()
        if depth >= below or not v.kids:
            continue
        todo += ((t, depth + 1) for t in v.kids.values() if type(t) is Node)
        if len(v.kids) == 1 and not v.here:
            continue
        heavy = max(v.kids, key=lambda c: 1 if type(v.kids[c]) is tuple else v.kids[c].size)  # noqa: B023
        most, rest = v.kids[heavy], {c: t for c, t in v.kids.items() if c != heavy}
        # The heavy child's character inserted into a light word, or into that which ends here.
        for ys, xs in coinciding(Node(rest, v.here), most):
            link(xs[0], ys[0])
        if not rest:
            continue
        light = reduce(merged, sorted(rest.values(), key=lambda t: 1 if type(t) is tuple else t.size))
        for group in endings(light):  # a light character replaced by another; each of a group is near all others
            if len(group) > 1 and len(words[group[0]]) == length:
                first, second, *_ = sorted(group)
                for x in group:
                    n[x] += len(group) - 1
                    best[x] = min(best[x], second if x == first else first)
        for xs, ys in coinciding(light, most):  # a light one by the heavy one
            if len(words[ys[0]]) == length:
                for x in xs:
                    link(x, ys[0])
        for xs, ys in coinciding(light, v):  # a light one inserted, where what follows differs from it
            y = words[ys[0]][depth : depth + 1]
            for x in xs:
                if words[x][depth] != y:
                    link(x, ys[0])
    return n, [b if b < len(words) else -1 for b in best]


#: Of a cell: the least length of its words, what they begin and end with, and under which position they may differ first.
CELL = ("m", "head", "tail", "below")


def cut(rows: DataFrame) -> DataFrame:
    """Each row in two cells: with half of what lies between added to the head, and with the other half to the tail."""
    between = F.col("m") - F.length("head") - F.length("tail")
    half = F.floor(between / 2).cast("int")
    at = F.length("head") + half
    size = F.length("middle")
    behind = (between - half).cast("int")
    part = lambda start, n: F.substring(F.col("middle"), start, n)
    sides = F.array(
        F.struct(F.concat("head", part(F.lit(1), half)).alias("head"), F.col("tail").alias("tail"), F.col("below").alias("below"), part(half + 1, size).alias("middle")),
        F.struct(F.col("head").alias("head"), F.concat(part(size - behind + 1, behind), F.col("tail")).alias("tail"), F.least("below", at).alias("below"), part(F.lit(1), size - behind).alias("middle")),
    )
    # Nothing differs first behind the head and under its length.
    return rows.select("m", F.explode(F.filter(sides, lambda s: F.length(s["head"]) < s["below"])).alias("s"), "n").select("m", "s.*", "n")


def dealt(words: DataFrame, group: int = GROUP) -> DataFrame:
    """m, head, tail, below, middle, n: the words in their cells, none of more than `group` words but where single characters are left."""
    whole = words.select(F.explode(F.filter(F.array(F.length("word"), F.length("word") - 1), lambda m: m >= LEAST)).alias("m"), F.lit("").alias("head"), F.lit("").alias("tail"), "word", "n")
    left, done = materialise(cut(whole.select("m", "head", "tail", (F.col("m") + 1).alias("below"), F.col("word").alias("middle"), "n"))), []
    while True:
        large = materialise(left.groupBy(*CELL).count().where((F.col("count") > group) & (F.col("m") - F.length("head") - F.length("tail") > 1)).select(*CELL))
        if large.isEmpty():
            return reduce(DataFrame.unionByName, [*done, left])
        done.append(left.join(large, list(CELL), "left_anti"))
        left = materialise(cut(left.join(large, list(CELL), "left_semi")))


def near(words: DataFrame, group: int = GROUP) -> DataFrame:
    """word, n_near, form_n, form for every word (word, n) with near words: their number, and the most frequent of them (ties: the least)."""

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []

        def rows() -> list[tuple]:
            if len(held) < 2:
                return []
            m, head, tail, below = cell
            held.sort(key=lambda x: (-x[1], x[0] + tail))  # as the whole words: the most frequent first
            numbers, best = near_words([w for w, _ in held], m - len(head) - len(tail), below - len(head))
            return [(head + w + tail, n, held[b][1], head + held[b][0] + tail) for (w, _), n, b in zip(held, numbers, best, strict=True) if n]

        def batch(out: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["word", "n_near", "form_n", "form"])

        out: list[tuple] = []
        for b in batches:
            for *own, middle, n in zip(*(b.column(c).to_pylist() for c in (*CELL, "middle", "n")), strict=True):
                if own != cell:
                    out += rows()
                    cell, held = own, []
                held.append((middle, n))
            if len(out) > 50_000:
                yield batch(out)
                out = []
        yield batch(out + rows())

    cells = dealt(words, group).repartition(*CELL).sortWithinPartitions(*CELL)
    found = cells.mapInArrow(linked, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.less")).alias("form_n"), "b.form")


def last_forms(forms: DataFrame) -> DataFrame:
    """word, root: where following forms (word, form) ends. Each round doubles the way; forms grow tenfold in frequency, so there is no circle and few rounds."""
    now = materialise(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = materialise(now.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if now.where("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the texts.

    A null or empty text has no words; a row without an id counts as one whose id is the empty text.
    Repeated rows count as often as they come, an empty table gives an empty one, other columns do not
    matter. Words of any length are compared whole; of equally frequent near words the least is the form.
    """
    words = materialise(word_counts(docs, id_col, text_col))
    none = F.lit(None)
    alone = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), none.cast("long").alias("form_n"), none.cast("string").alias("form"))
    linked = near(words, group).select("word", F.lit(None).cast("long").alias("n"), "n_near", "form_n", "form")
    frequent: Column = F.col("form_n") >= TIMES * F.col("n")
    by = alone.unionByName(linked).groupBy("word").agg(*(F.max(c).alias(c) for c in ("n", "n_near", "form_n", "form")))
    by = materialise(by.select("word", "n", "n_near", F.when(frequent, F.col("form_n")).alias("form_n"), F.when(frequent, F.col("form")).alias("form")))
    roots = last_forms(by.where("form is not null"))
    return by.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns of every word of all documents."""
    return spelling_variants(documents(spark, sf_dir))


#: CRC-32 bit by bit through a table that is made here, then all pairs of words that are equal after one deletion.
ORACLE_SQL = r"""
WITH RECURSIVE table_steps AS (SELECT i::BIGINT AS i, 0 AS k, i::BIGINT AS c FROM range(256) t(i) UNION ALL
    SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM table_steps WHERE k < 8),
tab AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM table_steps WHERE k = 8),
d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
r AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(t, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM d) GROUP BY ALL HAVING length(run) >= 7),
b AS (SELECT *, coalesce(doc_id::VARCHAR, '') || ':' || run AS key FROM r),
h AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(key, ''),
    lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [(192 + (unicode(c) >> 6))::BIGINT, (128 + (unicode(c) & 63))::BIGINT] END))),
    lambda s, x: xor(s >> 8, tab.t[xor(s & 255, x) + 1]))) AS h FROM b, tab),
w AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM h)
    WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
c AS MATERIALIZED (SELECT word, n, k, word[1:k - 1] || word[k + 1:] AS cut FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM w)),
near AS (SELECT a.word, b.word AS other, b.n FROM c a JOIN c b ON a.cut = b.cut AND a.k = b.k AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM c a JOIN w b ON a.cut = b.word UNION SELECT b.word, a.word, a.n FROM c a JOIN w b ON a.cut = b.word),
g AS (SELECT word, count(*) AS n_near, min({'less': -n, 'word': other}) AS best FROM near GROUP BY word),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= 10 * w.n THEN best.word END AS form,
    CASE WHEN -best.less >= 10 * w.n THEN -best.less END AS form_n FROM w LEFT JOIN g USING (word)),
way AS (SELECT word, word AS last, 0 AS k FROM f UNION ALL SELECT way.word, f.form, k + 1 FROM way JOIN f ON way.last = f.word WHERE f.form IS NOT NULL),
root AS (SELECT word, arg_max(last, k) AS root FROM way GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM f JOIN root USING (word)"""
