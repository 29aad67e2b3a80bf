"""Secret scans (operator 10) with a trigram inverted index, in DataFrame functions only.

From each rule's regular expression a Boolean query over lower-case trigrams is derived: any match
contains all trigrams of at least one of its alternatives. The index holds, for the trigrams that
the rules ask for, the posting lists of the documents (in blocks of ids, so that a frequent trigram
is many lists of bounded length). Lists are intersected within an alternative and united over
alternatives; only these candidates are matched with the rule. Rules without mandatory trigrams are
matched with every text.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderline.llm.common import documents, materialise


@dataclass(frozen=True)
class Rule:
    """pattern: in the common part of Java's and Python's syntax. value: the group whose length counts (0: the match), least: that length."""

    name: str
    pattern: str
    value: int = 0
    least: int = 0


def either(word: str) -> str:
    """A word in ASCII letters of either case; no other letters fold onto them."""
    return "".join(f"[{c.upper()}{c}]" for c in word)


#: Fixed values of the contract.
BASE = (
    Rule("assign", rf"""(?:{either("password")}|{either("passwd")}|{either("secret")}|{either("token")}|{either("api")}_?{either("key")})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Published formats of issued keys.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}", 0, 0),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 0),
)
#: Ids that one posting list can hold; candidates (16 bytes each) that may be broadcast.
LIST, FEW = 4096, 1_000_000


def trigram_query(pattern: str, most: int = 64) -> frozenset[frozenset[str]] | None:
    """Alternatives, each a set of trigrams that a match in lower case must contain; None if a match need not contain any."""

    def exact(items) -> set[str] | None:
        """All strings that the items can match, if they are few."""
        out = {""}
        for op, arg in items:
            if op is sre.LITERAL:
                own = {chr(arg).lower()}
            elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg) and len(arg) <= 8:
                own = {chr(a).lower() for _, a in arg}
            elif op is sre.BRANCH:
                parts = [exact(x) for x in arg[1]]
                own = None if None in parts else set().union(*parts)
            elif op is sre.SUBPATTERN:
                own = exact(arg[3])
            elif op is sre.MAX_REPEAT and arg[1] == 1:
                own = exact(arg[2])
                own = own if own is None or arg[0] else own | {""}
            else:
                own = None
            if own is None or len(out) * len(own) > most:
                return None
            out = {a + b for a in out for b in own}
        return out

    items, best, at = list(sre_parser.parse(pattern)), None, 0
    while at < len(items):
        end = at
        while end < len(items) and exact(items[at : end + 1]) is not None:
            end += 1
        strings = exact(items[at:end]) or {""}
        if all(len(s) >= 3 for s in strings):
            found = frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)
            # Of several mandatory parts the one whose weakest alternative asks for the most.
            found = frozenset(a for a in found if not any(b < a for b in found))
            if best is None or min(map(len, found)) > min(map(len, best)):
                best = found
        at = max(end, at + 1)
    return best


def any_of(trigrams: list[str]) -> str:
    """A pattern whose matches, of no length, are at the places where one of the trigrams stands; group 1 is the trigram. A test of the three characters by themselves comes first, then the trigrams by their first characters."""
    quote = lambda c: c if c.isalnum() else f"\\{c}"
    classes = "".join(f"[{''.join(map(quote, sorted({t[k] for t in trigrams})))}]" for k in range(3))
    heads = (f"{quote(c)}(?:{'|'.join(''.join(map(quote, t[1:])) for t in trigrams if t[0] == c)})" for c in sorted({t[0] for t in trigrams}))
    return f"(?={classes})(?=({'|'.join(heads)}))"


def postings(rows: DataFrame, trigrams: list[str]) -> DataFrame:
    """block, trigram, ids: sorted posting lists of the documents that contain a trigram, in lower case; each text is read once for all of them."""
    held = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(any_of(trigrams)), F.lit(1)))
    entries = rows.select("id", F.explode(held).alias("trigram"))
    return entries.groupBy(F.floor(F.col("id") / LIST).alias("block"), "trigram").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def candidates(rows: DataFrame, queries: dict[str, frozenset[frozenset[str]]]) -> DataFrame:
    """id, rules: the rules, as bits by their order here, whose trigram query the document's postings satisfy."""
    trigrams = sorted({t for q in queries.values() for a in q for t in a})
    lists = postings(rows, trigrams).groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "ids"))).alias("lists"))
    none = F.array().cast("array<bigint>")
    of = lambda t: F.coalesce(F.col("lists")[t], none)

    def met(bit: int, query: frozenset[frozenset[str]]) -> Column:
        ids = reduce(F.array_union, [reduce(F.array_intersect, [of(t) for t in sorted(a)]) for a in sorted(query, key=sorted)])
        return F.transform(ids, lambda i: F.struct(i.alias("id"), F.lit(1 << bit).cast("long").alias("bit")))

    pairs = lists.select(F.explode(F.concat(*(met(k, q) for k, q in enumerate(queries.values())))).alias("c")).select("c.id", "c.bit")
    return pairs.groupBy("id").agg(F.bit_or("bit").alias("rules"))


def spans(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, order, kind, end) of a rule's leftmost matches that do not overlap, in code points.

    Each find begins where the last one ended and takes what lies between too, so the lengths add up to positions.
    """
    full = rf"\G((?s:.*?))({rule.pattern})"
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(full), F.lit(0)).alias("a"), F.regexp_extract_all(text, F.lit(full), F.lit(2)).alias("m"), F.regexp_extract_all(text, F.lit(full), F.lit(2 + rule.value)).alias("v"))
    empty = F.array().cast("array<struct<start:int,kind_no:int,kind:string,end:int,n:int>>")

    def after(s: Column, x: Column) -> Column:
        end = s["at"] + F.length(x["a"])
        one = F.struct((end - F.length(x["m"])).alias("start"), F.lit(order).alias("kind_no"), F.lit(rule.name).alias("kind"), end.alias("end"), F.length(x["v"]).alias("n"))
        return F.struct(end.alias("at"), F.concat(s["out"], F.array(one)).alias("out"))

    all_ = F.aggregate(found, F.struct(F.lit(0).alias("at"), empty.alias("out")), after, lambda s: s["out"])
    return F.filter(all_, lambda x: x["n"] >= rule.least)


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, found: array of (start, kind_no, kind, end, n) by start, then kind, of every text.

    A null text counts as empty and has none. Repeated rows stay, each with its own spans; rows
    without an id are matched like others; an empty table gives an empty one; other columns go. Texts
    are read whole, however long; matches that begin together are in the order of the rules.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("id", F.coalesce("doc_id", F.lit(-1)))
    queries = {r.name: q for r in rules if (q := trigram_query(r.pattern)) is not None}
    hits = materialise(candidates(rows, queries)) if queries else None
    if hits is not None:
        rows = rows.join(F.broadcast(hits) if hits.count() <= FEW else hits, "id", "left")
    none = F.array().cast("array<struct<start:int,kind_no:int,kind:string,end:int,n:int>>")
    found = []
    for k, r in enumerate(rules):
        # Where a rule must read every text, a search tells first whether there is anything to place.
        wanted = F.col("rules").bitwiseAND(1 << list(queries).index(r.name)) != 0 if r.name in queries else F.col("text").rlike(r.pattern)
        found.append(F.when(wanted, spans(F.col("text"), r, k)).otherwise(none))
    return rows.select("doc_id", F.array_sort(F.concat(*found)).alias("found"))


def listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns of every whole text: number of finds of each base kind, hash of their spans, all spans."""
    s = scan_secrets(documents(spark, sf_dir))
    n = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda x: x["kind_no"] < len(BASE))
    return s.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))


def _oracle() -> str:
    parts = []
    for k, r in enumerate(BASE + MORE):
        p = r.pattern.replace("'", "''").replace(r"\x20", " ")
        full = f"(?s:(.*?))({p})"
        parts.append(f"""SELECT doc_id, {k} AS k, '{r.name}' AS kind, {r.least} AS least,
            regexp_extract_all(t, '{full}', 0) AS a, regexp_extract_all(t, '{full}', 2) AS m, regexp_extract_all(t, '{full}', {2 + r.value}) AS v FROM d""")
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    r AS ({" UNION ALL ".join(parts)}),
    i AS (SELECT *, unnest(range(1, len(a) + 1)) AS i FROM r),
    s AS (SELECT doc_id, k, kind, CAST(list_sum(list_transform(a[1:i], lambda x: length(x))) AS BIGINT) AS e, length(m[i]) AS n FROM i WHERE length(v[i]) >= least),
    g AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
        string_agg(kind || ':' || (e - n) || ':' || e, ',' ORDER BY e - n, k) FILTER (k < {len(BASE)}) AS base,
        string_agg(kind || ':' || (e - n) || ':' || e, ',' ORDER BY e - n, k) AS spans FROM s GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
        sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)"""


ORACLE_SQL = _oracle()
