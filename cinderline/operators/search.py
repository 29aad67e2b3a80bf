"""Ranked place search over names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderline.functions.rules import lookup
from cinderline.functions.text import evidence_text, phrases

#: How much a kind of place counts; 20 for all others.
TYPE_BOOSTS = {"localized_restriction_area": 90, "trailhead": 80, "campground": 74, "recreation_site": 68, "trail": 62, "lake": 58, "river": 52, "wilderness": 50, "destination": 48}
#: Fixed value: name rows that are scored at most.
CANDIDATES = 360


def name_score(name: Column, rank: Column, weight: Column, kind: Column, query: str, boosts: dict[str, int] = TYPE_BOOSTS) -> Column:
    """Additive: an exact name also earns what prefix, containment and tokens give."""
    q = F.lit(query)
    tokens = F.lit(True)
    for t in query.split():
        tokens = tokens & name.contains(t)
    bonus = lambda cond, n: F.when(cond, n).otherwise(0)
    return rank + weight + lookup(kind, boosts, 20) + bonus(name == q, 1000) + bonus(q.contains(name), 1000) + bonus(name.startswith(q), 650) + bonus(name.contains(query), 420) + bonus(tokens, 180)


def match_type(name: Column, query: str) -> Column:
    q = F.lit(query)
    return F.when(name == q, "exact").when(name.startswith(query), "prefix").when(name.contains(query), "contains").when(q.contains(name), "name_with_context").otherwise("token")


def search_places(names: DataFrame, query: str, kinds: list[str], limit: int = 8, boosts: dict[str, int] = TYPE_BOOSTS) -> DataFrame:
    """The best places for a normalised query.

    names: place_id, name, normalized_name, weight, search_rank, place_type. Candidates hold the
    query or one of its phrases, or are of a kind it stands for; the first CANDIDATES by rank,
    weight, name and id are scored (a top-k, as the feature asks), and each place keeps its best
    name. An empty query finds nothing.
    """
    if not query:
        return names.limit(0).select("place_id", "name", F.lit(0).cast("long").alias("score"), F.lit("").alias("match_type"))
    found = F.col("place_type").isin(*kinds) if kinds else F.lit(False)
    for p in phrases(query):
        found = found | F.col("normalized_name").contains(p)
    top = names.where(found).orderBy(F.desc_nulls_first("search_rank"), F.desc_nulls_first("weight"), "name", "place_id").limit(CANDIDATES)
    own = name_score(F.col("normalized_name"), F.col("search_rank"), F.col("weight"), F.col("place_type"), query, boosts)
    kind = F.when(F.col("place_type").isin(*kinds), 760).otherwise(0) if kinds else F.lit(0)
    scored = top.withColumn("own", own).withColumn("kind", kind)
    best = scored.groupBy("place_id").agg(F.max_by(F.struct("name", "normalized_name", "own", "kind"), F.struct("own", F.col("name"))).alias("b"))
    out = best.select("place_id", "b.name", (F.col("b.own") + F.col("b.kind")).cast("long").alias("score"), match_type(F.col("b.normalized_name"), query).alias("match_type"))
    return out.orderBy(F.desc("score"), "name", "place_id").limit(limit)


def passages_in_texts(texts: DataFrame, passages: DataFrame, text_id: str, passage_id: str) -> DataFrame:
    """Pairs of ids with the passage in the text, both with runs of white space as single blanks. Inputs: an id and text.

    A passage may begin and end inside words, so each of its inner words must be a word of the text.
    Candidates are the texts with the inner word that the fewest texts have, and only these are
    searched. Passages without an inner word are found by their rarest run of three characters.
    """
    flat = lambda df, row_id, name: df.select(row_id, evidence_text(F.col("text")).alias(name)).withColumn("_w", F.split(name, " "))
    items = flat(passages, passage_id, "needle").where("needle <> ''")
    hay = flat(texts, text_id, "hay")
    inner = items.where("size(_w) > 2").select(passage_id, "needle", F.explode(F.array_distinct(F.expr("slice(_w, 2, size(_w) - 2)"))).alias("word"))
    hits = holding_rarest(hay.select(text_id, F.explode(F.array_distinct("_w")).alias("word")), inner, text_id, passage_id)
    short = items.where("size(_w) <= 2").select(passage_id, "needle")
    if not short.isEmpty():
        n = F.least(F.length("needle"), F.lit(GRAM))
        grams = short.select(passage_id, "needle", F.explode(runs_of(F.col("needle"), n)).alias("word"))
        held = hay.select(text_id, F.explode(F.array_distinct(F.concat(*(runs_of(F.col("hay"), F.lit(k)) for k in range(1, GRAM + 1))))).alias("word"))
        hits = hits.unionByName(holding_rarest(held, grams, text_id, passage_id))
    return hits.join(hay.select(text_id, "hay"), text_id).where(F.col("hay").contains(F.col("needle"))).select(text_id, passage_id)


#: Characters of the runs by which passages without an inner word are found.
GRAM = 3


def runs_of(text: Column, n: Column) -> Column:
    """All different runs of n characters; none of a shorter text."""
    return F.array_distinct(F.transform(F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>")), lambda i: F.substring(text, i, n)))


def holding_rarest(held: DataFrame, wanted: DataFrame, text_id: str, passage_id: str) -> DataFrame:
    """text_id, passage_id, needle: the texts that have a passage's rarest word. held: text_id, word, a row for each different word; wanted: passage_id, needle, word. A passage with a word that no text has is in none."""
    words = held.join(wanted.select("word").distinct(), "word", "left_semi")
    seen = words.groupBy("word").count()
    rarest = wanted.join(seen, "word").groupBy(passage_id).agg(F.count("*").alias("_found"), F.min(F.struct("count", "word")).alias("_r"))
    keys = wanted.groupBy(passage_id).agg(F.count("*").alias("_all"), F.first("needle").alias("needle")).join(rarest, passage_id).where("_found = _all").select(passage_id, "needle", "_r.word")
    return words.join(keys, "word").select(text_id, passage_id, "needle")


#: What a land unit earns in searches, by its type (80 for all others), and the queries that stand for types.
LAND_UNIT_BOOST = 2400
LAND_UNIT_TYPE_BOOSTS = {"national_forest": 130, "national_park": 120, "national_park_complex": 120, "management_unit": 90}
_ALL_UNITS, _FORESTS, _PARKS = ("national_forest", "national_park", "national_park_complex", "management_unit"), ("national_forest",), ("national_park", "national_park_complex")
LAND_UNIT_CATEGORIES = {
    "area": _ALL_UNITS, "areas": _ALL_UNITS, "forest": _FORESTS, "forests": _FORESTS, "national forest": _FORESTS, "national forests": _FORESTS,
    "national park": _PARKS, "national parks": _PARKS, "park": _PARKS, "parks": _PARKS,
}
#: Words that alone name no land unit.
GENERIC_TOKENS = ("basin", "forest", "grassland", "lake", "management", "national", "park", "unit")


def unit_score(name: Column, kind: Column, query: str) -> Column:
    """Additive, as name_score."""
    q, tokens = F.lit(query), F.lit(True)
    for t in query.split():
        tokens = tokens & name.contains(t)
    bonus = lambda cond, n: F.when(cond, n).otherwise(0)
    return LAND_UNIT_BOOST + lookup(kind, LAND_UNIT_TYPE_BOOSTS, 80) + bonus(name == q, 1900) + bonus(q.contains(name), 1800) + bonus(name.startswith(query), 1100) + bonus(name.contains(query), 720) + bonus(tokens, 340)


def search_units(units: DataFrame, query: str) -> DataFrame:
    """unit_id, name, score, match_type of the land units that a normalised query names or stands for. units: unit_id, name, normalized_name, unit_type, a row for each name; the best name of a unit counts."""
    kinds = LAND_UNIT_CATEGORIES.get(query, ())
    category = F.col("unit_type").isin(*kinds) if kinds else F.lit(False)
    named, tokens = F.lit(False), query.split()
    if not (len(tokens) == 1 and tokens[0] in GENERIC_TOKENS) and tokens:
        has_all = F.lit(True)
        for t in tokens:
            has_all = has_all & F.col("normalized_name").contains(t)
        named = F.col("normalized_name").contains(query) | F.lit(query).contains(F.col("normalized_name")) | has_all
    scored = units.where("normalized_name <> ''").withColumn("_s", unit_score(F.col("normalized_name"), F.col("unit_type"), query))
    best = scored.groupBy("unit_id").agg(F.max_by(F.struct("name", "normalized_name", "unit_type", "_s"), F.struct("_s", "name")).alias("b")).select("unit_id", "b.*")
    score = (F.col("_s") + F.when(category, 760).otherwise(0)).cast("long")
    return best.where(category | named).select("unit_id", "name", score.alias("score"), match_type(F.col("normalized_name"), query).alias("match_type"))


def suggestions(units: DataFrame, places: DataFrame, limit: int = 8) -> DataFrame:
    """Land units and places in one list: by score, land units first, then by name. limit is clamped to 1 to 20 (a top-k, as the feature asks)."""
    both = units.select(F.lit("land_unit").alias("result_type"), F.col("unit_id").alias("id"), "name", "score").unionByName(places.select(F.lit("place").alias("result_type"), F.col("place_id").alias("id"), "name", "score"))
    return both.orderBy(F.desc("score"), F.when(F.col("result_type") == "land_unit", 0).otherwise(1), "name", "id").limit(clamped_limit(limit))


def clamped_limit(value: object, least: int = 1, most: int = 20, default: int = 8) -> int:
    """A limit that a user gave: an integer within bounds, the default for anything else."""
    try:
        return min(most, max(least, int(str(value))))
    except ValueError:
        return default
