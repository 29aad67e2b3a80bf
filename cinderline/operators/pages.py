"""Whole answers: what a page shows, as one row with its lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderline.functions.labels import candidate_score, direction, effective_policy, keyword_class
from cinderline.functions.words import transition_labels
from cinderline.operators.search import phrases

#: What texts say, in this order, and the answer, policy and confidence that stand for it.
STATED = (
    (r"no public[- ]use restrictions|no fire restrictions|fire ban is not in effect|restrictions? (have been )?(lifted|rescinded|ended)|campfires? are allowed", "none", "allowed", 0.93),
    (r"stage\s*2|stage ii", "stage_2", "prohibited", 0.9),
    (r"stage\s*1|stage i", "stage_1", "developed_sites_only", 0.82),
    (r"campfires?.{0,80}(prohibited|not allowed|banned)|prohibit.{0,80}campfires?", "full", "prohibited", 0.78),
)
#: Words of a sentence that is evidence, its longest length, the reason without an answer.
EVIDENCE, LONGEST, NO_STATUS = r"(?i)fire|restriction|campfire|stage|prohibit|allowed|rescinded|lifted", 500, "No explicit restriction status found."
UNSTATED = ("unknown", "unknown", 0.35)


def stated_claim(text: Column) -> Column:
    """(status, policy, confidence, evidence, reasons) of a text: the first rung that it matches, and the first sentence that says something. A null text states nothing."""
    rung = keyword_class(text, tuple((p, str(i)) for i, (p, *_) in enumerate(STATED)), str(len(STATED)))
    value = lambda k: reduce(lambda c, i: c.when(rung == str(i), F.lit(STATED[i][k])), range(1, len(STATED)), F.when(rung == "0", F.lit(STATED[0][k]))).otherwise(F.lit(UNSTATED[k - 1]))
    plain = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    said = F.filter(F.split(plain, r"(?<=[.!?])\s+"), lambda s: s.rlike(EVIDENCE))
    none = F.array().cast("array<string>")
    return F.struct(
        value(1).alias("status"), value(2).alias("policy"), value(3).alias("confidence"), F.transform(F.slice(said, 1, 1), lambda s: F.substring(s, 1, LONGEST)).alias("evidence"),
        F.when(rung == str(len(STATED)), F.array(F.lit(NO_STATUS))).otherwise(none).alias("reasons"),
    )


def usage_cost(model: Column, tokens: dict[str, Column], prices: list[tuple[str, float, float]]) -> Column:
    """The cost of a call, rounded to 8 places: input and newly cached tokens at a model's price of input, output at that of output, a million each; cached tokens that are read cost nothing.

    tokens: input, cache_creation, output (nulls are 0). prices: (pattern of model names, input, output),
    of which the first that matches counts; null without one.
    """
    n = lambda k: F.coalesce(tokens[k].cast("double"), F.lit(0.0))
    cost = lambda i, o: F.round((n("input") + n("cache_creation")) * i / 1e6 + n("output") * o / 1e6, 8)
    name = F.coalesce(model, F.lit(""))
    out = F.lit(None).cast("double")
    for pattern, price_in, price_out in reversed(prices):
        out = F.when(name.rlike(pattern), cost(price_in, price_out)).otherwise(out)
    return out


#: Fields of a layer that may hold the status and whose data it is, in this order, and its codes.
STATUS_FIELDS = ("Status", "FireRestrictionStatus", "RestrictionStatus", "restriction_status", "status")
OWNER_FIELDS = ("DataSource", "data_source", "Source", "source")
CODES = {"0": ("none", "allowed", "No restrictions"), "1": ("stage_1", "developed_sites_only", "Stage 1 public use fire restrictions"), "2": ("stage_2", "prohibited", "Stage 2 public use fire restrictions")}


def layer_claims(sources: DataFrame, features: DataFrame, source_id: str, layer_id: str, order: str) -> DataFrame:
    """source_id, found, status, policy, label, area, confidence of each source from its layer's first matching feature.

    sources: source_id, layer_id, data_source (null: the first feature counts); features: layer_id, order,
    attributes (a JSON object as text). A feature matches if whose data it is equals the source's, but for
    capitals, or contains it. Status codes are whole numbers, as numbers or as text.
    """
    value = lambda names: F.coalesce(*(F.get_json_object("attributes", f"$.{n}") for n in names))
    read = features.select(layer_id, order, F.coalesce(value(OWNER_FIELDS), F.lit("")).alias("_owner"), value(STATUS_FIELDS).alias("_code"), F.get_json_object("attributes", "$.Comments").alias("_area"))
    own = F.col("data_source")
    match = own.isNull() | (F.lower("_owner") == F.lower(own)) | F.col("_owner").contains(own)
    first = sources.select(source_id, layer_id, "data_source").join(read, layer_id).where(match).groupBy(source_id).agg(F.min_by(F.struct("_code", "_area"), order).alias("f"))
    code = F.regexp_replace("f._code", r"^0+(?=\d)", "")
    pick = lambda k, other: reduce(lambda c, item: c.when(code == item[0], F.lit(item[1][k])), list(CODES.items())[1:], F.when(code == "0", F.lit(CODES["0"][k]))).otherwise(other)
    joined = sources.select(source_id).join(first, source_id, "left")
    return joined.select(source_id, F.col("f").isNotNull().alias("found"), pick(0, "unknown").alias("status"), pick(1, "unknown").alias("policy"), pick(2, "Unknown restrictions").alias("label"), F.col("f._area").alias("area"), F.when(code.isin(*CODES), 0.95).otherwise(0.35).alias("confidence"))


def matching_names(names: DataFrame, places: DataFrame, query: str, kinds: list[str], most: int = 360, tie: str | None = None) -> DataFrame:
    """The names (place_id, name, normalized_name, weight) of active places (place_id once, active, search_rank, place_type) that hold the query or one of its phrases, or whose place is of a kind: the first `most` by rank, weight, name, place and, where given, the column tie, which tells a place's equal names apart. None for an empty query."""
    if not query and not kinds:
        return names.limit(0)
    held = reduce(lambda a, p: a | F.col("normalized_name").contains(p), phrases(query), F.lit(False)) if query else F.lit(False)
    joined = names.join(places.where("active").select("place_id", "search_rank", "place_type"), "place_id")
    kept = joined.where(held | (F.col("place_type").isin(*kinds) if kinds else F.lit(False)))
    return kept.orderBy(F.desc("search_rank"), F.desc("weight"), "name", "place_id", *([tie] if tie else [])).limit(most)


def change_log(changes: DataFrame, time: str, tie: str, most: int = 150) -> DataFrame:
    """day, entries: the newest changes by day, newest first, each with its direction and what it says before and after.

    changes: time, tie, unit_id, from_status, from_policy (null: first record), status, policy, origin. The
    list is cut to `most` entries (as the page is) before days are formed.
    """
    newest = changes.orderBy(F.desc(time), F.desc(tie)).limit(most)
    before, after = transition_labels(F.col("from_status"), F.col("from_policy"), F.col("status"), F.col("policy"))
    old, new = F.when(F.col("from_status").isNotNull(), effective_policy(F.col("from_status"), F.col("from_policy"))), effective_policy(F.col("status"), F.col("policy"))
    one = F.struct(F.col(tie).alias("id"), "unit_id", F.col("from_status").isNull().alias("first_record"), (F.col("origin") == "backfill").alias("reconstructed"), direction(old, new).alias("direction"), before.alias("from_label"), after.alias("to_label"))
    by = newest.select(F.date_format(time, "yyyy-MM-dd").alias("day"), F.struct(F.col(time).alias("t"), F.col(tie).alias("i")).alias("o"), one.alias("e")).groupBy("day").agg(F.reverse(F.array_sort(F.collect_list(F.struct("o", "e")))).alias("l"))
    return by.select("day", F.transform("l", lambda s: s["e"]).alias("entries"))


def review_rows(units: DataFrame, observations: DataFrame, unit_id: str, observation_id: str) -> DataFrame:
    """unit_id, observations, current, best (of the current ones, or of all without any) for each unit with observations to review.

    observations: observation_id, unit_id, current, status, errors (array), source_type, confidence,
    created_at. best is one row's struct, the greatest by the score and then the id; units without
    observations have counts of 0 and no best.
    """
    score = F.struct("current", candidate_score(F.col("status"), F.col("errors"), F.col("source_type"), F.col("confidence"), F.col("created_at")).alias("s"), F.col(observation_id).alias("i"))
    row = F.struct(observation_id, "status", "source_type", "confidence", "created_at", "current")
    by = observations.groupBy(unit_id).agg(F.count("*").alias("observations"), F.count_if("current").alias("current"), F.max_by(row, score).alias("best"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return units.select(unit_id).distinct().join(by, unit_id, "left").select(unit_id, zero("observations"), zero("current"), "best")


def climate_lows(normals: DataFrame, unit_id: str, month: int, least: int = 5, share: float = 0.5) -> DataFrame:
    """unit_id, month, bands: for each unit with a band that may be shown, its bands from the lowest up. normals: unit_id, month, least_ft, label, mean, p10, p90, n, share; a band needs so many cells and so much of the area (per cent)."""
    shown = normals.where((F.col("month") == month) & (F.col("n") >= least) & (F.coalesce("share", F.lit(0.0)) >= share))
    band = F.struct("least_ft", "label", *(F.round(c, 1).alias(c) for c in ("mean", "p10", "p90")), "n", F.round("share", 1).alias("share"))
    return shown.groupBy(unit_id).agg(F.array_sort(F.collect_list(band)).alias("bands")).select(unit_id, F.lit(month).alias("month"), "bands")


def dashboard(counts: dict[str, DataFrame], fetches: DataFrame, calls: DataFrame, most: int = 5) -> DataFrame:
    """One row: counts of tables by name, the latest fetches (fetched_at, id), the number and cost of priced calls.

    Each part is aggregated by itself and is one row before they come together.
    """
    rows = [df.agg(F.count("*").alias(name)) for name, df in counts.items()]
    latest = fetches.orderBy(F.desc("fetched_at"), F.desc("id")).limit(most).agg(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("fetched_at", "id")))), lambda s: s["id"]).alias("latest_fetches"))
    cost = calls.agg(F.count("cost").alias("priced_calls"), F.round(F.sum("cost"), 6).alias("cost"))
    one = lambda df: df.withColumn("_", F.lit(0))
    return reduce(lambda a, b: a.join(b, "_"), map(one, [*rows, latest, cost])).drop("_")


def trip_pages(checks: DataFrame, units: DataFrame, rules: DataFrame, wildfires: DataFrame, place_id: str, most: int = 20) -> DataFrame:
    """Trip checks (place_id, policy, verdict, confidence) with the matched units and rules, by name, and the wildfire answer. A place's matches are few; the first `most` names are listed, and how many there are."""
    def named(df: DataFrame, name: str) -> DataFrame:
        own = df.select(place_id, "name").distinct()
        number = F.row_number().over(Window.partitionBy(place_id).orderBy("name"))
        listed = own.withColumn("_n", number).where(F.col("_n") <= most).groupBy(place_id).agg(F.array_sort(F.collect_list("name")).alias(name))
        return own.groupBy(place_id).agg(F.count("*").alias(f"{name}_count")).join(listed, place_id)

    none = F.array().cast("array<string>")
    joined = checks.join(named(units, "units"), place_id, "left").join(named(rules, "rules"), place_id, "left").join(wildfires.select(place_id, F.struct("status", "minor", "incidents").alias("wildfires")), place_id, "left")
    return joined.withColumns({"units": F.coalesce("units", none), "rules": F.coalesce("rules", none), "units_count": F.coalesce("units_count", F.lit(0)), "rules_count": F.coalesce("rules_count", F.lit(0))})
