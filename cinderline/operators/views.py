"""The named answers: list of units, unit detail, maps, and the counts beside a list or a map."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderline.functions.labels import effective_policy
from cinderline.functions.rules import LINK_RANK, MAP_STATUSES, PUBLISHED_REVIEWS, lookup
from cinderline.functions.words import approximate, checked_label
from cinderline.operators.answers import status_group
from cinderline.operators.localized import rule_order, selected_parts
from cinderline.sources.tables import materialise


def status_list(units: DataFrame, statuses: DataFrame, sources: DataFrame, climate: DataFrame) -> DataFrame:
    """A row for each active unit, with defaults where it has no status, its climate (or null) and its sources in order.

    units: unit_id, slug, active and more; statuses: unit_id, status, policy, confidence,
    review_status, source_url, source_title, last_checked_at, summary, at most a row a unit; sources: unit_id, source_slug,
    source_name, source_type, source_address, source_checked_at, few a unit; climate: unit_id and a column climate.
    """
    active = units.where("active").drop("active")
    entry = F.struct("source_slug", "source_name", "source_type", "source_address", "source_checked_at")
    listed = sources.groupBy("unit_id").agg(F.array_sort(F.collect_list(entry)).alias("sources"))
    joined = active.join(statuses, "unit_id", "left").join(climate, "unit_id", "left").join(listed, "unit_id", "left")
    return joined.withColumns({
        "status": F.coalesce("status", F.lit("unknown")),
        "policy": effective_policy(F.col("status"), F.col("policy")),
        "confidence": F.coalesce("confidence", F.lit(0.0)),
        "review_status": F.coalesce("review_status", F.lit("needs_review")),
        "sources": F.coalesce("sources", F.array().cast(listed.schema["sources"].dataType)),
        "url": F.concat(F.lit("/fire-restrictions/"), F.col("slug")),
    })


def unit_details(listed: DataFrame, active_rules: DataFrame) -> DataFrame:
    """listed with its units' active rules (unit_id, rule_id, title, duration_type and more) in order, as an array of structs; few a unit."""
    values = [c for c in active_rules.columns if c != "unit_id"]
    order = rule_order(F.col("duration_type"), F.col("title"), F.col("rule_id"))
    by = active_rules.groupBy("unit_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.struct(*values).alias("r")))), lambda x: x["r"]).alias("rules"))
    return listed.join(by, "unit_id", "left").withColumn("rules", F.coalesce("rules", F.array().cast(by.schema["rules"].dataType)))


def link_source(sources: Column) -> Column:
    """The source that a unit's link comes from: the best kind, then by name."""
    ranked = F.transform(sources, lambda s: F.struct(lookup(s["source_type"], LINK_RANK, 9).alias("rank"), F.coalesce(s["source_name"], F.lit("")).alias("name"), s.alias("s")))
    return F.get(F.array_sort(ranked), F.lit(0))["s"]


def overview_map(boundaries: DataFrame, listed: DataFrame) -> DataFrame:
    """A feature for each boundary (slug, geometry) of a listed unit, with the group it is drawn in and where its answer comes from."""
    best = F.when(F.col("source_url").isNull(), link_source(F.col("sources")))
    joined = boundaries.join(listed, "slug").withColumn("_best", best)
    checked = F.coalesce("last_checked_at", F.col("_best")["source_checked_at"])
    return joined.withColumns({
        "last_checked_label": checked_label(checked), "source_url": F.coalesce("source_url", F.col("_best")["source_address"]),
        "source_title": F.coalesce("source_title", F.col("_best")["source_name"]), "map_status": status_group(F.col("review_status"), F.col("status")),
    }).withColumn("last_checked_at", checked).drop("_best", "sources")


FEATURE = "unit_id", "kind", "feature_slug", "name", "status", "policy", "map_status", "part_name", "geometry_is_approximate"


def unit_map(boundaries: DataFrame, listed: DataFrame, active_rules: DataFrame, parts: str = "parts", subfeatures: str = "subfeatures") -> DataFrame:
    """The features of all units' maps: boundary, the unit's own restriction, and localized rules.

    boundaries: slug. active_rules: unit_id, slug, title, status, policy, geometry_source_type,
    accuracy, parts (an array, null without a geometry), subfeatures (array of structs indexes,
    part_name). A rule is one feature for each of its subfeatures that names parts, without any of
    these one feature of all parts. Columns FEATURE and `parts`, null for the unit's own features.
    """
    text = lambda v=None: F.lit(v).cast("string")
    listed = materialise(listed)  # three kinds of features read it
    rules = active_rules.withColumnRenamed("slug", "rule_slug").join(listed.select("unit_id"), "unit_id").where(F.col(parts).isNotNull())
    chosen = F.filter(F.transform(F.coalesce(subfeatures, F.array().cast(rules.schema[subfeatures].dataType)), lambda s: F.struct(s["part_name"].alias("part_name"), selected_parts(F.col(parts), s["indexes"]).alias("own"))), lambda s: s["own"].isNotNull())
    whole = F.array(F.struct(text().alias("part_name"), F.col(parts).alias("own")))
    local = rules.withColumn("_f", F.explode(F.when(F.size(chosen) > 0, chosen).otherwise(whole)))
    local = local.select(
        "unit_id", text("localized_restriction").alias("kind"), F.col("rule_slug").alias("feature_slug"), F.col("title").alias("name"), "status", F.coalesce(F.nullif("policy", F.lit("")), F.lit("unknown")).alias("policy"), text("active").alias("map_status"),
        F.col("_f.part_name").alias("part_name"), approximate(F.col("geometry_source_type"), F.col("accuracy")).alias("geometry_is_approximate"), F.col("_f.own").alias("parts"),
    )
    known = boundaries.select("slug").join(listed, "slug")
    own = lambda df, kind, how: df.select("unit_id", text(kind).alias("kind"), F.col("slug").alias("feature_slug"), "name", "status", "policy", text(how).alias("map_status"), text().alias("part_name"), F.lit(None).cast("boolean").alias("geometry_is_approximate"), F.lit(None).cast(local.schema["parts"].dataType).alias("parts"))
    wide = known.where(F.col("review_status").isin(*PUBLISHED_REVIEWS) & F.col("status").isin(*MAP_STATUSES))
    return reduce(DataFrame.unionByName, [own(known, "land_unit_boundary", "boundary"), own(wide, "forestwide_restriction", "forestwide_active"), local])


def map_counts(features: DataFrame, unit: str = "unit_id") -> DataFrame:
    """By unit: features that are shown (neither boundary nor wildfire), restrictions of the whole unit, and different localized restrictions."""
    kind = F.col("kind")
    return features.groupBy(unit).agg(
        F.count_if(~F.col("map_status").isin("boundary", "wildfire")).alias("visible"), F.count_if(kind == "forestwide_restriction").alias("forestwide"),
        F.count_distinct(F.when(kind == "localized_restriction", F.nullif("feature_slug", F.lit("")))).alias("localized"),
    )


def section_counts(rows: DataFrame, section: str, shown: Column, typed: str) -> DataFrame:
    """By section: how many rows contain what was typed (all without anything), of how many; capitals and surplus blanks do not count."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    return rows.groupBy(section).agg(F.count_if(F.coalesce(plain(shown), F.lit("")).contains(plain(F.lit(typed)))).alias("visible"), F.count("*").alias("total"))
