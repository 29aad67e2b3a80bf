"""Localized rules: validation, order, and the parts of a map that they cover."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderline.functions.rules import DURATION_RANK, lookup
from cinderline.functions.text import contains_evidence, first_present, lenient_date, short_slug
from cinderline.operators.answers import RESTRICTIVE, RESTRICTIVE_EVIDENCE, TABULAR

#: What the columns of a rule may hold.
STOVES = ("unknown", "allowed", "fire_pan_required", "prohibited", "developed_sites_only", "allowed_with_shutoff_valve")
ALLOWED = {
    "status": ("unknown", "advisory", "partial", "stage_1", "stage_2", "full", "closure", "year_round"),
    "campfire_policy": ("unknown", "allowed", "developed_sites_only", "fire_pan_required", "prohibited", "propane_allowed", "stoves_only"),
    "charcoal_policy": STOVES, "gas_stove_policy": STOVES, "liquid_fuel_stove_policy": STOVES, "alcohol_stove_policy": STOVES, "solid_fuel_stove_policy": STOVES, "wood_stove_policy": STOVES,
    "duration_type": ("unknown", "permanent", "seasonal", "temporary", "incident"),
    "area_type": ("unknown", "ranger_district", "wilderness", "corridor", "campground", "trail", "trailhead", "watershed", "incident_area", "administrative_area", "named_area", "map_area", "other"),
    "geometry_source_type": (
        "unknown", "none", "text_description", "source_map", "source_pdf_map", "source_arcgis_feature", "geojson", "linked_map", "usfs_edw_wilderness", "blm_plss_section", "usgs_nhd_waterbody",
        "derived_nhd_centroid_buffer", "derived_nhd_waterbody_buffer", "derived_nhd_flowline_buffer", "derived_gnis_feature_buffer", "affected_area_envelope", "derived_dem_elevation",
        "derived_usfs_trail_boundary_polygon", "official_order_map_pending", "named_area_manual_review",
    ),
}
GEOJSON_TYPES = ("Point", "MultiPoint", "LineString", "MultiLineString", "Polygon", "MultiPolygon", "GeometryCollection", "Feature", "FeatureCollection")
SEASON = {"season_start_month": 12, "season_end_month": 12, "season_start_day": 31, "season_end_day": 31}


def localized_errors(source_type: Column, text: Column, today: Column, columns: list[str]) -> Column:
    """Array of error codes of a rule, empty if it is valid; the rule's columns have the names of the survey's model, and those in `columns` exist.

    missing_title, missing_area, missing_evidence; unsupported_<column>; bad_start, bad_end, past,
    reversed (dates); range_<column> (season); quote (not in the text, unless the source is a table);
    restrictive (no evidence of a restriction in the quotes, or in the text without quotes); geometry.
    """
    col = lambda c, kind="string": (F.col(c) if c in columns else F.lit(None)).cast(kind)
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    said = F.filter(F.coalesce(col("evidence_quotes", "array<string>"), F.array().cast("array<string>")), lambda q: q.isNotNull())
    restrictive = F.coalesce(col("status").isin(*RESTRICTIVE), F.lit(False))
    start, end = lenient_date(col("effective_start")), lenient_date(col("effective_end"))
    in_range = lambda c: col(c, "int").between(1, SEASON[c])
    recurring = F.coalesce((col("duration_type") == "seasonal") & in_range("season_start_month") & in_range("season_end_month") & in_range("season_start_day") & in_range("season_end_day"), F.lit(False))
    joined = F.array_join(said, "\n")
    evidence = F.when(blank(joined), F.coalesce(text, F.lit(""))).otherwise(joined)
    checks = [
        ("missing_title", blank(col("title"))),
        ("missing_area", blank(col("affected_area"))),
        ("missing_evidence", F.size(F.coalesce(col("evidence_quotes", "array<string>"), F.array().cast("array<string>"))) == 0),
        *((f"unsupported_{c}", ~F.coalesce(col(c), F.lit("")).isin(*values)) for c, values in ALLOWED.items()),
        ("bad_start", col("effective_start").isNotNull() & start.isNull()),
        ("bad_end", col("effective_end").isNotNull() & end.isNull()),
        ("past", (end < today) & restrictive & ~recurring),
        ("reversed", start > end),
        *((f"range_{c}", col(c, "int").isNotNull() & ~in_range(c)) for c in SEASON),
        ("quote", ~F.coalesce(source_type.isin(*TABULAR), F.lit(False)) & F.exists(said, lambda q: ~blank(q) & ~contains_evidence(F.coalesce(text, F.lit("")), q))),
        ("restrictive", restrictive & ~evidence.rlike(RESTRICTIVE_EVIDENCE)),
        ("geometry", col("geometry_json").isNotNull() & ~F.coalesce(F.try_variant_get(F.try_parse_json(col("geometry_json")), "$.type", "string").isin(*GEOJSON_TYPES), F.lit(False))),
    ]
    return F.array_compact(F.array(*(F.when(F.coalesce(cond, F.lit(False)), code) for code, cond in checks)))


def strong_rule(errors: Column, confidence: Column, reasons: Column, status: Column) -> Column:
    """Whether a rule may be believed without review."""
    return F.coalesce((F.size(errors) == 0) & (confidence >= 0.9) & (F.coalesce(F.size(reasons), F.lit(0)) <= 0) & status.isin(*RESTRICTIVE), F.lit(False))


def rule_order(duration: Column, title: Column, rule_id: Column) -> Column:
    """Sorts rules: temporary ones, incidents, seasonal and permanent ones, all others; then by title and id."""
    return F.struct(lookup(duration, DURATION_RANK, 9).alias("rank"), F.coalesce(title, F.lit("")).alias("title"), rule_id.alias("id"))


def unit_rules(rules: DataFrame, unit: str) -> DataFrame:
    """Each unit's rules in order, as an array of ids (a unit's rules are few)."""
    order = rule_order(F.col("duration_type"), F.col("title"), F.col("rule_id"))
    return rules.groupBy(unit).agg(F.transform(F.array_sort(F.collect_list(order)), lambda r: r["id"]).alias("rules"))


def selected_parts(parts: Column, indexes: Column) -> Column:
    """The parts of a MultiPolygon that an index list names: from 0, or from the end with negative numbers; others are left out. Null without any."""
    at = lambda i: F.get(parts, F.when(i < 0, i + F.size(parts)).otherwise(i))
    chosen = F.filter(F.transform(F.coalesce(indexes, F.array().cast("array<int>")), at), lambda p: p.isNotNull())
    return F.when(F.size(chosen) > 0, chosen)


def parsed_rules(rules: DataFrame) -> DataFrame:
    """Rules as a parser gives them, made ready to keep: values outside their vocabulary are unknown, dates read, a recurring season has no dates, a title and slug are found.

    rules: unit_id, source_slug, title, affected_area, duration_type, effective_start, effective_end
    (text), the four season columns, status, campfire_policy, errors (array), confidence; other
    columns stay. review_status is auto_accepted for a strong rule.
    """
    known = lambda c: F.when(F.col(c).isin(*ALLOWED[c]), F.col(c)).otherwise("unknown")
    recurring = F.coalesce((F.col("duration_type") == "seasonal") & reduce(lambda a, b: a & b, (F.col(c).between(1, most) for c, most in SEASON.items())), F.lit(False))
    title = F.coalesce(first_present(F.col("title"), F.col("affected_area")), F.lit("Localized fire-use rule"))
    day = lambda c: F.when(~recurring, lenient_date(F.col(c)))
    return rules.withColumns({
        "review_status": F.when(strong_rule(F.col("errors"), F.col("confidence"), F.lit(None).cast("array<string>"), F.col("status")), "auto_accepted").otherwise("needs_review"),
        "title": title, "slug": short_slug(F.concat_ws("-", "source_slug", title)), "effective_start": day("effective_start"), "effective_end": day("effective_end"),
        **{c: known(c) for c in ("status", "campfire_policy", "duration_type")}, "origin": F.lit("parsed_source"), "confidence": F.coalesce("confidence", F.lit(0.0)),
    })


def keep_rules(state: DataFrame, parsed: DataFrame, now: Column) -> DataFrame:
    """The state after parsed rules: of each (unit_id, slug) the last parsed rule, by fetch_id, instead of what was there, new ones added; created_at stays, updated_at is now for those that were there.

    Both have unit_id, slug, fetch_id; state also created_at, updated_at.
    """
    keys = ["unit_id", "slug"]
    values = [c for c in state.columns if c not in (*keys, "created_at", "updated_at")]
    newest = parsed.groupBy(*keys).agg(F.max_by(F.struct(*values), "fetch_id").alias("_new"))
    joined = state.withColumn("_there", F.lit(True)).join(newest, keys, "full_outer")
    fresh = F.col("_new").isNotNull()
    return joined.select(
        *keys, *(F.when(fresh, F.col("_new")[c]).otherwise(F.col(c)).alias(c) for c in values),
        F.coalesce("created_at", F.when(F.col("_there").isNull(), now)).alias("created_at"), F.when(fresh & F.col("_there").isNotNull(), now).otherwise(F.col("updated_at")).alias("updated_at"),
    )
