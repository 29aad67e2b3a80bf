"""Incidents from two feeds and an index of pages; sources from a catalogue of units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderline.functions.geometry import bounds, footprint_miles
from cinderline.functions.rules import EARTH_RADIUS_METERS, METERS_PER_MILE
from cinderline.functions.text import incident_id, incident_name
from cinderline.operators.joins import exact_then_unique


def point_box(lon: Column, lat: Column, acres: Column) -> Column:
    """Box of the circle that stands for an incident without a perimeter."""
    radius = footprint_miles(acres) * METERS_PER_MILE
    dy = F.degrees(radius / EARTH_RADIUS_METERS)
    dx = F.degrees(radius / (EARTH_RADIUS_METERS * F.cos(F.radians(lat))))
    return F.struct((lon - dx).alias("min_x"), (lat - dy).alias("min_y"), (lon + dx).alias("max_x"), (lat + dy).alias("max_y"))


def incidents(points: DataFrame, perimeters: DataFrame, pages: DataFrame) -> DataFrame:
    """One row for each point with an id and a place.

    points: n, id, name, unit, acres, contained, discovered_ms, lon, lat; perimeters: n, id, name,
    acres, contained, discovered_ms, ring; pages: n, unit, name, url. The first perimeter of an id
    counts; its size and containment come first, the point's discovery does. The page is that of unit
    and name, else the only one of the name.
    """
    first = F.struct("n")
    ring = perimeters.withColumn("id", incident_id(F.col("id"))).where("id is not null").groupBy("id").agg(*(F.min_by(c, first).alias(f"p_{c}") for c in ("name", "acres", "contained", "discovered_ms", "ring")))
    base = points.withColumn("id", incident_id(F.col("id"))).where("id is not null and lon is not null and lat is not null")
    joined = base.join(ring, "id", "left").select(
        "id", F.trim(F.coalesce("name", "p_name", F.lit(""))).alias("title"), F.upper("unit").alias("unit"), F.coalesce("p_acres", "acres").alias("acres"), F.coalesce("p_contained", "contained").alias("contained"),
        F.timestamp_millis(F.coalesce("discovered_ms", "p_discovered_ms")).alias("discovered_at"), "lon", "lat", F.col("p_ring").alias("ring"),
    )
    boxed = joined.withColumn("box", F.when(F.col("ring").isNotNull(), bounds(F.col("ring"))).otherwise(point_box(F.col("lon"), F.col("lat"), F.col("acres"))))
    named = boxed.withColumn("name", incident_name(F.col("title")))
    return exact_then_unique(named, pages.select(F.upper("unit").alias("unit"), incident_name(F.col("name")).alias("name"), "url", "n"), ["unit", "name"], "name", "url", "n")


def source_rows(units: DataFrame, default_paths: Column) -> DataFrame:
    """A row for each unit and path: a unit's own paths replace the default ones, extra paths are added. units: slug, official_url, paths, extra_paths (arrays of key, path)."""
    empty = F.slice(default_paths, 1, 0)
    every = F.concat(F.coalesce("paths", default_paths), F.coalesce("extra_paths", empty))
    return units.select("slug", "official_url", F.explode(every).alias("p")).select(F.concat_ws("-", "slug", "p.key").alias("source_slug"), "slug", F.concat(F.regexp_replace("official_url", "/$", ""), F.col("p.path")).alias("url"))
