"""Driver queries of shapes: covers, edge joins, overlays, regions of cells, lines."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderline.functions import geometry
from cinderline.operators import lines, overlay, simplify, spatial, views, wildfires
from cinderline.plans.catalogue import Tables, lat, lon, query
from cinderline.plans.records import shape_text
from cinderline.plans.views import LIST_SQL, MAP_SQL, RULE_SQL, active_rules, features, listed
from cinderline.sources.tables import dealt, materialise

PLANE = "pi() / 180 * 6378137.0"


def corner(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def square(x: Column, y: Column, s: Column) -> Column:
    """A ring about a point, s to each side."""
    return F.array(corner(x - s, y - s), corner(x + s, y - s), corner(x + s, y + s), corner(x - s, y + s))


def spots(t: Tables, label: int | None = None) -> DataFrame:
    e = t.embeddings if label is None else t.embeddings.where(F.col("label") == label)
    return e.select("vec_id", "label", lon().alias("x"), lat().alias("y"))


SPOTS_SQL = "p AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)"


# Covers

@query(f"""WITH {SPOTS_SQL}, g AS (SELECT vec_id AS gid, x, y, 0.02 + (vec_id % 5) / 100.0 AS s FROM p WHERE label = 1)
    SELECT p.vec_id AS point_id, gid FROM p JOIN g ON (abs(p.x - g.x) < s AND abs(p.y - g.y) < s AND NOT (abs(p.x - g.x) <= s / 3 AND abs(p.y - g.y) <= s / 3)) OR (abs(p.x - g.x - 0.1) < s / 2 AND abs(p.y - g.y - 0.1) < s / 2)""")
def multipart_places(t: Tables) -> DataFrame:
    s = 0.02 + F.col("vec_id") % 5 / 100.0
    x, y = F.col("x"), F.col("y")
    shapes = spots(t, 1).select(F.col("vec_id").alias("gid"), F.array(square(x, y, s), square(x, y, s / 3), square(x + 0.1, y + 0.1, s / 2)).alias("rings"))
    return spatial.points_in_polygons(spots(t).withColumnRenamed("vec_id", "point_id"), shapes, "point_id", "gid", 0.05)


@query(f"""WITH {SPOTS_SQL}, a AS (SELECT vec_id AS area_id, x, y FROM p WHERE label = 3),
    r AS (SELECT q.vec_id AS rule_id, CASE WHEN q.vec_id % 2 = 0 THEN q.x ELSE a.x END AS x, CASE WHEN q.vec_id % 2 = 0 THEN q.y ELSE a.y END AS y, CASE WHEN q.vec_id % 2 = 0 THEN 0.03 ELSE 0.08 END AS s
        FROM p q LEFT JOIN a ON a.area_id = q.vec_id + 1 WHERE q.label = 2),
    b AS (SELECT vec_id AS place_id, x, y, 0.005 AS h FROM p WHERE label = 1)
    SELECT place_id, rule_id, CASE WHEN abs(b.x - r.x) < s AND abs(b.y - r.y) < s THEN 'contains' ELSE 'intersects' END AS how FROM b JOIN r ON abs(b.x - r.x) <= s + h AND abs(b.y - r.y) <= s + h""")
def places_in_rules(t: Tables) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    drawn = F.when(F.col("vec_id") % 2 == 0, F.array(square(x, y, F.lit(0.03))))
    rules = spots(t, 2).select(F.col("vec_id").alias("rule_id"), (F.col("vec_id") + 1).alias("area_id"), drawn.alias("rings"))
    areas = spots(t, 3).select(F.col("vec_id").alias("area_id"), F.array(square(x, y, F.lit(0.08))).alias("rings"))
    places = spots(t, 1).select(F.col("vec_id").alias("place_id"), "x", "y", F.array(square(x, y, F.lit(0.005))).alias("rings"))
    return spatial.places_in_rules(places, rules, areas, "place_id", "rule_id", "area_id", 0.05)


# Proximity of perimeters

TIER_SQL = "CASE WHEN miles <= 0 THEN 'inside' WHEN miles <= 10 THEN 'near' WHEN miles <= 30 AND acres >= 100 THEN 'regional' END"
FIRES_SQL = "f AS (SELECT vec_id, label, embedding[1]::DOUBLE * 10 - 120 AS x, embedding[2]::DOUBLE * 10 + 44 AS y, (vec_id % 10) * 120.0 AS acres, 0.01 + (vec_id % 4) / 40.0 AS s, vec_id % 3 > 0 AS mapped FROM embeddings)"
RADIUS_SQL = "greatest(sqrt(acres * 4046.86 / pi()), 500.0)"


def fires(t: Tables) -> DataFrame:
    """Incidents about the spots, two of three with a mapped perimeter."""
    s = 0.01 + F.col("vec_id") % 4 / 40.0
    e = t.embeddings.select("vec_id", "label", (lon() * 10 - 120).alias("lon"), (lat() * 10 + 44).alias("lat"), (F.col("vec_id") % 10 * 120.0).alias("acres"))
    return e.withColumn("ring", F.when(F.col("vec_id") % 3 > 0, square(F.col("lon"), F.col("lat"), s)))


@query(f"""WITH {FIRES_SQL}, k AS (SELECT a.vec_id AS boundary_id, q.vec_id AS incident_id, q.acres, q.mapped, a.s * 2 * {PLANE} * cos(radians(a.y)) AS w, a.s * 2 * {PLANE} AS h, q.s * {PLANE} * cos(radians(a.y)) AS w2, q.s * {PLANE} AS h2,
        abs(q.x - a.x) * {PLANE} * cos(radians(a.y)) AS u, abs(q.y - a.y) * {PLANE} AS v FROM f a JOIN f q ON a.label = 1 AND q.label = 2),
    d AS (SELECT *, CASE WHEN mapped THEN sqrt(greatest(u - w - w2, 0) ** 2 + greatest(v - h - h2, 0) ** 2) ELSE greatest(0, sqrt(greatest(u - w, 0) ** 2 + greatest(v - h, 0) ** 2) - {RADIUS_SQL}) END / 1609.344 AS miles FROM k)
    SELECT boundary_id, incident_id, round(miles, 4) AS miles, {TIER_SQL} AS tier FROM d WHERE {TIER_SQL} IS NOT NULL""")
def perimeter_proximity(t: Tables) -> DataFrame:
    f = fires(t)
    boundaries = f.where("label = 1").select(F.col("vec_id").alias("boundary_id"), F.array(square(F.col("lon"), F.col("lat"), 2 * (0.01 + F.col("vec_id") % 4 / 40.0))).alias("rings"))
    incidents = f.where("label = 2").select(F.col("vec_id").alias("incident_id"), "lon", "lat", "acres", F.when(F.col("ring").isNotNull(), F.array("ring")).alias("rings"))
    return spatial.boundary_proximity(boundaries, incidents, "boundary_id", "incident_id").withColumn("miles", F.round("miles", 4))


@query(f"""WITH {FIRES_SQL}, k AS (SELECT a.vec_id AS point_id, q.vec_id AS incident_id, q.acres, q.mapped, q.s * {PLANE} * cos(radians(a.y)) AS w, q.s * {PLANE} AS h,
        abs(q.x - a.x) * {PLANE} * cos(radians(a.y)) AS u, abs(q.y - a.y) * {PLANE} AS v FROM f a JOIN f q ON a.label <> 2 AND q.label = 2),
    d AS (SELECT *, CASE WHEN mapped THEN sqrt(greatest(u - w, 0) ** 2 + greatest(v - h, 0) ** 2) ELSE greatest(0, sqrt(u ** 2 + v ** 2) - {RADIUS_SQL}) END / 1609.344 AS miles FROM k)
    SELECT point_id, incident_id, round(miles, 4) AS miles, {TIER_SQL} AS tier FROM d WHERE {TIER_SQL} IS NOT NULL""")
def perimeter_tiers(t: Tables) -> DataFrame:
    f = fires(t)
    return spatial.proximity(f.where("label <> 2").select(F.col("vec_id").alias("point_id"), "lon", "lat"), f.where("label = 2").withColumnRenamed("vec_id", "incident_id"), "point_id", "incident_id").withColumn("miles", F.round("miles", 4))


# Wildfire answers

NOW = datetime(2024, 1, 31, tzinfo=timezone.utc)
DETAIL_SQL = """i AS (SELECT vec_id AS incident_id, 'Fire ' || vec_id AS name, CAST(vec_id % 101 AS DOUBLE) AS contained, CASE WHEN vec_id % 7 = 0 THEN 'https://x.org/' || vec_id ELSE '' END AS url,
    CASE vec_id % 4 WHEN 0 THEN vec_id % 90 WHEN 1 THEN 7 END AS people, CASE WHEN vec_id % 5 > 0 THEN 'smoke ' || vec_id % 5 END AS said FROM embeddings)"""
ROLLUP_SQL = """a AS (SELECT place_id, CASE max(CASE tier WHEN 'inside' THEN 3 WHEN 'near' THEN 2 ELSE 1 END) WHEN 3 THEN 'inside' WHEN 2 THEN 'near' ELSE 'regional' END AS status, NOT bool_or(url <> '' OR acres >= 100) AS minor FROM x JOIN i USING (incident_id) GROUP BY 1),
    n AS (SELECT place_id, string_agg(name || '|' || CAST(CAST(round(miles, 1) AS DECIMAL(8, 1)) AS VARCHAR) || '|' || CAST(acres AS INTEGER) || '|' || coalesce(CAST(people AS VARCHAR), '-') || '|' || coalesce(said, '-') || '|' || incident_id, ',' ORDER BY miles, incident_id) AS incidents
        FROM (SELECT * FROM x JOIN i USING (incident_id) QUALIFY row_number() OVER (PARTITION BY place_id ORDER BY miles, incident_id) <= 5) GROUP BY 1),
    s AS (SELECT strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') AS as_of FROM events WHERE event_type = 'purchase' AND epoch(ts) >= epoch(TIMESTAMP '2024-01-31') - 48 * 3600)"""


def incident_details(t: Tables) -> DataFrame:
    i = F.col("vec_id")
    said = F.when(i % 5 > 0, F.concat(F.lit(" smoke "), (i % 5).cast("string"), F.lit(" "))).otherwise("  ")
    people = F.when(i % 4 == 0, (i % 90).cast("string")).when(i % 4 == 1, "7.9").when(i % 4 == 2, "some")
    return fires(t).select(
        i.alias("incident_id"), "lon", "lat", F.when(F.col("ring").isNotNull(), F.array("ring")).alias("rings"), F.concat(F.lit("Fire "), i.cast("string")).alias("name"), "acres", (i % 101).cast("double").alias("percent_contained"), F.lit(NOW).alias("discovered_at"), F.lit("active").alias("behavior"),
        F.when(i % 7 == 0, F.concat(F.lit("https://x.org/"), i.cast("string"))).otherwise("").alias("information_url"), people.alias("personnel"), said.alias("short_description"),
    )


def synced(t: Tables) -> datetime | None:
    return wildfires.last_sync(t.events.select(F.col("ts").alias("finished_at"), (F.col("event_type") == "purchase").alias("success")), NOW, 48)


def listed_incidents(c: Column) -> Column:
    dash = lambda x: F.coalesce(x.cast("string"), F.lit("-"))
    return F.array_join(F.transform(c, lambda i: F.concat_ws("|", i["name"], i["distance_miles"].cast("decimal(8,1)").cast("string"), i["acres"].cast("int").cast("string"), dash(i["personnel"]), dash(i["short_description"]), i["incident_id"])), ",")


def point_tiers(t: Tables) -> DataFrame:
    f = fires(t)
    return spatial.proximity(f.where("label <> 2").select(F.col("vec_id").alias("place_id"), "lon", "lat"), f.where("label = 2").withColumnRenamed("vec_id", "incident_id"), "place_id", "incident_id")


POINT_TIERS_SQL = f"""{FIRES_SQL}, k AS (SELECT a.vec_id AS place_id, q.vec_id AS incident_id, q.acres, q.mapped, q.s * {PLANE} * cos(radians(a.y)) AS w, q.s * {PLANE} AS h,
        abs(q.x - a.x) * {PLANE} * cos(radians(a.y)) AS u, abs(q.y - a.y) * {PLANE} AS v FROM f a JOIN f q ON a.label <> 2 AND q.label = 2),
    d AS (SELECT *, CASE WHEN mapped THEN sqrt(greatest(u - w, 0) ** 2 + greatest(v - h, 0) ** 2) ELSE greatest(0, sqrt(u ** 2 + v ** 2) - {RADIUS_SQL}) END / 1609.344 AS miles FROM k),
    x AS (SELECT place_id, incident_id, acres, mapped, miles, {TIER_SQL} AS tier FROM d WHERE {TIER_SQL} IS NOT NULL)"""


@query(f"""WITH {POINT_TIERS_SQL}, {DETAIL_SQL}, {ROLLUP_SQL} SELECT f.vec_id AS place_id, coalesce(status, 'none') AS status, coalesce(minor, false) AS minor, as_of, coalesce(incidents, '') AS incidents FROM f LEFT JOIN a ON a.place_id = f.vec_id LEFT JOIN n ON n.place_id = f.vec_id, s WHERE label <> 2""")
def wildfire_context(t: Tables) -> DataFrame:
    places = t.embeddings.where("label <> 2").select(F.col("vec_id").alias("place_id"))
    c = wildfires.contexts(places, point_tiers(t), incident_details(t).where("incident_id is not null"), synced(t), "place_id", "incident_id")
    return c.withColumn("incidents", listed_incidents(F.col("incidents")))


@query(f"""WITH {POINT_TIERS_SQL}, {DETAIL_SQL}, {ROLLUP_SQL.split('s AS (SELECT strftime')[0]} s AS (SELECT strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') AS as_of FROM events WHERE event_type = 'purchase' AND epoch(ts) >= epoch(TIMESTAMP '2024-01-31') - 48 * 3600)
    SELECT place_id, incident_id, CASE WHEN mapped THEN 'wildfire' ELSE 'wildfire_incident' END AS kind, CASE WHEN mapped THEN 'Polygon' ELSE 'Point' END AS shape, name, contained, as_of FROM d JOIN i USING (incident_id), s WHERE miles <= 30""")
def wildfire_features(t: Tables) -> DataFrame:
    f = fires(t)
    features = wildfires.incident_features(incident_details(t), synced(t), "incident_id")
    shown = features.select("incident_id", "kind", F.get_json_object("geometry", "$.type").alias("shape"), "name", F.col("percent_contained").alias("contained"), "as_of")
    incidents = f.where("label = 2").select(F.col("vec_id").alias("incident_id"), "lon", "lat", "acres", "ring").join(shown, "incident_id")
    return spatial.incidents_within(f.where("label <> 2").select(F.col("vec_id").alias("place_id"), "lon", "lat"), incidents, "place_id", "incident_id", carried=("kind", "shape", "name", "contained", "as_of"))


UNIT_TIERS_SQL = f"""{FIRES_SQL}, k AS (SELECT a.vec_id AS place_id, q.vec_id AS incident_id, q.acres, q.mapped, a.s * 2 * {PLANE} * cos(radians(a.y)) AS w, a.s * 2 * {PLANE} AS h, q.s * {PLANE} * cos(radians(a.y)) AS w2, q.s * {PLANE} AS h2,
        abs(q.x - a.x) * {PLANE} * cos(radians(a.y)) AS u, abs(q.y - a.y) * {PLANE} AS v FROM f a JOIN f q ON a.label = 1 AND q.label = 2),
    d AS (SELECT *, CASE WHEN mapped THEN sqrt(greatest(u - w - w2, 0) ** 2 + greatest(v - h - h2, 0) ** 2) ELSE greatest(0, sqrt(greatest(u - w, 0) ** 2 + greatest(v - h, 0) ** 2) - {RADIUS_SQL}) END / 1609.344 AS miles FROM k),
    x AS (SELECT place_id, incident_id, acres, mapped, miles, {TIER_SQL} AS tier FROM d WHERE {TIER_SQL} IS NOT NULL)"""


def bounded_units(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Units with a boundary (those whose id is that of a spot of label 1), and the incidents."""
    f = fires(t)
    boundaries = f.where("label = 1").select(F.col("vec_id").alias("unit_id"), F.array(square(F.col("lon"), F.col("lat"), 2 * (0.01 + F.col("vec_id") % 4 / 40.0))).alias("rings"))
    return boundaries, f.where("label = 2").select(F.col("vec_id").alias("incident_id"), "lon", "lat", "acres", F.when(F.col("ring").isNotNull(), F.array("ring")).alias("rings"))


def unit_tiers(t: Tables) -> DataFrame:
    return spatial.boundary_proximity(*bounded_units(t), "unit_id", "incident_id")


@query(f"""WITH {LIST_SQL}, {RULE_SQL}, wf AS (WITH {UNIT_TIERS_SQL}, {DETAIL_SQL}, {ROLLUP_SQL} SELECT a.place_id, a.status, a.minor, n.incidents, s.as_of FROM s LEFT JOIN a ON true LEFT JOIN n USING (place_id))
    SELECT l.unit_id, l.status, coalesce((SELECT string_agg(CAST(rule_id AS VARCHAR) || ' ' || title, ',' ORDER BY ro.i) FROM ro WHERE ro.unit_id = l.unit_id), '') AS rules, coalesce(wf.status, 'none') AS wildfires, coalesce(wf.minor, false) AS minor,
    (SELECT min(as_of) FROM wf) AS as_of, coalesce(wf.incidents, '') AS incidents FROM l LEFT JOIN wf ON wf.place_id = l.unit_id""")
def unit_pages(t: Tables) -> DataFrame:
    units = listed(t)
    c = wildfires.contexts(units.select("unit_id"), unit_tiers(t), incident_details(t), synced(t), "unit_id", "incident_id")
    page = wildfires.unit_pages(views.unit_details(units, active_rules(t)), c, "unit_id")
    rules = F.array_join(F.transform("rules", lambda r: F.concat(r["rule_id"].cast("string"), F.lit(" "), r["title"])), ",")
    return page.select("unit_id", "status", rules.alias("rules"), F.col("wildfires.status").alias("wildfires"), "wildfires.minor", "wildfires.as_of", listed_incidents(F.col("wildfires.incidents")).alias("incidents"))


@query(f"""WITH {MAP_SQL}, wf AS (WITH {UNIT_TIERS_SQL} SELECT place_id, incident_id, mapped FROM x)
    SELECT unit_id, kind, feature_slug FROM m UNION ALL SELECT place_id, CASE WHEN mapped THEN 'wildfire' ELSE 'wildfire_incident' END, CAST(incident_id AS VARCHAR) FROM wf WHERE place_id IN (SELECT unit_id FROM m)""")
def unit_features(t: Tables) -> DataFrame:
    own = materialise(features(t).select("unit_id", "kind", "feature_slug"))
    boundaries, incidents = bounded_units(t)
    shown = wildfires.incident_features(incident_details(t), synced(t), "incident_id").select("incident_id", "kind")
    found = spatial.boundary_incidents(wildfires.with_features(boundaries, own, "unit_id"), incidents.join(shown, "incident_id"), "unit_id", "incident_id", carried=("kind",))
    return wildfires.unit_features(own, found, "unit_id", known=True)


# Overlays

@query("""WITH RECURSIVE c AS (SELECT l_linenumber AS k, l_partkey % 24 AS r, l_suppkey % 30 AS c FROM lineitem GROUP BY ALL HAVING avg(l_quantity) > 26),
    o AS (SELECT k, c AS ax, r AS ay, c + 1 AS bx, r AS cy, 0 AS d FROM c UNION ALL SELECT k, c + 1, r, c + 1, r + 1, 1 FROM c UNION ALL SELECT k, c + 1, r + 1, c, r + 1, 2 FROM c UNION ALL SELECT k, c, r + 1, c, r, 3 FROM c),
    e AS MATERIALIZED (SELECT o.*, row_number() OVER () AS id FROM o WHERE NOT EXISTS (SELECT 1 FROM o q WHERE q.k = o.k AND q.ax = o.bx AND q.ay = o.cy AND q.bx = o.ax AND q.cy = o.ay)),
    n AS MATERIALIZED (SELECT e.id, e.d, arg_min(f.id, CASE WHEN f.d = (e.d + 1) % 4 THEN 0 WHEN f.d = e.d THEN 1 ELSE 2 END) AS nid, arg_min(f.d, CASE WHEN f.d = (e.d + 1) % 4 THEN 0 WHEN f.d = e.d THEN 1 ELSE 2 END) AS nd FROM e JOIN e f ON f.k = e.k AND f.ax = e.bx AND f.ay = e.cy GROUP BY ALL),
    w AS (SELECT id, id AS at FROM e UNION SELECT w.id, n.nid FROM w JOIN n ON n.id = w.at),
    g AS (SELECT id, min(at) AS ring FROM w GROUP BY 1)
    SELECT CAST(k AS BIGINT) AS region, CAST(min((ax, ay))[1] AS DOUBLE) AS x, CAST(min((ax, ay))[2] AS DOUBLE) AS y, sum(ax * cy - bx * ay) / 2.0 AS area, CAST(count(*) AS DOUBLE) AS length, CAST(count(*) FILTER (n.d <> n.nd) AS INTEGER) AS corners FROM e JOIN g USING (id) JOIN n USING (id) GROUP BY k, ring""".replace(" AS at FROM e UNION SELECT w.id, n.nid FROM w JOIN n ON n.id = w.at", " AS here FROM e UNION SELECT w.id, n.nid FROM w JOIN n ON n.id = w.here").replace("min(at) AS ring", "min(here) AS ring"))
def raster_regions(t: Tables) -> DataFrame:
    by = t.lineitem.groupBy(F.col("l_linenumber").cast("long").alias("region"), (F.col("l_partkey") % 24).alias("row"), (F.col("l_suppkey") % 30).alias("col")).agg(F.avg("l_quantity").alias("v")).where("v > 26")
    return overlay.raster_regions(by, "region").select("region", F.col("ring")[0]["x"].alias("x"), F.col("ring")[0]["y"].alias("y"), "area", "length", F.size("ring").alias("corners"))


WINDOWS_SQL = f"""{SPOTS_SQL}, g AS (SELECT vec_id, x, y, 0.0113 + (vec_id % 7) / 207.0 AS s, 0.0013 + 0.0017 * (vec_id % 11) AS o FROM p),
    r AS (SELECT vec_id, 1 AS side, [x - s, x + s, x] AS px, [y - s, y - s, y + s] AS py FROM g UNION ALL SELECT vec_id, 2, [x + o - s, x + o + s / 2, x + o / 2], [y + o, y - s - o, y + s + o] FROM g),
    e AS (SELECT vec_id, side, px[i] AS ax, py[i] AS ay, px[i % 3 + 1] AS bx, py[i % 3 + 1] AS cy FROM r, (SELECT unnest([1, 2, 3]) AS i)),
    h AS (SELECT e.vec_id, e.side, e.ax, e.ay, e.bx, e.cy, (w.bx - w.ax) * (e.ay - w.ay) - (w.cy - w.ay) * (e.ax - w.ax) AS u, (w.bx - w.ax) * (e.cy - w.ay) - (w.cy - w.ay) * (e.bx - w.ax) AS v FROM e JOIN e w ON w.vec_id = e.vec_id AND w.side <> e.side),
    c AS (SELECT vec_id, side, ax, ay, bx, cy, greatest(0, max(CASE WHEN u < 0 THEN CASE WHEN v > u THEN u / (u - v) ELSE 2 END END)) AS t0, least(1, min(CASE WHEN u >= 0 AND v < 0 THEN u / (u - v) END)) AS t1 FROM h GROUP BY ALL),
    q AS (SELECT vec_id, ax + coalesce(t0, 0) * (bx - ax) AS ax, ay + coalesce(t0, 0) * (cy - ay) AS ay, ax + coalesce(t1, 1) * (bx - ax) AS bx, ay + coalesce(t1, 1) * (cy - ay) AS cy FROM c WHERE coalesce(t0, 0) < coalesce(t1, 1))
    SELECT vec_id, round(sum((ax - x) * (cy - y) - (bx - x) * (ay - y)) / 2, 8) AS area FROM q JOIN p USING (vec_id) GROUP BY 1 HAVING round(sum((ax - x) * (cy - y) - (bx - x) * (ay - y)) / 2, 8) > 0"""


def windows(t: Tables) -> DataFrame:
    """Of every spot a triangle and another one, moved and turned, that cuts it."""
    x, y, s, o = F.col("x"), F.col("y"), 0.0113 + F.col("vec_id") % 7 / 207.0, 0.0013 + 0.0017 * (F.col("vec_id") % 11)
    return spots(t).select("vec_id", F.array(corner(x - s, y - s), corner(x + s, y - s), corner(x, y + s)).alias("ring"), F.array(corner(x + o - s, y + o), corner(x + o + s / 2, y - s - o), corner(x + o / 2, y + s + o)).alias("window"))


@query(f"WITH {WINDOWS_SQL}")
def clipped_windows(t: Tables) -> DataFrame:
    w = windows(t).withColumn("ring", overlay.clipped(F.col("ring"), F.col("window"))).where("size(ring) > 2")
    return w.select("vec_id", F.round(geometry.ring_area(F.col("ring")), 8).alias("area")).where("area > 0")


@query(f"WITH {WINDOWS_SQL}")
def shape_overlay(t: Tables) -> DataFrame:
    w = windows(t)
    shape = lambda c, i: w.select(F.col("vec_id").alias(i), F.array(c).alias("rings"))
    pairs = w.select("vec_id", F.col("vec_id").alias("a"), F.col("vec_id").alias("b"))
    cut = overlay.overlay(pairs, shape("ring", "a"), shape("window", "b"), "vec_id", "a", "b", 0.02, digits=12)
    return cut.groupBy("vec_id").agg(F.round(F.sum("area"), 8).alias("area"))


@query(f"""WITH {SPOTS_SQL}, s AS (SELECT *, 0.01 + (vec_id % 5) / 100.0 AS s FROM p), n AS (SELECT *, unnest(CASE WHEN vec_id % 4 = 1 THEN [1, 2] ELSE [1] END) AS i FROM s)
    SELECT vec_id, round(CASE WHEN vec_id % 4 = 1 THEN s * s / 4 ELSE s * s END, 8) AS area, CASE WHEN vec_id % 4 = 1 THEN 3 ELSE 4 END AS corners FROM n""")
def repaired_rings(t: Tables) -> DataFrame:
    """Squares as they are, as bow ties, drawn twice, and with a spike."""
    x, y, s, k = F.col("x"), F.col("y"), 0.01 + F.col("vec_id") % 5 / 100.0, F.col("vec_id") % 4
    a, b, c, d = corner(x, y), corner(x + s, y), corner(x + s, y + s), corner(x, y + s)
    ring = F.when(k == 0, F.array(a, b, c, d)).when(k == 1, F.array(a, c, b, d)).when(k == 2, F.array(a, b, c, d, a, b, c, d)).otherwise(F.array(a, b, corner(x + 2 * s, y), b, c, d))
    fixed = overlay.repaired(spots(t).select("vec_id", F.array(ring).alias("rings")), "vec_id", 0.02, 12)
    return fixed.select("vec_id", F.round("area", 8).alias("area"), F.size("ring").alias("corners"))


@query("""WITH s AS (SELECT l_suppkey % 25 AS k, l_partkey % 40 AS x, l_orderkey % 50 AS y FROM lineitem WHERE l_quantity > 45 GROUP BY ALL),
    c AS (SELECT DISTINCT k, x + i AS x, y + j AS y FROM s, (SELECT unnest([0, 1, 2]) AS i), (SELECT unnest([0, 1]) AS j))
    SELECT CAST(k AS BIGINT) AS unit_id, CAST(count(*) AS DOUBLE) AS area FROM c GROUP BY 1""")
def united_areas(t: Tables) -> DataFrame:
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    cells = t.lineitem.where("l_quantity > 45").select((F.col("l_suppkey") % 25).alias("unit_id"), (F.col("l_partkey") % 40).alias("x"), (F.col("l_orderkey") % 50).alias("y")).distinct()
    shapes = cells.select("unit_id", F.struct("x", "y").alias("shape"), F.array(F.array(corner(x, y), corner(x + 3, y), corner(x + 3, y + 2), corner(x, y + 2))).alias("rings"))
    return overlay.united(shapes, "unit_id", "shape", 2.0).groupBy("unit_id").agg(F.sum("area").alias("area"))


@query("""WITH w AS (SELECT n_nationkey AS area_id, 'part ' || i AS name, i FROM nation, (SELECT unnest(range(5)) AS i)),
    f AS (SELECT s_nationkey AS area_id, 'part ' || s_suppkey % 4 AS name, min(s_suppkey) AS s FROM supplier GROUP BY ALL),
    b AS (SELECT area_id, name, greatest(0, least(10, s % 13 + 4.0) - greatest(0, s % 13)) * greatest(0, least(10, s % 7 + 6.0) - greatest(0, s % 7)) AS area FROM w JOIN f USING (area_id, name)),
    m AS (SELECT area_id, string_agg(name, ',' ORDER BY name) AS missing FROM w WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.area_id = w.area_id AND f.name = w.name) GROUP BY 1)
    SELECT CAST(area_id AS INTEGER) AS area_id, name, CAST(0 AS INTEGER) AS part, area, '' AS missing FROM b WHERE area > 0 UNION ALL SELECT CAST(area_id AS INTEGER), '', CAST(-1 AS INTEGER), 0.0, missing FROM m""")
def envelope_parts(t: Tables) -> DataFrame:
    """Features of areas cut to them, and the names without a feature."""
    areas = t.nation.select(F.col("n_nationkey").alias("area_id"), F.array(F.array(*(corner(F.lit(float(x)), F.lit(float(y))) for x, y in ((0, 0), (10, 0), (10, 10), (0, 10))))).alias("rings"))
    wanted = t.nation.select(F.col("n_nationkey").alias("area_id"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i")).select("area_id", F.concat(F.lit("part "), F.col("i")).alias("name"))
    s = t.supplier.groupBy(F.col("s_nationkey").alias("area_id"), F.concat(F.lit("part "), F.col("s_suppkey") % 4).alias("name")).agg(F.min("s_suppkey").alias("s"))
    x, y = (F.col("s") % 13).cast("double"), (F.col("s") % 7).cast("double")
    features = s.select("area_id", "name", F.array(F.array(corner(x, y), corner(x + 4, y), corner(x + 4, y + 6), corner(x, y + 6))).alias("rings"))
    parts, missing = overlay.envelope(wanted, features, areas, "area_id", "name", 2.0)
    rows = parts.select("area_id", "name", "part", F.round("size", 6).alias("area"), F.lit("").alias("missing"))
    return rows.unionByName(missing.select("area_id", F.lit("").alias("name"), F.lit(-1).alias("part"), F.lit(0.0).alias("area"), F.array_join("missing", ",").alias("missing")))


@query("""WITH u AS (SELECT s_suppkey AS unit_id, CASE WHEN s_suppkey % 4 * 0.4 > 0.5 THEN s_suppkey % 4 * 0.4 ELSE 0 END AS l, CASE WHEN (s_suppkey + 1) % 4 * 0.4 > 0.5 THEN (s_suppkey + 1) % 4 * 0.4 ELSE 0 END AS r FROM supplier)
    SELECT unit_id, round(CAST(100 + (r - l) * 5 AS DOUBLE), 6) AS area, CAST(4 + CASE WHEN l > 0 THEN 1 ELSE 0 END + CASE WHEN r > 0 THEN 1 ELSE 0 END AS INTEGER) AS corners FROM u""")
def simplified_borders(t: Tables) -> DataFrame:
    """Neighbouring units whose common borders have a bend, some of them within the tolerance."""
    k = F.col("s_suppkey")
    bend = lambda i: i % 4 * 0.4
    at = lambda x, y: corner(x.cast("double"), F.lit(float(y)))
    ring = F.array(at(k * 10, 0), at(k * 10 + 10, 0), at(k * 10 + 10 + bend(k + 1), 5), at(k * 10 + 10, 10), at(k * 10, 10), at(k * 10 + bend(k), 5))
    simple = simplify.simplified(t.supplier.select(k.alias("unit_id"), F.array(ring).alias("rings")), "unit_id", 0.5, 5.0)
    return simple.select("unit_id", F.round("area", 6).alias("area"), F.size("ring").alias("corners"))


@query(f"""WITH s AS (SELECT c_custkey AS id, c_custkey % 9 AS f, CAST(c_custkey AS DOUBLE) AS k FROM customer WHERE c_custkey % 9 < 8),
    n AS (SELECT id, [1, 2, 2, 2, 4, 8, 4, 5][f + 1] AS n, [k, k, k, k, 2 * k - 2, 4 * k - 4, 2 * k - 2, 3 * k - 2][f + 1] AS x, [k + 1, k + 1, k + 1, k + 1, 2 * k + 1, 4 * k + 2, 2 * k + 1, 3 * k + 2][f + 1] AS y FROM s)
    SELECT id, CAST(n AS INTEGER) AS points, round((x + n * 120) * {PLANE} * cos(radians(44)) / 1e6, 6) AS east, round((y - n * 44) * {PLANE} / 1e6, 6) AS north FROM n""")
def moved_shapes(t: Tables) -> DataFrame:
    """Shapes of all types in metres from an origin."""
    moved = geometry.reprojected(shape_text(F.col("c_custkey")), lambda x, y: geometry.projected(x, y, F.lit(-120.0), F.lit(44.0)))
    texts = materialise(dealt(t.customer.select("c_custkey")).select(F.col("c_custkey").alias("id"), moved.alias("moved")))
    p = dealt(texts).select("id", geometry.geojson_points(F.col("moved")).alias("p")).where("p is not null")
    total = lambda c: F.round(F.aggregate("p", F.lit(0.0), lambda a, v: a + v[c]) / 1e6, 6)
    return p.select("id", F.size("p").alias("points"), total("x").alias("east"), total("y").alias("north"))


# Lines

@query(f"""WITH {SPOTS_SQL}, l AS (SELECT label, x AS ax, y AS ay, lead(x) OVER w AS bx, lead(y) OVER w AS cy FROM p WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
    d AS (SELECT p.vec_id AS point_id, l.label AS line_id, greatest(0, least(1, ((x - ax) * (bx - ax) + (y - ay) * (cy - ay)) / nullif((bx - ax) ** 2 + (cy - ay) ** 2, 0))) AS t, x, y, ax, ay, bx, cy FROM p JOIN l ON bx IS NOT NULL AND p.label <> l.label)
    SELECT point_id, line_id FROM d GROUP BY 1, 2 HAVING min(sqrt((x - ax - t * (bx - ax)) ** 2 + (y - ay - t * (cy - ay)) ** 2)) <= 0.002""")
def line_buffer(t: Tables) -> DataFrame:
    """Spots within a line's corridor, of other labels than the line's."""
    line = spots(t).groupBy(F.col("label").alias("line_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", corner(F.col("x"), F.col("y")).alias("p")))), lambda s: s["p"]).alias("line"))
    found = lines.near_lines(spots(t).withColumnRenamed("vec_id", "point_id"), line, "point_id", "line_id", 0.002)
    return found.join(spots(t).select(F.col("vec_id").alias("point_id"), "label"), "point_id").where("label <> line_id").select("point_id", "line_id")


@query("""WITH o AS (SELECT o_custkey AS k, o_orderkey AS x, round(o_totalprice) AS y, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
    e AS (SELECT k, arg_min(x, i) < arg_max(x, i) AS ahead FROM o GROUP BY 1)
    SELECT k AS track_id, CAST(CASE WHEN ahead THEN i - 1 ELSE n - i END AS BIGINT) AS place, CAST(x AS DOUBLE) AS x, y FROM o JOIN e USING (k) WHERE n > 1""")
def stitched_tracks(t: Tables) -> DataFrame:
    """Segments between an account's orders in time, every other one turned, strung to its track."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = t.orders.select("o_custkey", "o_orderdate", "o_orderkey", F.col("o_orderkey").cast("double").alias("x"), F.round("o_totalprice").alias("y"))
    s = o.withColumns({"bx": F.lead("x").over(w), "by": F.lead("y").over(w), "odd": F.col("o_orderkey") % 2 == 1}).where("bx is not null")
    pick = lambda a, b: F.when(F.col("odd"), F.col(a)).otherwise(F.col(b))
    loose = s.select(F.col("o_custkey").alias("track_id"), pick("x", "bx").alias("ax"), pick("y", "by").alias("ay"), pick("bx", "x").alias("bx"), pick("by", "y").alias("by"))
    return lines.stitched(loose, "track_id").drop("line")
