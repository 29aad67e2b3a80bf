"""Driver's queries of records, feeds, lenient values, seasons, imports, lists, shapes, lines and streams, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderline.functions import geometry, labels, text
from cinderline.operators import history, joins, merge, spatial, stats
from cinderline.plans.catalogue import STATUS, STATUS_SQL, Tables, bands, of_type, query
from cinderline.plans.views import pick, picked
from cinderline.sources import documents, records, sinks
from cinderline.sources.tables import dealt
from cinderline.streaming import live

BODIES = ('{"features":[{"a":1}],"exceededTransferLimit":false}', '{"error":{"code":500}}', '{"data":[]}', '{"features":[', '{"features":[],"exceededTransferLimit":true}', None, '{"features":"none"}')


@query("""SELECT c_custkey AS id, 'Customer ' || c_custkey AS name, CASE c_mktsegment WHEN 'BUILDING' THEN 'cabin' WHEN 'HOUSEHOLD' THEN 'camp' ELSE 'other' END AS kind,
    CASE WHEN c_custkey % 3 = 0 THEN 'none' ELSE 'given' END AS state, CASE WHEN c_custkey % 5 <> 0 THEN round(c_acctbal, 2) END AS balance FROM customer""")
def mapped_records(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    raw = t.customer.select(k.cast("string").alias("Id"), F.when(k % 2 == 0, F.concat(F.lit("Customer "), k.cast("string"))).otherwise(F.lit("  ")).alias("NAME"), F.concat(F.lit("Customer "), k.cast("string")).alias("LABEL"), F.col("c_mktsegment").alias("CLASS"), F.when(k % 3 == 0, "").otherwise("given").alias("STATE"), F.when(k % 5 == 0, "n/a").otherwise(F.format_string(" %.2f ", "c_acctbal")).alias("BALANCE"))
    return records.mapped(raw, {
        "id": {"columns": ["Id"], "type": "long"}, "name": {"columns": ["TITLE", "NAME", "LABEL"]}, "kind": {"columns": ["CLASS"], "values": {"BUILDING": "cabin", "HOUSEHOLD": "camp"}, "other": "other"},
        "state": {"columns": ["STATE"], "default": "none"}, "balance": {"columns": ["BALANCE"], "type": "double"},
    })


@query(f"""WITH b AS (SELECT event_id, {picked('event_id', *BODIES)} AS body FROM events), v AS (SELECT *, CASE WHEN json_valid(body) THEN body END AS j FROM b)
    SELECT event_id, CASE WHEN j IS NULL THEN 'not JSON' WHEN json_extract(j, '$.error') IS NOT NULL THEN 'error object' WHEN json_type(j, '$.features') IS DISTINCT FROM 'ARRAY' THEN 'no features'
    WHEN coalesce(CAST(json_extract(j, '$.exceededTransferLimit') AS BOOLEAN), false) THEN 'cut short' END AS problem FROM v""")
def feed_problems(t: Tables) -> DataFrame:
    return t.events.select("event_id", documents.feed_problem(pick(F.col("event_id"), *BODIES)).alias("problem"))


@query("""SELECT p_size AS source, CASE WHEN p_size % 10 = 0 THEN '' ELSE coalesce(string_agg(p_type || ': ' || p_name || ': ' || p_brand, chr(10) ORDER BY p_partkey) FILTER (regexp_matches(p_name || ' ' || p_brand || ' ' || p_type, '(?i)economy|ring')), '') END AS extracted_text,
    CASE WHEN p_size % 10 = 0 THEN 0 ELSE CAST(count(*) AS INTEGER) END AS alerts, CASE WHEN p_size % 10 = 0 THEN 0 ELSE CAST(count(*) FILTER (regexp_matches(p_name || ' ' || p_brand || ' ' || p_type, '(?i)economy|ring')) AS INTEGER) END AS matching,
    CASE WHEN p_size % 10 <> 0 THEN max(CAST(DATE '2024-01-01' + CAST(p_partkey % 300 AS INTEGER) AS VARCHAR)) END AS modified, p_size % 10 = 0 AS needs_review FROM part GROUP BY p_size""")
def alert_lines(t: Tables) -> DataFrame:
    at = F.concat(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("p_partkey") % 300).cast("int")).cast("string"), F.lit(" 08:00:00.0"))
    alert = F.struct("p_partkey", F.col("p_name").alias("title"), F.col("p_brand").alias("description"), F.col("p_type").alias("category"), F.lit("x").alias("url"), at.alias("lastIndexedDate"))
    body = F.to_json(F.struct(F.array_sort(F.collect_list(alert)).alias("data")))
    bodies = t.part.groupBy(F.col("p_size").alias("source")).agg(body.alias("body")).withColumn("body", F.when(F.col("source") % 10 == 0, F.expr("substr(body, 1, length(body) - 2)")).otherwise(F.col("body")))
    return documents.parse_alerts(bodies, "body", "economy|ring").drop("body")


@query("""SELECT s_suppkey AS feed, i AS n, 'ca-unit' || s_suppkey || ' Ridge & <' || i || '> Fire' AS title, 'https://feed.example/' || s_suppkey || '/' || i AS link, 'it''s "new"' AS description,
    'CA-UNIT' || s_suppkey AS unit, 'ridge & <' || i || '>' AS name FROM supplier, (SELECT unnest([0, 1]) AS i) WHERE s_suppkey % 4 <> 3""")
def rss_items(t: Tables) -> DataFrame:
    k = F.col("s_suppkey").cast("string")
    item = lambda n, cdata: F.concat(F.lit(f"<item>\n<title>{'<![CDATA[' if cdata else ''}ca-unit"), k, F.lit(f" Ridge &amp; &lt;{n}&gt; Fire{']]>' if cdata else ''}</title><link>http://feed.example/"), k, F.lit(f"/{n}</link><description>it&#39;s &quot;new&quot;</description></item>"))
    body = F.when(k.cast("long") % 4 == 3, F.lit("<rss></rss>")).otherwise(F.concat(F.lit("<rss><channel><title>all</title>"), item(0, False), item(1, True), F.lit("</channel></rss>")))
    return documents.parse_rss(t.supplier.select(F.col("s_suppkey").alias("feed"), body.alias("body")), "body", "feed")


@query("""SELECT event_id, CASE WHEN event_id % 7 = 0 THEN '{}' ELSE props END AS answer FROM events""")
def json_answers(t: Tables) -> DataFrame:
    said = F.when(F.col("event_id") % 7 == 0, F.lit("no } object {")).otherwise(F.concat(F.lit("Here it is:\n"), F.col("props"), F.lit("\ndone")))
    return t.events.select("event_id", text.json_in_text(said).alias("answer"))


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderdate AS d, o_totalprice AS p FROM orders)
    SELECT k AS order_id, CASE WHEN k % 6 < 4 THEN strftime(d, '%Y-%m-%d') END AS day, CASE WHEN k % 4 = 0 THEN round(p, 2) WHEN k % 4 = 1 THEN 1000.0 END AS number,
    CASE WHEN k % 3 <> 0 AND k % 5 <> 0 THEN printf('%02d-%02d', month(d), day(d)) END AS season, CASE k % 2 WHEN 0 THEN 'Developed Sites Only' ELSE 'Stage 1' END AS label FROM o""")
def lenient_values(t: Tables) -> DataFrame:
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    formats = ("yyyy-MM-dd", "MM/dd/yyyy", "MMMM d, yyyy", "MMM d, yyyy")
    written = F.when(k % 6 == 4, "soon").when(k % 6 == 5, "")
    for i, f in enumerate(formats):
        written = written.when(k % 6 == i, F.date_format(d, f))
    number = F.when(k % 4 == 0, F.format_string(" %.2f", "o_totalprice")).when(k % 4 == 1, "1e3").when(k % 4 == 2, "about 5").otherwise("")
    return t.orders.select(k.alias("order_id"), text.lenient_date(written, formats).cast("string").alias("day"), text.lenient_number(number).alias("number"), text.month_day_label(F.when(k % 3 != 0, F.month(d)), F.when(k % 5 != 0, F.dayofmonth(d))).alias("season"), text.labelize(pick(k, "developed_sites_only", "stage_1")).alias("label"))


@query("""WITH b AS (SELECT CAST(least(floor(p_size * 300 / 2000) * 2000, 12000) AS INTEGER) AS low FROM part)
    SELECT low, CASE WHEN low >= 12000 THEN '12,000+ ft' ELSE format('{:,}', low) || '-' || format('{:,}', low + 2000) || ' ft' END AS label, count(*) AS n FROM b GROUP BY low""")
def band_labels(t: Tables) -> DataFrame:
    low = F.least(F.floor(F.col("p_size") * 300 / 2000) * 2000, F.lit(12000)).cast("int")
    return t.part.groupBy(low.alias("low")).agg(F.count("*").alias("n")).withColumn("label", labels.band_label(F.col("low"), 2000, 12000))


DURATIONS = ("permanent", "seasonal", "temporary", None)


@query(f"""WITH r AS (SELECT o_orderkey AS k, {picked('o_orderkey', *DURATIONS)} AS duration, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderdate AS DATE) END AS a, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderdate AS DATE) + 400 END AS b,
    CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 12 + 1 END AS m1, o_orderkey % 28 + 1 AS d1, o_orderkey % 11 + 1 AS m2, CASE WHEN o_orderkey % 13 = 0 THEN 31 ELSE o_orderkey % 29 + 1 END AS d2 FROM orders),
    s AS (SELECT *, try_cast(format('2000-{{:02d}}-{{:02d}}', m1, d1) AS DATE) IS NOT NULL AND try_cast(format('2000-{{:02d}}-{{:02d}}', m2, d2) AS DATE) IS NOT NULL AS real, m1 * 100 + d1 AS x, m2 * 100 + d2 AS y FROM r)
    SELECT k AS rule_id, CASE WHEN duration = 'permanent' THEN true WHEN duration = 'seasonal' AND m1 IS NOT NULL THEN real AND CASE WHEN x <= y THEN 715 BETWEEN x AND y ELSE 715 >= x OR 715 <= y END
    ELSE (a IS NULL OR DATE '2000-07-15' >= a) AND (b IS NULL OR DATE '2000-07-15' <= b) END AS active, CASE WHEN duration = 'permanent' THEN 'permanent' ELSE 'current' END AS part FROM s""")
def active_rules(t: Tables) -> DataFrame:
    k, d = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    duration = pick(k, *DURATIONS)
    season = (F.when(k % 7 != 0, k % 12 + 1), k % 28 + 1, k % 11 + 1, F.when(k % 13 == 0, 31).otherwise(k % 29 + 1))
    active = labels.rule_active(duration, F.when(k % 3 != 0, d), F.when(k % 5 != 0, F.date_add(d, 400)), season, labels.as_day("2000-07-15"))
    return t.orders.select(k.alias("rule_id"), active.alias("active"), F.when(duration == "permanent", "permanent").otherwise("current").alias("part"))


@query("""WITH b AS (SELECT CAST(month(l_shipdate) AS INTEGER) AS month, CAST(floor(p_size / 10) * 10 AS INTEGER) AS band, count(l_extendedprice) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL),
    s AS (SELECT *, n * 100.0 / sum(n) OVER (PARTITION BY month) AS share FROM b)
    SELECT month, string_agg(band || ':' || n, ', ' ORDER BY band) AS bands FROM s WHERE n >= 20 AND share >= 10 GROUP BY month""")
def low_context(t: Tables) -> DataFrame:
    shown = stats.ordered_structs(stats.displayable(bands(t), 20, 10), "month", "band", "n")
    return shown.select("month", F.array_join(F.transform("entries", lambda e: F.concat_ws(":", e["band"], e["n"])), ", ").alias("bands"))


@query("""WITH l AS (SELECT c_mktsegment AS phrase, list_sort(list(DISTINCT n_name)) AS l FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 50 < CASE c_mktsegment WHEN 'BUILDING' THEN 1 ELSE 50 END GROUP BY 1)
    SELECT phrase, CASE WHEN len(l) > 1 THEN array_to_string(l[1:len(l) - 1], ', ') || ' and ' || l[len(l)] ELSE l[1] END AS labels FROM l""")
def stove_clauses(t: Tables) -> DataFrame:
    rows = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).where(F.col("c_custkey") % 50 < F.when(F.col("c_mktsegment") == "BUILDING", 1).otherwise(50))
    return stats.joined_labels(rows, "c_mktsegment", "n_name").withColumnRenamed("c_mktsegment", "phrase")


@query("""WITH f AS (SELECT conv_id, role, min(turn) AS first FROM conversations WHERE role <> '' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY first) AS n FROM f)
    SELECT conv_id, string_agg(role, '>' ORDER BY n) AS roles FROM r WHERE n <= 2 GROUP BY conv_id""")
def first_roles(t: Tables) -> DataFrame:
    by = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("l"))
    return by.select("conv_id", F.array_join(stats.first_distinct(F.transform("l", lambda s: s["role"]), 2), ">").alias("roles"))


@query("""SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN 'live' ELSE 'other' END AS origin FROM events WHERE event_id % 3 <> 1
    UNION ALL SELECT event_id, user_id, 'backfill' FROM events WHERE event_type = 'error'""")
def rebuilt_history(t: Tables) -> DataFrame:
    old = t.events.select("event_id", "user_id", pick(F.col("event_id"), "live", "backfill", "other").alias("origin"))
    rebuilt = t.events.where("event_type = 'error'").select("event_id", "user_id")
    once = history.replaced_history(old, rebuilt, "origin", "backfill")
    return history.replaced_history(once, rebuilt, "origin", "backfill")  # running it again changes nothing


@query("""SELECT c_custkey, c_custkey % 3 <> 0 AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS active FROM customer""")
def deactivate_missing(t: Tables) -> DataFrame:
    state = t.customer.select("c_custkey", (F.col("c_custkey") % 3 != 0).alias("active"))
    return merge.deactivate_missing(state, t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("""SELECT 'empty' AS run, s_suppkey AS id, s_name AS name, s_suppkey % 2 = 0 AS active FROM supplier WHERE s_suppkey % 3 <> 0
    UNION ALL SELECT 'whole', s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN CASE WHEN s_suppkey % 3 <> 0 THEN s_name END WHEN s_suppkey % 4 <> 0 THEN 'new' ELSE s_name END, s_suppkey % 4 <> 0 FROM supplier WHERE s_suppkey % 3 <> 0 OR s_suppkey % 4 <> 0""")
def guarded_merge(t: Tables) -> DataFrame:
    k, at = F.col("s_suppkey"), F.lit("2024-01-01").cast("timestamp")
    state = t.supplier.where(k % 3 != 0).select(k.alias("id"), F.col("s_name").alias("name"), (k % 2 == 0).alias("active"), at.alias("first_seen"), at.alias("last_seen"))
    snapshot = t.supplier.where(k % 4 != 0).select(k.alias("id"), F.when(k % 5 != 0, "new").alias("name"))
    run = lambda name, df: merge.guarded_merge(state, df, "id", [["name"]], at).select(F.lit(name).alias("run"), "id", "name", "active")
    return run("empty", snapshot.where("id < 0")).unionByName(run("whole", snapshot))


@query("""WITH s AS (SELECT CASE WHEN c_nationkey <> 3 THEN c_nationkey END AS unit_id, c_mktsegment AS band, count(*) AS n FROM customer WHERE c_custkey % 2 = 0 GROUP BY ALL),
    i AS (SELECT CASE WHEN c_nationkey <> 3 THEN c_nationkey END AS unit_id, c_mktsegment AS band, 1000 + count(*) AS n FROM customer WHERE c_nationkey < 10 GROUP BY ALL)
    SELECT coalesce(unit_id, -1) AS unit_id, band, n FROM i UNION ALL SELECT coalesce(unit_id, -1), band, n FROM s WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.unit_id IS NOT DISTINCT FROM s.unit_id AND i.band = s.band)""")
def keyed_upsert(t: Tables) -> DataFrame:
    by = lambda df, more: df.groupBy(F.when(F.col("c_nationkey") != 3, F.col("c_nationkey")).alias("unit_id"), F.col("c_mktsegment").alias("band")).agg((F.count("*") + more).alias("n"))
    return merge.keyed_upsert(by(t.customer.where("c_custkey % 2 = 0"), 0), by(t.customer.where("c_nationkey < 10"), 1000), ["unit_id", "band"], ["n"]).fillna(-1, ["unit_id"])


@query("""SELECT o_custkey AS unit_id, 'match' AS kind, min(o_orderkey) AS id FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey
    UNION ALL SELECT c_custkey, NULL, -1 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""")
def prefer_existing(t: Tables) -> DataFrame:
    matches = t.orders.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("unit_id")).agg(F.min("o_orderkey").alias("id")).select("unit_id", F.lit("match").alias("kind"), "id")
    return joins.prefer_existing(matches, t.customer.select(F.col("c_custkey").alias("unit_id")), "unit_id").fillna(-1, ["id"])


@query("""WITH p AS (SELECT p_partkey, string_split(p_name || ' ' || p_name || ' old', ' ') AS l, string_split(lower(p_type) || ' ring old', ' ') AS r FROM part)
    SELECT p_partkey, array_to_string(list_filter(l, lambda x: NOT list_contains(r, x)), ' ') AS rest FROM p""")
def token_difference(t: Tables) -> DataFrame:
    left, right = F.split(F.concat_ws(" ", "p_name", "p_name", F.lit("old")), " "), F.split(F.concat(F.lower("p_type"), F.lit(" ring old")), " ")
    return t.part.select("p_partkey", F.array_join(joins.without_tokens(left, right), " ").alias("rest"))


@query("""SELECT s_suppkey AS place_id, 'supplier ' || printf('%09d', s_suppkey) AS normalized_name, s_name AS name, 'primary' AS kind, 100 AS weight FROM supplier
    UNION ALL SELECT s_suppkey, 'alder ' || s_suppkey, 'Alder ' || s_suppkey, 'alias', 60 FROM supplier WHERE s_suppkey % 2 = 0
    UNION ALL SELECT s_suppkey, 'old alder', CASE WHEN s_suppkey % 4 = 0 THEN 'Old-Alder' ELSE 'OLD alder' END, 'alias', 60 FROM supplier WHERE s_suppkey % 2 = 0""")
def place_aliases(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    aliases = F.when(k % 2 == 0, F.concat(F.lit("Alder "), k.cast("string"), F.lit("; ;"), F.when(k % 4 == 0, "Old-Alder").otherwise("OLD alder"), F.lit(";"), F.col("s_name")))
    return records.place_names(t.supplier.select(k.alias("place_id"), "s_name", aliases.alias("also")), "place_id", "s_name", "also")


@query("""SELECT c_custkey AS place_id, CASE WHEN c_custkey % 4 = 0 THEN 'areas' ELSE 'camps' END AS dataset, c_name AS name, 0.0 AS x, CASE WHEN c_custkey % 4 = 0 THEN false ELSE c_custkey % 3 <> 0 END AS active FROM customer
    WHERE NOT (c_custkey % 4 = 0 AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'))
    UNION ALL SELECT o_custkey, 'areas', 'Area ' || o_custkey, min(o_custkey % 90) + 1.0, true FROM orders WHERE o_orderstatus = 'P' AND o_custkey % 2 = 0 GROUP BY o_custkey""")
def seeded_places(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    state = t.customer.select(k.alias("place_id"), F.when(k % 4 == 0, "areas").otherwise("camps").alias("dataset"), F.col("c_name").alias("name"), F.lit(0.0).alias("x"), (k % 3 != 0).alias("active"))
    x = (F.col("place_id") % 90).cast("double")
    ring = F.array(*(F.struct((x + dx).alias("x"), F.lit(dy).alias("y")) for dx, dy in ((0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0))))
    rules = t.orders.where("o_orderstatus = 'P' AND o_custkey % 2 = 0").select(F.col("o_custkey").alias("place_id")).distinct()
    seeded = rules.select("place_id", F.concat(F.lit("Area "), F.col("place_id").cast("string")).alias("name"), geometry.ring_centroid(ring)["x"].alias("x"))
    return merge.reseeded(state, seeded, "place_id", "dataset", "areas")


def shape_text(k: Column) -> Column:
    """GeoJSON of nine forms about the point (k, k + 1)."""
    x, y = k.cast("string"), (k + 1).cast("string")
    p = F.concat(F.lit("["), x, F.lit(","), y, F.lit("]"))
    ring = F.concat(F.lit("["), p, F.lit(",[-1,-1],[-1,0],"), p, F.lit("]"))
    shape = lambda kind, *inner: F.concat(F.lit(f'{{"type":"{kind}","coordinates":'), *inner, F.lit("}"))
    polygon = shape("Polygon", F.lit("["), ring, F.lit("]"))
    forms = [
        shape("Point", p), shape("MultiPoint", F.lit("["), p, F.lit(",[0,0]]")), shape("LineString", F.lit("["), p, F.lit(",[0,0]]")), shape("MultiLineString", F.lit("[["), p, F.lit(",[0,0]]]")), polygon,
        shape("MultiPolygon", F.lit("[["), ring, F.lit("],["), ring, F.lit("]]")), F.concat(F.lit('{"type":"Feature","geometry":'), polygon, F.lit("}")),
        F.concat(F.lit('{"type":"GeometryCollection","geometries":['), shape("Point", p), F.lit(","), polygon, F.lit("]}")), F.lit('{"type":"Circle","coordinates":[0,0]}'),
    ]
    out = F.when(k % 9 == 0, forms[0])
    for i, f in enumerate(forms[1:], 1):
        out = out.when(k % 9 == i, f)
    return out


@query("""SELECT c_custkey AS id, CAST([1, 2, 2, 2, 4, 8, 4, 5, -1][c_custkey % 9 + 1] AS INTEGER) AS points, CAST([-1, -1, -1, -1, 1, 2, 1, 1, -1][c_custkey % 9 + 1] AS INTEGER) AS polygons,
    CASE WHEN c_custkey % 9 < 8 THEN CAST(c_custkey AS DOUBLE) END AS max_x, CASE c_custkey % 9 WHEN 0 THEN CAST(c_custkey AS DOUBLE) WHEN 8 THEN NULL WHEN 1 THEN 0.0 WHEN 2 THEN 0.0 WHEN 3 THEN 0.0 ELSE -1.0 END AS min_x, CASE WHEN c_custkey % 9 BETWEEN 4 AND 7 THEN (c_custkey + 1) / 2.0 END AS area FROM customer""")
def geometry_kinds(t: Tables) -> DataFrame:
    shapes = t.customer.select(F.col("c_custkey").alias("id"), shape_text(F.col("c_custkey")).alias("shape"))
    read = shapes.select("id", geometry.geojson_points(F.col("shape")).alias("p"), geometry.geojson_polygons(F.col("shape")).alias("g")).withColumn("box", geometry.bounds(F.col("p")))
    return read.select("id", F.coalesce(F.size("p"), F.lit(-1)).alias("points"), F.coalesce(F.size("g"), F.lit(-1)).alias("polygons"), "box.max_x", "box.min_x", F.abs(geometry.ring_area(F.col("g")[0][0])).alias("area"))


@query("""SELECT c_nationkey AS unit_id, CAST(sum(CASE c_custkey % 9 WHEN 5 THEN 2 ELSE 1 END) AS INTEGER) AS polygons, CAST(min(c_custkey) AS DOUBLE) AS first_x FROM customer WHERE c_custkey % 9 BETWEEN 4 AND 7 GROUP BY 1""")
def combined_polygons(t: Tables) -> DataFrame:
    f = dealt(t.customer.select("c_nationkey", "c_custkey")).select("c_nationkey", "c_custkey", geometry.geojson_polygons(shape_text(F.col("c_custkey"))).alias("polygons"))
    merged = spatial.combined_polygons(f, "c_nationkey", "polygons", "c_custkey")
    seen = geometry.bound(F.col("polygons"), lambda p: F.struct(F.size(p).alias("polygons"), p[0][0][0]["x"].alias("first_x")))
    return merged.select(F.col("c_nationkey").alias("unit_id"), seen.alias("s")).select("unit_id", "s.polygons", "s.first_x")


@query("""SELECT p_partkey, 12 AS corners, round(6 * p_size * p_size * sin(pi() / 6), 6) AS area, round(p_retailprice + p_size, 6) AS max_x FROM part""")
def point_buffers(t: Tables) -> DataFrame:
    ring = geometry.circle(F.col("p_retailprice"), F.lit(0.0), F.col("p_size"), 12)
    return t.part.select("p_partkey", F.size(ring).alias("corners"), F.round(geometry.ring_area(ring), 6).alias("area"), F.round(geometry.bounds(ring)["max_x"], 6).alias("max_x"))


@query("""WITH s AS (SELECT o_custkey, o_orderkey, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0.0) AS step FROM (SELECT *, 3.0 * (o_orderkey % 97) AS x, 4.0 * (o_orderkey % 97) AS y FROM orders) WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
    d AS (SELECT o_orderkey, o_orderdate FROM orders) SELECT o_orderkey, round(step, 4) AS step, round(sum(step) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 4) AS "offset" FROM s JOIN d USING (o_orderkey)""")
def track_offsets(t: Tables) -> DataFrame:
    p = t.orders.select("o_custkey", "o_orderdate", "o_orderkey", (F.col("o_orderkey") % 97 * 3.0).alias("x"), (F.col("o_orderkey") % 97 * 4.0).alias("y"))
    return spatial.track_offsets(p, "o_custkey", ["o_orderdate", "o_orderkey"], "x", "y").select("o_orderkey", F.round("step", 4).alias("step"), F.round("offset", 4).alias("offset"))


LINE = ((0.0, 0.0), (30.0, 0.0), (30.0, 40.0), (30.0, 40.0), (60.0, 80.0))
_PARTS = [(ax, ay, bx - ax, by - ay, ((bx - ax) ** 2 + (by - ay) ** 2) ** 0.5) for (ax, ay), (bx, by) in zip(LINE, LINE[1:], strict=False)]
LINE_SQL = " UNION ALL ".join(
    f"SELECT {i} AS i, k, x, y, {sum(p[4] for p in _PARTS[:i])} AS passed, {length} AS len, {ax} AS ax, {ay} AS ay, {dx} AS dx, {dy} AS dy, {f'greatest(0.0, least(1.0, ((x - {ax}) * {dx} + (y - {ay}) * {dy}) / {length * length}))' if length else '0.0'} AS s FROM p"
    for i, (ax, ay, dx, dy, length) in enumerate(_PARTS)
)


@query(f"""WITH p AS (SELECT p_partkey AS k, p_size * 1.5 AS x, p_retailprice - 900 AS y FROM part), e AS ({LINE_SQL}), d AS (SELECT *, sqrt(pow(x - ax - s * dx, 2) + pow(y - ay - s * dy, 2)) AS away FROM e)
    SELECT k AS part_id, round(away, 4) AS distance, round(passed + s * len, 4) AS "offset" FROM d QUALIFY row_number() OVER (PARTITION BY k ORDER BY away, i) = 1""")
def nearest_on_line(t: Tables) -> DataFrame:
    near = geometry.nearest_on_line(geometry.ring_of(list(LINE)), F.col("p_size") * 1.5, F.col("p_retailprice") - 900)
    return t.part.select(F.col("p_partkey").alias("part_id"), near.alias("n")).select("part_id", F.round("n.distance", 4).alias("distance"), F.round("n.offset", 4).alias("offset"))


@query("""SELECT '{"type":"Feature","geometry":' || CASE WHEN c_custkey % 3 = 0 THEN 'null' ELSE '{"type":"Point","coordinates":[' || c_custkey || ',' || c_nationkey || ']}' END || ',"properties":{"name":"' || c_name || '","kind":' || CASE WHEN c_custkey % 2 = 0 THEN '"camp"' ELSE 'null' END || '}}' AS value FROM customer""")
def feature_export(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    point = F.when(k % 3 != 0, F.struct(F.lit("Point").alias("type"), F.array(k, F.col("c_nationkey").cast("long")).alias("coordinates")))
    return sinks.feature_lines(t.customer.select(point.alias("g"), F.col("c_name").alias("name"), F.when(k % 2 == 0, "camp").alias("kind")), "g", "name", "kind")


@query("""WITH n AS (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 150)
    SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey DESC) AS entries FROM n GROUP BY 1""")
def newest_entries(t: Tables) -> DataFrame:
    rows = history.newest(t.orders.select("o_orderdate", "o_orderkey"), 150, "o_orderdate", "o_orderkey").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return stats.ordered_structs(rows, "day", "o_orderkey").select("day", F.array_join(F.transform(F.reverse("entries"), lambda e: e["o_orderkey"].cast("string")), ",").alias("entries"))


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def review_queue(t: Tables) -> DataFrame:
    return history.where_given(t.orders, o_orderstatus="F", o_custkey=None, o_orderpriority="1-URGENT").select("o_orderkey", "o_orderpriority")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS place FROM orders WHERE o_orderstatus <> 'P' ORDER BY o_orderkey LIMIT 500 OFFSET 500")
def page_rows(t: Tables) -> DataFrame:
    return stats.page_rows(t.orders.where("o_orderstatus <> 'P'").select("o_orderkey", "o_orderpriority"), "o_orderkey", 500, 2).select("o_orderkey", "place")


@query("SELECT l_orderkey AS order_id, l_linenumber AS line, CASE WHEN l_orderkey % 4 <> 0 THEN l_quantity END AS quantity, CAST(l_shipdate AS DATE)::VARCHAR AS day FROM lineitem")
def normals_import(t: Tables) -> DataFrame:
    raw = t.lineitem.select(F.col("l_orderkey").cast("string").alias("order_id"), F.format_string(" %d", "l_linenumber").alias("line"), F.when(F.col("l_orderkey") % 4 != 0, F.col("l_quantity").cast("string")).otherwise("").alias("quantity"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"))
    typed = records.typed_import(raw, {"order_id": "long", "line": "int", "quantity": "double", "day": "date"}, t.orders.select(F.col("o_orderkey").alias("order_id")), "order_id")
    return typed.withColumn("day", F.col("day").cast("string"))


def stream_of(t: Tables, name: str) -> DataFrame:
    """A table as a stream. The source takes a single file only by a pattern."""
    return t.spark.readStream.schema(getattr(t, name).schema).parquet(f"{t.sf_dir}/{name}.parque[t]")


@query(f"""WITH l AS (SELECT user_id, ts, event_id, {STATUS_SQL} AS s, lag({STATUS_SQL}) OVER w AS b, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, b AS before, s AS after FROM l WHERE n = 1 OR s <> b""")
def stream_changes(t: Tables) -> DataFrame:
    stream = stream_of(t, "events").withColumn("status", of_type(STATUS))
    return live.drained(live.status_changes(stream, "user_id", "ts", "event_id", "status")).withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss"))


@query("SELECT DISTINCT sha256(text) AS content_hash FROM documents WHERE text IS NOT NULL")
def stream_documents(t: Tables) -> DataFrame:
    stream = stream_of(t, "documents").where("text is not null").select(F.sha2("text", 256).alias("content_hash"), F.lit("2024-01-01").cast("timestamp").alias("at"))
    return live.drained(live.distinct_documents(stream, "content_hash", "at")).select("content_hash")
