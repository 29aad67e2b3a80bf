"""More of the driver's queries: localized rules, suggestions, conditional fetches, closing rows, small expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderline.functions import labels, text
from cinderline.operators import answers, history, joins, localized, search, spatial
from cinderline.plans.catalogue import NEAR_SQL, POLICY, POLICY_SQL, STATUS, STATUS_SQL, TRIANGLES_SQL, Tables, lat, lon, near_pairs, of_type, query, triangles

RULE_SQL = f"""r AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat, text, CASE WHEN doc_id % 9 = 0 THEN ' ' ELSE 'rule ' || doc_id % 4 END AS title, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE 'area' END AS area,
    CASE doc_id % 4 WHEN 0 THEN 'full' WHEN 1 THEN 'stage_2' WHEN 2 THEN 'unknown' ELSE 'none' END AS status, CASE doc_id % 5 WHEN 0 THEN 'permanent' WHEN 1 THEN 'seasonal' WHEN 2 THEN 'temporary' WHEN 3 THEN 'incident' ELSE 'other' END AS duration,
    CASE WHEN doc_id % 3 = 0 THEN ['Released under the MIT License.'] WHEN doc_id % 3 = 1 THEN ['fires are prohibited'] ELSE []::VARCHAR[] END AS said,
    CASE WHEN doc_id % 6 = 0 THEN '2024-02-30' WHEN doc_id % 6 = 1 THEN '2024-01-15' ELSE NULL END AS fin, CASE WHEN doc_id % 8 = 0 THEN '2024-01-20' ELSE NULL END AS start, CAST(doc_id % 14 AS INTEGER) AS month,
    CASE WHEN doc_id % 7 = 0 THEN '{{"type": "Circle"}}' WHEN doc_id % 7 = 1 THEN '{{"type": "Polygon"}}' END AS shape, CASE WHEN doc_id % 2 = 0 THEN 'arcgis_feature_layer' ELSE 'fs_fire_page' END AS kind, (doc_id % 10) / 10.0 AS confidence FROM documents),
    v AS (SELECT *, try_cast(fin AS DATE) AS e, try_cast(start AS DATE) AS s, status IN ('full', 'stage_2') AS restrictive FROM r),
    c AS (SELECT *, list_filter([CASE WHEN trim(title) = '' THEN 'missing_title' END, CASE WHEN area IS NULL THEN 'missing_area' END, CASE WHEN len(said) = 0 THEN 'missing_evidence' END,
        CASE WHEN status = 'none' THEN 'unsupported_status' END, CASE WHEN duration = 'other' THEN 'unsupported_duration_type' END, CASE WHEN fin IS NOT NULL AND e IS NULL THEN 'bad_end' END,
        CASE WHEN e < DATE '2024-01-31' AND restrictive AND NOT (duration = 'seasonal' AND month BETWEEN 1 AND 12) THEN 'past' END, CASE WHEN s > e THEN 'reversed' END, CASE WHEN month NOT BETWEEN 1 AND 12 THEN 'range_season_start_month' END,
        CASE WHEN kind <> 'arcgis_feature_layer' AND len(list_filter(said, lambda q: NOT contains(flat, q))) > 0 THEN 'quote' END,
        CASE WHEN restrictive AND NOT regexp_matches(CASE WHEN len(said) = 0 THEN text ELSE array_to_string(said, chr(10)) END, '{answers.RESTRICTIVE_EVIDENCE.replace("(?iu)", "(?i)")}') THEN 'restrictive' END,
        CASE WHEN doc_id % 7 = 0 THEN 'geometry' END], lambda x: x IS NOT NULL) AS errors FROM v)"""


def rules(t: Tables) -> DataFrame:
    k = F.col("doc_id")
    pick = lambda n, *values: F.get(F.array(*map(F.lit, values)), (k % n).cast("int"))
    said = F.when(k % 3 == 0, F.array(F.lit("Released under the MIT License."))).when(k % 3 == 1, F.array(F.lit("fires are prohibited"))).otherwise(F.array().cast("array<string>"))
    fixed = {c: F.lit("unknown") for c in localized.ALLOWED}
    own = {
        "title": F.when(k % 9 == 0, " ").otherwise(F.concat(F.lit("rule "), (k % 4).cast("string"))), "affected_area": F.when(k % 11 != 0, "area"), "status": pick(4, "full", "stage_2", "unknown", "none"),
        "duration_type": pick(5, "permanent", "seasonal", "temporary", "incident", "other"), "evidence_quotes": said, "effective_end": F.when(k % 6 == 0, "2024-02-30").when(k % 6 == 1, "2024-01-15"), "effective_start": F.when(k % 8 == 0, "2024-01-20"),
        "season_start_month": (k % 14).cast("int"), "season_start_day": F.lit(1), "season_end_month": F.lit(9), "season_end_day": F.lit(30), "geometry_json": F.when(k % 7 == 0, '{"type": "Circle"}').when(k % 7 == 1, '{"type": "Polygon"}'),
        "source_type": F.when(k % 2 == 0, "arcgis_feature_layer").otherwise("fs_fire_page"), "confidence": k % 10 / 10.0, "rule_id": k,
    }
    wide = t.documents.select("doc_id", "text").withColumns(fixed | own)
    return wide.withColumn("errors", localized.localized_errors(F.col("source_type"), F.col("text"), F.lit("2024-01-31").cast("date"), wide.columns))


@query(f"""WITH {RULE_SQL} SELECT doc_id, array_to_string(errors, ',') AS errors, len(errors) = 0 AND confidence >= 0.9 AND restrictive AS strong FROM c""")
def localized_validation(t: Tables) -> DataFrame:
    strong = localized.strong_rule(F.col("errors"), F.col("confidence"), F.lit(None).cast("array<string>"), F.col("status"))
    return rules(t).select("doc_id", F.array_join("errors", ",").alias("errors"), strong.alias("strong"))


@query(f"""WITH {RULE_SQL} SELECT doc_id % 50 AS unit, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY CASE duration WHEN 'temporary' THEN 0 WHEN 'incident' THEN 1 WHEN 'seasonal' THEN 2 WHEN 'permanent' THEN 3 ELSE 9 END, title, doc_id) AS rules FROM r GROUP BY 1""")
def localized_order(t: Tables) -> DataFrame:
    return localized.unit_rules(rules(t).withColumn("unit", F.col("doc_id") % 50), "unit").select("unit", F.array_join(F.transform("rules", lambda i: i.cast("string")), ",").alias("rules"))


@query("""WITH u AS (SELECT n_nationkey AS id, lower(n_name) || ' national forest' AS name, CASE n_nationkey % 3 WHEN 0 THEN 'national_forest' WHEN 1 THEN 'national_park' ELSE 'other' END AS kind FROM nation),
    q AS (SELECT *, 2400 + CASE kind WHEN 'national_forest' THEN 130 WHEN 'national_park' THEN 120 ELSE 80 END + CASE WHEN contains('united national forest', name) THEN 1800 ELSE 0 END + CASE WHEN starts_with(name, 'united national forest') THEN 1100 ELSE 0 END
        + CASE WHEN contains(name, 'united national forest') THEN 720 ELSE 0 END + CASE WHEN contains(name, 'united') AND contains(name, 'national') AND contains(name, 'forest') THEN 340 ELSE 0 END AS score FROM u
        WHERE contains(name, 'united national forest') OR contains('united national forest', name) OR (contains(name, 'united') AND contains(name, 'national') AND contains(name, 'forest'))),
    p AS (SELECT r_regionkey AS id, lower(r_name) AS name, 3000 + r_regionkey * 10 AS score FROM region),
    a AS (SELECT 'land_unit' AS result_type, CAST(id AS BIGINT) AS id, name, CAST(score AS BIGINT) AS score FROM q UNION ALL SELECT 'place', CAST(id AS BIGINT), name, CAST(score AS BIGINT) FROM p)
    SELECT * FROM a ORDER BY score DESC, result_type, name, id LIMIT 8""")
def search_suggestions(t: Tables) -> DataFrame:
    k = F.col("n_nationkey")
    name = F.concat(F.lower("n_name"), F.lit(" national forest"))
    units = t.nation.select(k.cast("long").alias("unit_id"), name.alias("name"), name.alias("normalized_name"), F.when(k % 3 == 0, "national_forest").when(k % 3 == 1, "national_park").otherwise("other").alias("unit_type"))
    places = t.region.select(F.col("r_regionkey").cast("long").alias("place_id"), F.lower("r_name").alias("name"), (3000 + F.col("r_regionkey") * 10).cast("long").alias("score"))
    return search.suggestions(search.search_units(units, "united national forest"), places)


@query("""WITH f AS (SELECT user_id, ts, event_id, CASE WHEN event_type = 'purchase' AND user_id % 3 <> 0 THEN 'e' || event_id END AS etag, CASE WHEN event_type IN ('purchase', 'view') THEN 'm' || event_id END AS last_modified FROM events),
    a AS (SELECT * FROM f WHERE etag IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
    b AS (SELECT * FROM f WHERE last_modified IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
    SELECT user_id, coalesce(a.etag, '-') AS etag, CASE WHEN a.user_id IS NULL THEN b.last_modified ELSE a.last_modified END AS last_modified FROM b LEFT JOIN a USING (user_id)""")
def conditional_headers(t: Tables) -> DataFrame:
    bought, seen = F.col("event_type") == "purchase", F.col("event_type").isin("purchase", "view")
    f = t.events.select("user_id", "ts", "event_id", F.when(bought & (F.col("user_id") % 3 != 0), F.concat(F.lit("e"), "event_id")).alias("etag"), F.when(seen, F.concat(F.lit("m"), "event_id")).alias("last_modified"))
    return history.conditional_headers(f, "user_id", "ts", "event_id").fillna("-", ["etag"])


@query(f"""WITH e AS (SELECT user_id, ts, event_id, {STATUS_SQL} AS s, {POLICY_SQL} AS p FROM events),
    h AS (SELECT * FROM e WHERE ts < TIMESTAMP '2024-01-15' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
    n AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
    SELECT user_id, coalesce(h.s, '-') AS from_status, n.s AS to_status, coalesce(h.p, '-') AS from_policy, n.p AS to_policy FROM n LEFT JOIN h USING (user_id) WHERE user_id % 5 <> 0 AND NOT (h.s IS NULL AND n.s = 'unknown') AND NOT (h.s IS NOT NULL AND h.s = n.s AND h.p = n.p)""")
def closing_rows(t: Tables) -> DataFrame:
    e = t.events.select("user_id", "ts", "event_id", of_type(STATUS).alias("status"), of_type(POLICY).alias("policy"))
    last = history.latest_per_key(e.where(F.col("ts") < F.lit("2024-01-15").cast("timestamp")), "user_id", "ts", "event_id")
    out = history.closing_rows(last, history.latest_per_key(e, "user_id", "ts", "event_id"), e.where("user_id % 5 = 0"), "user_id")
    return out.fillna("-", ["from_status", "from_policy"])


@query("""WITH o AS (SELECT o_custkey AS source_id, bool_and(o_orderkey % 4 = 0) AS only FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
    SELECT o_orderkey AS id FROM orders LEFT JOIN o ON o.source_id = o_custkey WHERE o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AND (o_orderstatus = 'P' OR (o_orderstatus <> 'F' AND (o.only IS NULL OR o.only)))""")
def parse_decisions(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    fetches = t.orders.select(k.alias("id"), F.col("o_custkey").alias("source_id"), F.when(k % 7 == 0, "timeout").alias("error"), F.when(k % 11 != 0, k).alias("document_id"), (F.col("o_orderstatus") == "P").alias("changed"))
    seen = t.orders.where("o_orderstatus = 'F'").select(k.alias("fetch_id"), F.col("o_custkey").alias("source_id"), F.when(k % 4 == 0, F.array(F.lit("llm parsing is disabled or unavailable."))).alias("reasons"))
    return history.fetches_to_parse(fetches, seen, True).select("id")


@query("""SELECT r_regionkey, string_agg(n_name, ',' ORDER BY i) AS names FROM (SELECT r_regionkey, unnest([r_regionkey, r_regionkey + 5, r_regionkey + 10]) AS c, generate_subscripts([1, 2, 3], 1) AS i FROM region) JOIN nation ON n_nationkey = c GROUP BY 1""")
def units_by_codes(t: Tables) -> DataFrame:
    k = F.col("r_regionkey")
    units = t.region.select(k, F.array(k, k + 5, k + 10).alias("codes"))
    return joins.by_codes(units, t.nation.select(F.col("n_nationkey").alias("code"), "n_name"), "r_regionkey", "codes", "code", "n_name").select("r_regionkey", F.array_join("n_names", ",").alias("names"))


@query("""SELECT vec_id, (y = 0 AND x = 0 AND vec_id % 2 = 0) OR (y BETWEEN 37.0 AND 49.1 AND x BETWEEN -125.1 AND -116.0) AS kept, label IN (1, 2) AS allowed
    FROM (SELECT vec_id, label, CASE WHEN vec_id % 5 = 0 THEN 0 ELSE embedding[2]::DOUBLE * 40 + 44 END AS y, CASE WHEN vec_id % 5 = 0 THEN 0 ELSE embedding[1]::DOUBLE * 40 - 120 END AS x FROM embeddings)""")
def launch_box(t: Tables) -> DataFrame:
    off = F.col("vec_id") % 5 == 0
    y, x = F.when(off, 0.0).otherwise(lat() * 40 + 44), F.when(off, 0.0).otherwise(lon() * 40 - 120)
    return t.embeddings.select("vec_id", labels.in_box(y, x, F.when(F.col("vec_id") % 2 == 0, "{}")).alias("kept"), labels.class_allowed(F.col("label").cast("string"), ["1", "2"]).alias("allowed"))


@query("""SELECT o_custkey, arg_max(o_orderkey, (CASE o_orderstatus WHEN 'F' THEN 600 WHEN 'O' THEN 500 ELSE 350 END, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 50 END, CASE WHEN o_orderkey % 2 = 0 THEN 88 ELSE 10 END, CAST(o_orderkey % 100 AS INTEGER), o_orderdate, o_orderkey)) AS best FROM orders GROUP BY 1""")
def review_candidates(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "full").when(F.col("o_orderstatus") == "O", "none").otherwise("advisory")
    errors = F.when(k % 3 == 0, F.array(F.lit("quote"))).otherwise(F.array().cast("array<string>"))
    score = labels.candidate_score(status, errors, F.when(k % 2 == 0, "fs_fire_page").otherwise("inciweb_feed"), k % 100 / 100.0, F.col("o_orderdate"))
    return t.orders.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct(score.alias("s"), k.alias("k"))).alias("best"))


@query("""SELECT event_id, '{"a":{"k":' || json_extract_string(props, '$.k') || ',"z":null},"b":[2,1]}' AS canonical FROM events""")
def canonical_json(t: Tables) -> DataFrame:
    raw = F.concat(F.lit('{ "b": [2, 1], "a": {"z": null, "k": '), F.get_json_object("props", "$.k"), F.lit("} }"))
    return t.events.select("event_id", text.canonical_json(raw).alias("canonical"))


@query("SELECT p_partkey, 'parts-' || replace(lower(p_name), ' ', '-') || '-' || CASE WHEN p_partkey % 2 = 0 THEN 'x' || p_partkey ELSE left(sha1('parts:' || p_name || ':' || p_size || ':' || p_brand), 8) END AS slug, round(p_size * 1.8 + 32, 6) AS f, round(p_size * 3.280839895, 6) AS ft FROM part")
def place_slugs(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    slug = text.place_slug(F.lit("parts"), F.col("p_name"), F.when(k % 2 == 0, F.concat(F.lit("x"), k.cast("string"))), F.col("p_size").cast("string"), F.col("p_brand"))
    return t.part.select("p_partkey", slug.alias("slug"), F.round(labels.fahrenheit(F.col("p_size")), 6).alias("f"), F.round(labels.feet(F.col("p_size")), 6).alias("ft"))


@query(f"""WITH {NEAR_SQL} SELECT point_id, bool_and(NOT (incident_id % 4 = 0 OR acres >= 100)) AS minor_only, count(DISTINCT incident_id % 3) AS kinds FROM x WHERE tier IS NOT NULL GROUP BY 1""")
def minor_incidents(t: Tables) -> DataFrame:
    q = F.col("incident_id")
    big = labels.significant(F.when(q % 4 == 0, "https://x.org"), q % 10 * 120.0)
    return near_pairs(t).groupBy("point_id").agg(F.bool_and(~big).alias("minor_only"), F.count_distinct(q % 3).alias("kinds"))


@query("SELECT l_orderkey, l_linenumber, [[1.0], [2.0], [3.0]][CASE WHEN l_linenumber % 7 < 3 THEN l_linenumber % 7 + 1 ELSE 3 END][1] AS part FROM lineitem WHERE l_linenumber % 7 < 3 OR l_linenumber % 7 = 6")
def selected_parts(t: Tables) -> DataFrame:
    n = F.col("l_linenumber") % 7
    parts = F.array(*(F.array(F.lit(x)) for x in (1.0, 2.0, 3.0)))
    chosen = localized.selected_parts(parts, F.array(F.when(n == 6, -1).otherwise(n).cast("int")))
    return t.lineitem.select("l_orderkey", "l_linenumber", chosen.alias("c")).where("c is not null").select("l_orderkey", "l_linenumber", F.col("c")[0][0].alias("part"))


@query("SELECT n_name, CAST(row_number() OVER (ORDER BY CASE r_name WHEN 'ASIA' THEN 0 WHEN 'EUROPE' THEN 1 ELSE 2 END, n_name) AS BIGINT) AS place FROM nation JOIN region ON r_regionkey = n_regionkey")
def state_order(t: Tables) -> DataFrame:
    from cinderline.operators.stats import page_assign

    named = t.nation.join(t.region, F.col("r_regionkey") == F.col("n_regionkey"))
    key = F.struct(labels.custom_order(F.col("r_name"), ["ASIA", "EUROPE"]).alias("o"), F.col("n_name").alias("n"))
    return page_assign(named.select("n_name", key.alias("k")), "k", 100).select("n_name", "place")


@query(f"""WITH {TRIANGLES_SQL}, w AS (SELECT a_id, b_id FROM c JOIN e q ON q.vec_id = b_id JOIN t p ON p.vec_id = a_id WHERE (q.ay > p.y) <> (q.cy > p.y) AND p.x < q.ax + (p.y - q.ay) / (q.cy - q.ay) * (q.bx - q.ax) GROUP BY 1, 2 HAVING count(*) % 2 = 1)
    SELECT a_id AS place_id, b_id AS boundary_id, CASE WHEN w.a_id IS NULL THEN 'intersects' ELSE 'contains' END AS how FROM (SELECT * FROM m UNION SELECT * FROM i) LEFT JOIN w USING (a_id, b_id)""")
def places_in_boundaries(t: Tables) -> DataFrame:
    g = triangles(t)
    places = g.where("label = 1").join(t.embeddings.select("vec_id", lon().alias("x"), lat().alias("y")), "vec_id").withColumnRenamed("vec_id", "place_id")
    return spatial.places_in_boundaries(places, g.where("label = 2").withColumnRenamed("vec_id", "boundary_id"), "place_id", "boundary_id", 0.05)
