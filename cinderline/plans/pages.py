"""Driver queries of whole answers, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderline.operators import answers, pages, stats, wildfires
from cinderline.operators.search import phrases
from cinderline.plans.answers import TRIP_SQL, trip_policy
from cinderline.plans.catalogue import COLLAPSED_SQL, Tables, collapsed, query
from cinderline.plans.shapes import DETAIL_SQL, POINT_TIERS_SQL, ROLLUP_SQL, incident_details, listed_incidents, point_tiers, synced

SAID = ("", "Stage 2 restrictions apply. Call us!", "All is well? Restrictions have been LIFTED today.", "Campfires are, until further notice, prohibited. Thanks.", "Stage I  in effect.", "No campfire  news. Fire danger is low.")
SAID_SQL = "CASE doc_id % 6 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SAID)) + " END"


@query(f"""WITH d AS (SELECT doc_id, coalesce(text, '') || '. ' || {SAID_SQL} AS t FROM documents), r AS (SELECT doc_id, lower(t) AS l, trim(regexp_replace(t, '\\s+', ' ', 'g')) AS p FROM d),
    c AS (SELECT doc_id, CASE WHEN regexp_matches(l, 'no public[- ]use restrictions|no fire restrictions|fire ban is not in effect|restrictions? (have been )?(lifted|rescinded|ended)|campfires? are allowed') THEN 0 WHEN regexp_matches(l, 'stage\\s*2|stage ii') THEN 1
        WHEN regexp_matches(l, 'stage\\s*1|stage i') THEN 2 WHEN regexp_matches(l, 'campfires?.{{0,80}}(prohibited|not allowed|banned)|prohibit.{{0,80}}campfires?') THEN 3 ELSE 4 END AS k,
        list_filter(string_split(regexp_replace(p, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: regexp_matches(s, '(?i)fire|restriction|campfire|stage|prohibit|allowed|rescinded|lifted')) AS e FROM r)
    SELECT doc_id, ['none', 'stage_2', 'stage_1', 'full', 'unknown'][k + 1] AS status, ['allowed', 'prohibited', 'developed_sites_only', 'prohibited', 'unknown'][k + 1] AS policy, CAST([0.93, 0.9, 0.82, 0.78, 0.35][k + 1] AS DOUBLE) AS confidence,
    coalesce(e[1][:500], '-') AS evidence, CASE WHEN k = 4 THEN 1 ELSE 0 END AS reasons FROM c""")
def stated_claims(t: Tables) -> DataFrame:
    said = F.element_at(F.array(*map(F.lit, SAID)), (F.col("doc_id") % len(SAID) + 1).cast("int"))
    c = t.documents.select("doc_id", pages.stated_claim(F.concat(F.coalesce("text", F.lit("")), F.lit(". "), said)).alias("c"))
    return c.select("doc_id", "c.status", "c.policy", "c.confidence", F.coalesce(F.get("c.evidence", F.lit(0)), F.lit("-")).alias("evidence"), F.size("c.reasons").alias("reasons"))


@query("""SELECT o_orderkey, round(CASE o_custkey % 3 WHEN 0 THEN (floor(o_totalprice) + o_orderkey % 1000) * 1.5 / 1e6 + (o_custkey % 5000) * 5 / 1e6 WHEN 1 THEN (floor(o_totalprice) + o_orderkey % 1000) * 3 / 1e6 + (o_custkey % 5000) * 15 / 1e6 END, 8) AS cost FROM orders WHERE o_custkey % 3 < 2""")
def priced_calls(t: Tables) -> DataFrame:
    return calls(t).where("cost is not null").select("o_orderkey", "cost")


def calls(t: Tables) -> DataFrame:
    """Orders as calls of models, one of three without a price."""
    k = F.col("o_custkey")
    model = F.when(k % 3 == 0, "model-small-1").when(k % 3 == 1, "model-large-1").otherwise("other")
    tokens = {"input": F.floor("o_totalprice"), "cache_creation": F.col("o_orderkey") % 1000, "output": k % 5000}
    return t.orders.select("o_orderkey", pages.usage_cost(model, tokens, [("small-1", 1.5, 5.0), ("large-[0-9]", 3.0, 15.0)]).alias("cost"))


@query("""WITH f AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey % 4 AS code, 'Unit ' || l_suppkey % 5 AS owner, CASE WHEN l_linenumber % 2 = 0 THEN 'area ' || l_linenumber END AS area FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) = 1),
    s AS (SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN 'UNIT ' || o_custkey % 5 WHEN 1 THEN 'nit ' || o_custkey % 5 END AS want FROM orders),
    m AS (SELECT s.k, arg_min(code, n) AS code, arg_min(coalesce(area, '-'), n) AS area FROM s JOIN f USING (k) WHERE want IS NULL OR lower(owner) = lower(want) OR contains(owner, want) GROUP BY 1)
    SELECT s.k AS source_id, m.k IS NOT NULL AS found, CASE code WHEN 0 THEN 'none' WHEN 1 THEN 'stage_1' WHEN 2 THEN 'stage_2' ELSE 'unknown' END AS status, CASE code WHEN 0 THEN 'No restrictions' WHEN 1 THEN 'Stage 1 public use fire restrictions' WHEN 2 THEN 'Stage 2 public use fire restrictions' ELSE 'Unknown restrictions' END AS label,
    coalesce(area, '-') AS area, CAST(CASE WHEN code < 3 THEN 0.95 ELSE 0.35 END AS DOUBLE) AS confidence FROM s LEFT JOIN m USING (k)""")
def layer_claims(t: Tables) -> DataFrame:
    owner = F.concat(F.lit("Unit "), F.col("l_suppkey") % 5)
    code = F.col("l_partkey") % 4
    name = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit(',"Comments":"area '), "l_linenumber", F.lit('"'))).otherwise("")
    text = F.concat(F.lit('{"'), F.when(code == 1, "Status").otherwise("restriction_status"), F.lit('":'), F.when(code == 2, F.lit('"02"')).otherwise(code.cast("string")), F.lit(',"'), F.when(F.col("l_suppkey") % 2 == 0, "DataSource").otherwise("source"), F.lit('":"'), owner, F.lit('"'), name, F.lit("}"))
    lines = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min_by(F.struct(text.alias("a")), F.struct("l_partkey", "l_suppkey")).alias("f"))
    features = lines.select(F.col("l_orderkey").alias("layer_id"), "l_linenumber", F.col("f.a").alias("attributes"))
    k = F.col("o_orderkey")
    sources = t.orders.select(k.alias("source_id"), k.alias("layer_id"), F.when(k % 3 == 0, F.concat(F.lit("UNIT "), F.col("o_custkey") % 5)).when(k % 3 == 1, F.concat(F.lit("nit "), F.col("o_custkey") % 5)).alias("data_source"))
    return pages.layer_claims(sources, features, "source_id", "layer_id", "l_linenumber").select("source_id", "found", "status", "label", F.coalesce("area", F.lit("-")).alias("area"), "confidence")


ASKED = "large rod"


@query(f"""SELECT p_partkey AS name_id, s_suppkey AS place_id, lower(p_name) AS name FROM part JOIN supplier ON s_suppkey = p_partkey % 10 WHERE s_acctbal > -500 AND ({" OR ".join(f"contains(lower(p_name), '{p}')" for p in phrases(ASKED))} OR s_nationkey % 4 = 1) ORDER BY s_nationkey DESC, p_size DESC, p_name, place_id, p_partkey LIMIT 360""")
def matching_names(t: Tables) -> DataFrame:
    names = t.part.select(F.col("p_partkey").alias("name_id"), (F.col("p_partkey") % 10).alias("place_id"), F.col("p_name").alias("name"), F.lower("p_name").alias("normalized_name"), F.struct("p_size", F.lit(0)).alias("weight"))
    places = t.supplier.select(F.col("s_suppkey").alias("place_id"), (F.col("s_acctbal") > -500).alias("active"), F.col("s_nationkey").alias("search_rank"), F.concat(F.lit("kind "), F.col("s_nationkey") % 4).alias("place_type"))
    return pages.matching_names(names, places, ASKED, ["kind 1"], tie="name_id").select("name_id", "place_id", F.col("normalized_name").alias("name"))


LOG_SQL = f"""{COLLAPSED_SQL}, n AS (SELECT * FROM x ORDER BY ts DESC, event_id DESC LIMIT 150), w AS (SELECT *, CASE WHEN from_status = 'none' AND from_policy IN ('', 'unknown') THEN 'allowed' ELSE from_policy END AS f,
    CASE policy WHEN 'allowed' THEN 0 WHEN 'developed_sites_only' THEN 2 WHEN 'stoves_only' THEN 3 WHEN 'prohibited' THEN 4 ELSE -1 END AS ra, CASE from_policy WHEN 'allowed' THEN 0 WHEN 'developed_sites_only' THEN 2 WHEN 'stoves_only' THEN 3 WHEN 'prohibited' THEN 4 ELSE -1 END AS rb FROM n)"""


@query(f"""WITH {LOG_SQL} SELECT strftime(ts, '%Y-%m-%d') AS day, string_agg(event_id || ' ' || user_id || ' ' || CASE WHEN from_status IS NULL THEN 'first' WHEN ra < 0 OR rb < 0 THEN 'updated' WHEN ra > rb THEN 'tightened' WHEN ra < rb THEN 'eased' ELSE 'updated' END || CASE WHEN event_id % 5 = 0 THEN ' again' ELSE '' END, ',' ORDER BY ts DESC, event_id DESC) AS entries FROM w GROUP BY 1""")
def change_log(t: Tables) -> DataFrame:
    changes = collapsed(t).withColumnRenamed("user_id", "unit_id").withColumn("origin", F.when(F.col("event_id") % 5 == 0, "backfill").otherwise("live"))
    log = pages.change_log(changes, "ts", "event_id")
    return log.select("day", F.array_join(F.transform("entries", lambda e: F.concat(e["id"].cast("string"), F.lit(" "), e["unit_id"].cast("string"), F.lit(" "), e["direction"], F.when(e["reconstructed"], " again").otherwise(""))), ",").alias("entries"))


@query("""WITH o AS (SELECT *, o_orderdate > TIMESTAMP '1999-01-01' AS cur, (CASE o_orderstatus WHEN 'F' THEN 600 WHEN 'O' THEN 500 ELSE 350 END, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 50 END, CASE WHEN o_orderkey % 2 = 0 THEN 88 ELSE 10 END, CAST(o_orderkey % 100 AS INTEGER), o_orderdate, o_orderkey) AS s FROM orders),
    g AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (cur) AS c, arg_max(o_orderkey, (cur, s)) AS best, arg_max(o_orderstatus, (cur, s)) AS st FROM o GROUP BY 1)
    SELECT c_custkey AS unit_id, coalesce(n, 0) AS observations, coalesce(c, 0) AS current, coalesce(best, -1) AS best, coalesce(CASE st WHEN 'F' THEN 'full' WHEN 'O' THEN 'none' ELSE CASE WHEN st IS NOT NULL THEN 'advisory' END END, '-') AS status FROM customer LEFT JOIN g ON o_custkey = c_custkey""")
def review_rows(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "full").when(F.col("o_orderstatus") == "O", "none").otherwise("advisory")
    errors = F.when(k % 3 == 0, F.array(F.lit("quote"))).otherwise(F.array().cast("array<string>"))
    o = t.orders.select(k.alias("observation_id"), F.col("o_custkey").alias("unit_id"), (F.col("o_orderdate") > F.lit("1999-01-01").cast("timestamp")).alias("current"), status.alias("status"), errors.alias("errors"), F.when(k % 2 == 0, "fs_fire_page").otherwise("inciweb_feed").alias("source_type"), (k % 100 / 100.0).alias("confidence"), F.col("o_orderdate").cast("timestamp").alias("created_at"))
    r = pages.review_rows(t.customer.select(F.col("c_custkey").alias("unit_id")), o, "unit_id", "observation_id")
    return r.select("unit_id", "observations", "current", F.coalesce("best.observation_id", F.lit(-1)).alias("best"), F.coalesce("best.status", F.lit("-")).alias("status"))


@query("""WITH b AS (SELECT l_suppkey AS unit_id, l_linenumber AS k, avg(l_quantity) AS mean, quantile_cont(l_quantity, 0.1) AS p10, quantile_cont(l_quantity, 0.9) AS p90, count(*) AS n FROM lineitem GROUP BY ALL),
    s AS (SELECT *, n * 100.0 / sum(n) OVER (PARTITION BY unit_id) AS share FROM b) SELECT unit_id, string_agg(k || ':' || CAST(CAST(round(p10, 1) AS DECIMAL(8, 1)) AS VARCHAR) || ':' || CAST(CAST(round(p90, 1) AS DECIMAL(8, 1)) AS VARCHAR) || ':' || n, ',' ORDER BY k) AS bands FROM s WHERE n >= 5 AND share >= 8 GROUP BY 1""")
def climate_lows(t: Tables) -> DataFrame:
    by = stats.band_stats(t.lineitem.withColumnRenamed("l_suppkey", "unit_id"), ["unit_id"], F.col("l_linenumber"), "l_quantity", ["unit_id"])
    normals = by.select("unit_id", F.lit(7).alias("month"), F.col("band").alias("least_ft"), F.concat(F.lit("band "), "band").alias("label"), "mean", "p10", "p90", "n", "share")
    tenth = lambda c: c.cast("decimal(8,1)").cast("string")
    lows = pages.climate_lows(normals, "unit_id", 7, 5, 8.0)
    return lows.select("unit_id", F.array_join(F.transform("bands", lambda b: F.concat_ws(":", b["least_ft"].cast("string"), tenth(b["p10"]), tenth(b["p90"]), b["n"].cast("string"))), ",").alias("bands"))


@query("""WITH c AS (SELECT CASE o_custkey % 3 WHEN 0 THEN (floor(o_totalprice) + o_orderkey % 1000) * 1.5 / 1e6 + (o_custkey % 5000) * 5 / 1e6 WHEN 1 THEN (floor(o_totalprice) + o_orderkey % 1000) * 3 / 1e6 + (o_custkey % 5000) * 15 / 1e6 END AS cost FROM orders)
    SELECT (SELECT count(*) FROM customer) AS units, (SELECT count(*) FROM supplier) AS sources, (SELECT string_agg(event_id, ',' ORDER BY ts DESC, event_id DESC) FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 5)) AS latest, (SELECT count(cost) FROM c) AS priced_calls, (SELECT round(sum(round(cost, 8)), 3) FROM c) AS cost""")
def dashboard(t: Tables) -> DataFrame:
    fetches = t.events.select(F.col("ts").alias("fetched_at"), F.col("event_id").alias("id"))
    d = pages.dashboard({"units": t.customer, "sources": t.supplier}, fetches, calls(t))
    return d.select("units", "sources", F.array_join(F.transform("latest_fetches", lambda i: i.cast("string")), ",").alias("latest"), "priced_calls", F.round("cost", 3).alias("cost"))


@query(f"""WITH f AS (SELECT o_custkey AS c, min(5 - r) AS m, count(*) AS n, min(o_orderkey % 50) / 50.0 AS conf FROM (SELECT *, 5 - least(o_orderkey % 9, 5) AS r FROM orders WHERE o_orderstatus = 'F') GROUP BY 1),
    r AS (SELECT o_custkey AS c, min(least(o_orderkey % 13, 5)) AS m, count(*) AS n, min(o_orderkey % 40) / 40.0 AS conf FROM orders WHERE o_orderstatus = 'P' GROUP BY 1),
    j AS (SELECT c_custkey, coalesce(f.n, 0) AS fn, coalesce(r.n, 0) AS rn, least(coalesce(f.m, 5), coalesce(r.m, 5)) AS m FROM customer LEFT JOIN f ON f.c = c_custkey LEFT JOIN r ON r.c = c_custkey),
    u AS (SELECT o_custkey AS c, count(DISTINCT o_orderkey % 7) AS n, string_agg(DISTINCT 'unit ' || o_orderkey % 7, ',' ORDER BY 'unit ' || o_orderkey % 7) AS names FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
    wf AS (WITH {POINT_TIERS_SQL}, {DETAIL_SQL}, {ROLLUP_SQL} SELECT a.place_id, a.status, n.incidents FROM a LEFT JOIN n USING (place_id))
    SELECT c_custkey AS place_id, {TRIP_SQL.format('m')} AS policy, CASE WHEN fn = 0 THEN 'outside' WHEN rn > 0 AND m = 0 THEN 'local_ban' WHEN m = 0 THEN 'area_ban' WHEN m BETWEEN 1 AND 3 THEN 'limited' WHEN m = 4 THEN 'clear' ELSE 'unsure' END AS verdict, coalesce(u.n, 0) AS units_count, coalesce(u.names, '') AS units,
    coalesce(wf.status, 'none') AS wildfires, coalesce(wf.incidents, '') AS incidents FROM j LEFT JOIN u ON u.c = c_custkey LEFT JOIN wf ON wf.place_id = c_custkey""")
def trip_pages(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    side = lambda s, m, c: t.orders.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("place_id"), trip_policy(F.least(k % m, F.lit(5))).alias("policy"), (k % c / float(c)).alias("confidence"), F.concat(F.lit("unit "), (k % 7).cast("string")).alias("name"))
    places = t.customer.select(F.col("c_custkey").alias("place_id"), F.lit(1.0).alias("confidence"))
    checks = answers.trip_checks(places, side("F", 9, 50).drop("name"), side("P", 13, 40).drop("name"))
    fires = wildfires.contexts(places, point_tiers(t), incident_details(t), synced(t), "place_id", "incident_id")
    page = pages.trip_pages(checks, side("F", 9, 50), side("P", 13, 40), fires, "place_id")
    return page.select("place_id", "policy", "verdict", "units_count", F.array_join("units", ",").alias("units"), F.col("wildfires.status").alias("wildfires"), listed_incidents(F.col("wildfires.incidents")).alias("incidents"))
