"""More of the driver's queries: validation, escalation, scopes, verdicts, contexts, incidents, sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderline.operators import answers, feeds, history, joins, stats
from cinderline.plans.catalogue import NEAR_SQL, STATUS, STATUS_SQL, Tables, near_pairs, of_type, query, seconds


QUOTES = (("Released under the MIT License.",), ("campfires are allowed",), ("restrictions apply", "new line: not lifted"), ("all restrictions were lifted", "no fire"), ())
QUOTES_SQL = "CASE d.doc_id % 5 " + " ".join(f"WHEN {k} THEN [{', '.join(repr(x) for x in q)}]::VARCHAR[]" for k, q in enumerate(QUOTES)) + " END"


@query(f"""WITH c AS (SELECT d.doc_id, d.text, trim(regexp_replace(d.text, '\\s+', ' ', 'g')) AS flat, CASE d.doc_id % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'full' ELSE 'unknown' END AS status, CASE WHEN d.doc_id % 5 = 0 THEN 'allowed' ELSE 'unknown' END AS policy,
    CASE d.doc_id % 4 WHEN 0 THEN 'inciweb_feed' WHEN 1 THEN 'arcgis_feature_layer' ELSE 'fs_fire_page' END AS kind, {QUOTES_SQL} AS said, DATE '2024-01-01' + CAST(d.doc_id % 60 AS INTEGER) AS fin FROM documents d),
    e AS (SELECT *, kind <> 'arcgis_feature_layer' AS read, list_filter(said, lambda q: CASE status WHEN 'none' THEN regexp_matches(q, '{answers.NONE_EVIDENCE.replace("(?iu)", "(?i)")}') WHEN 'full' THEN regexp_matches(q, '{answers.RESTRICTIVE_EVIDENCE.replace("(?iu)", "(?i)")}') ELSE false END) AS carrying FROM c),
    g AS (SELECT *, CASE WHEN len(carrying) > 0 THEN array_to_string(carrying, chr(10)) || chr(10) || text WHEN len(said) = 0 THEN text ELSE array_to_string(said, chr(10)) END AS evidence,
        len(list_filter(CASE WHEN len(carrying) > 0 THEN carrying ELSE said END, lambda q: NOT contains(flat, q))) > 0 AS lost FROM e)
    SELECT doc_id, read AND lost AS bad_quote, read AND status = 'full' AND NOT regexp_matches(evidence, '{answers.RESTRICTIVE_EVIDENCE.replace("(?iu)", "(?i)")}') AS no_evidence,
    read AND status = 'none' AND NOT regexp_matches(evidence, '{answers.NONE_EVIDENCE.replace("(?iu)", "(?i)")}') AS not_none,
    read AND status = 'full' AND fin < DATE '2024-01-31' AS past, kind = 'inciweb_feed' AND policy <> 'unknown' AS context FROM g""")
def observation_validation(t: Tables) -> DataFrame:
    k = F.col("doc_id")
    status = F.when(k % 3 == 0, "none").when(k % 3 == 1, "full").otherwise("unknown")
    kind = F.when(k % 4 == 0, "inciweb_feed").when(k % 4 == 1, "arcgis_feature_layer").otherwise("fs_fire_page")
    lists = F.array(*(F.array(*map(F.lit, q)).cast("array<string>") for q in QUOTES))
    end = F.date_add(F.lit("2024-01-01").cast("date"), (k % 60).cast("int"))
    found = answers.validation_errors(status, F.when(k % 5 == 0, "allowed").otherwise("unknown"), F.get(lists, (k % 5).cast("int")), F.col("text"), kind, end, F.lit("2024-01-31").cast("date"))
    codes = {"bad_quote": "quote", "no_evidence": "restrictive", "not_none": "none", "past": "past", "context": "context"}
    return t.documents.select("doc_id", found.alias("e")).select("doc_id", *(F.array_contains("e", code).alias(name) for name, code in codes.items()))


@query("""SELECT doc_id, kind <> 'arcgis_feature_layer' AND (conf < 0.7 OR NOT ok OR (status = 'unknown' AND regexp_matches(text, '(?i)restriction|campfire|public use|forest order|prohibit')) OR conflicts) AS escalate
    FROM (SELECT doc_id, text, (doc_id % 10) / 10.0 AS conf, doc_id % 7 <> 0 AS ok, doc_id % 11 = 0 AS conflicts, CASE WHEN doc_id % 3 = 0 THEN 'unknown' ELSE 'full' END AS status, CASE WHEN doc_id % 4 = 1 THEN 'arcgis_feature_layer' ELSE 'fs_fire_page' END AS kind FROM documents)""")
def escalation(t: Tables) -> DataFrame:
    k = F.col("doc_id")
    kind, status = F.when(k % 4 == 1, "arcgis_feature_layer").otherwise("fs_fire_page"), F.when(k % 3 == 0, "unknown").otherwise("full")
    return t.documents.select("doc_id", answers.should_escalate(kind, k % 10 / 10.0, k % 7 != 0, status, F.col("text"), k % 11 == 0, F.lit(False)).alias("escalate"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'forestwide' WHEN o_orderpriority = '1-URGENT' OR (o_orderkey % 4 = 0 AND NOT (o_orderstatus = 'P' AND o_orderkey % 2 = 0)) OR o_orderstatus = 'F' THEN 'mixed' ELSE 'localized' END AS scope FROM orders""")
def claim_scopes(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    none = F.lit(None).cast("string")
    status = F.when(F.col("o_orderstatus") == "F", "full").when(F.col("o_orderstatus") == "P", "partial").otherwise("unknown")
    policy = F.when(k % 2 == 0, "unknown").otherwise("allowed")
    return t.orders.select("o_orderkey", answers.claim_scope(k % 3, F.when(F.col("o_orderpriority") == "1-URGENT", "high"), none, none, F.when(k % 4 == 0, "area"), status, policy).alias("scope"))


@query(f"""SELECT CASE WHEN user_id % 3 <> 0 AND s = 'none' THEN 'none' WHEN user_id % 3 <> 0 AND s <> 'unknown' THEN 'active' ELSE 'unknown' END AS grp, count(*) AS n FROM (SELECT *, {STATUS_SQL} AS s FROM events) GROUP BY 1""")
def status_groups(t: Tables) -> DataFrame:
    review = F.when(F.col("user_id") % 3 == 0, "needs_review").otherwise("accepted")
    return t.events.groupBy(answers.status_group(review, of_type(STATUS)).alias("grp")).agg(F.count("*").alias("n"))


TRIP_SQL = "CASE {} WHEN 0 THEN 'prohibited' WHEN 1 THEN 'developed_sites_only' WHEN 2 THEN 'fire_pan_required' WHEN 3 THEN 'allowed_with_shutoff_valve' WHEN 4 THEN 'allowed' ELSE 'unknown' END"


def trip_policy(k):
    names = ("prohibited", "developed_sites_only", "fire_pan_required", "allowed_with_shutoff_valve", "allowed")
    out = F.when(k == 0, names[0])
    for i, n in enumerate(names[1:], 1):
        out = out.when(k == i, n)
    return out.otherwise("unknown")


@query(f"""WITH f AS (SELECT o_custkey AS c, min(5 - r) AS m, count(*) AS n, min(o_orderkey % 50) / 50.0 AS conf FROM (SELECT *, 5 - least(o_orderkey % 9, 5) AS r FROM orders WHERE o_orderstatus = 'F') GROUP BY 1),
    r AS (SELECT o_custkey AS c, min(least(o_orderkey % 13, 5)) AS m, count(*) AS n, min(o_orderkey % 40) / 40.0 AS conf FROM orders WHERE o_orderstatus = 'P' GROUP BY 1),
    j AS (SELECT c_custkey, coalesce(f.n, 0) AS fn, coalesce(r.n, 0) AS rn, least(coalesce(f.m, 5), coalesce(r.m, 5)) AS m, least((c_custkey % 30 + 1) / 30.0, f.conf, r.conf) AS confidence FROM customer LEFT JOIN f ON f.c = c_custkey LEFT JOIN r ON r.c = c_custkey)
    SELECT c_custkey AS place_id, {TRIP_SQL.format('m')} AS policy, CASE WHEN fn = 0 THEN 'outside' WHEN rn > 0 AND m = 0 THEN 'local_ban' WHEN m = 0 THEN 'area_ban' WHEN m BETWEEN 1 AND 3 THEN 'limited' WHEN m = 4 THEN 'clear' ELSE 'unsure' END AS verdict, round(CAST(confidence AS DOUBLE), 6) AS confidence FROM j""")
def trip_checks(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    side = lambda s, m, c: t.orders.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("place_id"), trip_policy(F.least(k % m, F.lit(5))).alias("policy"), (k % c / float(c)).alias("confidence"))
    places = t.customer.select(F.col("c_custkey").alias("place_id"), ((F.col("c_custkey") % 30 + 1) / 30.0).alias("confidence"))
    return answers.trip_checks(places, side("F", 9, 50), side("P", 13, 40)).withColumn("confidence", F.round("confidence", 6))


@query(f"""WITH {NEAR_SQL}, r AS (SELECT point_id, CASE max(CASE tier WHEN 'inside' THEN 3 WHEN 'near' THEN 2 ELSE 1 END) WHEN 3 THEN 'inside' WHEN 2 THEN 'near' ELSE 'regional' END AS tier, count(*) AS n FROM x WHERE tier IS NOT NULL GROUP BY 1),
    l AS (SELECT max(ts) AS last FROM events WHERE event_type = 'purchase') SELECT point_id, CASE WHEN last >= TIMESTAMP '2024-01-31' - INTERVAL 48 HOUR THEN tier ELSE 'stale' END AS status, CASE WHEN last >= TIMESTAMP '2024-01-31' - INTERVAL 48 HOUR THEN n ELSE 0 END AS n FROM r, l""")
def incident_context(t: Tables) -> DataFrame:
    from cinderline.operators.spatial import tier_rollup

    syncs = t.events.select(F.col("ts").alias("finished_at"), (F.col("event_type") == "purchase").alias("success"))
    return answers.gated_context(tier_rollup(near_pairs(t), "point_id").select("point_id", "tier", "n"), syncs, F.lit("2024-01-31").cast("timestamp"), 48).select("point_id", "status", "n")


@query("""SELECT event_id, CASE c WHEN 0 THEN 'none' WHEN 1 THEN 'stage_1' WHEN 2 THEN 'stage_2' ELSE 'unknown' END AS status, CASE c WHEN 0 THEN 'allowed' WHEN 1 THEN 'developed_sites_only' WHEN 2 THEN 'prohibited' ELSE 'unknown' END AS policy, CASE WHEN c IN (0, 1, 2) THEN 0.95 ELSE 0.35 END AS confidence
    FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(json_extract(props, '$.k') AS INTEGER) % 5 END AS a, CAST(event_id % 4 AS INTEGER) AS b, coalesce(a, b) AS c FROM events)""")
def stage_codes(t: Tables) -> DataFrame:
    code = F.when(F.col("event_id") % 3 != 0, F.try_variant_get(F.try_parse_json("props"), "$.k", "int") % 5)
    status, policy, confidence = answers.stage_code(code, (F.col("event_id") % 4).cast("int"))
    return t.events.select("event_id", status.alias("status"), policy.alias("policy"), confidence.alias("confidence"))


@query("""WITH p AS (SELECT c_custkey AS n, upper('id-' || c_custkey) AS id, c_name AS name, 'u' || c_nationkey AS unit, c_acctbal AS acres FROM customer WHERE c_custkey % 10 <> 0),
    q AS (SELECT upper('id-' || o_custkey) AS id, arg_min(o_totalprice, o_orderkey) AS acres, arg_min(epoch_ms(o_orderdate), o_orderkey) AS ms FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1)
    SELECT p.id, round(coalesce(q.acres, p.acres), 2) AS acres, coalesce(CAST(q.ms / 1000 AS BIGINT), -1) AS discovered FROM p LEFT JOIN q ON p.id = q.id""")
def incident_merge(t: Tables) -> DataFrame:
    none = lambda kind: F.lit(None).cast(kind)
    points = t.customer.select(F.col("c_custkey").alias("n"), F.when(F.col("c_custkey") % 10 != 0, F.concat(F.lit("{id-"), F.col("c_custkey").cast("string"), F.lit("}"))).alias("id"), F.col("c_name").alias("name"), F.concat(F.lit("u"), F.col("c_nationkey").cast("string")).alias("unit"), F.col("c_acctbal").alias("acres"), none("double").alias("contained"), none("long").alias("discovered_ms"), F.lit(-120.0).alias("lon"), F.lit(44.0).alias("lat"))
    perimeters = t.orders.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("n"), F.concat(F.lit("ID-"), F.col("o_custkey").cast("string")).alias("id"), none("string").alias("name"), F.col("o_totalprice").alias("acres"), none("double").alias("contained"), (seconds("o_orderdate") * 1000).alias("discovered_ms"), none("array<struct<x:double,y:double>>").alias("ring"))
    pages = t.supplier.select(F.col("s_suppkey").alias("n"), F.concat(F.lit("u"), F.col("s_nationkey").cast("string")).alias("unit"), F.col("s_name").alias("name"), F.lit("x").alias("url"))
    return feeds.incidents(points, perimeters, pages).select("id", F.round("acres", 2).alias("acres"), F.coalesce(F.unix_seconds("discovered_at"), F.lit(-1)).alias("discovered"))


@query("""WITH d AS (SELECT unnest([{'key': 'alerts', 'path': '/alerts'}, {'key': 'fire', 'path': '/fire'}]) AS p), u AS (SELECT lower(n_name) AS slug, n_nationkey AS k FROM nation)
    SELECT slug || '-' || p.key AS source_slug, slug, 'https://x.org/' || slug || p.path AS url FROM u, d WHERE k % 3 <> 0 UNION ALL SELECT slug || '-own', slug, 'https://x.org/' || slug || '/own' FROM u WHERE k % 3 = 0
    UNION ALL SELECT slug || '-more', slug, 'https://x.org/' || slug || '/more' FROM u WHERE k % 2 = 0""")
def source_catalogue(t: Tables) -> DataFrame:
    path = lambda key: F.struct(F.lit(key).alias("key"), F.lit(f"/{key}").alias("path"))
    k = F.col("n_nationkey")
    units = t.nation.select(F.lower("n_name").alias("slug"), F.concat(F.lit("https://x.org/"), F.lower("n_name"), F.lit("/")).alias("official_url"), F.when(k % 3 == 0, F.array(path("own"))).alias("paths"), F.when(k % 2 == 0, F.array(path("more"))).alias("extra_paths"))
    return feeds.source_rows(units, F.array(path("alerts"), path("fire")))


@query(f"""WITH e AS (SELECT event_id, user_id, ts, event_type, {STATUS_SQL} AS s, event_id % 4 AS src FROM events)
    SELECT a.event_id, coalesce(arg_max(b.s, (b.ts, b.event_id)) <> a.s, false) AS conflicts FROM e a LEFT JOIN e b ON a.user_id = b.user_id AND a.src <> b.src AND b.s <> 'unknown' AND b.ts <= a.ts AND b.ts > a.ts - INTERVAL 1 DAY GROUP BY a.event_id, a.s""")
def recent_conflicts(t: Tables) -> DataFrame:
    e = t.events.select("event_id", "user_id", "ts", of_type(STATUS).alias("s"), (F.col("event_id") % 4).alias("src"))
    return joins.conflicting_newest(e, e.where("s <> 'unknown'"), "user_id", "src", "ts", "event_id", "s", 1).select("event_id", "conflicts")


@query("""SELECT l_orderkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags, count(*) AS n FROM lineitem GROUP BY 1 HAVING bool_and(l_quantity > 10) AND bool_or(l_discount > 0.05)""")
def all_and_any(t: Tables) -> DataFrame:
    by = t.lineitem.groupBy("l_orderkey").agg(F.bool_and(F.col("l_quantity") > 10).alias("a"), F.bool_or(F.col("l_discount") > 0.05).alias("o"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("flags"), F.count("*").alias("n"))
    return by.where("a and o").select("l_orderkey", "flags", "n")


@query("""SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS newest, count(*) FILTER (o_orderdate > TIMESTAMP '2000-01-01') AS current, count(*) FILTER (o_orderdate <= TIMESTAMP '2000-01-01') AS stale, count(*) AS total FROM orders GROUP BY 1""")
def review_summary(t: Tables) -> DataFrame:
    new = F.col("o_orderdate") > F.lit("2000-01-01").cast("timestamp")
    counts = stats.bucket_counts(t.orders, ["o_custkey"], {"current": new, "stale": ~new})
    newest = history.latest_per_key(t.orders.select("o_custkey", "o_orderdate", "o_orderkey"), "o_custkey", "o_orderdate", "o_orderkey")
    return counts.join(newest, "o_custkey").select("o_custkey", F.col("o_orderkey").alias("newest"), "current", "stale", "total")
