"""Driver's queries of the named views: list and detail of units, maps, labels, publishing, reviews, parsed rules, overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderline.functions import words
from cinderline.functions.rules import LINK_RANK, STATE_BY_MARKET, STATE_BY_UNIT, STATE_NAMES
from cinderline.operators import answers, history, localized, resolve, views
from cinderline.plans.catalogue import CLAIMS_SQL, STATUS, STATUS_SQL, Tables, claims, of_type, query


def pick(k: Column, *values: str | None) -> Column:
    """The value whose place is k modulo their number."""
    return F.get(F.array(*(F.lit(v).cast("string") for v in values)), (k % len(values)).cast("int"))


def picked(k: str, *values: str | None) -> str:
    return f"CASE {k} % {len(values)} " + " ".join(f"WHEN {i} THEN {'NULL' if v is None else repr(v)}" for i, v in enumerate(values)) + " END"


UNIT_STATUS = ("closure", "none", "unknown", "stage_1", "partial", "full")
UNIT_POLICY = ("prohibited", "", None, "developed_sites_only", "allowed")
REVIEWS = ("accepted", "needs_review", "auto_accepted")
KINDS = ("fs_fire_page", "nps_alerts_api", "partner_page", "fs_fire_info_page")

LIST_SQL = f"""u AS (SELECT c_custkey AS unit_id, 'unit-' || c_custkey AS slug, c_name AS name FROM customer WHERE c_custkey % 13 <> 0),
    s AS (SELECT o_custkey AS unit_id, o_orderkey AS k, o_orderdate AS seen FROM orders WHERE o_custkey % 7 <> 0 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
    p AS (SELECT u.unit_id, slug, name, k, coalesce({picked('k', *UNIT_STATUS)}, 'unknown') AS status, {picked('k', *UNIT_POLICY)} AS raw, coalesce((k % 100) / 100.0, 0.0) AS confidence, coalesce({picked('k', *REVIEWS)}, 'needs_review') AS review_status,
        CASE WHEN k % 4 = 0 THEN 'https://x.org/' || k END AS source_url, CASE WHEN k % 5 <> 0 THEN seen END AS last_checked_at FROM u LEFT JOIN s USING (unit_id)),
    l AS (SELECT * EXCLUDE (raw), CASE WHEN status = 'none' AND coalesce(raw, '') IN ('', 'unknown') THEN 'allowed' WHEN coalesce(raw, '') = '' THEN 'unknown' ELSE raw END AS policy FROM p),
    f AS (SELECT o_custkey AS unit_id, 's' || o_orderkey AS source_slug, o_clerk_name AS source_name, kind, o_orderdate AS seen FROM (SELECT *, 'n' || o_orderkey % 17 AS o_clerk_name, {picked('o_orderkey', *KINDS)} AS kind FROM orders) WHERE o_orderkey % 2 = 1)"""


def listed(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    units = t.customer.select(F.col("c_custkey").alias("unit_id"), F.concat(F.lit("unit-"), F.col("c_custkey").cast("string")).alias("slug"), F.col("c_name").alias("name"), (F.col("c_custkey") % 13 != 0).alias("active"))
    newest = history.latest_per_key(t.orders.where("o_custkey % 7 <> 0").select("o_custkey", "o_orderdate", "o_orderkey"), "o_custkey", "o_orderdate", "o_orderkey")
    statuses = newest.select(
        F.col("o_custkey").alias("unit_id"), pick(k, *UNIT_STATUS).alias("status"), pick(k, *UNIT_POLICY).alias("policy"), (k % 100 / 100.0).alias("confidence"), pick(k, *REVIEWS).alias("review_status"),
        F.when(k % 4 == 0, F.concat(F.lit("https://x.org/"), k.cast("string"))).alias("source_url"), F.lit(None).cast("string").alias("source_title"), F.when(k % 5 != 0, F.col("o_orderdate")).alias("last_checked_at"),
    )
    sources = t.orders.where(k % 2 == 1).select(F.col("o_custkey").alias("unit_id"), F.concat(F.lit("s"), k.cast("string")).alias("source_slug"), F.concat(F.lit("n"), (k % 17).cast("string")).alias("source_name"), pick(k, *KINDS).alias("source_type"), F.concat(F.lit("a"), k.cast("string")).alias("source_address"), F.col("o_orderdate").alias("source_checked_at"))
    climate = t.customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("unit_id"), F.round("c_acctbal", 2).alias("climate"))
    return views.status_list(units, statuses, sources, climate)


@query(f"""WITH {LIST_SQL} SELECT l.unit_id, '/fire-restrictions/' || slug AS url, status, policy, CAST(confidence AS DOUBLE) AS confidence, review_status, CASE WHEN l.unit_id % 2 = 0 THEN round(c_acctbal, 2) END AS climate,
    coalesce((SELECT string_agg(source_slug, ',' ORDER BY source_slug) FROM f WHERE f.unit_id = l.unit_id), '') AS sources FROM l JOIN customer ON c_custkey = l.unit_id""")
def status_list(t: Tables) -> DataFrame:
    return listed(t).select("unit_id", "url", "status", "policy", "confidence", "review_status", "climate", F.array_join(F.transform("sources", lambda s: s["source_slug"]), ",").alias("sources"))


def active_rules(t: Tables) -> DataFrame:
    """Line items as rules of their order's customer."""
    n, k = F.col("l_linenumber"), F.col("l_orderkey")
    rows = t.lineitem.where((k % 3 == 0) & (n <= 4)).join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("unit_id")), "l_orderkey")
    part = F.struct(F.array(F.lit(0), F.lit(-1)).alias("indexes"), F.lit("ends").alias("part_name")), F.struct(F.array(F.lit(7)).alias("indexes"), F.lit("none").alias("part_name")), F.struct(F.array(F.lit(1)).alias("indexes"), F.lit("middle").alias("part_name"))
    return rows.select(
        "unit_id", (k * 10 + n).alias("rule_id"), F.concat(F.lit("rule "), (k % 4).cast("string")).alias("title"), pick(k + n, "permanent", "seasonal", "temporary", "incident", "other").alias("duration_type"), F.concat(F.lit("r"), (k % 5).cast("string")).alias("slug"),
        F.lit("partial").alias("status"), pick(n, *UNIT_POLICY).alias("policy"), pick(k, "derived_dem_elevation", None, "geojson").alias("geometry_source_type"), pick(n, "approximate", "exact", None).alias("accuracy"),
        F.when(n != 3, F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))).alias("parts"), F.when(k % 2 == 0, F.array(*part)).when(k % 5 == 0, F.array(part[1])).alias("subfeatures"),
        (k % 10 / 10.0).alias("confidence"), F.when(n != 2, F.array(F.concat(F.lit("q"), (k % 3).cast("string")), F.lit(""))).alias("evidence_quotes"), F.concat(F.lit("u"), k.cast("string")).alias("source_url"),
    )


RULE_SQL = f"""ar AS (SELECT o_custkey AS unit_id, l_orderkey AS k, l_linenumber AS n, l_orderkey * 10 + l_linenumber AS rule_id, 'rule ' || l_orderkey % 4 AS title, {picked('(l_orderkey + l_linenumber)', 'permanent', 'seasonal', 'temporary', 'incident', 'other')} AS duration,
    'r' || l_orderkey % 5 AS slug, coalesce({picked('l_linenumber', *UNIT_POLICY)}, '') AS policy, {picked('l_orderkey', 'derived_dem_elevation', None, 'geojson')} AS gtype, {picked('l_linenumber', 'approximate', 'exact', None)} AS accuracy
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_orderkey % 3 = 0 AND l_linenumber <= 4),
    ro AS (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY CASE duration WHEN 'temporary' THEN 0 WHEN 'incident' THEN 1 WHEN 'seasonal' THEN 2 WHEN 'permanent' THEN 3 ELSE 9 END, title, rule_id) AS i, count(*) OVER (PARTITION BY unit_id) AS m FROM ar)"""


@query(f"""WITH {LIST_SQL}, {RULE_SQL} SELECT unit_id, status, coalesce((SELECT string_agg(CAST(rule_id AS VARCHAR) || ' ' || title, ',' ORDER BY i) FROM ro WHERE ro.unit_id = l.unit_id), '') AS rules FROM l""")
def unit_details(t: Tables) -> DataFrame:
    return views.unit_details(listed(t), active_rules(t)).select("unit_id", "status", F.array_join(F.transform("rules", lambda r: F.concat(r["rule_id"].cast("string"), F.lit(" "), r["title"])), ",").alias("rules"))


@query(f"""WITH {LIST_SQL}, b AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY unit_id ORDER BY CASE kind {' '.join(f"WHEN '{k}' THEN {LINK_RANK[k]}" for k in KINDS if k in LINK_RANK)} ELSE 9 END, source_name, source_slug) = 1)
    SELECT slug, coalesce(source_url, replace(b.source_slug, 's', 'a'), '-') AS source_url, CASE WHEN source_url IS NULL THEN coalesce(b.source_name, '-') ELSE '-' END AS source_title,
    coalesce(strftime(coalesce(last_checked_at, CASE WHEN source_url IS NULL THEN b.seen END), '%b %-d, %Y'), 'not checked') AS last_checked_label,
    CASE WHEN review_status = 'needs_review' OR status = 'unknown' THEN 'unknown' WHEN status = 'none' THEN 'none' ELSE 'active' END AS map_status FROM l LEFT JOIN b USING (unit_id) WHERE unit_id % 3 <> 0""")
def overview_map(t: Tables) -> DataFrame:
    outlines = t.customer.where("c_custkey % 3 <> 0").select(F.concat(F.lit("unit-"), F.col("c_custkey").cast("string")).alias("slug"), F.lit("{}").alias("geometry"))
    none = lambda c: F.coalesce(c, F.lit("-")).alias(c)
    return views.overview_map(outlines, listed(t)).select("slug", none("source_url"), none("source_title"), "last_checked_label", "map_status")


MAP_SQL = f"""{LIST_SQL}, {RULE_SQL}, kn AS (SELECT * FROM l WHERE unit_id % 3 <> 0),
    lo AS (SELECT ar.* FROM ar JOIN l USING (unit_id) WHERE n <> 3),
    m AS (SELECT unit_id, 'land_unit_boundary' AS kind, slug AS feature_slug, '-' AS part_name, false AS approx, 0.0 AS total FROM kn
    UNION ALL SELECT unit_id, 'forestwide_restriction', slug, '-', false, 0.0 FROM kn WHERE review_status IN ('accepted', 'auto_accepted') AND status IN ('closure', 'full', 'stage_1', 'stage_2', 'year_round')
    UNION ALL SELECT unit_id, 'localized_restriction', slug, x[1], coalesce(accuracy = 'approximate', false) OR coalesce(gtype LIKE 'derived_%', false), CAST(x[2] AS DOUBLE)
    FROM (SELECT *, unnest(CASE WHEN k % 2 = 0 THEN [['ends', '4.0'], ['middle', '2.0']] ELSE [['-', '6.0']] END) AS x FROM lo))"""


def features(t: Tables) -> DataFrame:
    outlines = t.customer.where("c_custkey % 3 <> 0").select(F.concat(F.lit("unit-"), F.col("c_custkey").cast("string")).alias("slug"))
    return views.unit_map(outlines, listed(t), active_rules(t))


@query(f"WITH {MAP_SQL} SELECT * FROM m")
def unit_map(t: Tables) -> DataFrame:
    total = F.coalesce(F.aggregate("parts", F.lit(0.0), lambda a, x: a + x), F.lit(0.0))
    return features(t).select("unit_id", "kind", "feature_slug", F.coalesce("part_name", F.lit("-")).alias("part_name"), F.coalesce("geometry_is_approximate", F.lit(False)).alias("approx"), total.alias("total"))


@query(f"""WITH {MAP_SQL} SELECT unit_id, count(*) FILTER (kind <> 'land_unit_boundary') AS visible, count(*) FILTER (kind = 'forestwide_restriction') AS forestwide, count(DISTINCT feature_slug) FILTER (kind = 'localized_restriction') AS localized FROM m GROUP BY 1""")
def map_counts(t: Tables) -> DataFrame:
    return views.map_counts(features(t))


@query("SELECT p_brand, count(*) FILTER (contains(lower(p_name || ' ' || p_type), 'a s')) AS visible, count(*) AS total FROM part GROUP BY 1")
def section_search(t: Tables) -> DataFrame:
    return views.section_counts(t.part.select("p_brand", F.concat_ws("  ", "p_name", "p_type").alias("shown")), "p_brand", F.col("shown"), " A  s ")


WORDS = {"full": "Full", "stage_1": "Stage 1", "year_round": "Year Round", "none": "None", "unknown": "Unknown"}
CHANGES = {"prohibited": "No campfires", "allowed": "Campfires allowed", "unknown": "Unknown", "stoves_only": "Stoves Only", "fire_pan_required": "Fire pan required"}
BEFORE = ("prohibited", "fire_pan_required", "", "stoves_only")


@query(f"""WITH e AS (SELECT event_id, {STATUS_SQL} AS st, CASE WHEN event_id % 6 <> 0 THEN {picked('event_id', *STATUS.values())} END AS fs, {picked('event_id', *BEFORE)} AS fp, {picked('(event_id // 3)', *BEFORE)} AS tp FROM events),
    x AS (SELECT *, CASE WHEN fp = '' THEN CASE WHEN fs = 'none' THEN 'allowed' ELSE 'unknown' END ELSE fp END AS f, CASE WHEN tp = '' THEN CASE WHEN st = 'none' THEN 'allowed' ELSE 'unknown' END ELSE tp END AS t FROM e)
    SELECT event_id, coalesce(CASE WHEN fs IS NOT NULL AND f = t THEN {'CASE fs ' + ' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in WORDS.items()) + ' END'} WHEN fs IS NOT NULL THEN {'CASE f ' + ' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in CHANGES.items()) + ' END'} END, '-') AS before,
    CASE WHEN fs IS NOT NULL AND f = t THEN {'CASE st ' + ' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in WORDS.items()) + ' END'} ELSE {'CASE t ' + ' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in CHANGES.items()) + ' END'} END AS after FROM x""")
def transition_labels(t: Tables) -> DataFrame:
    k = F.col("event_id")
    before, after = words.transition_labels(F.when(k % 6 != 0, pick(k, *STATUS.values())), pick(k, *BEFORE), of_type(STATUS), pick(F.floor(k / 3), *BEFORE))
    return t.events.select("event_id", F.coalesce(before, F.lit("-")).alias("before"), after.alias("after"))


@query("""WITH o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 <> 0 THEN strftime(o_orderdate, '%b %-d, %Y') END AS a, CASE WHEN o_orderkey % 4 <> 0 THEN strftime(o_orderdate + INTERVAL 9 DAY, '%b %-d, %Y') END AS b FROM orders),
    d AS (SELECT *, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN a || ' to ' || b WHEN a IS NOT NULL THEN 'Since ' || a WHEN b IS NOT NULL THEN 'Through ' || b ELSE 'Current' END AS span FROM o)
    SELECT k AS o_orderkey, CASE k % 5 WHEN 0 THEN 'Permanent' WHEN 1 THEN CASE WHEN k % 2 = 0 THEN 'Seasonal 06-01 to 09-30' ELSE 'Seasonal' END WHEN 3 THEN 'Incident' ELSE span END AS duration,
    CASE k % 4 WHEN 0 THEN 'Allowed with shutoff valve' WHEN 1 THEN 'Developed sites only' WHEN 2 THEN 'Not Allowed' ELSE 'Unknown' END || CASE WHEN k % 4 <> 0 AND k % 3 = 0 THEN '; shutoff valve required' ELSE '' END AS stove FROM d""")
def rule_labels(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    start, end = F.when(k % 3 != 0, F.to_date("o_orderdate")), F.when(k % 4 != 0, F.date_add(F.to_date("o_orderdate"), 9))
    season = lambda v: F.when(k % 2 == 0, v)
    duration = words.duration_label(pick(k, "permanent", "seasonal", "temporary", "incident", "other"), start, end, season("06-01"), season("09-30"))
    stove = words.stove_label(pick(k, "allowed_with_shutoff_valve", "developed_sites_only", "not_allowed", ""), F.when(k % 5 != 0, k % 3 == 0).otherwise(k % 3 == 0))
    return t.orders.select("o_orderkey", duration.alias("duration"), stove.alias("stove"))


STATE_SQL = "CASE slug " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATE_BY_UNIT.items()) + " ELSE CASE market " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATE_BY_MARKET.items()) + " ELSE 'other' END END"
MARKETS = ("oregon", "northern_california", "elsewhere", "extended_tahoe", "washington")


@query(f"""WITH c AS (SELECT c_custkey AS k, {picked('c_custkey', 'olympic', 'tahoe', 'x', 'y', 'z', 'modoc', 'w')} AS slug, {picked('c_custkey', *MARKETS)} AS market FROM customer), s AS (SELECT *, {STATE_SQL} AS state FROM c)
    SELECT k AS c_custkey, state, CASE market WHEN 'oregon' THEN 'or' WHEN 'washington' THEN 'wa' WHEN 'elsewhere' THEN '-' ELSE 'ca' END AS by_market,
    'Trail Head' || CASE WHEN k % 2 = 0 THEN ' / ' || slug WHEN k % 3 = 0 THEN ' / a forest' ELSE '' END || CASE state {' '.join(f"WHEN '{a}' THEN ' / {b}'" for a, b in STATE_NAMES.items() if a != 'other')} ELSE '' END
    || CASE k % 3 WHEN 0 THEN ' / Lane County' WHEN 1 THEN ' / Linn County' ELSE '' END || CASE WHEN k % 4 = 0 THEN ' / q quad' ELSE '' END AS subtitle FROM s""")
def place_subtitles(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    slug, market = pick(k, "olympic", "tahoe", "x", "y", "z", "modoc", "w"), pick(k, *MARKETS)
    state = words.state_code(slug, market)
    subtitle = words.subtitle(F.lit("trail_head"), F.when(k % 2 == 0, slug), F.when(k % 3 == 0, F.lit("a forest")), state, pick(k, "Lane", "Linn County", ""), F.when(k % 4 == 0, "q"))
    return t.customer.select("c_custkey", state.alias("state"), F.coalesce(words.state_of_market(market), F.lit("-")).alias("by_market"), subtitle.alias("subtitle"))


@query(f"""WITH {CLAIMS_SQL}, {RULE_SQL},
    q AS (SELECT unit_id, max(confidence) AS confidence, min(CASE policy WHEN 'prohibited' THEN 0 WHEN 'developed_sites_only' THEN 2 WHEN 'allowed' THEN 5 ELSE 6 END) AS best, string_agg(title, ', ' ORDER BY i) FILTER (i <= 3) AS titles, max(m) AS m, max(k) FILTER (i = 1) AS k1 FROM (SELECT *, (k % 10) / 10.0 AS confidence FROM ro) GROUP BY 1),
    w AS (SELECT unit_id, text, min(place) AS place FROM (SELECT unit_id, 'q' || k % 3 AS text, i AS place FROM ro WHERE n <> 2) GROUP BY 1, 2),
    ws AS (SELECT unit_id, string_agg(text, ',' ORDER BY place) AS said FROM w GROUP BY 1)
    SELECT c_custkey AS unit_id, CASE WHEN r.unit_id IS NOT NULL THEN CASE WHEN conflict THEN 'conflict' ELSE 'published' END WHEN q.unit_id IS NOT NULL THEN 'localized' ELSE 'unknown' END AS outcome,
    CASE WHEN r.unit_id IS NOT NULL THEN CASE WHEN conflict THEN 'unknown' ELSE r.eff END WHEN best = 0 THEN 'prohibited' WHEN best = 2 THEN 'developed_sites_only' WHEN best = 5 THEN 'allowed' ELSE 'unknown' END AS policy,
    CAST(CASE WHEN r.unit_id IS NOT NULL THEN CASE WHEN conflict THEN 0 ELSE r.confidence END ELSE coalesce(q.confidence, 0) END AS DOUBLE) AS confidence,
    CASE WHEN r.unit_id IS NULL THEN coalesce(titles || CASE WHEN m > 3 THEN ',  and ' || m - 3 || ' more' ELSE '' END, '-') ELSE '-' END AS area, CASE WHEN r.unit_id IS NULL THEN coalesce(said, '-') ELSE '-' END AS quotes, CASE WHEN r.unit_id IS NULL THEN coalesce('u' || k1, '-') ELSE '-' END AS source_url
    FROM customer LEFT JOIN r ON r.unit_id = c_custkey LEFT JOIN q ON q.unit_id = c_custkey LEFT JOIN ws ON ws.unit_id = c_custkey""")
def localized_outcomes(t: Tables) -> DataFrame:
    published = resolve.publish(t.customer.select(F.col("c_custkey").alias("unit_id")), resolve.resolve_claims(claims(t), 6 - F.substring("source_type", 1, 1).cast("int")))
    out = resolve.publish_with_rules(published, active_rules(t))
    none = lambda c: F.coalesce(c, F.lit("-"))
    return out.select("unit_id", "outcome", "policy", "confidence", none(F.col("affected_area")).alias("area"), none(F.nullif(F.array_join("evidence_quotes", ","), F.lit(""))).alias("quotes"), none(F.col("source_url")).alias("source_url"))


REVIEWED_SQL = CLAIMS_SQL.replace("WHERE o_orderkey % 11 <> 0 AND o_orderdate > TIMESTAMP '2000-06-01'", "WHERE o_orderdate > TIMESTAMP '2000-06-01' AND CASE WHEN o_orderkey % 17 = 0 THEN o_orderkey % 2 = 0 ELSE o_orderkey % 11 <> 0 END")


@query(f"""WITH {REVIEWED_SQL} SELECT d.unit_id, CASE WHEN r.unit_id IS NULL THEN 'unknown' WHEN conflict THEN 'conflict' ELSE 'published' END AS outcome, CASE WHEN r.unit_id IS NULL OR conflict THEN 'unknown' ELSE status END AS status,
    CASE WHEN r.unit_id IS NULL OR conflict THEN -1 ELSE claim_id END AS claim_id FROM (SELECT DISTINCT o_custkey AS unit_id FROM orders WHERE o_orderkey % 17 = 0 AND o_orderdate > TIMESTAMP '2000-06-01') d LEFT JOIN r USING (unit_id)""")
def review_and_resolve(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    decisions = t.orders.where(k % 17 == 0).select(k.alias("claim_id"), (k % 2 == 0).alias("accept"), F.lit("wrong area").alias("reason"))
    reviewed = resolve.review_claims(claims(t).withColumn("needs_review_reasons", F.lit(None).cast("array<string>")), decisions)
    return resolve.resolve_touched(reviewed, 6 - F.substring("source_type", 1, 1).cast("int")).select("unit_id", "outcome", "status", F.coalesce("claim_id", F.lit(-1)).alias("claim_id"))


PUR = ("Fire Danger: moderate, IFPL: I, PUR:  Seasonal Restrictions", "fire danger: LOW IFPL: II PUR: Seasonal Restrictions", "PUR: Seasonal Restrictions", "No Campfires here", "")


@query(f"""WITH c AS (SELECT o_orderkey AS k, {picked('o_orderkey', *PUR)} AS text, CASE WHEN o_orderkey % 2 = 0 THEN 'official_usfs' ELSE 'official_nps' END AS authority, o_orderkey % 7 = 0 AS page FROM orders),
    x AS (SELECT *, authority = 'official_usfs' AND k % 5 < 2 AS pur, authority = 'official_nps' AND page AND k % 5 = 3 AS park FROM c)
    SELECT k AS o_orderkey, CASE WHEN pur THEN 'advisory' WHEN park THEN 'year_round' ELSE 'unknown' END AS status, CASE WHEN pur THEN CASE k % 5 WHEN 0 THEN 'MODERATE' ELSE 'LOW' END WHEN park THEN '-' ELSE 'HIGH' END AS danger,
    CASE WHEN pur THEN 'Fire Danger: ' || CASE k % 5 WHEN 0 THEN 'MODERATE' ELSE 'LOW' END || '|IFPL: I|PUR: Seasonal Restrictions' WHEN park THEN 'No Campfires here' ELSE '' END AS quotes,
    CAST(CASE WHEN pur THEN greatest(0.9, (k % 100) / 100.0) WHEN park THEN greatest(0.95, (k % 100) / 100.0) ELSE (k % 100) / 100.0 END AS DOUBLE) AS confidence, CASE WHEN pur OR park THEN 'other' ELSE 'no effective dates|other' END AS reasons FROM x""")
def structural_overrides(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    none = F.lit(None).cast("string")
    rows = t.orders.select(
        "o_orderkey", F.when(k % 2 == 0, "official_usfs").otherwise("official_nps").alias("authority"), F.lit("nps_fire_page").alias("source_type"), F.when(k % 7 == 0, "park").otherwise("other").alias("source_slug"), pick(k, *PUR).alias("text"), F.lit("unknown").alias("status"), F.lit("unknown").alias("policy"),
        F.lit("HIGH").alias("fire_danger_rating"), none.alias("ifpl_level"), F.lit(None).cast("date").alias("effective_start"), F.lit(None).cast("date").alias("effective_end"), F.lit("7").alias("order_number"), none.alias("affected_area"), none.alias("summary"),
        F.array().cast("array<string>").alias("evidence_quotes"), (k % 100 / 100.0).alias("confidence"), F.array(F.lit("no effective dates"), F.lit("other")).alias("needs_review_reasons"),
    )
    page = t.region.where("r_regionkey = 0").select(F.lit("park").alias("source_slug"), F.lit("(?i)no campfires").alias("pattern"), F.lit("year_round").alias("page_status"), F.lit("prohibited").alias("page_policy"), F.lit("backcountry").alias("page_area"), F.lit("s").alias("page_summary"), F.lit("No Campfires here").alias("page_quote"))
    out = answers.page_overrides(answers.current_pur(rows), page)
    return out.select("o_orderkey", "status", F.coalesce("fire_danger_rating", F.lit("-")).alias("danger"), F.array_join("evidence_quotes", "|").alias("quotes"), "confidence", F.array_join("needs_review_reasons", "|").alias("reasons"))


@query("""WITH o AS (SELECT o_custkey AS unit_id, 'src-rule-' || o_orderkey % 4 AS slug, o_orderkey AS k FROM orders),
    a AS (SELECT * FROM o WHERE k % 2 = 0 QUALIFY row_number() OVER (PARTITION BY unit_id, slug ORDER BY k DESC) = 1), b AS (SELECT * FROM o WHERE k % 2 = 1 OR k % 8 = 0 QUALIFY row_number() OVER (PARTITION BY unit_id, slug ORDER BY k DESC) = 1),
    j AS (SELECT coalesce(a.unit_id, b.unit_id) AS unit_id, coalesce(a.slug, b.slug) AS slug, a.k AS old, b.k AS new FROM a FULL JOIN b ON a.unit_id = b.unit_id AND a.slug = b.slug)
    SELECT unit_id, slug, coalesce(new, old) AS fetch_id, CASE coalesce(new, old) % 3 WHEN 0 THEN 'full' WHEN 1 THEN 'unknown' ELSE 'stage_1' END AS status, CASE WHEN old IS NULL THEN 1 ELSE 0 END AS created, CASE WHEN new IS NOT NULL AND old IS NOT NULL THEN 1 ELSE 0 END AS updated,
    CASE WHEN coalesce(new, old) % 3 <> 1 AND coalesce(new, old) % 100 >= 90 THEN 'auto_accepted' ELSE 'needs_review' END AS review_status FROM j""")
def parsed_rules(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    none = F.lit(None).cast("string")
    raw = t.orders.select(
        F.col("o_custkey").alias("unit_id"), F.lit("src").alias("source_slug"), F.concat(F.lit("Rule "), (k % 4).cast("string")).alias("title"), none.alias("affected_area"), F.lit("temporary").alias("duration_type"), none.alias("effective_start"), none.alias("effective_end"),
        *(F.lit(None).cast("int").alias(c) for c in localized.SEASON), pick(k, "full", "nonsense", "stage_1").alias("status"), F.lit("prohibited").alias("campfire_policy"), F.array().cast("array<string>").alias("errors"), (k % 100 / 100.0).alias("confidence"), k.alias("fetch_id"),
    )
    rules = localized.parsed_rules(raw)
    state = history.latest_per_key(rules.where("fetch_id % 2 = 0").withColumn("at", F.col("fetch_id")), ["unit_id", "slug"], "at", "fetch_id").drop("at")
    at = lambda n: F.timestamp_seconds(F.lit(n))
    kept = localized.keep_rules(state.withColumns({"created_at": at(0), "updated_at": at(0)}), rules.where("fetch_id % 2 = 1 or fetch_id % 8 = 0"), at(1))
    return kept.select("unit_id", "slug", "fetch_id", "status", F.coalesce(F.unix_seconds("created_at").cast("int"), F.lit(0)).alias("created"), F.coalesce(F.unix_seconds("updated_at").cast("int"), F.lit(0)).alias("updated"), "review_status")


@query("""SELECT c_custkey, CAST(epoch(l) AS BIGINT) AS last_at FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS l FROM orders GROUP BY 1) ON o_custkey = c_custkey
    WHERE l IS NULL OR epoch(l) + (1 + c_custkey % 90) * 1440 * 60 <= epoch(TIMESTAMP '2001-06-01') ORDER BY l ASC NULLS FIRST, c_custkey LIMIT 25""")
def due_next(t: Tables) -> DataFrame:
    """The sources to be fetched next: those never fetched, then the longest waiting."""
    last = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("l"))
    waiting = history.due(t.customer.join(last, "c_custkey", "left"), "l", (1 + F.col("c_custkey") % 90) * 1440, F.lit("2001-06-01").cast("timestamp"))
    return waiting.orderBy(F.col("l").asc_nulls_first(), "c_custkey").limit(25).select("c_custkey", F.unix_seconds(F.col("l").cast("timestamp")).alias("last_at"))
