"""The driver's queries by name, each with the SQL that gives the same rows.

Every query applies an operator to whole tables; constants such as reference times are parameters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderline.functions import geometry, labels, text
from cinderline.operators import history, joins, merge, resolve, search, spatial, stats
from cinderline.sources import documents as pages
from cinderline.sources import sinks
from cinderline.streaming import live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
T0 = "2024-01-31 00:00:00"


class Tables:
    """tables.orders and so on, read on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def seconds(c: str | Column) -> Column:
    return F.unix_seconds(F.col(c).cast("timestamp") if isinstance(c, str) else c.cast("timestamp"))


def whole(c: str) -> Column:
    """The nearest whole number, of two the even one, as SQL casts a double."""
    return F.bround(c, 0).cast("long")


def day(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


#: Event types as statuses, in both languages.
STATUS = {"error": "full", "purchase": "stage_1", "signup": "year_round", "view": "none", "click": "unknown"}
STATUS_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUS.items()) + " END"
POLICY = {"error": "prohibited", "purchase": "developed_sites_only", "signup": "stoves_only", "view": "", "click": "unknown"}
POLICY_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in POLICY.items()) + " END"


def of_type(table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[F.col("event_type")]


# Truth resolution

CLAIMS_SQL = """c AS (SELECT o_custkey AS unit_id, o_orderpriority AS source, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS pri,
    CASE o_orderstatus WHEN 'F' THEN 'full' WHEN 'O' THEN 'none' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'stage_1' ELSE 'year_round' END END AS status,
    CASE WHEN o_orderkey % 5 = 0 THEN 'unknown' WHEN o_orderstatus = 'O' THEN 'allowed' WHEN o_orderkey % 7 = 0 THEN 'developed_sites_only' ELSE 'prohibited' END AS policy,
    (o_orderkey % 100) / 100.0 AS confidence, o_orderdate AS created_at, o_orderkey AS claim_id FROM orders
    WHERE o_orderkey % 11 <> 0 AND o_orderdate > TIMESTAMP '2000-06-01'),
    n AS (SELECT *, CASE WHEN status = 'none' AND policy = 'unknown' THEN 'allowed' ELSE policy END AS eff,
        CASE status WHEN 'full' THEN 90 WHEN 'stage_1' THEN 70 WHEN 'year_round' THEN 60 WHEN 'none' THEN 10 ELSE 0 END AS sev
        FROM c QUALIFY row_number() OVER (PARTITION BY unit_id, source ORDER BY created_at DESC, claim_id DESC) = 1),
    o AS (SELECT unit_id, bool_or(status IN ('stage_1', 'stage_2', 'full', 'closure')) AS ordered, count(*) AS candidates FROM n GROUP BY unit_id),
    k AS (SELECT n.* FROM n JOIN o USING (unit_id) WHERE NOT (ordered AND status = 'year_round')),
    t AS (SELECT unit_id, count(DISTINCT status) AS ns, count(DISTINCT eff) AS ne, min(eff) AS e1 FROM k GROUP BY unit_id),
    b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY unit_id ORDER BY sev DESC, 6 - pri DESC, confidence DESC, created_at DESC, claim_id DESC) = 1),
    r AS (SELECT unit_id, (ns > 1 AND (ne > 1 OR e1 = 'unknown')) AS conflict, status, eff, confidence, claim_id, candidates FROM b JOIN t USING (unit_id) JOIN o USING (unit_id))"""


def claims(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "full").when(F.col("o_orderstatus") == "O", "none").when(k % 2 == 0, "stage_1").otherwise("year_round")
    policy = F.when(k % 5 == 0, "unknown").when(F.col("o_orderstatus") == "O", "allowed").when(k % 7 == 0, "developed_sites_only").otherwise("prohibited")
    recent = t.orders.where(F.col("o_orderdate") > F.lit("2000-06-01").cast("timestamp"))
    return recent.select(F.col("o_custkey").alias("unit_id"), F.col("o_orderpriority").alias("source"), F.col("o_orderpriority").alias("source_type"), status.alias("status"), policy.alias("policy"), (k % 100 / 100.0).alias("confidence"), F.when(k % 11 == 0, "needs_review").otherwise("accepted").alias("review_status"), F.lit(None).cast("string").alias("scope"), F.col("o_orderdate").alias("created_at"), k.alias("claim_id"))


@query(f"""WITH {CLAIMS_SQL} SELECT c_custkey AS unit_id, CASE WHEN r.unit_id IS NULL THEN 'unknown' WHEN conflict THEN 'conflict' ELSE 'published' END AS outcome,
    CASE WHEN r.unit_id IS NULL OR conflict THEN 'unknown' ELSE status END AS status, CASE WHEN r.unit_id IS NULL OR conflict THEN 'unknown' ELSE eff END AS policy,
    CASE WHEN r.unit_id IS NULL OR conflict THEN 0.0 ELSE CAST(confidence AS DOUBLE) END AS confidence, coalesce(CASE WHEN NOT conflict THEN claim_id END, -1) AS claim_id, coalesce(candidates, 0) AS candidates
    FROM customer LEFT JOIN r ON r.unit_id = c_custkey""")
def resolve_claims(t: Tables) -> DataFrame:
    return resolve.publish(t.customer.select(F.col("c_custkey").alias("unit_id")), resolve.resolve_claims(claims(t), 6 - F.substring("source_type", 1, 1).cast("int"))).fillna(-1, ["claim_id"])


@query("SELECT user_id, event_type, event_id, round(value, 2) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_source(t: Tables) -> DataFrame:
    return history.latest_per_key(t.events.select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id", F.round("value", 2).alias("value"))


@query("""WITH f AS (SELECT user_id, ts, event_id, CASE WHEN event_type <> 'view' THEN sha256(event_type) END AS h FROM events),
    n AS (SELECT * FROM f WHERE h IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
    SELECT e.event_id, e.user_id FROM events e LEFT JOIN n USING (user_id) WHERE CASE WHEN n.h IS NULL THEN e.ts > TIMESTAMP '2024-01-31' - INTERVAL 7 DAY
    ELSE n.ts > TIMESTAMP '2024-01-31' - INTERVAL 7 DAY AND n.h = sha256(e.event_type) END""")
def freshness_filter(t: Tables) -> DataFrame:
    e = t.events.withColumn("h", F.sha2("event_type", 256))
    f = e.withColumn("fh", F.when(F.col("event_type") != "view", F.col("h")))
    return history.fresh_claims(e, f, "user_id", "h", "ts", "fh", "ts", "event_id", F.lit(T0).cast("timestamp"), 7).select("event_id", "user_id")


@query("""WITH f AS (SELECT *, CASE WHEN event_type <> 'view' THEN event_type END AS h FROM events)
    SELECT event_id, coalesce(h, last_value(h IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS h FROM f""")
def fetch_carry_forward(t: Tables) -> DataFrame:
    return history.carry_forward(t.events.withColumn("h", F.when(F.col("event_type") != "view", F.col("event_type"))), "user_id", ["ts", "event_id"], "h").select("event_id", "h")


@query("""WITH f AS (SELECT *, CASE WHEN event_type <> 'view' THEN event_type END AS h FROM events)
    SELECT event_id, h IS NOT NULL AND h IS DISTINCT FROM last_value(h IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS changed FROM f""")
def content_changed(t: Tables) -> DataFrame:
    return history.content_changed(t.events.withColumn("h", F.when(F.col("event_type") != "view", F.col("event_type"))), "user_id", ["ts", "event_id"], "h").select("event_id", "changed")


COLLAPSED_SQL = f"""e AS (SELECT user_id, ts, event_id, {STATUS_SQL} AS status, CASE WHEN {STATUS_SQL} = 'none' AND {POLICY_SQL} IN ('', 'unknown') THEN 'allowed' WHEN {POLICY_SQL} = '' THEN 'unknown' ELSE {POLICY_SQL} END AS policy FROM events),
    l AS (SELECT *, lag(status) OVER w AS from_status, lag(policy) OVER w AS from_policy, row_number() OVER w AS n FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    x AS (SELECT * FROM l WHERE n = 1 OR status IS DISTINCT FROM from_status OR policy IS DISTINCT FROM from_policy)"""


def collapsed(t: Tables) -> DataFrame:
    e = t.events.select("user_id", "ts", "event_id", of_type(STATUS).alias("status"), labels.effective_policy(of_type(STATUS), of_type(POLICY)).alias("policy"))
    return history.collapse_repeats(e, "user_id", ["ts", "event_id"], "status", "policy")


@query(f"WITH {COLLAPSED_SQL} SELECT user_id, event_id, status, policy, from_status, from_policy FROM x")
def collapse_repeats(t: Tables) -> DataFrame:
    return collapsed(t).select("user_id", "event_id", "status", "policy", "from_status", "from_policy")


@query(f"""WITH {COLLAPSED_SQL}, r AS (SELECT *, CASE policy WHEN 'allowed' THEN 0 WHEN 'developed_sites_only' THEN 2 WHEN 'stoves_only' THEN 3 WHEN 'prohibited' THEN 4 ELSE -1 END AS a,
    CASE from_policy WHEN 'allowed' THEN 0 WHEN 'developed_sites_only' THEN 2 WHEN 'stoves_only' THEN 3 WHEN 'prohibited' THEN 4 ELSE -1 END AS b FROM x)
    SELECT user_id, event_id, CASE WHEN from_policy IS NULL THEN 'first' WHEN a < 0 OR b < 0 THEN 'updated' WHEN a > b THEN 'tightened' WHEN a < b THEN 'eased' ELSE 'updated' END AS direction FROM r""")
def change_direction(t: Tables) -> DataFrame:
    return collapsed(t).select("user_id", "event_id", labels.direction(F.col("from_policy"), F.col("policy")).alias("direction"))


@query(f"""WITH {COLLAPSED_SQL} SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, arg_min(status, (ts, event_id)) AS first_value, arg_max(status, (ts, event_id)) AS last_value FROM x GROUP BY 1""")
def change_log_days(t: Tables) -> DataFrame:
    return history.change_log_days(collapsed(t), "ts", "event_id", "status")


@query("""WITH l AS (SELECT user_id, min(ts) AS live FROM events WHERE ts >= TIMESTAMP '2024-01-24' AND event_type = 'purchase' GROUP BY user_id)
    SELECT event_id, e.user_id FROM events e LEFT JOIN l USING (user_id) WHERE live IS NULL OR ts < live""")
def backfill_before_live(t: Tables) -> DataFrame:
    e = t.events
    return history.before_live(e, e.where((F.col("ts") >= F.lit("2024-01-24").cast("timestamp")) & (F.col("event_type") == "purchase")), "user_id", "ts").select("event_id", "user_id")


@query("""SELECT c_custkey, CAST(epoch(l) AS BIGINT) AS last_at FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS l FROM orders GROUP BY 1) ON o_custkey = c_custkey
    WHERE l IS NULL OR epoch(l) + (1 + c_custkey % 90) * 1440 * 60 <= epoch(TIMESTAMP '2001-06-01')""")
def due_sources(t: Tables) -> DataFrame:
    last = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("l"))
    return history.due(t.customer.join(last, "c_custkey", "left"), "l", (1 + F.col("c_custkey") % 90) * 1440, F.lit("2001-06-01").cast("timestamp")).select("c_custkey", seconds("l").alias("last_at"))


@query("SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS copies, min(source) AS source FROM documents GROUP BY 1")
def document_dedup(t: Tables) -> DataFrame:
    return t.documents.groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.min("source").alias("source"))


# Text and search

MESSY_SQL = "(CASE p_partkey % 4 WHEN 0 THEN 'Mt. ' WHEN 1 THEN 'N''ville & ' WHEN 2 THEN 'Big Lk—' ELSE 'Old ' END || upper(p_name) || CASE p_partkey % 3 WHEN 0 THEN ' CG' WHEN 1 THEN ' NF' ELSE ' Trl #' || p_size END)"
NORMAL_SQL = """array_to_string(list_transform(list_filter(string_split(regexp_replace(regexp_replace(replace(lower(m), '&', ' and '), '[''`]', '', 'g'), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> ''),
    lambda w: CASE w WHEN 'mt' THEN 'mount' WHEN 'lk' THEN 'lake' WHEN 'cg' THEN 'campground' WHEN 'nf' THEN 'national forest' WHEN 'trl' THEN 'trail' ELSE w END), ' ')"""


def messy() -> Column:
    k = F.col("p_partkey")
    head = F.when(k % 4 == 0, "Mt. ").when(k % 4 == 1, "N'ville & ").when(k % 4 == 2, "Big Lk—").otherwise("Old ")
    tail = F.when(k % 3 == 0, F.lit(" CG")).when(k % 3 == 1, F.lit(" NF")).otherwise(F.concat(F.lit(" Trl #"), F.col("p_size").cast("string")))
    return F.concat(head, F.upper("p_name"), tail)


@query(f"SELECT p_partkey, {NORMAL_SQL} AS name FROM (SELECT p_partkey, {MESSY_SQL} AS m FROM part)")
def normalize_names(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", text.normalize_name(messy()).alias("name"))


@query(f"""SELECT p_partkey, array_to_string(list_filter(string_split(regexp_replace({NORMAL_SQL}, '\\b(national forest|forest|wilderness|campground|trailhead)\\b', '', 'g'), ' '), lambda w: w <> ''), '-') AS slug,
    regexp_replace(left(regexp_replace(regexp_replace(lower(m), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 12), '-+$', '') AS short_slug,
    regexp_replace(regexp_replace(lower(m), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS snake FROM (SELECT p_partkey, {MESSY_SQL} AS m FROM part)""")
def slugify(t: Tables) -> DataFrame:
    m = messy()
    return t.part.select("p_partkey", text.slugify(m).alias("slug"), text.short_slug(m, 12).alias("short_slug"), text.snake(m).alias("snake"))


@query("""WITH c AS (SELECT p_partkey AS place_id, p_name AS name, p_size AS weight, CAST(p_retailprice AS BIGINT) % 50 AS search_rank, p_type FROM part
    WHERE p_name LIKE '%red widget%' OR p_type IN ('PROMO') ORDER BY search_rank DESC, weight DESC, name, place_id LIMIT 360)
    SELECT place_id, name, CAST(search_rank + weight + 20 + CASE WHEN name = 'red widget' THEN 1000 ELSE 0 END + CASE WHEN contains('red widget', name) THEN 1000 ELSE 0 END + CASE WHEN starts_with(name, 'red widget') THEN 650 ELSE 0 END
    + CASE WHEN contains(name, 'red widget') THEN 420 ELSE 0 END + CASE WHEN contains(name, 'red') AND contains(name, 'widget') THEN 180 ELSE 0 END + CASE WHEN p_type = 'PROMO' THEN 760 ELSE 0 END AS BIGINT) AS score,
    CASE WHEN name = 'red widget' THEN 'exact' WHEN starts_with(name, 'red widget') THEN 'prefix' WHEN contains(name, 'red widget') THEN 'contains' WHEN contains('red widget', name) THEN 'name_with_context' ELSE 'token' END AS match_type
    FROM c ORDER BY score DESC, name, place_id LIMIT 8""")
def place_search(t: Tables) -> DataFrame:
    names = t.part.select(F.col("p_partkey").alias("place_id"), F.col("p_name").alias("name"), F.col("p_name").alias("normalized_name"), F.col("p_size").alias("weight"), (whole("p_retailprice") % 50).alias("search_rank"), F.col("p_type").alias("place_type"))
    return search.search_places(names, "red widget", ["PROMO"])


@query("""SELECT o_orderkey, CASE WHEN k THEN false WHEN s <= e THEN n BETWEEN s AND e ELSE n >= s OR n <= e END AS active FROM (SELECT o_orderkey, (1 + o_orderkey % 12) * 100 + 1 + o_orderkey % 31 AS s, (1 + (o_orderkey // 12) % 12) * 100 + 1 + (o_orderkey // 7) % 31 AS e, month(o_orderdate) * 100 + day(o_orderdate) AS n,
    try_cast(printf('%04d-%02d-%02d', year(o_orderdate), CAST(1 + o_orderkey % 12 AS INT), CAST(1 + o_orderkey % 31 AS INT)) AS DATE) IS NULL OR try_cast(printf('%04d-%02d-%02d', year(o_orderdate), CAST(1 + (o_orderkey // 12) % 12 AS INT), CAST(1 + (o_orderkey // 7) % 31 AS INT)) AS DATE) IS NULL AS k FROM orders)""")
def season_rules(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    part = lambda d, n: (1 + F.floor(k / d) % n).cast("int")
    return t.orders.select("o_orderkey", labels.season_active(part(1, 12), part(1, 31), part(12, 12), part(7, 31), F.col("o_orderdate")).alias("active"))


@query("""SELECT d.doc_id, count(*) AS items, min(item_id) AS first_item FROM documents d JOIN benchmark b ON contains(trim(regexp_replace(d.text, '\\s+', ' ', 'g')), trim(regexp_replace(b.text, '\\s+', ' ', 'g'))) GROUP BY 1""")
def evidence_check(t: Tables) -> DataFrame:
    found = search.passages_in_texts(t.documents, t.benchmark, "doc_id", "item_id")
    return found.groupBy("doc_id").agg(F.count_distinct("item_id").alias("items"), F.min("item_id").alias("first_item"))


@query("""SELECT doc_id, CASE WHEN hard THEN 'needs_review' WHEN auto AND conf >= 0.8 THEN 'auto_accepted' WHEN official AND (CASE WHEN status = 'none' THEN conf >= 0.85 AND clear ELSE status IN ('full', 'stage_1') AND conf >= 0.9 END) THEN 'auto_accepted' ELSE 'needs_review' END AS decision
    FROM (SELECT d.doc_id, (d.doc_id % 20) / 20.0 + 0.05 AS conf, d.doc_id % 3 = 0 AS auto, lang = 'en' AS official, coalesce(toxic, 0) = 1 AS hard, coalesce(quality, 0) = 1 AS clear,
    CASE d.doc_id % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'full' WHEN 2 THEN 'stage_1' ELSE 'unknown' END AS status FROM documents d LEFT JOIN labels l USING (doc_id))""")
def review_decision(t: Tables) -> DataFrame:
    k = F.col("doc_id")
    d = t.documents.join(t.labels, "doc_id", "left")
    status = F.when(k % 4 == 0, "none").when(k % 4 == 1, "full").when(k % 4 == 2, "stage_1").otherwise("unknown")
    conf = (k % 20).cast("decimal(10,0)") / F.lit(20).cast("decimal(10,1)") + F.lit(0.05).cast("decimal(3,2)")
    is_one = lambda c: F.coalesce(F.col(c), F.lit(0)) == 1
    return d.select("doc_id", labels.review_decision(status, conf.cast("double"), F.col("lang") == "en", k % 3 == 0, is_one("toxic"), is_one("quality")).alias("decision"))


LADDER = ((r"no fire|lifted|rescinded", "none"), (r"stage\s*2|password|token", "stage_2"), (r"license|released", "stage_1"), (r"idiot|moron.{0,80}", "full"))


@query("""SELECT doc_id, CASE WHEN regexp_matches(l, 'no fire|lifted|rescinded') THEN 'none' WHEN regexp_matches(l, 'stage\\s*2|password|token') THEN 'stage_2' WHEN regexp_matches(l, 'license|released') THEN 'stage_1' WHEN regexp_matches(l, 'idiot|moron.{0,80}') THEN 'full' ELSE 'unknown' END AS status
    FROM (SELECT doc_id, lower(text) AS l FROM documents)""")
def keyword_classifier(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", labels.keyword_class(F.col("text"), LADDER).alias("status"))


# Aggregations

@query("""SELECT o_orderpriority, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS active, count(*) FILTER (o_orderstatus = 'O') AS none, count(*) FILTER (o_orderstatus = 'P') AS unknown FROM orders GROUP BY 1""")
def bucket_partition(t: Tables) -> DataFrame:
    is_ = lambda s: F.col("o_orderstatus") == s
    return stats.bucket_counts(t.orders, ["o_orderpriority"], {"active": is_("F"), "none": is_("O"), "unknown": is_("P")})


MODES = ("prohibited", "stoves_only", "developed_sites_only", "fire_pan_required", "propane_allowed", "allowed", "unknown")


@query("""WITH p AS (SELECT l_orderkey, l_tax, l_discount, CAST(l_partkey % 7 AS INTEGER) AS i FROM lineitem)
    SELECT l_orderkey, ['prohibited', 'stoves_only', 'developed_sites_only', 'fire_pan_required', 'propane_allowed', 'allowed', 'unknown'][min(i) + 1] AS policy, round(min(least(l_tax, l_discount)), 4) AS confidence FROM p GROUP BY 1""")
def strongest_policy(t: Tables) -> DataFrame:
    mode = F.element_at(F.array(*map(F.lit, MODES)), (F.col("l_partkey") % 7 + 1).cast("int"))
    return t.lineitem.withColumn("mode", mode).groupBy("l_orderkey").agg(resolve.first_in_precedence(F.col("mode")).alias("policy"), F.round(F.min(F.least("l_tax", "l_discount")), 4).alias("confidence"))


@query("""WITH c AS (SELECT c_nationkey AS unit, c_mktsegment AS name, min_by(c_custkey, c_custkey) AS v FROM customer GROUP BY 1, 2), u AS (SELECT c_mktsegment || '/' || CAST(c_acctbal AS BIGINT) % 400 AS name, max(c_custkey) AS v FROM customer GROUP BY 1 HAVING count(*) = 1),
    s AS (SELECT s_suppkey, s_nationkey AS unit, CASE WHEN s_suppkey % 2 = 0 THEN 'BUILDING' ELSE 'MACHINERY/' || CAST(s_acctbal AS BIGINT) % 400 END AS name FROM supplier)
    SELECT s_suppkey, coalesce(CASE WHEN s_suppkey % 2 = 0 THEN c.v END, u.v, -1) AS c_custkey FROM s LEFT JOIN c ON s.unit = c.unit AND s.name = c.name LEFT JOIN u ON s.name = u.name""")
def exact_then_unique_join(t: Tables) -> DataFrame:
    rest = lambda c: (whole(c) % 400).cast("string")
    left = t.supplier.select("s_suppkey", F.col("s_nationkey").alias("unit"), F.when(F.col("s_suppkey") % 2 == 0, F.lit("BUILDING")).otherwise(F.concat(F.lit("MACHINERY/"), rest("s_acctbal"))).alias("name"))
    c = t.customer
    segment = c.select(F.col("c_nationkey").alias("unit"), F.col("c_mktsegment").alias("name"), "c_custkey")
    fine = c.select(F.lit(-1).alias("unit"), F.concat("c_mktsegment", F.lit("/"), rest("c_acctbal")).alias("name"), "c_custkey")
    return joins.exact_then_unique(left, segment.unionByName(fine), ["unit", "name"], "name", "c_custkey", "c_custkey").select("s_suppkey", "c_custkey").fillna(-1)


@query("""SELECT o_orderkey, coalesce(l_quantity, -1) AS quantity, coalesce(l_linenumber, -1) AS l_linenumber FROM orders LEFT JOIN (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice) = 1) ON l_orderkey = o_orderkey""")
def first_perimeter_join(t: Tables) -> DataFrame:
    order = [F.col(c) for c in ("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")]
    lines = t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey")
    return joins.with_first(t.orders.select("o_orderkey"), lines, "o_orderkey", *order).select("o_orderkey", F.coalesce("l_quantity", F.lit(-1.0)).alias("quantity"), F.coalesce("l_linenumber", F.lit(-1)).alias("l_linenumber"))


@query("""SELECT c_custkey, m AS month FROM customer CROSS JOIN (SELECT CAST(unnest(range(1, 13)) AS INTEGER) AS m) EXCEPT SELECT o_custkey, CAST(month(o_orderdate) AS INTEGER) FROM orders""")
def missing_months(t: Tables) -> DataFrame:
    there = t.orders.select(F.col("o_custkey").alias("c_custkey"), F.month("o_orderdate").alias("month"))
    return joins.missing_combinations(t.customer, there, "c_custkey", "month", list(range(1, 13)))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 250000)")
def must_match(t: Tables) -> DataFrame:
    """The customers that a check for large closed orders would stop at."""
    large = t.orders.where("o_orderstatus = 'F' and o_totalprice > 250000").select(F.col("o_custkey").alias("c_custkey"))
    return joins.unmatched(t.customer, large, ["c_custkey"]).select("c_custkey", "c_name")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') OR c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def indexable_union(t: Tables) -> DataFrame:
    key = lambda df: df.select(F.col("o_custkey").alias("c_custkey"))
    near = t.customer.join(t.nation.where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey")), "c_nationkey", "left_semi").select("c_custkey")
    return joins.any_flag(t.customer, "c_custkey", key(t.orders.where("o_totalprice > 400000")), key(t.orders.where("o_orderpriority = '1-URGENT'")), near).select("c_custkey")


@query("""WITH u AS (SELECT 0 AS side, s_nationkey AS nation, s_suppkey AS id FROM supplier UNION ALL SELECT 1, c_nationkey, c_custkey FROM customer) SELECT nation, id FROM u QUALIFY row_number() OVER (PARTITION BY nation ORDER BY side, id) = 1""")
def dedup_union_first(t: Tables) -> DataFrame:
    return joins.union_first("nation", "id", t.supplier.select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("id")), t.customer.select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("id")))


MERGE_SQL = """s AS (SELECT user_id, arg_max(value, (ts, event_id)) AS acres, arg_max(CASE WHEN event_type <> 'view' THEN event_type END, (ts, event_id)) FILTER (event_type <> 'view') AS shape, floor(epoch(max(ts)))::BIGINT AS seen FROM events WHERE ts < TIMESTAMP '2024-01-02' GROUP BY 1),
    n AS (SELECT * FROM (SELECT user_id, value AS acres, CASE WHEN event_type <> 'view' THEN event_type END AS shape, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE ts >= TIMESTAMP '2024-01-29') WHERE r = 1)"""


@query(f"""WITH {MERGE_SQL} SELECT coalesce(s.user_id, n.user_id) AS user_id, round(CASE WHEN n.user_id IS NOT NULL THEN n.acres ELSE s.acres END, 4) AS acres, CASE WHEN n.user_id IS NOT NULL AND n.shape IS NOT NULL THEN n.shape ELSE s.shape END AS shape,
    n.user_id IS NOT NULL AS active, coalesce(s.seen, 0) AS first_seen, CASE WHEN n.user_id IS NOT NULL THEN 0 ELSE s.seen END AS last_seen FROM s FULL JOIN n ON s.user_id = n.user_id""")
def snapshot_merge(t: Tables) -> DataFrame:
    shape = F.when(F.col("event_type") != "view", F.col("event_type"))
    when = F.struct("ts", "event_id")
    old = t.events.where(F.col("ts") < F.lit("2024-01-02").cast("timestamp"))
    state = old.groupBy("user_id").agg(F.max_by("value", when).alias("acres"), F.max_by(shape, F.when(shape.isNotNull(), when)).alias("shape"), F.max(seconds("ts")).alias("last_seen")).select("user_id", "acres", "shape", F.lit(True).alias("active"), F.col("last_seen").alias("first_seen"), "last_seen")
    new = history.latest_per_key(t.events.where(F.col("ts") >= F.lit("2024-01-29").cast("timestamp")).select("user_id", "ts", "event_id", F.col("value").alias("acres"), shape.alias("shape")), "user_id", "ts", "event_id").select("user_id", "acres", "shape")
    return merge.snapshot_merge(state, new, "user_id", [["shape"]], F.lit(0).cast("long")).withColumn("acres", F.round("acres", 4))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'insert' WHEN o_orderkey % 7 = 0 THEN 'changed' WHEN o_orderkey % 3 = 0 THEN 'neutral' ELSE 'same' END AS action, CASE WHEN o_orderkey % 10 = 0 OR o_orderkey % 7 = 0 THEN 'needs_review' ELSE 'accepted' END AS review_status FROM orders""")
def fingerprint_upsert(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    state = t.orders.where(k % 10 != 0).select("o_orderkey", "o_orderstatus", "o_orderpriority", F.lit("accepted").alias("review_status"))
    new = t.orders.select("o_orderkey", F.when(k % 7 == 0, F.concat("o_orderstatus", F.lit("!"))).otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), F.when(k % 3 == 0, F.lit("moved")).otherwise(F.col("o_orderpriority")).alias("o_orderpriority"), F.lit("accepted").alias("review_status"))
    return merge.fingerprint_upsert(state, new, "o_orderkey", ["o_orderkey", "o_orderstatus"], ["o_orderpriority"]).select("o_orderkey", "action", "review_status")


BANDS_SQL = """b AS (SELECT CAST(month(l_shipdate) AS INTEGER) AS month, CAST(p_size // 10 * 10 AS INTEGER) AS band, avg(l_extendedprice) AS mean, quantile_cont(l_extendedprice, 0.1) AS p10, quantile_cont(l_extendedprice, 0.9) AS p90, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)"""


def bands(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_size"), "l_partkey").withColumn("month", F.month("l_shipdate"))
    return stats.band_stats(rows, ["month"], (F.floor(F.col("p_size") / 10) * 10).cast("int"), "l_extendedprice", ["month"])


@query(f"WITH {BANDS_SQL} SELECT month, band, round(mean, 4) AS mean, round(p10, 4) AS p10, round(p90, 4) AS p90, n, round(n * 100.0 / sum(n) OVER (PARTITION BY month), 6) AS share FROM b")
def band_stats(t: Tables) -> DataFrame:
    return bands(t).select("month", "band", *(F.round(c, 4).alias(c) for c in ("mean", "p10", "p90")), "n", F.round("share", 6).alias("share"))


@query(f"WITH {BANDS_SQL} SELECT month, round(lo, 2) AS lowest, round(hi, 2) AS highest, n AS bands FROM (SELECT month, arg_min(mean, band) AS lo, arg_max(mean, band) AS hi, count(*) AS n FROM b GROUP BY 1) WHERE n > 1 AND hi - lo > 5")
def band_inversion(t: Tables) -> DataFrame:
    return stats.inverted(bands(t), ["month"], "band", "mean", 5.0).select("month", F.round("lowest", 2).alias("lowest"), F.round("highest", 2).alias("highest"), "bands")


@query("""SELECT event_type, CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) AS tokens_in, CAST(sum(event_id % 50) AS BIGINT) AS tokens_out, round(sum(round(CAST(floor(value * 100) AS BIGINT) * p / 1e6 + (event_id % 50) * q / 1e6, 8)), 4) AS cost
    FROM (SELECT *, CASE WHEN event_type = 'purchase' THEN 3.0 ELSE 1.0 END AS p, CASE WHEN event_type = 'purchase' THEN 15.0 ELSE 5.0 END AS q FROM events) GROUP BY 1""")
def cost_rollup(t: Tables) -> DataFrame:
    dear = F.col("event_type") == "purchase"
    return stats.cost_rollup(t.events, ["event_type"], F.floor(F.col("value") * 100), F.col("event_id") % 50, F.when(dear, 3.0).otherwise(1.0), F.when(dear, 15.0).otherwise(5.0)).withColumn("cost", F.round("cost", 4))


@query("SELECT o_orderkey, o_custkey, o_orderpriority, row_number() OVER (ORDER BY o_orderkey) AS place, CAST(ceil(row_number() OVER (ORDER BY o_orderkey) / 450.0) AS BIGINT) AS page FROM orders")
def page_assign(t: Tables) -> DataFrame:
    return stats.page_assign(t.orders.select("o_orderkey", "o_custkey", "o_orderpriority"), "o_orderkey", 450)


@query("""SELECT CAST(ceil(row_number() OVER (ORDER BY u) / 40.0) AS BIGINT) AS page, '<url><loc>' || replace(replace(replace(replace(replace(u, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&apos;') || '</loc>' || CASE WHEN page_id % 3 = 0 THEN '' ELSE '<lastmod>2024-01-' || printf('%02d', 1 + page_id % 28) || '</lastmod>' END || '</url>' AS value
    FROM (SELECT page_id, url, url || '?a=' || page_id || '&b' AS u FROM pages)""")
def sitemap(t: Tables) -> DataFrame:
    day_of = F.when(F.col("page_id") % 3 != 0, F.make_date(F.lit(2024), F.lit(1), (1 + F.col("page_id") % 28).cast("int")))
    return sinks.sitemap_entries(t.pages.select(F.concat("url", F.lit("?a="), F.col("page_id").cast("string"), F.lit("&b")).alias("u"), day_of.alias("at")), "u", "at", 40)


@query(" UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n FROM {n}" for n in TABLES))
def dashboard_counts(t: Tables) -> DataFrame:
    return stats.table_counts({n: getattr(t, n) for n in TABLES})


@query("SELECT o_orderkey, CAST(CASE WHEN month(o_orderdate) * 100 + day(o_orderdate) BETWEEN 601 AND 930 THEN least(60 + o_orderkey % 2000, 720) ELSE 60 + o_orderkey % 2000 END AS BIGINT) AS minutes FROM orders")
def seasonal_cap(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", labels.poll_minutes(60 + F.col("o_orderkey") % 2000, F.col("o_orderdate"), 720).cast("long").alias("minutes"))


# Space

def lon() -> Column:
    return F.col("embedding")[0].cast("double")


def lat() -> Column:
    return F.col("embedding")[1].cast("double")


@query("SELECT label, min(embedding[1])::DOUBLE AS min_x, min(embedding[2])::DOUBLE AS min_y, max(embedding[1])::DOUBLE AS max_x, max(embedding[2])::DOUBLE AS max_y FROM embeddings GROUP BY 1")
def bbox_of_points(t: Tables) -> DataFrame:
    return t.embeddings.groupBy("label").agg(F.min(lon()).alias("min_x"), F.min(lat()).alias("min_y"), F.max(lon()).alias("max_x"), F.max(lat()).alias("max_y"))


@query("""WITH a AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), b AS (SELECT vec_id, x - 0.01 AS x0, y - 0.01 AS y0, x + 0.01 AS x1, y + 0.01 AS y1 FROM a)
    SELECT l.vec_id AS a_id, r.vec_id AS b_id FROM b l JOIN b r ON l.x0 <= r.x1 AND l.x1 >= r.x0 AND l.y0 <= r.y1 AND l.y1 >= r.y0""")
def bbox_overlap_join(t: Tables) -> DataFrame:
    boxes = t.embeddings.select("vec_id", (lon() - 0.01).alias("min_x"), (lat() - 0.01).alias("min_y"), (lon() + 0.01).alias("max_x"), (lat() + 0.01).alias("max_y"))
    return spatial.box_join(boxes.withColumnRenamed("vec_id", "a_id"), boxes.withColumnRenamed("vec_id", "b_id"), "a_id", "b_id", 0.05)


SHAPES = {1: [(-0.2, -0.2), (0.2, -0.15), (0.05, 0.22)], 2: [(0.0, 0.0), (0.3, 0.0), (0.3, 0.3), (0.15, 0.1), (0.0, 0.3)], 3: [(-0.3, 0.1), (-0.1, 0.1), (-0.1, 0.3), (-0.3, 0.3)]}
EDGES_SQL = "e(pid, ax, ay, cx, cy) AS (VALUES " + ", ".join(f"({k}, {ax}::DOUBLE, {ay}::DOUBLE, {bx}::DOUBLE, {by}::DOUBLE)" for k, r in SHAPES.items() for (ax, ay), (bx, by) in zip(r, [*r[1:], r[0]], strict=True)) + ")"


def shapes(spark: SparkSession) -> DataFrame:
    one = spark.range(1)
    parts = [one.select(F.lit(k).alias("pid"), geometry.ring_of(r).alias("ring")) for k, r in SHAPES.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"""WITH {EDGES_SQL}, p AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)
    SELECT vec_id, pid FROM p JOIN e ON (ay > y) <> (cy > y) AND x < ax + (y - ay) / (cy - ay) * (cx - ax) GROUP BY 1, 2 HAVING count(*) % 2 = 1""")
def point_in_polygon(t: Tables) -> DataFrame:
    polygons = shapes(t.spark).select("pid", F.array("ring").alias("rings"))
    return spatial.points_in_polygons(t.embeddings.select("vec_id", lon().alias("x"), lat().alias("y")), polygons, "vec_id", "pid", 0.1)


@query("""WITH g AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, 0.01 + (vec_id % 7) / 90.0 AS s FROM embeddings), c AS (SELECT vec_id, x, y, s, [x, x + 2 * s, x + s, x + 2 * s, x - s] AS px, [y, y - s, y + s, y + 3 * s, y + 2 * s] AS py FROM g),
    e AS (SELECT vec_id, x, y, px[i] - x AS ax, py[i] - y AS ay, px[i % 5 + 1] - x AS cx, py[i % 5 + 1] - y AS cy FROM c, (SELECT unnest([1, 2, 3, 4, 5]) AS i))
    SELECT vec_id, round(sum(ax * cy - cx * ay) / 2, 8) AS area, round(any_value(x) + sum((ax + cx) * (ax * cy - cx * ay)) / (3 * sum(ax * cy - cx * ay)), 6) AS x, round(any_value(y) + sum((ay + cy) * (ax * cy - cx * ay)) / (3 * sum(ax * cy - cx * ay)), 6) AS y FROM e GROUP BY 1""")
def polygon_centroid_area(t: Tables) -> DataFrame:
    """Of a concave ring at each spot."""
    s = 0.01 + F.col("vec_id") % 7 / 90.0
    corner = lambda i, j: F.struct((lon() + i * s).alias("x"), (lat() + j * s).alias("y"))
    rings = t.embeddings.select("vec_id", F.array(corner(0, 0), corner(2, -1), corner(1, 1), corner(2, 3), corner(-1, 2)).alias("ring"))
    c = geometry.ring_centroid(F.col("ring"))
    return rings.select("vec_id", F.round(geometry.ring_area(F.col("ring")), 8).alias("area"), F.round(c["x"], 6).alias("x"), F.round(c["y"], 6).alias("y"))


NEAR_SQL = """p AS (SELECT vec_id, embedding[1]::DOUBLE * 10 - 120 AS lon, embedding[2]::DOUBLE * 10 + 44 AS lat, (vec_id % 10) * 120.0 AS acres, label FROM embeddings),
    d AS (SELECT a.vec_id AS point_id, b.vec_id AS incident_id, b.acres, greatest(0, sqrt(((b.lon - a.lon) * pi() / 180 * 6378137.0 * cos(radians(a.lat))) ** 2 + ((b.lat - a.lat) * pi() / 180 * 6378137.0) ** 2) / 1609.344 - greatest(sqrt(b.acres * 4046.86 / pi()), 500.0) / 1609.344) AS miles FROM p a CROSS JOIN p b),
    x AS (SELECT *, CASE WHEN miles <= 0 THEN 'inside' WHEN miles <= 10 THEN 'near' WHEN miles <= 30 AND acres >= 100 THEN 'regional' END AS tier FROM d)"""


def near_pairs(t: Tables) -> DataFrame:
    p = t.embeddings.select("vec_id", (lon() * 10 - 120).alias("lon"), (lat() * 10 + 44).alias("lat"), (F.col("vec_id") % 10 * 120.0).alias("acres"), "label")
    return spatial.proximity(p.withColumnRenamed("vec_id", "point_id"), p.withColumnRenamed("vec_id", "incident_id"), "point_id", "incident_id")


@query(f"WITH {NEAR_SQL} SELECT point_id, incident_id, round(miles, 4) AS miles, tier FROM x WHERE tier IS NOT NULL")
def proximity_tiers(t: Tables) -> DataFrame:
    return near_pairs(t).withColumn("miles", geometry.rounded_miles(F.col("miles")))


@query(f"WITH {NEAR_SQL} SELECT point_id, CASE max(CASE tier WHEN 'inside' THEN 3 WHEN 'near' THEN 2 ELSE 1 END) WHEN 3 THEN 'inside' WHEN 2 THEN 'near' ELSE 'regional' END AS tier, count(*) AS n, round(min(miles), 4) AS nearest FROM x WHERE tier IS NOT NULL GROUP BY 1")
def incident_status_rollup(t: Tables) -> DataFrame:
    return spatial.tier_rollup(near_pairs(t), "point_id").withColumn("nearest", F.round("nearest", 4))


@query("""WITH p AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)
    SELECT a.vec_id, b.vec_id AS feature_id, round((a.x - b.x) ** 2 + (a.y - b.y) ** 2, 10) AS d2 FROM p a JOIN p b ON a.label = b.label AND a.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY (a.x - b.x) ** 2 + (a.y - b.y) ** 2, b.vec_id) = 1""")
def nearest_feature(t: Tables) -> DataFrame:
    p = t.embeddings.select("vec_id", "label", lon().alias("x"), lat().alias("y"))
    return spatial.nearest_feature(p, p.withColumnRenamed("vec_id", "feature_id"), "vec_id", "feature_id", "label", 0.05).withColumn("d2", F.round("d2", 10))


TRIANGLES_SQL = """t AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, 0.01 + (vec_id % 7) / 200.0 AS s FROM embeddings),
    g AS (SELECT vec_id, label, s, [x - s, x + s, x] AS px, [y - s, y - s, y + s] AS py FROM t),
    e AS (SELECT vec_id, label, i, px[i] AS ax, py[i] AS ay, px[i % 3 + 1] AS bx, py[i % 3 + 1] AS cy FROM g, (SELECT unnest([1, 2, 3]) AS i)),
    c AS (SELECT a.vec_id AS a_id, b.vec_id AS b_id FROM g a JOIN g b ON a.label = 1 AND b.label = 2 AND a.px[1] <= b.px[2] AND b.px[1] <= a.px[2] AND a.py[1] <= b.py[3] AND b.py[1] <= a.py[3]),
    m AS (SELECT DISTINCT a_id, b_id FROM c JOIN e p ON p.vec_id = a_id JOIN e q ON q.vec_id = b_id
        WHERE sign((p.bx - p.ax) * (q.ay - p.ay) - (p.cy - p.ay) * (q.ax - p.ax)) * sign((p.bx - p.ax) * (q.cy - p.ay) - (p.cy - p.ay) * (q.bx - p.ax)) <= 0
        AND sign((q.bx - q.ax) * (p.ay - q.ay) - (q.cy - q.ay) * (p.ax - q.ax)) * sign((q.bx - q.ax) * (p.cy - q.ay) - (q.cy - q.ay) * (p.bx - q.ax)) <= 0),
    i AS (SELECT a_id, b_id FROM c JOIN e q ON q.vec_id = b_id JOIN g p ON p.vec_id = a_id WHERE (q.ay > p.py[1]) <> (q.cy > p.py[1]) AND p.px[1] < q.ax + (p.py[1] - q.ay) / (q.cy - q.ay) * (q.bx - q.ax) GROUP BY 1, 2 HAVING count(*) % 2 = 1
        UNION SELECT a_id, b_id FROM c JOIN e q ON q.vec_id = a_id JOIN g p ON p.vec_id = b_id WHERE (q.ay > p.py[1]) <> (q.cy > p.py[1]) AND p.px[1] < q.ax + (p.py[1] - q.ay) / (q.cy - q.ay) * (q.bx - q.ax) GROUP BY 1, 2 HAVING count(*) % 2 = 1)"""


def triangles(t: Tables) -> DataFrame:
    s = 0.01 + F.col("vec_id") % 7 / 200.0
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    ring = F.array(corner(lon() - s, lat() - s), corner(lon() + s, lat() - s), corner(lon(), lat() + s))
    return t.embeddings.select("vec_id", "label", F.array(ring).alias("rings"))


@query(f"WITH {TRIANGLES_SQL} SELECT * FROM m UNION SELECT * FROM i")
def polygon_intersects(t: Tables) -> DataFrame:
    g = triangles(t)
    return spatial.polygon_pairs(g.where("label = 1").withColumnRenamed("vec_id", "a_id"), g.where("label = 2").withColumnRenamed("vec_id", "b_id"), "a_id", "b_id", 0.05)


@query("""WITH b AS (SELECT vec_id, embedding[1]::DOUBLE * 10 - 120 AS x, embedding[2]::DOUBLE * 10 + 44 AS y, 0.01 + (vec_id % 7) / 20.0 AS s, (vec_id % 10) * 120.0 AS acres, label FROM embeddings),
    k AS (SELECT a.vec_id AS boundary_id, q.vec_id AS incident_id, q.acres, a.s * pi() / 180 * 6378137.0 * cos(radians(a.y)) AS w, a.s * pi() / 180 * 6378137.0 AS h,
        (q.x - a.x) * pi() / 180 * 6378137.0 * cos(radians(a.y)) AS u, (q.y - a.y) * pi() / 180 * 6378137.0 AS v FROM b a JOIN b q ON a.label = 1 AND q.label = 2),
    d AS (SELECT *, greatest(0, sqrt(greatest(abs(u) - w, 0) ** 2 + greatest(abs(v) - h, 0) ** 2) - greatest(sqrt(acres * 4046.86 / pi()), 500.0)) / 1609.344 AS miles FROM k),
    x AS (SELECT *, CASE WHEN miles <= 0 THEN 'inside' WHEN miles <= 10 THEN 'near' WHEN miles <= 30 AND acres >= 100 THEN 'regional' END AS tier FROM d)
    SELECT boundary_id, incident_id, round(miles, 4) AS miles, tier FROM x WHERE tier IS NOT NULL""")
def boundary_proximity(t: Tables) -> DataFrame:
    x, y, s = lon() * 10 - 120, lat() * 10 + 44, 0.01 + F.col("vec_id") % 7 / 20.0
    corner = lambda i, j: F.struct((x + i * s).alias("x"), (y + j * s).alias("y"))
    squares = t.embeddings.where("label = 1").select(F.col("vec_id").alias("boundary_id"), F.array(F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1))).alias("rings"))
    none = F.lit(None).cast("array<array<struct<x:double,y:double>>>")
    fires = t.embeddings.where("label = 2").select(F.col("vec_id").alias("incident_id"), x.alias("lon"), y.alias("lat"), (F.col("vec_id") % 10 * 120.0).alias("acres"), none.alias("rings"))
    return spatial.boundary_proximity(squares, fires, "boundary_id", "incident_id").withColumn("miles", F.round("miles", 4))


# Documents and feeds

@query("""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g')) AS title FROM pages""")
def page_titles(t: Tables) -> DataFrame:
    return t.pages.select("page_id", pages.page_title(F.col("html")).alias("title"))


@query()
def html_extract(t: Tables) -> DataFrame:
    return pages.extract_pages(t.pages, "license|released|the|der|les|que").select("page_id", "title", F.size("headings").alias("headings"), F.size("links").alias("links"), F.array_join("excerpts", "\n").alias("excerpts"), F.sha2("body", 256).alias("body_sha256"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def json_props(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "int").alias("k"))


# Set operations, grouping sets and time windows that a user of SQL expects beside these

@query("SELECT coalesce(n_regionkey, -1) AS n_regionkey, n_name, count(*) AS customers FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ROLLUP (nation.n_regionkey, n_name)")
def rollup_customers(t: Tables) -> DataFrame:
    return t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).rollup("n_regionkey", "n_name").agg(F.count("*").alias("customers")).fillna(-1, ["n_regionkey"])


@query("SELECT o_orderstatus, o_orderpriority, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube_orders(t: Tables) -> DataFrame:
    return t.orders.cube("o_orderstatus", "o_orderpriority").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def except_keys(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey").subtract(t.orders.where("o_orderstatus = 'P'").select("o_custkey"))


@query("SELECT s_nationkey AS nation FROM supplier INTERSECT SELECT c_nationkey FROM customer")
def intersect_keys(t: Tables) -> DataFrame:
    return t.supplier.select(F.col("s_nationkey").alias("nation")).intersect(t.customer.select("c_nationkey"))


@query("SELECT CAST(epoch(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01')) AS BIGINT) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_windows(t: Tables) -> DataFrame:
    return live.windowed_counts(t.events, "ts", "event_type", "6 hours").select(seconds(F.col("window.start")).alias("start"), "event_type", "n")


@query("SELECT CAST(epoch(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01')) AS BIGINT) - 21600 * CAST(i AS BIGINT) AS start, event_type, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS i) GROUP BY 1, 2")
def sliding_windows(t: Tables) -> DataFrame:
    return live.windowed_counts(t.events, "ts", "event_type", "12 hours", "6 hours").select(seconds(F.col("window.start")).alias("start"), "event_type", "n")


@query("""WITH l AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 2 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM l) SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, count(*) AS n FROM s GROUP BY user_id, s""")
def session_windows(t: Tables) -> DataFrame:
    return live.sessions(t.events, "ts", "user_id", "2 hours").select("user_id", seconds(F.col("session_window.start")).alias("start"), "n")
