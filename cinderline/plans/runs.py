"""Driver queries of runs over time: staleness by timers, audit rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderline.plans.catalogue import Tables, query
from cinderline.plans.records import stream_of
from cinderline.sources import audit
from cinderline.sources.tables import steps_dir
from cinderline.streaming import freshness


@query("""WITH e AS (SELECT DISTINCT user_id, epoch_us(ts) // 1000 AS t FROM events), w AS (SELECT max(t) - 3600000 AS passed FROM e),
    g AS (SELECT user_id, t, lag(t) OVER u AS before, lead(t) OVER u AS after FROM e WINDOW u AS (PARTITION BY user_id ORDER BY t))
    SELECT CAST(user_id AS VARCHAR) AS user_id, t AS at, 'current' AS state FROM g WHERE before IS NULL OR t > before + 129600000
    UNION ALL SELECT CAST(user_id AS VARCHAR), t + 129600000, 'stale' FROM g, w WHERE after > t + 129600000 OR (after IS NULL AND t + 129600000 <= passed)""")
def stream_freshness(t: Tables) -> DataFrame:
    """When users turn current and stale (36 hours without an event), the last ones by timers."""
    changes = freshness.freshness_changes(stream_of(t, "events"), "user_id", "ts", 36 * 3600, 7 * 86400)
    return freshness.with_ordered_state(t.spark, changes).select("user_id", F.unix_millis("at").alias("at"), "state")


@query("""SELECT 'orders' AS job, true AS success, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS closed, CAST(max(o_orderkey) AS BIGINT) AS newest, '-' AS failed FROM orders
    UNION ALL SELECT 'customers', true, count(*), count(*) FILTER (c_acctbal < 0), CAST(max(c_custkey) AS BIGINT), '-' FROM customer UNION ALL SELECT 'broken', false, -1, -1, -1, 'failed' FROM region WHERE r_regionkey = 0""")
def audit_trail(t: Tables) -> DataFrame:
    """Two imports with counts taken in passing, and one that fails on a row."""
    base = f"{steps_dir(t.spark)}/audit-{uuid.uuid4().hex}"
    trail, save = f"{base}/trail", lambda name: lambda df: df.write.parquet(f"{base}/{name}")
    audit.audited(t.orders, "orders", save("orders"), trail, {"closed": F.count_if(F.col("o_orderstatus") == "F"), "newest": F.max("o_orderkey")})
    audit.audited(t.customer, "customers", save("customers"), trail, {"closed": F.count_if(F.col("c_acctbal") < 0), "newest": F.max("c_custkey")})
    bad = t.customer.withColumn("c_name", F.when(F.col("c_custkey") == 7, F.raise_error(F.lit("no name"))).otherwise(F.col("c_name")))
    audit.audited(bad, "broken", save("broken"), trail, fail=False)
    count = lambda k: F.coalesce(F.col("counts")[k], F.lit(-1)).cast("long")
    return audit.audit_rows(t.spark, trail).select("job", "success", count("rows").alias("n"), count("closed").alias("closed"), count("newest").alias("newest"), F.when(F.col("error_message").isNotNull(), "failed").otherwise("-").alias("failed"))
