"""Operators over ordered histories: newest rows, carried values, changes, freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _columns(names: str | list[str]) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def latest_per_key(df: DataFrame, keys: str | list[str], order: str, tie: str) -> DataFrame:
    """The newest row of each key, by order and then by tie, as one aggregation: rows are reduced before they move.

    Rows whose order is null are the oldest.
    """
    keys = _columns(keys)
    rest = [c for c in df.columns if c not in keys]
    best = F.max(F.struct(F.col(order).alias("_o"), F.col(tie).alias("_t"), F.struct(*rest).alias("_r"))).alias("_b")
    return df.groupBy(*keys).agg(best).select(*keys, "_b._r.*").select(*df.columns)


def best_per_key(df: DataFrame, keys: str | list[str], *order: Column) -> DataFrame:
    """The first row of each key in an order with a total tie-break."""
    w = Window.partitionBy(*_columns(keys)).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def previous_known(df: DataFrame, key: str, order: list[str], value: str) -> Column:
    """The last value before this row that is not null."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))


def carry_forward(df: DataFrame, key: str, order: list[str], *values: str) -> DataFrame:
    """Nulls take the last known value before them."""
    return df.withColumns({v: F.coalesce(F.col(v), previous_known(df, key, order, v)) for v in values})


def content_changed(df: DataFrame, key: str, order: list[str], value: str, out: str = "changed") -> DataFrame:
    """Whether a known value differs from the last known one before it; the first one has changed, an unknown one has not."""
    return df.withColumn(out, F.col(value).isNotNull() & ~F.col(value).eqNullSafe(previous_known(df, key, order, value)))


def collapse_repeats(df: DataFrame, key: str, order: list[str], *values: str) -> DataFrame:
    """Rows that differ from the row before in some value, with that row's values as from_*; equal neighbours vanish."""
    w = Window.partitionBy(key).orderBy(*order)
    marked = df.withColumns({f"from_{v}": F.lag(v).over(w) for v in values} | {"_first": F.row_number().over(w) == 1})
    same = F.lit(True)
    for v in values:
        same = same & F.col(v).eqNullSafe(F.col(f"from_{v}"))
    return marked.where(F.col("_first") | ~same).drop("_first")


def fresh_claims(claims: DataFrame, fetches: DataFrame, source: str, claim_hash: str, claim_time: str, fetch_hash: str, fetch_time: str, fetch_tie: str, as_of: Column, days: int) -> DataFrame:
    """Claims that are current: their source's newest hashed fetch is recent and has their hash; without any such fetch, claims that are recent themselves."""
    newest = latest_per_key(fetches.where(F.col(fetch_hash).isNotNull()).select(F.col(source), F.col(fetch_hash).alias("_hash"), F.col(fetch_time).alias("_time"), F.col(fetch_tie).alias("_tie")), source, "_time", "_tie")
    limit = as_of - F.expr(f"interval {days} days")
    current = F.when(F.col("_hash").isNull(), F.col(claim_time) > limit).otherwise((F.col("_time") > limit) & (F.col(claim_hash) == F.col("_hash")))
    return claims.join(newest, source, "left").where(current).select(*claims.columns)


def change_log_days(changes: DataFrame, time: str, tie: str, value: str) -> DataFrame:
    """By day: number of changes, and the value of the first and the last."""
    order = F.struct(F.col(time), F.col(tie))
    return changes.groupBy(F.date_format(time, "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.min_by(value, order).alias("first_value"), F.max_by(value, order).alias("last_value"))


def before_live(history: DataFrame, live: DataFrame, key: str, time: str) -> DataFrame:
    """Rows older than their key's first live row; all rows of keys without one."""
    first = live.groupBy(key).agg(F.min(time).alias("_live"))
    return history.join(first, key, "left").where(F.col("_live").isNull() | (F.col(time) < F.col("_live"))).drop("_live")


def due(df: DataFrame, last: str, minutes: Column, now: Column) -> DataFrame:
    """Rows never checked, or not within their interval."""
    return df.where(F.col(last).isNull() | (F.unix_timestamp(last) + minutes * 60 <= F.unix_timestamp(now)))


def replaced_history(old: DataFrame, rebuilt: DataFrame, origin: str, value: str) -> DataFrame:
    """The old rows of other origins and the rebuilt ones: running it again changes nothing."""
    return old.where(~F.col(origin).eqNullSafe(value)).unionByName(rebuilt.withColumn(origin, F.lit(value)))


def conditional_headers(fetches: DataFrame, source: str, at: str, tie: str) -> DataFrame:
    """source, etag, last_modified of each source's newest fetch with an etag, else of its newest with a last-modified. The two come from one row."""
    pair = F.struct("etag", "last_modified")
    newest = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(at, tie, pair.alias("pair"))))["pair"]
    chosen = fetches.groupBy(source).agg(F.coalesce(newest("etag"), newest("last_modified")).alias("p"))
    return chosen.where("p is not null").select(source, "p.etag", "p.last_modified")


def closing_rows(last: DataFrame, current: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """The rows that close a history rebuilt up to now: key, from_status, from_policy, to_status, to_policy.

    last: key, status, policy of the newest rebuilt row; current: key, status, policy as published.
    Keys with live entries need none, nor do those whose current pair is the last one, nor unknown
    ones without a history.
    """
    before = last.select(key, F.col("status").alias("from_status"), F.col("policy").alias("from_policy"), F.lit(True).alias("_there"))
    joined = current.join(live.select(key).distinct(), key, "left_anti").join(before, key, "left")
    same = F.col("_there").isNotNull() & F.col("from_status").eqNullSafe(F.col("status")) & F.col("from_policy").eqNullSafe(F.col("policy"))
    new = joined.where(~same & ~(F.col("_there").isNull() & (F.col("status") == "unknown")))
    return new.select(key, "from_status", "from_policy", F.col("status").alias("to_status"), F.col("policy").alias("to_policy"))


def fetches_to_parse(fetches: DataFrame, observations: DataFrame, parser_on: bool) -> DataFrame:
    """Fetches (id, source_id, error, document_id, changed) that are to be parsed: without error and with a document, changed or not parsed yet while their source has nothing but placeholders.

    observations: fetch_id, source_id, reasons. Without any observation of its source a fetch is
    parsed; with placeholders only where the parser is on.
    """
    placeholder = F.exists(F.coalesce(F.col("reasons"), F.array().cast("array<string>")), lambda r: r.rlike("(?i)LLM parsing is disabled or unavailable"))
    sources = observations.groupBy("source_id").agg(F.bool_and(placeholder).alias("_only"))
    parsed = observations.select(F.col("fetch_id").alias("id"), F.lit(True).alias("_parsed")).distinct()
    ready = fetches.where("error is null and document_id is not null").join(parsed, "id", "left").join(sources, "source_id", "left")
    again = F.col("_parsed").isNull() & (F.col("_only").isNull() | (F.col("_only") & F.lit(parser_on)))
    return ready.where(F.coalesce(F.col("changed"), F.lit(False)) | again).drop("_parsed", "_only")


def newest(df: DataFrame, limit: int, *order: str) -> DataFrame:
    """The newest rows by the columns in turn (a top-k, as the feature asks); every task keeps its own newest before any row moves."""
    return df.orderBy(*(F.desc(c) for c in order)).limit(limit)


def where_given(df: DataFrame, **wanted: object) -> DataFrame:
    """Rows that have each wanted value; a wanted None asks nothing."""
    for name, value in wanted.items():
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    return df
