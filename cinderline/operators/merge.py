"""State from snapshots: upserts that keep what was last known, deactivation, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderline.functions.text import fingerprint


def snapshot_merge(state: DataFrame, snapshot: DataFrame, key: str, keep_known: list[list[str]], now: Column) -> DataFrame:
    """The state after a full snapshot, by one full outer join.

    Both have the same columns; the state also active, first_seen, last_seen. A key in the snapshot
    is active and takes its values, but each group in keep_known (columns that belong together, the
    first of them telling) keeps the old values if the new ones are missing. A key that is missing
    becomes inactive and keeps everything else. The snapshot must have a key once.
    """
    values = [c for c in snapshot.columns if c != key]
    new = snapshot.select(F.col(key), F.lit(True).alias("_in"), *(F.col(c).alias(f"_{c}") for c in values))
    joined = state.join(new, key, "full_outer")
    seen = F.coalesce("_in", F.lit(False))
    group_of = {c: g[0] for g in keep_known for c in g}
    value = lambda c: F.when(seen & ((F.col(f"_{group_of[c]}").isNotNull()) if c in group_of else F.lit(True)), F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
    return joined.select(key, *map(value, values), seen.alias("active"), F.coalesce("first_seen", now).alias("first_seen"), F.when(seen, now).otherwise(F.col("last_seen")).alias("last_seen"))


def guarded_merge(state: DataFrame, snapshot: DataFrame, key: str, keep_known: list[list[str]], now: Column) -> DataFrame:
    """As snapshot_merge, but an empty snapshot is taken for a failed run: the state stays."""
    return state if snapshot.isEmpty() else snapshot_merge(state, snapshot, key, keep_known, now)


def deactivate_missing(state: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    there = seen.select(key).distinct().withColumn("_there", F.lit(True))
    return state.join(there, key, "left").withColumn("active", F.col("active") & F.coalesce("_there", F.lit(False))).drop("_there")


def fingerprint_upsert(state: DataFrame, incoming: DataFrame, key: str, content: list[str], neutral: list[str]) -> DataFrame:
    """incoming with action (insert, same, neutral, changed) and review_status.

    content decides what a row says, neutral what may change without a new review. A changed row
    needs review; a neutral change and an unchanged row keep the state's review status; a new one
    needs review.
    """
    of = lambda: fingerprint(*(F.col(c) for c in content))
    whole = lambda: fingerprint(*(F.col(c) for c in [*content, *neutral]))
    old = state.select(key, of().alias("_content"), whole().alias("_whole"), F.col("review_status").alias("_review"))
    joined = incoming.drop("review_status").withColumns({"_new": of(), "_new_whole": whole()}).join(old, key, "left")
    action = F.when(F.col("_content").isNull(), "insert").when(F.col("_content") != F.col("_new"), "changed").when(F.col("_whole") != F.col("_new_whole"), "neutral").otherwise("same")
    out = joined.withColumn("action", action).withColumn("review_status", F.when(F.col("action").isin("insert", "changed"), "needs_review").otherwise(F.col("_review")))
    return out.drop("_content", "_whole", "_review", "_new", "_new_whole")


def keyed_upsert(state: DataFrame, incoming: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """State with incoming values where keys agree, null keys agreeing with null ones, and new rows added."""
    s, n = state.alias("s"), incoming.alias("n")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"s.{k}").eqNullSafe(F.col(f"n.{k}"))
    joined = s.join(n.withColumn("_in", F.lit(True)).alias("n"), on, "full_outer")
    fresh = F.coalesce("_in", F.lit(False))
    return joined.select(*(F.when(fresh, F.col(f"n.{k}")).otherwise(F.col(f"s.{k}")).alias(k) for k in keys), *(F.when(fresh, F.col(f"n.{v}")).otherwise(F.col(f"s.{v}")).alias(v) for v in values))


def reseeded(state: DataFrame, seeded: DataFrame, key: str, dataset: str, name: str) -> DataFrame:
    """The state after a dataset has been derived anew: its seeded rows inserted or updated and active, its others inactive; other datasets' rows stay.

    state: key, dataset, values and active; seeded: key and values, each key once. Running it again changes nothing.
    """
    new = seeded.withColumns({dataset: F.lit(name), "active": F.lit(True)})
    old = state.join(new.select(key, dataset), [key, dataset], "left_anti")
    return old.withColumn("active", F.col("active") & ~F.col(dataset).eqNullSafe(name)).unionByName(new.select(*state.columns))
