"""Joins beyond the plain ones: unique fallbacks, firsts, completeness, unions that keep the first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderline.operators.history import best_per_key


def exact_then_unique(left: DataFrame, right: DataFrame, exact: list[str], name: str, value: str, tie: str) -> DataFrame:
    """left with the right side's value: of the first row that agrees in all exact columns, else of the only row with that name, else null."""
    first = right.where(F.col(name).isNotNull()).groupBy(*exact).agg(F.min_by(value, tie).alias("_exact"))
    only = right.groupBy(name).agg(F.count("*").alias("_n"), F.max(value).alias("_only")).where("_n = 1").drop("_n")
    return left.join(first, exact, "left").join(only, name, "left").withColumn(value, F.coalesce("_exact", "_only")).drop("_exact", "_only")


def with_first(left: DataFrame, right: DataFrame, key: str, *order: Column) -> DataFrame:
    """left with the first row of the right side for its key, nulls without one."""
    return left.join(best_per_key(right, key, *order), key, "left")


def missing_combinations(units: DataFrame, present: DataFrame, unit: str, part: str, parts: list[int]) -> DataFrame:
    """(unit, part) pairs of all units and the given parts that are absent. Parts are a literal list, so each unit is only expanded in place."""
    every = units.select(unit, F.explode(F.array(*map(F.lit, parts))).alias(part))
    return every.join(present.select(unit, part).distinct(), [unit, part], "left_anti")


def unmatched(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.join(right, on, "left_anti")


def all_matched(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """left joined with right; a row that finds no partner stops the query."""
    keys = right.select(*on).distinct().withColumn("_there", F.lit(True))
    checked = left.join(keys, on, "left").withColumn("_there", F.when(F.col("_there").isNull(), F.raise_error(F.concat(F.lit("no match for "), F.to_json(F.struct(*on))))).otherwise(F.col("_there")))
    return checked.where("_there").drop("_there").join(right, on)


def any_flag(df: DataFrame, key: str, *sides: DataFrame) -> DataFrame:
    """Rows of df whose key occurs in at least one side (each a table with that key)."""
    flagged = reduce(lambda a, i: a.join(sides[i].select(key).distinct().withColumn(f"_f{i}", F.lit(True)), key, "left"), range(len(sides)), df)
    names = [f"_f{i}" for i in range(len(sides))]
    return flagged.where(F.coalesce(*names, F.lit(False))).drop(*names)


def union_first(key: str, tie: str, *tables: DataFrame) -> DataFrame:
    """All tables' rows, of each key only the first: by the tables' order, then by tie."""
    every = reduce(DataFrame.unionByName, [t.withColumn("_side", F.lit(i)) for i, t in enumerate(tables)])
    return best_per_key(every, key, F.col("_side"), F.col(tie)).drop("_side")


def prefer_existing(existing: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """existing, and of the others those whose key it lacks."""
    return existing.unionByName(more.join(existing.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def without_tokens(left: Column, right: Column) -> Column:
    """Array difference that keeps the left side's repeats."""
    return F.filter(left, lambda x: ~F.coalesce(F.array_contains(right, x), F.lit(False)))


def conflicting_newest(claims: DataFrame, others: DataFrame, unit: str, source: str, time: str, tie: str, status: str, days: int) -> DataFrame:
    """claims with whether the newest of the others from another source, within so many days before, has another status.

    The newest row of another source is the newest row, or else the last one before its run of equal
    sources. So one pass over each unit's ordered rows finds it, and no pairs are made.
    """
    o = others.select(F.col(unit), F.col(source).alias("_s"), F.col(time).alias("_t"), F.col(tie).alias("_i"), F.col(status).alias("_v"))
    w = Window.partitionBy(unit).orderBy("_t", "_i")
    starts = F.when(~F.lag("_s").over(w).eqNullSafe(F.col("_s")), F.struct(F.lag("_t").over(w).alias("t"), F.lag("_v").over(w).alias("v")))
    runs = o.withColumn("_start", starts).withColumn("_prior", F.last("_start", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_start")
    rows = claims.select(F.col(unit), F.col(time).alias("_t"), F.col(tie).alias("_i"), F.lit(1).alias("_kind"), F.struct(*claims.columns).alias("_claim"))
    both = runs.withColumn("_kind", F.lit(0)).unionByName(rows, allowMissingColumns=True)
    until = Window.partitionBy(unit).orderBy("_t", "_kind", "_i").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("_kind") == 0, F.struct("_s", F.col("_t").alias("t"), F.col("_v").alias("v"), "_prior")), ignorenulls=True).over(until)
    found = both.withColumn("_seen", seen).where("_kind = 1").select("_claim.*", "_seen")
    newest = F.when(F.col("_seen._s") != F.col(source), F.struct("_seen.t", "_seen.v")).otherwise(F.col("_seen._prior"))
    recent = (newest["t"] > F.col(time) - F.expr(f"interval {days} days")) & (newest["v"] != F.col(status))
    return found.withColumn("conflicts", F.coalesce(recent, F.lit(False))).drop("_seen")


def by_codes(units: DataFrame, features: DataFrame, unit: str, codes: str, code: str, value: str) -> DataFrame:
    """Each unit with the values of the features of all its codes, in the order of the codes; a code without a feature stops the query."""
    each = units.select(unit, F.posexplode(F.array_distinct(codes)).alias("_no", code))
    joined = all_matched(each, features.select(code, value), [code])
    return joined.groupBy(unit).agg(F.transform(F.array_sort(F.collect_list(F.struct("_no", value))), lambda s: s[value]).alias(f"{value}s"))
