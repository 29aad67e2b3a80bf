"""Aggregations: bands, shares, inversions, costs, pages, counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderline.sources.tables import materialise


def exact_quantiles(df: DataFrame, groups: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """groups and a column for each share: the quantile with linear interpolation between neighbours in rank, as an array-free, spilling plan.

    Values are counted first, then dealt by ranges of (groups, value) and written, so no task holds a
    large group: running counts within a range, on top of the sizes of its group's earlier ranges,
    tell which values hold the wanted ranks. Nulls do not count; a group of nulls only has no row.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.where(F.col(value).isNotNull()).groupBy(*groups, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    ranged = materialise(counts.repartitionByRange(parts, *groups, "_v").withColumn("_p", F.spark_partition_id()))
    sizes = ranged.groupBy(*groups, "_p").agg(F.sum("_n").alias("_size"))  # a group has a row for each range it reaches into
    by_group = Window.partitionBy(*groups)
    sizes = sizes.select(*groups, "_p", (F.sum("_size").over(by_group.orderBy("_p")) - F.col("_size")).alias("_before"), F.sum("_size").over(by_group).alias("_total"))
    same = [F.col(f"r.{g}").eqNullSafe(F.col(f"s.{g}")) for g in groups]
    placed = ranged.alias("r").join(sizes.alias("s"), [F.col("r._p") == F.col("s._p"), *same]).select(*(f"r.{g}" for g in groups), "r._p", "_v", "_n", "_before", "_total")
    last = F.col("_before") + F.sum("_n").over(Window.partitionBy(*groups, "_p").orderBy("_v"))
    placed = placed.withColumn("_last", last).withColumn("_first", F.col("_last") - F.col("_n"))

    def share_of(share: float) -> Column:
        """What a value adds to the quantile: its weight, if it holds the rank below or above the wanted place."""
        at = (F.col("_total") - 1) * share
        low, part = F.floor(at), at - F.floor(at)
        holds = lambda rank: (rank >= F.col("_first")) & (rank < F.col("_last"))
        return F.when(holds(low), (1 - part) * F.col("_v")).otherwise(0.0) + F.when(holds(low + 1) & (part > 0), part * F.col("_v")).otherwise(0.0)

    return placed.groupBy(*groups).agg(*(F.sum(share_of(q)).alias(name) for name, q in shares.items()))


def band_stats(df: DataFrame, groups: list[str], band: Column, value: str, part_of: list[str]) -> DataFrame:
    """By groups and band: mean, exact 10th and 90th percentiles with linear interpolation, count, and its share in per cent of the count over part_of."""
    rows = df.select(*groups, band.alias("band"), value)
    by = rows.groupBy(*groups, "band").agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    ranks = exact_quantiles(rows, [*groups, "band"], value, {"p10": 0.1, "p90": 0.9})
    same = [F.col(f"b.{g}").eqNullSafe(F.col(f"q.{g}")) for g in (*groups, "band")]
    joined = by.alias("b").join(ranks.alias("q"), same, "left").select("b.*", "q.p10", "q.p90")
    return joined.withColumn("share", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(*part_of)))


def displayable(df: DataFrame, least: int = 5, share: float = 0.5) -> DataFrame:
    return df.where((F.col("n") >= least) & (F.col("share") >= share))


def inverted(bands: DataFrame, groups: list[str], band: str, value: str, margin: float) -> DataFrame:
    """Groups whose highest band is above the lowest by more than the margin."""
    by = bands.groupBy(*groups).agg(F.min_by(value, band).alias("lowest"), F.max_by(value, band).alias("highest"), F.count("*").alias("bands"))
    return by.where((F.col("bands") > 1) & (F.col("highest") - F.col("lowest") > margin))


def cost_rollup(df: DataFrame, groups: list[str], tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> DataFrame:
    """Prices are for a million tokens; each row's cost is rounded to 8 places, the sum to 6."""
    cost = F.round(tokens_in * price_in / 1e6 + tokens_out * price_out / 1e6, 8)
    return df.groupBy(*groups).agg(F.sum(tokens_in).alias("tokens_in"), F.sum(tokens_out).alias("tokens_out"), F.round(F.sum(cost), 6).alias("cost"))


def page_assign(df: DataFrame, order: str, size: int) -> DataFrame:
    """page and place of each row in a total order, without one task that numbers all rows.

    Rows are dealt by ranges of the order and written, so that the ranges are the same for all that
    follows; numbers count on from the sizes of the ranges before. Of rows that tie any may come first.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialise(df.repartitionByRange(parts, order).withColumn("_p", F.spark_partition_id()))
    own = ranged.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(order)))
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_size"))  # one row a range
    before = sizes.alias("a").join(F.broadcast(sizes.alias("b")), F.col("b._p") < F.col("a._p"), "left").groupBy("a._p").agg(F.coalesce(F.sum("b._size"), F.lit(0)).alias("_before"))
    place = (F.col("_before") + F.col("_r")).cast("long")
    return own.join(F.broadcast(before), "_p").withColumn("place", place).withColumn("page", F.ceil(place / size).cast("long")).drop("_p", "_r", "_before")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, t in tables.items()])


def bucket_counts(df: DataFrame, groups: list[str], buckets: dict[str, Column]) -> DataFrame:
    """Count of all rows and of those of each condition."""
    return df.groupBy(*groups).agg(F.count("*").alias("total"), *(F.count_if(c).alias(name) for name, c in buckets.items()))


def ordered_structs(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """Each key's rows as an array of structs, sorted by their columns in turn. For keys whose number of rows is bounded."""
    return df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("entries"))


def first_distinct(values: Column, most: int) -> Column:
    """The first so many different, not empty values of an array, in the order of their first occurrence."""
    return F.slice(F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (v != ""))), 1, most)


def joined_labels(df: DataFrame, phrase: str, label: str) -> DataFrame:
    """For each phrase its labels as one sentence part: "a, b and c"."""
    by = df.groupBy(phrase).agg(F.array_sort(F.collect_set(label)).alias("_l"))
    n = F.size("_l")
    head = F.array_join(F.slice("_l", F.lit(1), F.greatest(n - 1, F.lit(0))), ", ")
    return by.select(phrase, F.when(n > 1, F.concat(head, F.lit(" and "), F.element_at("_l", -1))).otherwise(F.element_at("_l", 1)).alias("labels"))


def page_rows(df: DataFrame, order: str, size: int, page: int) -> DataFrame:
    """The rows of one page, with their places; what a limit and an offset in a total order give."""
    return page_assign(df, order, size).where(F.col("page") == page).drop("page")
