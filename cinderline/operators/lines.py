"""Lines: loose segments strung to lines, parts of lines and rings, and what lies near them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinderline.functions.geometry import all_edges, segment_distance, segments
from cinderline.operators.cover import covered_points, polygon_cover
from cinderline.operators.spatial import by_cell
from cinderline.sources.tables import materialise


ENDS = ("ax", "ay", "bx", "by")


def strung_keys(keys: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, ...]:
    """The lines of whole keys: of each point the key's number, the line's first segment, its place, x and y. keys: numbers; e: ax, ay, bx, by a row."""
    # Each segment once, from its lesser end on; halves k and k + n are its two directions.
    swap = (e[:, 0] > e[:, 2]) | ((e[:, 0] == e[:, 2]) & (e[:, 1] > e[:, 3]))
    e = np.where(swap[:, None], e[:, [2, 3, 0, 1]], e) + 0.0
    long = (e[:, 0] != e[:, 2]) | (e[:, 1] != e[:, 3])
    one = np.unique(np.column_stack([keys[long], e[long]]), axis=0)
    n, half = len(one), np.concatenate([one, one[:, [0, 3, 4, 1, 2]]])
    back = (np.arange(2 * n) + n) % max(1, 2 * n)
    _, spot, many = np.unique(half[:, :3], axis=0, return_inverse=True, return_counts=True)
    order = np.argsort(spot.ravel(), kind="stable")
    start = np.cumsum(many) - many
    two = start[many == 2]
    to = np.arange(2 * n)
    # What follows a half at a point that only two share: the other that begins there.
    to[back[order[two]]], to[back[order[two + 1]]] = order[two + 1], order[two]
    left = (to != np.arange(2 * n)).astype(np.int64)
    reach = 1
    while reach <= 2 * n:
        left, to = left + left[to], to[to]
        reach *= 2
    # Ends follow themselves; in loops nothing does.
    at_end = left == left + left[to]
    first, before = back[to[back]], left[back]
    less = lambda a, b: np.logical_or.reduce([(a[:, :k] == b[:, :k]).all(1) & (a[:, k] < b[:, k]) for k in range(4)])
    kept = np.flatnonzero(at_end & less(half[first, 1:], half[back[to], 1:])) if n else np.arange(0)
    head = kept[before[kept] == 0]
    rows = np.concatenate([head, kept])
    x, y = (np.concatenate([half[head, 1 + c], half[kept, 3 + c]]) for c in (0, 1))
    return half[rows, 0].astype(np.int64), half[first[rows], 1:], np.concatenate([np.zeros(len(head), np.int64), before[kept] + 1]), x, y


def stitched(loose: DataFrame, key: str) -> DataFrame:
    """key, line, place, x, y: the points, in order, of the lines that loose segments (key, ax, ay, bx, by) form.

    Segments run either way and come in any order; repeated ones count once, and those without length do
    not count. A line ends where one or more than two segments of its key meet, and begins at the lesser
    of its ends; line is its first segment from there. Closed loops without such a point have no row.
    Segments are dealt and sorted by key; keys that lie whole in a batch of rows are strung there, and
    only what batches cut, such as a key of any size, is strung by rounds of joins (`strung_by_rounds`).
    """
    # Keys that are equal without being the same bytes, or nested, and other coordinates are left to the rounds.
    types = dict(loose.dtypes)
    if any(types[c] != "double" for c in ENDS) or types[key].split("<")[0] in ("float", "double", "struct", "array", "map", "variant"):
        return strung_by_rounds(loose, key)
    n = int(loose.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = loose.select(key, *ENDS).repartition(n, key).sortWithinPartitions(key)
    name = dealt.schema[key]

    def string(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, e = b.column(0), np.column_stack([b.column(k + 1).to_numpy(zero_copy_only=False) for k in range(4)])
            number = keys.dictionary_encode()
            code = number.indices.to_numpy(zero_copy_only=False) if not keys.null_count else np.where(keys.is_null(), -1, number.indices.fill_null(-1))
            # The first and the last key may go on in other batches; coordinates that are no numbers are left to the rounds.
            cut = (code == code[0]) | (code == code[-1]) | (code == -1)
            cut |= np.isin(code, code[~np.isfinite(e).all(1)])
            which, line, place, x, y = strung_keys(code[~cut], e[~cut])
            none = lambda m, kind: pa.nulls(m, kind)
            rest, k, double = b.filter(pa.array(cut)), len(which), pa.float64()
            m = rest.num_rows
            held = number.dictionary.take(pa.array(which))
            both = lambda a, c: pa.concat_arrays([a, c])
            columns = [both(rest.column(0), held.cast(rest.column(0).type)), *(both(rest.column(1 + c), pa.array(line[:, c], double)) for c in range(4)), both(none(m, pa.int64()), pa.array(place, pa.int64())), both(none(m, double), pa.array(x, double)), both(none(m, double), pa.array(y, double))]
            yield pa.RecordBatch.from_arrays(columns, names=[key, *ENDS, "place", "x", "y"])

    fields = T.StructType([name, *(T.StructField(c, T.DoubleType()) for c in ENDS), T.StructField("place", T.LongType()), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
    done = materialise(dealt.mapInArrow(string, fields))
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    line = F.struct(point("ax", "ay").alias("u"), point("bx", "by").alias("v"))
    rest = strung_by_rounds(done.where("place is null").select(key, *ENDS), key)
    return done.where("place is not null").select(key, line.alias("line"), "place", "x", "y").unionByName(rest)


def strung_by_rounds(loose: DataFrame, key: str) -> DataFrame:
    """stitched for keys of any size: every segment finds its line's end, and how far it is, by pointers that double their reach."""
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    a, b = point("ax", "ay"), point("bx", "by")
    one = loose.where((F.col("ax") != F.col("bx")) | (F.col("ay") != F.col("by"))).select(key, F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    ways = F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("h")
    half = materialise(one.select(key, ways).select(key, "h.u", "h.v"))
    through = half.groupBy(key, "u").count().where("count = 2").select(key, F.col("u").alias("v"))
    # What follows: the other segment at a point that only two share.
    after = half.select(key, F.col("u").alias("v"), F.col("v").alias("w"))
    follows = half.join(through, [key, "v"]).join(after, [key, "v"]).where(F.col("w") != F.col("u")).select(key, "u", "v", F.struct(F.col("v").alias("u"), F.col("w").alias("v")).alias("to"))
    own = F.struct("u", "v")
    now = materialise(half.join(follows, [key, "u", "v"], "left").select(key, own.alias("h"), "to", F.col("to").isNotNull().cast("long").alias("left"), own.alias("last")))
    most, reach = half.count(), 1
    while not now.where("to is not null").isEmpty() and reach <= 2 * most:
        ahead = now.select(key, F.col("h").alias("to"), F.col("to").alias("_to"), F.col("left").alias("_left"), F.col("last").alias("_last"))
        now = materialise(now.join(ahead, [key, "to"], "left").select(key, "h", F.col("_to").alias("to"), (F.col("left") + F.coalesce("_left", F.lit(0))).alias("left"), F.coalesce("_last", "last").alias("last")))
        reach *= 2
    # Loops never end. What follows a half that runs back ends with the line's first segment.
    ended = now.where("to is null")
    turn = lambda h: F.struct(F.col(f"{h}.v").alias("u"), F.col(f"{h}.u").alias("v"))
    back = ended.select(key, turn("h").alias("h"), turn("last").alias("first"), F.col("left").alias("before"))
    kept = ended.join(back, [key, "h"]).where(F.col("first") < turn("last"))
    spot = lambda place, p: F.struct(place.cast("long").alias("place"), F.col(p).alias("p"))
    points = F.when(F.col("before") == 0, F.array(spot(F.lit(0), "h.u"), spot(F.lit(1), "h.v"))).otherwise(F.array(spot(F.col("before") + 1, "h.v")))
    return kept.select(key, F.col("first").alias("line"), F.explode(points).alias("s")).select(key, "line", "s.place", F.col("s.p.x").alias("x"), F.col("s.p.y").alias("y"))


def line_slice(line: Column, start: Column, stop: Column) -> Column:
    """The part of a line between two offsets along it, both ends included; offsets beyond the line are its ends. Null for fewer than two points, or if start is behind stop."""
    lo, hi = F.greatest(start, F.lit(0.0)), stop

    def step(state: Column, e: Column) -> Column:
        length = F.hypot(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"])
        begin = state["passed"]
        end = begin + length
        at = lambda offset: F.struct(*((e["a"][c] + F.coalesce((offset - begin) / F.nullif(length, F.lit(0.0)), F.lit(0.0)) * (e["b"][c] - e["a"][c])).alias(c) for c in "xy"))
        touched = (end >= lo) & (begin <= hi)
        first = at(F.greatest(lo, begin))
        points = F.when(touched, F.concat(F.when(F.size(state["points"]) == 0, F.array(first)).otherwise(state["points"]), F.array(at(F.least(hi, end))))).otherwise(state["points"])
        return F.struct(end.alias("passed"), points.alias("points"))

    none = F.array().cast("array<struct<x:double,y:double>>")
    found = F.aggregate(segments(line), F.struct(F.lit(0.0).alias("passed"), none.alias("points")), step)["points"]
    distinct = F.filter(F.transform(found, lambda p, i: F.struct(p.alias("p"), ((i > 0) & (F.get(found, i - 1) == p)).alias("again"))), lambda s: ~s["again"])
    return F.when((F.size(line) > 1) & (lo <= hi), F.transform(distinct, lambda s: s["p"]))


def ring_way(ring: Column, start: Column, stop: Column) -> Column:
    """The corners of a closed ring (first corner not repeated) from one index to another, the shorter way round, both ends included; of equal ways that along the ring."""
    n = F.size(ring)
    doubled = F.concat(ring, ring)
    length = lambda line: F.aggregate(segments(line), F.lit(0.0), lambda s, e: s + F.hypot(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]))
    along = F.slice(doubled, start + 1, F.pmod(stop - start, n) + 1)
    back = F.reverse(F.slice(doubled, stop + 1, F.pmod(start - stop, n) + 1))
    return F.when(length(along) <= length(back), along).otherwise(back)


def near_lines(points: DataFrame, lines: DataFrame, point_id: str, line_id: str, within: float) -> DataFrame:
    """Pairs (point, line) with the point (x, y) at most so far from a line (an array of points): the line's buffer, as a set of segments with an exact test. A line of one point is its circle."""
    alone = F.array(F.struct(F.get("line", F.lit(0)).alias("a"), F.get("line", F.lit(0)).alias("b")))
    edges = lines.where("size(line) > 0").select(line_id, F.explode(F.when(F.size("line") > 1, segments(F.col("line"))).otherwise(alone)).alias("e"))
    return near_edges(points, edges, point_id, line_id, within)


def near_edges(points: DataFrame, edges: DataFrame, point_id: str, shape_id: str, within: float) -> DataFrame:
    """Pairs (point, shape), once each, with the point at most so far from one of the shape's edges e."""
    # An edge is dealt to the cells that its corridor passes, column by column, not to those of its box.
    size = 2 * within
    e = edges.select(F.col(shape_id).alias("_shape"), *(F.col(f"e.{k}.{c}").alias(f"{k}{c}") for k in "ab" for c in "xy")).where("ax is not null and ay is not null and bx is not null and by is not null").distinct()
    column = lambda v: F.floor(v / size)
    across = e.withColumn("i", F.explode(F.sequence(column(F.least("ax", "bx") - within), column(F.greatest("ax", "bx") + within))))
    steep = (F.col("by") - F.col("ay")) / F.nullif(F.col("bx") - F.col("ax"), F.lit(0.0))
    at = lambda x: F.coalesce(F.col("ay") + (F.least(F.greatest(x, F.least("ax", "bx")), F.greatest("ax", "bx")) - F.col("ax")) * steep, F.col("ay"))
    # The part of the edge that is no farther than `within` from the column; an upright one has its whole height.
    y1, y2 = at(F.col("i") * size - within), at((F.col("i") + 1) * size + within)
    upright = F.col("ax") == F.col("bx")
    low, high = F.when(upright, F.least("ay", "by")).otherwise(F.least(y1, y2)), F.when(upright, F.greatest("ay", "by")).otherwise(F.greatest(y1, y2))
    hair = 1e-9 * size
    laid = across.withColumns({"_low": low - within - hair, "_high": high + within + hair}).withColumn("j", F.explode(F.sequence(column(F.col("_low")), column(F.col("_high"))))).drop("_low", "_high")
    spots = points.where("x is not null and y is not null").select(F.col(point_id).alias("_point"), "x", "y", column(F.col("x")).alias("i"), column(F.col("y")).alias("j"))
    flat = {k: {c: F.col(f"{k}{c}") for c in "xy"} for k in "ab"}
    near = by_cell(spots, laid, ["i", "j"]).where(segment_distance(F.col("x"), F.col("y"), flat) <= within)
    return near.select(F.col("_point").alias(point_id), F.col("_shape").alias(shape_id)).distinct()


def near_shapes(points: DataFrame, shapes: DataFrame, point_id: str, shape_id: str, within: float) -> DataFrame:
    """Pairs (point, shape) with the point inside the shape's rings or at most so far from its outline: the buffer of a lake."""
    edges = shapes.where("size(rings) > 0").select(shape_id, F.explode(all_edges(F.col("rings"))).alias("e"))
    size = max(within, 1e-9)
    inside = covered_points(points, polygon_cover(shapes, shape_id, size), point_id, shape_id, size)
    return near_edges(points, edges, point_id, shape_id, within).unionByName(inside).distinct()
