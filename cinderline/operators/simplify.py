"""Simpler outlines whose neighbours still meet: borders are cut into arcs where three shapes meet, and each arc is simplified once for all shapes it bounds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderline.functions.geometry import line_length, segments
from cinderline.operators.cover import covered_points, polygon_cover
from cinderline.operators.lines import stitched
from cinderline.operators.overlay import ENDS, closed_rings, cut_edges, edges_of, sides, strung
from cinderline.sources.tables import materialise

POINTS = "array<struct<x:double,y:double>>"


def fewer(points: np.ndarray, tolerance: float, least: int) -> np.ndarray:
    """Indexes of the points that Douglas and Peucker's method keeps of a line, in order: the farthest from a chord, again and again, while it is farther than the tolerance or fewer than `least` inner points are kept. The ends of a closed line are one point."""
    kept, todo, waiting = {0, len(points) - 1}, [(0, len(points) - 1)], []
    while todo or (waiting and len(kept) - 2 < least):
        if todo:
            a, b = todo.pop()
        else:  # of what lies within the tolerance the farthest
            waiting.sort()
            _, a, b, k = waiting.pop()
            kept.add(k)
            todo += [(a, k), (k, b)]
            continue
        if b - a < 2:
            continue
        chord, inner = points[b] - points[a], points[a + 1 : b] - points[a]
        length = float(chord @ chord)
        t = np.clip(inner @ chord / length, 0, 1) if length else np.zeros(len(inner))
        away = np.hypot(*(inner - t[:, None] * chord).T)
        k = a + 1 + int(away.argmax())
        if away.max() > tolerance:
            kept.add(k)
            todo += [(a, k), (k, b)]
        else:
            waiting.append((float(away.max()), a, b, k))
    return np.array(sorted(kept))


def fewer_points(points: Column, tolerance: float, least: Column) -> Column:
    """The line with fewer points, none of the others farther than the tolerance from it."""

    @F.pandas_udf(POINTS)
    def simple(lines: pd.Series, inner: pd.Series) -> pd.Series:
        out = []
        for line, n in zip(lines, inner, strict=True):
            at = np.array([(p["x"], p["y"]) for p in line], float)
            out.append([{"x": float(x), "y": float(y)} for x, y in at[fewer(at, tolerance, int(n))]])
        return pd.Series(out)

    return simple(points, least)


def arcs(shapes: DataFrame, key: str, size: float, digits: int = 9) -> DataFrame:
    """left, right (sorted keys of the shapes on each side of it), points, closed: the arcs of all borders, each once. An arc ends where others begin; a border that meets none is closed.

    Shapes (key once, rings) may meet in corners or on each other's sides.
    """
    some = shapes.where("size(rings) > 0").select(key, "rings")
    pieces = materialise(cut_edges(edges_of(some, key).withColumn("_one", F.lit(0)).drop(key), "_one", size, digits).drop("_one").withColumn("piece", F.monotonically_increasing_id()))
    held = covered_points(sides(pieces), polygon_cover(some, key, size), "point", key, size)
    by = held.groupBy(F.col("point.piece").alias("piece")).agg(*(F.array_sort(F.collect_set(F.when(F.col("point.left") == is_left, F.col(key)))).alias(c) for is_left, c in ((True, "left"), (False, "right"))))
    # The side of the lesser list is to be on the left, so that a border runs one way.
    lists = pieces.join(by, "piece").where(F.to_json("left") != F.to_json("right"))
    turned = F.to_json("left") > F.to_json("right")
    pick = lambda a, b: F.when(turned, F.col(b)).otherwise(F.col(a))
    owned = materialise(lists.select(*(pick(c, d).alias(c) for c, d in zip(ENDS, ("bx", "by", "ax", "ay"), strict=True)), pick("left", "right").alias("left"), pick("right", "left").alias("right")).withColumn("border", F.concat_ws("|", F.to_json("left"), F.to_json("right"))))
    point = F.struct("x", "y")
    lines = stitched(owned, "border").groupBy("border", "line").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", point.alias("p")))), lambda s: s["p"]).alias("points"))
    lines = materialise(lines.withColumn("closed", F.lit(False)))
    # What no line holds runs in loops.
    used = lines.select("border", F.explode(segments(F.col("points"))).alias("s")).select("border", F.explode(F.array(F.struct("s.a", "s.b"), F.struct(F.col("s.b").alias("a"), F.col("s.a").alias("b")))).alias("s"))
    flat = used.select("border", F.col("s.a.x").alias("ax"), F.col("s.a.y").alias("ay"), F.col("s.b.x").alias("bx"), F.col("s.b.y").alias("by"))
    rest = materialise(owned.join(flat, ["border", *ENDS], "left_anti"))
    ring = strung(rest, "border").groupBy("border", "ring").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")).alias("p")))), lambda s: s["p"]).alias("points"))
    loops = ring.select("border", F.concat("points", F.slice("points", 1, 1)).alias("points"), F.lit(True).alias("closed"))
    both = lines.select("border", "points", "closed").unionByName(loops)
    # A line may have been strung against its border's direction: its first segment tells.
    first = both.select("border", "points", "closed", F.col("points")[0]["x"].alias("ax"), F.col("points")[0]["y"].alias("ay"), F.col("points")[1]["x"].alias("bx"), F.col("points")[1]["y"].alias("by"))
    same = first.join(owned.select("border", *ENDS, F.lit(True).alias("same")), ["border", *ENDS], "left")
    names = owned.select("border", "left", "right").distinct()
    return same.join(names, "border").select("left", "right", F.when(F.col("same"), F.col("points")).otherwise(F.reverse("points")).alias("points"), "closed")


def simplified(shapes: DataFrame, key: str, tolerance: float, size: float, digits: int = 9) -> DataFrame:
    """key, ring, area, length: the shapes' rings (holes have a negative area) with fewer corners, none of the others farther than the tolerance from its border.

    Neighbours share every border as before, for each is simplified once. Points where borders meet
    stay; a closed border keeps three corners, and of several borders between the same two points all
    but the shortest keep a corner between them, so every ring has an area.
    """
    a = materialise(arcs(shapes, key, size, digits))
    last = F.element_at("points", -1)
    ends = materialise(a.select("*", F.least(F.col("points")[0], last).alias("_u"), F.greatest(F.col("points")[0], last).alias("_v"), line_length(F.col("points")).alias("_n"), F.xxhash64("points").alias("_h")))
    shortest = ends.where("not closed").groupBy("_u", "_v").agg(F.min(F.struct("_n", "_h")).alias("_s"))
    least = F.when(F.col("closed"), 2).when(F.struct("_n", "_h") != F.col("_s"), 1).otherwise(0)
    simple = materialise(ends.join(shortest, ["_u", "_v"], "left").select("left", "right", fewer_points(F.col("points"), tolerance, least).alias("points")))
    edge = simple.select("left", "right", F.explode(segments(F.col("points"))).alias("e"))
    on = lambda side, a, b: edge.select(F.explode(side).alias(key), *(F.col(f"e.{p}.{c}").alias(f"{n}{c}") for n, p in (("a", a), ("b", b)) for c in "xy"))
    return closed_rings(on("left", "a", "b").unionByName(on("right", "b", "a")), key)
