"""Shapes from directed edges: regions of raster cells, intersections, unions and repair, without whole shapes in one row until their rings are.

Edges of all shapes that belong together are cut where they meet. Each piece is kept if what is asked
for holds on one of its sides only, and turned so that this side is its left. The pieces are then
strung to rings: each is followed by the piece that begins at its end (of several, that which turns
most to the left), and all pieces of a ring find its least piece, and how far they are from it, by
pointers that double their reach from round to round. Every round is a join of tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderline.functions.geometry import all_edges, edges, on_edge, ring_contains
from cinderline.operators.cover import covered_points, edge_cover, polygon_cover
from cinderline.operators.spatial import box_join, ends, flat_edge
from cinderline.sources.tables import materialise

ENDS = ("ax", "ay", "bx", "by")
#: How far beside a piece its sides are looked at, in parts of its length.
BESIDE = 1e-4


def strung(outline: DataFrame, key: str) -> DataFrame:
    """outline (key, ax, ay, bx, by) with ring and place: which ring an edge is in, and its place there, from the ring's least corner on.

    Edges are directed; at every corner as many begin as end. Where several begin, an edge is followed
    by that which turns most to the left, so rings that touch stay apart. Repeated edges count once.
    """
    e = materialise(outline.select(key, *ENDS).distinct().withColumn("id", F.monotonically_increasing_id()))
    after = e.select(F.col(key).alias("_k"), F.col("ax").alias("_x"), F.col("ay").alias("_y"), (F.col("bx") - F.col("ax")).alias("_dx"), (F.col("by") - F.col("ay")).alias("_dy"), F.col("id").alias("_to"))
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    turn = F.atan2(dx * F.col("_dy") - dy * F.col("_dx"), dx * F.col("_dx") + dy * F.col("_dy"))
    corner = F.struct("ax", "ay", "id")
    linked = e.join(after, (F.col(key) == F.col("_k")) & (F.col("bx") == F.col("_x")) & (F.col("by") == F.col("_y")))
    now = materialise(linked.groupBy("id").agg(F.max_by("_to", F.struct(turn, "_to")).alias("to"), F.first(corner).alias("least"), F.lit(0).cast("long").alias("at")))
    reach = 1
    while True:
        ahead = now.select(F.col("id").alias("to"), F.col("to").alias("_to"), F.col("least").alias("_least"), F.col("at").alias("_at"))
        less = F.col("_least") < F.col("least")
        now = materialise(
            now.join(ahead, "to").select("id", F.col("_to").alias("to"), F.least("least", "_least").alias("least"), F.when(less, F.col("_at") + reach).otherwise(F.col("at")).alias("at"), less.alias("moved"))
        )
        # If no edge sees a lesser corner at twice the reach, all see their ring's least one.
        if now.where("moved").isEmpty():
            return e.join(now.select("id", F.col("least.id").alias("ring"), F.when(F.col("at") == 0, F.lit(0)).otherwise(-F.col("at")).alias("_at")), "id").withColumn("place", F.struct(F.col("_at") != 0, F.col("_at"))).drop("id", "_at")
        now, reach = now.drop("moved"), reach * 2


def closed_rings(outline: DataFrame, key: str) -> DataFrame:
    """key, ring (points from the least corner on, not closed), area (negative for holes), length, of the rings that directed edges form; corners between edges of one direction go."""
    part = F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")
    by = strung(outline, key).groupBy(key, "ring").agg(
        (F.sum(part) / 2).alias("area"), F.sum(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))).alias("length"), F.array_sort(F.collect_list(F.struct("place", F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")).alias("p")))).alias("_points"),
    )
    points = F.transform("_points", lambda s: s["p"])
    n = F.size(points)
    straight = lambda a, b, c: (b["x"] - a["x"]) * (c["y"] - b["y"]) == (b["y"] - a["y"]) * (c["x"] - b["x"])
    held = by.withColumn("_p", points)
    kept = F.filter(F.transform("_p", lambda p, i: F.struct(p.alias("p"), straight(F.get("_p", F.pmod(i - 1, F.size("_p"))), p, F.get("_p", F.pmod(i + 1, F.size("_p")))).alias("flat"))), lambda s: ~s["flat"])
    return held.where(n > 2).select(key, F.transform(kept, lambda s: s["p"]).alias("ring"), "area", "length")


def cell_outline(cells: DataFrame, key: str) -> DataFrame:
    """key, ax, ay, bx, by: the directed outline of the cells (key, row, col) of each key, cells on the left. Cell (row, col) is the square from (col, row) to (col + 1, row + 1).

    Every cell gives its four edges; what two neighbours give runs both ways and vanishes. Edges in one
    line are joined to runs. No row holds more than a run; repeated cells count once.
    """
    c, r = F.col("col").cast("double"), F.col("row").cast("double")
    edge = lambda flat, line, at, way: F.struct(F.lit(flat).alias("flat"), line.alias("line"), at.alias("at"), F.lit(way).alias("way"))
    four = F.array(edge(True, r, c, 1), edge(False, c + 1, r, 1), edge(True, r + 1, c, -1), edge(False, c, r, -1))
    single = cells.select(key, "row", "col").distinct().select(key, F.explode(four).alias("e")).select(key, "e.*").groupBy(key, "flat", "line", "at").agg(F.count("*").alias("n"), F.first("way").alias("way")).where("n = 1")
    # Neighbours in a line whose direction is the same have the same difference to their number.
    w = Window.partitionBy(key, "flat", "line", "way").orderBy("at")
    runs = single.withColumn("_run", F.col("at") - F.row_number().over(w)).groupBy(key, "flat", "line", "way", "_run").agg(F.min("at").alias("lo"), (F.max("at") + 1).alias("hi"))
    start, stop = F.when(F.col("way") == 1, F.col("lo")).otherwise(F.col("hi")), F.when(F.col("way") == 1, F.col("hi")).otherwise(F.col("lo"))
    pick = lambda flat, x: F.when(F.col("flat"), flat).otherwise(x)
    return runs.select(key, pick(start, F.col("line")).alias("ax"), pick(F.col("line"), start).alias("ay"), pick(stop, F.col("line")).alias("bx"), pick(F.col("line"), stop).alias("by"))


def raster_regions(cells: DataFrame, key: str, origin: tuple[float, float] = (0.0, 0.0), size: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """key, ring, area, length: the outlines of all cells (key, row, col) of a key, dissolved; holes have a negative area.

    Cells that touch at a corner only are in different rings. origin: the corner of cell (0, 0); size:
    of a cell in x and y (negative where rows count downward; areas keep their sign).
    """
    flip = F.lit(size[0] * size[1] < 0)
    scaled = {k: origin["xy".index(k[1])] + F.col(k) * size["xy".index(k[1])] for k in ENDS}
    laid = cell_outline(cells, key).select(key, *(scaled[k].alias(k) for k in ENDS))
    back = {"ax": "bx", "ay": "by", "bx": "ax", "by": "ay"}
    return closed_rings(laid.select(key, *(F.when(flip, F.col(back[k])).otherwise(F.col(k)).alias(k) for k in ENDS)), key)


def cut_edges(loose: DataFrame, key: str, size: float, digits: int) -> DataFrame:
    """key, ax, ay, bx, by: pieces of the edges of a key between all points where they meet, undirected, once each. Coordinates are rounded to so many digits, so that meeting points are equal."""
    rounded = loose.select(key, *(F.round(F.col(c), digits).alias(c) for c in ENDS))
    first = F.struct("ax", "ay") <= F.struct("bx", "by")
    turned = rounded.select(key, *(F.when(first, F.col(c)).otherwise(F.col(d)).alias(c) for c, d in zip(ENDS, ("bx", "by", "ax", "ay"), strict=True)))
    one = materialise(turned.where("ax <> bx or ay <> by").distinct())
    box = {"min_x": F.least("ax", "bx"), "min_y": F.least("ay", "by"), "max_x": F.greatest("ax", "bx"), "max_y": F.greatest("ay", "by")}
    dealt = lambda name: one.select(F.struct(F.col(key).alias("key"), *ENDS).alias(name), F.col(key).alias("_of"), *(c.alias(k) for k, c in box.items()))
    pairs = box_join(dealt("e"), dealt("f"), "e", "f", size, on=("_of",)).where(F.col("e") < F.col("f"))
    e, f = flat_edge("e"), flat_edge("f")
    rx, ry = (e["b"][c] - e["a"][c] for c in "xy")
    sx, sy = (f["b"][c] - f["a"][c] for c in "xy")
    qx, qy = (f["a"][c] - e["a"][c] for c in "xy")
    across = F.nullif(rx * sy - ry * sx, F.lit(0.0))
    placed = pairs.withColumns({"_t": (qx * sy - qy * sx) / across, "_u": (qx * ry - qy * rx) / across})
    point = F.struct(F.round(e["a"]["x"] + F.col("_t") * rx, digits).alias("x"), F.round(e["a"]["y"] + F.col("_t") * ry, digits).alias("y"))
    meet = F.when(F.col("_t").between(0, 1) & F.col("_u").between(0, 1), point)
    on = lambda edge, p: F.when(on_edge(edge, p["x"], p["y"]), F.struct(p["x"].alias("x"), p["y"].alias("y")))
    found = lambda first, p: F.struct(F.lit(first).alias("first"), p.alias("p"))
    spots = F.array(found(True, meet), found(False, meet), found(True, on(e, f["a"])), found(True, on(e, f["b"])), found(False, on(f, e["a"])), found(False, on(f, e["b"])))
    met = placed.select("e", "f", F.explode(spots).alias("m")).where("m.p is not null").select(F.when(F.col("m.first"), F.col("e")).otherwise(F.col("f")).alias("e"), "m.p")
    both_ends = F.array(*(F.struct(F.col(f"{k}x").alias("x"), F.col(f"{k}y").alias("y")) for k in "ab"))
    ends_ = one.select(F.struct(F.col(key).alias("key"), *ENDS).alias("e"), F.explode(both_ends).alias("p"))
    # In the order of the points themselves, which is that along the edge.
    by = met.unionByName(ends_).groupBy("e").agg(F.sort_array(F.collect_set("p")).alias("p"))
    n = F.size("p")
    piece = F.explode(F.arrays_zip(F.slice("p", F.lit(1), n - 1).alias("a"), F.slice("p", F.lit(2), n - 1).alias("b"))).alias("s")
    return by.where(n > 1).select(F.col("e.key").alias(key), piece).select(key, F.col("s.a.x").alias("ax"), F.col("s.a.y").alias("ay"), F.col("s.b.x").alias("bx"), F.col("s.b.y").alias("by")).distinct()


def sides(pieces: DataFrame, *kept: str) -> DataFrame:
    """A point left and one right of each piece: point (piece, left), x, y, and the columns that are kept."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    mid = ((F.col("ax") + F.col("bx")) / 2, (F.col("ay") + F.col("by")) / 2)
    beside = lambda way, left: F.struct(F.lit(left).alias("left"), (mid[0] - way * BESIDE * dy).alias("x"), (mid[1] + way * BESIDE * dx).alias("y"))
    return pieces.select("piece", *kept, F.explode(F.array(beside(1, True), beside(-1, False))).alias("s")).select(F.struct("piece", "s.left").alias("point"), "s.x", "s.y", *kept)


def bordering(pieces: DataFrame, key: str, inside: DataFrame) -> DataFrame:
    """The pieces one side of which is inside and the other is not, inside on the left. inside: piece, left of the points that are."""
    by = inside.groupBy("piece").agg(F.bool_or("left").alias("_in"), F.bool_or(~F.col("left")).alias("_out"))
    kept = pieces.join(by, "piece").where(F.col("_in") != F.col("_out"))
    return kept.select(key, *(F.when(F.col("_in"), F.col(c)).otherwise(F.col(d)).alias(c) for c, d in zip(ENDS, ("bx", "by", "ax", "ay"), strict=True)))


def edges_of(shapes: DataFrame, key: str) -> DataFrame:
    return shapes.select(key, F.explode(all_edges(F.col("rings"))).alias("e")).select(key, *(F.col(f"e.{c[0]}.{c[1]}").alias(c) for c in ENDS))


def without_dangles(pieces: DataFrame, key: str) -> DataFrame:
    """The pieces that bound something: those that end where no other piece is go, again and again."""
    while True:
        corners = pieces.select(key, F.explode(F.array(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y")))).alias("c"))
        loose = materialise(corners.groupBy(key, "c").count().where("count = 1").select(key, "c.x", "c.y"))
        if loose.isEmpty():
            return pieces
        for x, y in (("ax", "ay"), ("bx", "by")):
            pieces = pieces.join(loose.select(key, F.col("x").alias(x), F.col("y").alias(y)), [key, x, y], "left_anti")
        pieces = materialise(pieces)


def repaired(shapes: DataFrame, key: str, size: float, digits: int = 9) -> DataFrame:
    """key, ring, area, length: the rings of what a shape's lines enclose, simple and turned (holes have a negative area).

    shapes: key (once), rings. Lines are cut where they cross; a line drawn twice counts once, and what
    ends in nothing goes. What is then inside an odd number of times is kept. A valid shape stays as it
    is, but for the order of its corners. Null and empty rings give no row.
    """
    some = shapes.where("size(rings) > 0").select(key, "rings")
    cut = materialise(cut_edges(edges_of(some, key), key, size, digits))
    pieces = materialise(without_dangles(cut, key).withColumn("piece", F.monotonically_increasing_id()))
    drawn = pieces.groupBy(F.col(key).alias("_shape")).agg(F.collect_list(ends(F.struct(*ENDS))).alias("edges"))
    found = covered_points(sides(pieces.withColumn("_shape", F.col(key)), "_shape"), edge_cover(drawn, "_shape", size), "point", "_shape", size, ("_shape",))
    return closed_rings(bordering(pieces, key, found.select("point.piece", "point.left")), key)


def overlay(pairs: DataFrame, left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str, size: float, how: str = "intersection", digits: int = 9) -> DataFrame:
    """key, ring, area, length: the rings of the intersection, union or difference of two shapes, for each row of pairs (key, left_id, right_id).

    left, right: id (once), rings of any form, with holes or of several polygons; what lies inside an odd
    number of times counts as inside. Borders that both share are handled as one. Holes have a negative
    area; pairs without anything in common have no row.
    """
    a, b = (df.where("size(rings) > 0").select(F.col(i).alias(n), "rings") for df, i, n in ((left, left_id, "_l"), (right, right_id, "_r")))
    who = materialise(pairs.select(key, F.col(left_id).alias("_l"), F.col(right_id).alias("_r")))
    both = edges_of(who.join(a, "_l"), key).unionByName(edges_of(who.join(b, "_r"), key))
    pieces = materialise(cut_edges(both, key, size, digits).join(who, key).withColumn("piece", F.monotonically_increasing_id()))

    def held(shapes: DataFrame, n: str) -> DataFrame:
        some = shapes.join(who.select(n).distinct(), n, "left_semi")
        found = covered_points(sides(pieces, n), polygon_cover(some, n, size), "point", n, size, (n,))
        return found.select("point.piece", "point.left", F.lit(n).alias("of"))

    by = held(a, "_l").unionByName(held(b, "_r")).groupBy("piece", "left").agg(F.collect_set("of").alias("of"))
    wanted = {"intersection": F.size("of") == 2, "union": F.size("of") > 0, "difference": (F.size("of") == 1) & F.array_contains("of", "_l")}[how]
    return closed_rings(bordering(pieces, key, by.where(wanted)), key)


def united(shapes: DataFrame, key: str, shape_id: str, size: float, digits: int = 9) -> DataFrame:
    """key, ring, area, length: the union of all shapes (shape_id, rings) of a key. Shapes meet edge by edge; none is held together with all others."""
    some = shapes.where("size(rings) > 0").select(key, shape_id, "rings")
    pieces = materialise(cut_edges(edges_of(some, key), key, size, digits).withColumn("piece", F.monotonically_increasing_id()))
    cover = polygon_cover(some.withColumn("_shape", F.struct(F.col(key).alias("of"), shape_id)), "_shape", size).withColumn("_of", F.col("_shape.of"))
    found = covered_points(sides(pieces.withColumn("_of", F.col(key)), "_of"), cover, "point", "_shape", size, ("_of",))
    return closed_rings(bordering(pieces, key, found.select("point.piece", "point.left").distinct()), key)


def parts_of(rings: DataFrame, key: str) -> DataFrame:
    """key, part (from 0, by the least corner), rings (the outer one, then its holes), size (its area): rings of closed_rings as polygons. A hole belongs to the smallest outer ring around its first corner."""
    holes = rings.where("area < 0").select(key, F.col("ring").alias("hole"), F.col("area").alias("hole_area"), F.xxhash64("ring").alias("_h"))
    outer = rings.where("area > 0").select(key, "ring", "area")
    corner = F.col("hole")[0]
    # Beside the hole's first edge, outside the hole and so inside its outer ring.
    step = F.col("hole")[1]
    x, y = (corner["x"] + step["x"]) / 2 - BESIDE * (step["y"] - corner["y"]), (corner["y"] + step["y"]) / 2 + BESIDE * (step["x"] - corner["x"])
    around = holes.join(outer, key).where(ring_contains(F.col("ring"), x, y)).groupBy(key, "_h").agg(F.min_by("ring", "area").alias("ring"), F.first("hole").alias("hole"), F.first("hole_area").alias("hole_area"))
    held = around.groupBy(key, "ring").agg(F.array_sort(F.collect_list("hole")).alias("holes"), F.sum("hole_area").alias("less"))
    whole = outer.join(held, [key, "ring"], "left")
    number = (F.row_number().over(Window.partitionBy(key).orderBy(F.col("ring")[0], "area")) - 1).alias("part")
    return whole.select(key, number, F.concat(F.array("ring"), F.coalesce("holes", F.array().cast("array<array<struct<x:double,y:double>>>"))).alias("rings"), (F.col("area") + F.coalesce("less", F.lit(0.0))).alias("size"))


def envelope(wanted: DataFrame, features: DataFrame, areas: DataFrame, area_id: str, name: str, size: float) -> tuple[DataFrame, DataFrame]:
    """Parts of an area's features, and what is missing.

    wanted: area_id, name (of one group within an area, each once); features: area_id, name, rings; areas:
    area_id, rings. First table: area_id, name, part, rings, size of each wanted feature cut to its area,
    parts counted from 0 within a feature. Second: area_id, missing, the sorted names without a feature.
    """
    asked = wanted.select(area_id, name).distinct()
    found = asked.join(features.where("size(rings) > 0").select(area_id, name, "rings"), [area_id, name])
    key = F.struct(area_id, name).alias("_key")
    pairs = found.select(key, F.struct(area_id, name).alias("_feature"), F.col(area_id).alias("_area"))
    cut = overlay(pairs, found.select(F.struct(area_id, name).alias("_feature"), "rings"), areas.select(F.col(area_id).alias("_area"), "rings"), "_key", "_feature", "_area", size)
    parts = parts_of(cut, "_key").select(F.col(f"_key.{area_id}").alias(area_id), F.col(f"_key.{name}").alias(name), "part", "rings", "size")
    missing = asked.join(found, [area_id, name], "left_anti").groupBy(area_id).agg(F.array_sort(F.collect_set(name)).alias("missing"))
    return parts, missing


def clipped(ring: Column, window: Column) -> Column:
    """A ring cut to a convex window, whose corners run to the left: each side of the window cuts off what lies right of it. Empty if nothing is left."""

    def by_side(kept: Column, s: Column) -> Column:
        left = lambda p: (s["b"]["x"] - s["a"]["x"]) * (p["y"] - s["a"]["y"]) - (s["b"]["y"] - s["a"]["y"]) * (p["x"] - s["a"]["x"])

        def step(e: Column) -> Column:
            u, v = left(e["a"]), left(e["b"])
            t = u / F.nullif(u - v, F.lit(0.0))
            meet = F.struct((e["a"]["x"] + t * (e["b"]["x"] - e["a"]["x"])).alias("x"), (e["a"]["y"] + t * (e["b"]["y"] - e["a"]["y"])).alias("y"))
            crossing = F.when((u < 0) != (v < 0), F.array(meet)).otherwise(F.slice(F.array(meet), F.lit(1), F.lit(0)))
            return F.concat(crossing, F.when(v >= 0, F.array(e["b"])).otherwise(F.slice(F.array(meet), F.lit(1), F.lit(0))))

        return F.flatten(F.transform(edges(kept), step))

    return F.aggregate(edges(window), ring, by_side)
