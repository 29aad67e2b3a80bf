"""Spatial joins by grid cells: an equality join on the cells that boxes touch, then the exact test."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderline.functions.geometry import all_edges, bounds, boxes_overlap, edges, edges_meet, footprint_miles, outline_distance, outlines_apart, outlines_between, polygon_contains, projected, projected_rings, rings_bounds
from cinderline.functions.labels import proximity_tier
from cinderline.functions.rules import EARTH_RADIUS_METERS, METERS_PER_MILE, NEAR_MILES, REGIONAL_ACRES, REGIONAL_MILES
from cinderline.operators.cover import covered_points, polygon_cover
from cinderline.sources.tables import materialise

#: Metres a degree of latitude.
GROUND = math.pi / 180 * EARTH_RADIUS_METERS


def cells(min_x: Column, min_y: Column, max_x: Column, max_y: Column, size: float | Column) -> Column:
    """Array of (i, j) of all grid cells that a box touches."""
    span = lambda a, b: F.sequence(F.floor(a / size), F.floor(b / size))
    return F.flatten(F.transform(span(min_x, max_x), lambda i: F.transform(span(min_y, max_y), lambda j: F.struct(i.alias("i"), j.alias("j")))))


def by_cell(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """An equality join whose result may be far larger than its inputs: small inputs, too, are dealt to all shuffle partitions, not broadcast or put together in a few."""
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return left.repartition(n, *keys).hint("merge").join(right.repartition(n, *keys), keys)


#: Cells that a box is copied to on its own grid at most, and how much larger the next grid's cells are.
MOST_CELLS, COARSER, GRIDS = 256, 16, 6


def box_join(left: DataFrame, right: DataFrame, left_id: str, right_id: str, size: float, unboxed: bool = False, most_unboxed: int = 1000, on: tuple[str, ...] = (), carried: tuple[tuple[str, ...], tuple[str, ...]] = ((), ())) -> DataFrame:
    """Pairs of ids whose boxes (min_x, min_y, max_x, max_y) overlap.

    Boxes meet in the cell where their intersection begins, so each pair comes once and needs no
    distinct. A box of many cells goes to a coarser grid. On its own grid a box meets those of the same
    or of finer grids, which are copied to the grids that the other side has; boxes of fine grids alone
    never meet on a coarse one. Rows without a box overlap everything by definition; they are paired
    only with `unboxed`, if either side has `most_unboxed` of them at most (ValueError otherwise). on:
    columns of both sides that must be equal, too. carried: columns of the left and the right side that
    go along to the pairs of boxes, so that these need not be joined again.
    """
    box = ("min_x", "min_y", "max_x", "max_y")
    if unboxed and any(carried):
        raise ValueError("rows without a box carry no columns")

    def gridded(df: DataFrame, row_id: str, p: str, more: tuple[str, ...]) -> DataFrame:
        wide = lambda k: (F.floor((F.col("max_x") - F.col("min_x")) / (size * COARSER**k)) + 2) * (F.floor((F.col("max_y") - F.col("min_y")) / (size * COARSER**k)) + 2)
        own = F.lit(GRIDS - 1)
        for k in reversed(range(GRIDS - 1)):
            own = F.when(wide(k) <= MOST_CELLS, k).otherwise(own)
        boxed = df.where(" and ".join(f"{x} is not null" for x in box))
        return boxed.select(row_id, *on, *more, own.alias("_own"), *(F.col(x).alias(f"{p}_{x}") for x in box))

    def dealt(df: DataFrame, p: str, grids: Column) -> DataFrame:
        by = df.withColumn("_grid", F.explode(grids)).withColumn("_size", size * F.pow(F.lit(float(COARSER)), F.col("_grid")))
        return by.withColumn("c", F.explode(cells(*(F.col(f"{p}_{x}") for x in box), F.col("_size")))).select("*", "c.i", "c.j").drop("c", "_own")

    a, b = gridded(left, left_id, "a", carried[0]), gridded(right, right_id, "b", carried[1])
    grids_a, grids_b = (sorted(r._own for r in df.select("_own").distinct().collect()) for df in (a, b))  # GRIDS at most
    own = (F.col("i") == F.floor(F.greatest("a_min_x", "b_min_x") / F.col("_size"))) & (F.col("j") == F.floor(F.greatest("a_min_y", "b_min_y") / F.col("_size")))
    overlap = boxes_overlap(tuple(F.col(f"a_{x}") for x in box), tuple(F.col(f"b_{x}") for x in box))
    alone = F.array("_own")
    coarser = lambda grids, least: F.filter(F.array(*map(F.lit, grids)).cast("array<int>"), lambda k: k >= least)
    met = lambda x, y: by_cell(x, y.drop("_size"), [*on, "_grid", "i", "j"]).where(own & overlap).select(left_id, right_id, *carried[0], *carried[1])
    pairs = met(dealt(a, "a", alone), dealt(b, "b", coarser(grids_a, F.col("_own"))))
    if grids_a and grids_b and grids_b[-1] > grids_a[0]:
        pairs = pairs.unionByName(met(dealt(a, "a", coarser(grids_b, F.col("_own") + 1)), dealt(b, "b", alone)))
    if unboxed:
        missing = " or ".join(f"{x} is null" for x in box)
        if max(df.where(missing).count() for df in (left, right)) > most_unboxed:
            raise ValueError(f"more than {most_unboxed} rows without a box, each of which would be paired with everything")
        pairs = pairs.unionByName(left.where(missing).select(left_id).crossJoin(right.select(right_id)))
        pairs = pairs.unionByName(left.where(f"not ({missing})").select(left_id).crossJoin(right.where(missing).select(right_id)))
    return pairs


def edge_pairs(left: DataFrame, right: DataFrame, left_id: str, right_id: str, size: float) -> DataFrame:
    """(a, b): structs of an id, ax, ay, bx, by for each two edges of rings on both sides whose boxes overlap; an equality join on the cells of the edges, not of the polygons."""

    def dealt(df: DataFrame, row_id: str, name: str) -> DataFrame:
        e = df.select(row_id, F.explode(all_edges(F.col("rings"))).alias("e")).select(row_id, *(F.col(f"e.{k}.{c}").alias(f"{k}{c}") for k in "ab" for c in "xy"))
        box = {"min_x": F.least("ax", "bx"), "min_y": F.least("ay", "by"), "max_x": F.greatest("ax", "bx"), "max_y": F.greatest("ay", "by")}
        return e.select(F.struct(F.col(row_id).alias("id"), "ax", "ay", "bx", "by").alias(name), *(c.alias(k) for k, c in box.items()))

    return box_join(dealt(left, left_id, "a"), dealt(right, right_id, "b"), "a", "b", size)


def ends(e: Column) -> Column:
    """ax, ay, bx, by as (a, b)."""
    return F.struct(*(F.struct(e[f"{k}x"].alias("x"), e[f"{k}y"].alias("y")).alias(k) for k in "ab"))


def flat_edge(name: str) -> dict[str, dict[str, Column]]:
    """An edge's ax, ay, bx, by in the struct of this name as a and b with x and y each: for expressions without structs or lambdas, which Spark compiles."""
    return {k: {c: F.col(f"{name}.{k}{c}") for c in "xy"} for k in "ab"}


def polygon_pairs(left: DataFrame, right: DataFrame, left_id: str, right_id: str, size: float) -> DataFrame:
    """Pairs of ids whose polygons (rings) have a point in common: edges that meet, found edge by edge, or else one holds a corner of the other's rings."""
    rings = lambda df, row_id, name: df.where("size(rings) > 0").select(F.col(row_id).alias(name), "rings")
    a, b = rings(left, left_id, "_l"), rings(right, right_id, "_r")
    boxed = lambda df, row_id: df.select(row_id, rings_bounds(F.col("rings")).alias("b")).select(row_id, "b.*")
    near = materialise(box_join(boxed(a, "_l"), boxed(b, "_r"), "_l", "_r", size))
    some = lambda df, row_id: df.join(near.select(row_id).distinct(), row_id, "left_semi")
    met = edge_pairs(some(a, "_l"), some(b, "_r"), "_l", "_r", size).where(edges_meet(flat_edge("a"), flat_edge("b"))).select(F.col("a.id").alias("_l"), F.col("b.id").alias("_r")).distinct()
    met = materialise(met)
    apart = near.join(met, ["_l", "_r"], "left_anti").join(a.withColumnRenamed("rings", "_a"), "_l").join(b.withColumnRenamed("rings", "_b"), "_r")
    corner_in = lambda p, q: F.exists(p, lambda r: polygon_contains(F.col(q), F.get(r, F.lit(0))["x"], F.get(r, F.lit(0))["y"]))
    within = apart.where(corner_in("_a", "_b") | corner_in("_b", "_a")).select("_l", "_r")
    return met.unionByName(within).select(F.col("_l").alias(left_id), F.col("_r").alias(right_id))


#: Neighbouring edges of an outline that are told apart only when their box may hold the nearest ones.
GROUP = 16


def edge_groups(rings: Column) -> Column:
    """Array of (edges, box) over the edges of all rings, some at a time."""
    e = all_edges(rings)
    part = lambda k: F.slice(e, k * GROUP + 1, F.lit(GROUP))
    corners = lambda g: F.concat(F.transform(g, lambda x: x["a"]), F.transform(g, lambda x: x["b"]))
    return F.transform(F.sequence(F.lit(0), F.ceil(F.size(e) / GROUP).cast("int") - 1), lambda k: F.struct(part(k).alias("edges"), bounds(corners(part(k))).alias("box")))


def outline_distances(pairs: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """keys, distance: the least between two outlines (arrays of rings, in a plane) that do not meet, for each row of pairs.

    Outlines of a few edges are compared at once. Of others, boxes of neighbouring edges come first: a
    pair of boxes is looked into if it is no farther apart than two corners of these outlines are at
    most; only then are edges compared with edges.
    """
    edged = pairs.select(*keys, all_edges(F.col(a)).alias("_a"), all_edges(F.col(b)).alias("_b"), F.col(a).alias("_ra"), F.col(b).alias("_rb"))
    few = (F.size("_a") <= GROUP) & (F.size("_b") <= GROUP)
    direct = edged.where(few & (F.size("_a") > 0) & (F.size("_b") > 0)).select(*keys, outlines_apart(F.col("_a"), F.col("_b")).alias("distance"))
    held = materialise(edged.where(~few & (F.size("_a") > 0) & (F.size("_b") > 0)).select(*keys, edge_groups(F.col("_ra")).alias("_p"), edge_groups(F.col("_rb")).alias("_q")))
    if held.isEmpty():
        return direct
    both = held.select(*keys, F.explode("_p").alias("_g"), "_q").select(*keys, "_g", F.explode("_q").alias("_h"))
    gap = lambda k: F.greatest(F.col(f"_g.box.min_{k}") - F.col(f"_h.box.max_{k}"), F.col(f"_h.box.min_{k}") - F.col(f"_g.box.max_{k}"), F.lit(0.0))
    start = lambda g: F.col(g)["edges"][0]["a"]
    most = both.groupBy(*keys).agg(F.min(F.hypot(start("_g")["x"] - start("_h")["x"], start("_g")["y"] - start("_h")["y"])).alias("_most"))
    near = both.join(most, keys).where(F.hypot(gap("x"), gap("y")) <= F.col("_most") * (1 + 1e-9)).select(*keys, F.col("_g.edges").alias("_g"), F.col("_h.edges").alias("_h"))
    apart = near.select(*keys, outlines_apart(F.col("_g"), F.col("_h")).alias("_d"))
    return direct.unionByName(apart.groupBy(*keys).agg(F.min("_d").alias("distance")))


def places_in_boundaries(places: DataFrame, boundaries: DataFrame, place_id: str, boundary_id: str, size: float) -> DataFrame:
    """(place, boundary, how): contains for a place's point (x, y) in a boundary (rings), else intersects for its own rings, if it has any."""
    inside = points_in_polygons(places.where("x is not null and y is not null"), boundaries, place_id, boundary_id, size).withColumn("how", F.lit("contains"))
    meets = polygon_pairs(places.where("size(rings) > 0"), boundaries, place_id, boundary_id, size)
    return inside.unionByName(meets.join(inside, [place_id, boundary_id], "left_anti").withColumn("how", F.lit("intersects")))


def places_in_rules(places: DataFrame, rules: DataFrame, areas: DataFrame, place_id: str, rule_id: str, area_id: str, size: float) -> DataFrame:
    """(place, rule, how) as places_in_boundaries, over the rules' own rings or, without any, those of their area. rules: rule_id, area_id (may be null), rings; areas: area_id (once), rings."""
    own = F.when(F.size("rings") > 0, F.col("rings"))
    drawn = rules.select(rule_id, area_id, own.alias("_own")).join(areas.select(area_id, F.col("rings").alias("_area")), area_id, "left")
    return places_in_boundaries(places, drawn.select(rule_id, F.coalesce("_own", "_area").alias("rings")).where("size(rings) > 0"), place_id, rule_id, size)


def boundary_proximity(boundaries: DataFrame, incidents: DataFrame, boundary_id: str, incident_id: str, within: float = 30.0) -> DataFrame:
    """(boundary, incident, miles, tier): inside where an incident's perimeter meets the boundary, else the tier of the distance between them.

    boundaries: rings in degrees, with holes or of several polygons; incidents: lon, lat, acres and
    rings (null: the circle of the area). Distances are on the plane that touches in the middle of
    the boundary's box. Outlines of a few edges go along to the cells and are measured there; only pairs
    with a longer one are joined with their outlines (long_proximity).
    """
    few, long = by_length(boundaries, incidents, boundary_id, incident_id, within)
    near = outline_box_pairs(*few, boundary_id, incident_id, within).withColumn("miles", outline_miles())
    found = reduce(DataFrame.unionByName, [near.where(F.col("miles") <= within).select(boundary_id, incident_id, "acres", "miles"), *long])
    return found.select(boundary_id, incident_id, "miles", proximity_tier(F.col("miles"), F.col("acres")).alias("tier")).where("tier is not null")


def boundary_incidents(boundaries: DataFrame, incidents: DataFrame, boundary_id: str, incident_id: str, within: float = 30.0, carried: tuple[str, ...] = ()) -> DataFrame:
    """(boundary, incident, the carried columns of incidents) of all pairs that have a tier, as in boundary_proximity, without the distance.

    Only those outlines are measured that the boxes leave open: as an outline touches all sides of its
    box, two are no farther apart than a side of the one and the facing side of the other can be.
    """
    few, long = by_length(boundaries, incidents, boundary_id, incident_id, within)
    near, cols = outline_box_pairs(*few, boundary_id, incident_id, within, carried), [boundary_id, incident_id, *carried]
    side = lambda k, q: F.least(F.abs(F.col(f"_{k}2") - F.col(f"_{q}1")), F.abs(F.col(f"_{q}2") - F.col(f"_{k}1")))
    span = lambda k, q: F.greatest(f"_{k}2", f"_{q}2") - F.least(f"_{k}1", f"_{q}1")
    squared = lambda x, y: F.pow(x * F.col("_east"), 2) + F.pow(y * GROUND, 2)
    most = F.least(squared(side("x", "u"), span("y", "v")), squared(span("x", "u"), side("y", "v")))
    sure = most <= F.pow((F.col("_limit") + F.col("_r")) * METERS_PER_MILE, 2) * (1 - 1e-9)
    rest = near.where(~sure).withColumn("miles", outline_miles()).where(F.col("miles") <= F.col("_limit")).select(*cols)
    far = [df.where(proximity_tier(F.col("miles"), F.col("acres")).isNotNull()).select(boundary_id, incident_id).join(incidents.select(incident_id, *carried), incident_id).select(*cols) for df in long]
    return reduce(DataFrame.unionByName, [near.where(sure).select(*cols), rest, *far])


def by_length(boundaries: DataFrame, incidents: DataFrame, boundary_id: str, incident_id: str, within: float) -> tuple[tuple[DataFrame, DataFrame], list[DataFrame]]:
    """Boundaries and incidents of GROUP edges at most, and long_proximity of the other pairs, if there are any."""
    few = F.coalesce(F.size(all_edges(F.col("rings"))), F.lit(0)) <= GROUP
    short = boundaries.where(few), incidents.where(few)
    some_long = [(boundaries.where(~few), incidents), (short[0], incidents.where(~few))]
    return short, [long_proximity(b, q, boundary_id, incident_id, within) for (b, q), sided in zip(some_long, (0, 1), strict=True) if not (b, q)[sided].isEmpty()]


def outline_box_pairs(boundaries: DataFrame, incidents: DataFrame, boundary_id: str, incident_id: str, within: float, carried: tuple[str, ...] = ()) -> DataFrame:
    """Pairs whose boxes are near enough for a tier: boundary_id, incident_id, acres, the carried columns of incidents, and what outline_miles asks for.

    _limit: miles up to which the incident has a tier; _x1 ... _y2, _u1 ... _v2: both boxes; _east:
    metres a degree of longitude; _r: miles of an incident's radius.
    """
    reach = within / 69.0
    numbers = lambda e: F.flatten(F.transform(e, lambda x: F.array(*(x[k][c] for k in "ab" for c in "xy"))))
    b = materialise(boundaries.where("size(rings) > 0").select(boundary_id, numbers(all_edges(F.col("rings"))).alias("_p"), rings_bounds(F.col("rings")).alias("box")))
    far = F.least(F.greatest(F.abs("_y1"), F.abs("_y2")) + reach, F.lit(89.0))
    wide = reach / F.greatest(F.cos(F.radians(far)), F.lit(0.01))
    left = b.select(boundary_id, "_p", *(F.col(f"box.{k}_{c}").alias(f"_{c}{n}") for n, k in ((1, "min"), (2, "max")) for c in "xy")).withColumns({"_lon0": (F.col("_x1") + F.col("_x2")) / 2, "_lat0": (F.col("_y1") + F.col("_y2")) / 2})
    left = left.withColumns({"_east": GROUND * F.cos(F.radians("_lat0")), "min_x": F.col("_x1") - wide, "min_y": F.col("_y1") - reach, "max_x": F.col("_x2") + wide, "max_y": F.col("_y2") + reach})
    mapped = F.coalesce(F.size("rings") > 0, F.lit(False))
    point = F.array("lon", "lat", "lon", "lat")
    own = F.when(mapped, rings_bounds(F.col("rings"))).otherwise(F.struct(F.col("lon").alias("min_x"), F.col("lat").alias("min_y"), F.col("lon").alias("max_x"), F.col("lat").alias("max_y")))
    limit = F.when(F.coalesce("acres", F.lit(0.0)) >= REGIONAL_ACRES, min(within, REGIONAL_MILES)).otherwise(min(within, NEAR_MILES))
    q = materialise(incidents.select(incident_id, "acres", *carried, F.when(mapped, numbers(all_edges(F.col("rings")))).otherwise(point).alias("_q"), F.when(mapped, 0.0).otherwise(footprint_miles(F.col("acres"))).alias("_r"), limit.alias("_limit"), own.alias("box")))
    grown, east = F.col("_r") / 69.0, F.col("_r") / 69.0 / F.greatest(F.cos(F.radians(F.least(F.abs("_v2") + 1, F.lit(89.0)))), F.lit(0.01))
    right = q.select(*q.drop("box").columns, *(F.col(f"box.{k}_{c}").alias(f"_{d}{n}") for n, k in ((1, "min"), (2, "max")) for c, d in (("x", "u"), ("y", "v"))))
    right = right.withColumns({"min_x": F.col("_u1") - east, "min_y": F.col("_v1") - grown, "max_x": F.col("_u2") + east, "max_y": F.col("_v2") + grown})
    along = ("_p", "_x1", "_y1", "_x2", "_y2", "_lon0", "_lat0", "_east"), ("acres", *carried, "_q", "_r", "_limit", "_u1", "_v1", "_u2", "_v2")
    pairs = box_join(left, right, boundary_id, incident_id, max(0.25, reach), carried=along)
    gap = lambda k, q: F.greatest(F.col(f"_{k}1") - F.col(f"_{q}2"), F.col(f"_{q}1") - F.col(f"_{k}2"), F.lit(0.0))
    least = F.pow(gap("x", "u") * F.col("_east"), 2) + F.pow(gap("y", "v") * GROUND, 2)
    return pairs.where(least <= F.pow((F.col("_limit") + F.col("_r")) * METERS_PER_MILE, 2) * (1 + 1e-9))


def outline_miles() -> Column:
    """Of outline_box_pairs: 0 where outlines meet or one holds the other, else the distance less the radius."""
    metres = outlines_between(F.col("_p"), F.col("_q"), F.col("_lon0"), F.col("_lat0"), F.col("_east"), F.lit(GROUND))
    return F.greatest(F.lit(0.0), metres - F.col("_r") * METERS_PER_MILE) / METERS_PER_MILE


def long_proximity(boundaries: DataFrame, incidents: DataFrame, boundary_id: str, incident_id: str, within: float) -> DataFrame:
    """(boundary, incident, acres, miles) as boundary_proximity tells it, for outlines of any length: edges meet edge by edge, and pairs are joined with their outlines."""
    reach = within / 69.0
    b = boundaries.select(boundary_id, F.col("rings").alias("_b"), rings_bounds(F.col("rings")).alias("box"))
    mid = {"lon0": (F.col("box.min_x") + F.col("box.max_x")) / 2, "lat0": (F.col("box.min_y") + F.col("box.max_y")) / 2}
    far = F.least(F.greatest(F.abs("box.min_y"), F.abs("box.max_y")) + reach, F.lit(89.0))
    wide = reach / F.greatest(F.cos(F.radians(far)), F.lit(0.01))
    left = b.select(boundary_id, (F.col("box.min_x") - wide).alias("min_x"), (F.col("box.min_y") - reach).alias("min_y"), (F.col("box.max_x") + wide).alias("max_x"), (F.col("box.max_y") + reach).alias("max_y"))
    mapped = F.coalesce(F.size("rings") > 0, F.lit(False))
    radius = F.when(mapped, 0.0).otherwise(footprint_miles(F.col("acres")))
    own = F.when(mapped, rings_bounds(F.col("rings"))).otherwise(F.struct(F.col("lon").alias("min_x"), F.col("lat").alias("min_y"), F.col("lon").alias("max_x"), F.col("lat").alias("max_y")))
    q = incidents.select(incident_id, "lon", "lat", "acres", F.when(mapped, F.col("rings")).alias("_q"), radius.alias("_r"), own.alias("o"))
    grown, east = F.col("_r") / 69.0, F.col("_r") / 69.0 / F.greatest(F.cos(F.radians(F.least(F.abs("o.max_y") + 1, F.lit(89.0)))), F.lit(0.01))
    right = q.select(incident_id, (F.col("o.min_x") - east).alias("min_x"), (F.col("o.min_y") - grown).alias("min_y"), (F.col("o.max_x") + east).alias("max_x"), (F.col("o.max_y") + grown).alias("max_y"))
    pairs = materialise(box_join(left, right, boundary_id, incident_id, max(0.25, reach)).hint("merge").join(q.select(incident_id, F.col("_q").isNotNull().alias("_mapped")), incident_id))
    flat = b.withColumns(mid).select(boundary_id, "lon0", "lat0", projected_rings(F.col("_b"), F.col("lon0"), F.col("lat0")).alias("_flat"))
    flat = materialise(flat.withColumn("_edges", all_edges(F.col("_flat"))))
    # Without a perimeter: the circle of the area, from its middle to each edge.
    circles = pairs.where("not _mapped").hint("merge").join(flat.drop("_flat"), boundary_id).hint("merge").join(q.drop("o", "_q"), incident_id)
    east_of, north_of = projected(F.col("lon"), F.col("lat"), F.col("lon0"), F.col("lat0"))
    point = outline_distance(F.col("_edges"), east_of, north_of)
    to_circles = circles.select(boundary_id, incident_id, "acres", (F.greatest(F.lit(0.0), point - F.col("_r") * METERS_PER_MILE) / METERS_PER_MILE).alias("miles"))
    # Perimeters that meet the boundary are inside; the others are as far as the outlines are.
    shapes = q.where("_q is not null").select(incident_id, "acres", F.col("_q").alias("rings"))
    meets = materialise(polygon_pairs(boundaries, shapes, boundary_id, incident_id, max(0.25, reach)))
    far = pairs.where("_mapped").hint("merge").join(meets, [boundary_id, incident_id], "left_anti").hint("merge").join(flat.drop("_edges"), boundary_id).hint("merge").join(shapes, incident_id)
    apart = outline_distances(far.withColumn("_q", projected_rings(F.col("rings"), F.col("lon0"), F.col("lat0"))), [boundary_id, incident_id], "_flat", "_q").withColumn("miles", F.col("distance") / METERS_PER_MILE)
    to_shapes = apart.drop("distance").unionByName(meets.withColumn("miles", F.lit(0.0))).join(shapes.select(incident_id, "acres"), incident_id)
    return to_circles.unionByName(to_shapes.select(*to_circles.columns)).where(F.col("miles") <= within)


def points_in_polygons(points: DataFrame, polygons: DataFrame, point_id: str, polygon_id: str, size: float) -> DataFrame:
    """Pairs (point, polygon) with the point inside, boundaries left out.

    points: x, y; polygons: rings, those of holes and of several polygons together. Each polygon is
    covered by cells of the sizes that its outline asks for (cover.py); a point is tested against the
    edges in its own cell. Points without coordinates and polygons without rings are in no pair.
    """
    return covered_points(points, polygon_cover(polygons, polygon_id, size), point_id, polygon_id, size)


def footprint_pairs(points: DataFrame, incidents: DataFrame, point_id: str, incident_id: str, within: float, size: float, carried: tuple[str, ...] = ()) -> DataFrame:
    """Points (lon, lat) beside incidents whose box, or circle, is within so many miles: point_id, incident_id, acres, the carried columns of incidents, x, y, box, miles (to the box; without a ring to the circle), and _edges of a ring.

    Cells are of a side `size`; an incident is only copied to the cells that its reach touches.
    """
    degrees = 1 / 69.0
    mapped = "ring" in incidents.columns
    # All that depends on one side only is worked out before the sides meet: metres a degree, the footprint, the edges.
    p = points.select(point_id, F.col("lon").alias("x"), F.col("lat").alias("y"), (GROUND * F.cos(F.radians("lat"))).alias("_east"))
    point = F.struct(F.col("lon").alias("min_x"), F.col("lat").alias("min_y"), F.col("lon").alias("max_x"), F.col("lat").alias("max_y"))
    known = (F.col("ring").isNotNull() & (F.size("ring") > 0)) if mapped else F.lit(False)
    box = F.when(known, bounds(F.col("ring"))).otherwise(point) if mapped else point
    radius = F.when(known, 0.0).otherwise(footprint_miles(F.col("acres")))
    reach = (radius + within) * degrees
    # A degree of longitude is shorter away from the equator.
    far = F.greatest(F.abs("box.min_y"), F.abs("box.max_y"))
    wide = F.col("reach") / F.greatest(F.cos(F.radians(F.least(far + F.col("reach"), F.lit(89.0)))), F.lit(0.01))
    kept = [incident_id, "acres", *carried, "box", "_radius", *(["_edges"] if mapped else [])]
    around = cells(F.col("box.min_x") - wide, F.col("box.min_y") - F.col("reach"), F.col("box.max_x") + wide, F.col("box.max_y") + F.col("reach"), size)
    own = {"box": box, "reach": reach, "_radius": radius} | ({"_edges": F.when(known, edges(F.col("ring")))} if mapped else {})
    q = incidents.withColumns(own).select(*kept, F.explode(around).alias("c")).select(*kept, "c.i", "c.j")
    joined = by_cell(p.withColumns({"i": F.floor(F.col("x") / size), "j": F.floor(F.col("y") / size)}), q, ["i", "j"])
    # To the box: the whole distance for a point, and at most the distance for a ring.
    gap = lambda k, c: F.greatest(F.col(f"box.min_{k}") - F.col(c), F.col(c) - F.col(f"box.max_{k}"), F.lit(0.0))
    u, v = gap("x", "x") * F.col("_east"), gap("y", "y") * GROUND
    return joined.withColumn("miles", F.greatest(F.lit(0.0), F.sqrt(u * u + v * v) / METERS_PER_MILE - F.col("_radius"))).where(F.col("miles") <= within * (1 + 1e-9))


def ring_miles() -> Column:
    """Of footprint_pairs with a ring: the distance to it, 0 inside."""
    return outline_distance(F.col("_edges"), F.col("x"), F.col("y"), F.col("_east"), F.lit(GROUND)) / METERS_PER_MILE


def proximity(points: DataFrame, incidents: DataFrame, point_id: str, incident_id: str, within: float = 30.0) -> DataFrame:
    """(point, incident, miles, tier) of all pairs within so many miles of an incident's perimeter that have a tier.

    points: lon, lat; incidents: lon, lat, acres and, if there is one, ring: the mapped perimeter in
    degrees. Without a ring the circle of the incident's area stands for it. Distances are on the
    plane that touches at the point, 0 inside. Cells are half as large as the reach, so that crowded
    places are many tasks' and fewer pairs are looked at in vain.
    """
    near = footprint_pairs(points, incidents, point_id, incident_id, within, max(0.125, within / 138.0))
    if "ring" in incidents.columns:
        cols = [point_id, incident_id, "acres", "miles"]
        near = near.where("_edges is null").select(*cols).unionByName(near.where("_edges is not null").withColumn("miles", ring_miles()).select(*cols))
    near = near.where(F.col("miles") <= within)
    return near.select(point_id, incident_id, "miles", proximity_tier(F.col("miles"), F.col("acres")).alias("tier")).where("tier is not null")


def incidents_within(points: DataFrame, incidents: DataFrame, point_id: str, incident_id: str, within: float = 30.0, carried: tuple[str, ...] = ()) -> DataFrame:
    """(point, incident, the carried columns of incidents) of all pairs within so many miles of an incident's perimeter, as in proximity, without the distance.

    What is asked of an incident goes along to the cells, so the pairs, which may be far more than both
    tables, are not joined or shuffled again. Of rings only those are measured that the box leaves open:
    as a ring touches all sides of its box, it is no farther than the far end of the nearer side.
    """
    near, cols = footprint_pairs(points, incidents, point_id, incident_id, within, max(0.125, within / 138.0), carried), [point_id, incident_id, *carried]
    if "ring" not in incidents.columns:
        return near.where(F.col("miles") <= within).select(*cols)
    side = lambda pick, k, scale: F.pow(pick(F.abs(F.col(k) - F.col(f"box.min_{k}")), F.abs(F.col(k) - F.col(f"box.max_{k}"))) * scale, 2)
    east, north = F.col("_east"), F.lit(GROUND)
    most = F.least(side(F.least, "x", east) + side(F.greatest, "y", north), side(F.greatest, "x", east) + side(F.least, "y", north))
    sure = most <= (within * METERS_PER_MILE * (1 - 1e-9)) ** 2
    rings = near.where("_edges is not null")
    out = near.where("_edges is null").where(F.col("miles") <= within).select(*cols).unionByName(rings.where(sure).select(*cols))
    return out.unionByName(rings.where(~sure).withColumn("miles", ring_miles()).where(F.col("miles") <= within).select(*cols))


def tier_rollup(pairs: DataFrame, point_id: str) -> DataFrame:
    """By point: the strongest tier, the number of incidents, and the nearest distance. Tiers are compared as numbers, so that pairs are summed up where they are found."""
    tiers = ("regional", "near", "inside")
    rank = F.when(F.col("tier") == "inside", 3).when(F.col("tier") == "near", 2).otherwise(1)
    by = pairs.groupBy(point_id).agg(F.max(rank).alias("_rank"), F.count("*").alias("n"), F.min("miles").alias("nearest"))
    return by.select(point_id, F.element_at(F.array(*map(F.lit, tiers)), F.col("_rank")).alias("tier"), "n", "nearest")


#: Features in the nine cells about a target that it is compared with at most, and how often cells are quartered until no more are there.
MOST_NEAR, QUARTERINGS = 256, 12


def nearest_feature(targets: DataFrame, features: DataFrame, target_id: str, feature_id: str, group: str, size: float) -> DataFrame:
    """For each target the other feature of its group with the least squared distance (x, y), then the least id.

    Targets look at the nine cells about them if these hold `MOST_NEAR` features at most; a find no
    farther than a cell's side is final. Where more are, cells of a quarter of the side follow until that few are there, so
    a target's work does not grow with the table. Targets that found nothing so look again with cells
    four times as large. What then is left, far from all features or beside a dense place, descends
    from the largest cells to smaller ones, into those alone that may hold something nearer than a
    feature already seen (`descended`). Features in one spot count as their two least ids. Rounds are
    written, and read only what the rounds before left.
    """
    spot = features.select(group, feature_id, F.col("x").alias("fx"), F.col("y").alias("fy")).where("fx is not null and fy is not null")
    # Of a spot's features no target takes another than the least, or the next if that is itself.
    first = spot.groupBy(group, "fx", "fy").agg(F.min(feature_id).alias("_a"))
    second = spot.join(first, [group, "fx", "fy"]).where(F.col(feature_id) > F.col("_a")).groupBy(group, "fx", "fy").agg(F.min(feature_id).alias("_b"))
    f = first.join(second, [group, "fx", "fy"], "left")
    f = materialise(f.select(group, F.explode(F.array_compact(F.array("_a", "_b"))).alias(feature_id), "fx", "fy"))
    cell = lambda x, y, side: {"i": F.floor(F.col(x) / side), "j": F.floor(F.col(y) / side)}
    nine = F.explode(F.array(*(F.struct(F.lit(i).alias("di"), F.lit(j).alias("dj")) for i in (-1, 0, 1) for j in (-1, 0, 1)))).alias("d")
    moved = [(F.col("i") + F.col("d.di")).alias("i"), (F.col("j") + F.col("d.dj")).alias("j")]
    done = []

    def looked(left: DataFrame, side: float) -> tuple[DataFrame, DataFrame]:
        """Targets that found nothing near enough, and those that have too many features about them."""
        counts = f.groupBy(group, *(c.alias(k) for k, c in cell("fx", "fy", side).items())).agg(F.count("*").alias("_n"))
        about = counts.select(group, "i", "j", "_n", nine).select(group, *moved, "_n").groupBy(group, "i", "j").agg(F.sum("_n").alias("_n"))
        known = materialise(left.withColumns(cell("x", "y", side)).join(about, [group, "i", "j"], "left").withColumn("_many", F.coalesce("_n", F.lit(0)) > MOST_NEAR).drop("_n"))
        few = known.where("not _many")
        pairs = by_cell(few.select("*", nine).select(target_id, group, "x", "y", *moved), f.withColumns(cell("fx", "fy", side)), [group, "i", "j"])
        done.append(materialise(nearest_of(pairs, target_id, feature_id).where(F.col("d2") <= side * side)))
        return few.drop("i", "j", "_many").join(done[-1].select(target_id), target_id, "left_anti"), known.where("_many").drop("i", "j", "_many")

    many, side, unfound = targets.select(target_id, group, "x", "y").where("x is not null and y is not null"), size, []
    for _ in range(QUARTERINGS):
        none, many = looked(many, side)
        unfound.append(none)
        if many.isEmpty():
            break
        side /= 4
    left = materialise(reduce(DataFrame.unionByName, unfound))
    if not left.isEmpty():
        left = reduce(DataFrame.unionByName, looked(left, size * 4))
    left = materialise(left.unionByName(many))
    if left.isEmpty():
        return reduce(DataFrame.unionByName, done)
    return reduce(DataFrame.unionByName, [*done, descended(left, f, target_id, feature_id, group, side)])


def nearest_of(pairs: DataFrame, target_id: str, feature_id: str) -> DataFrame:
    """target_id, feature_id, d2: of pairs (x, y, fx, fy) each target's nearest other feature, of equally near ones the least id."""
    d = F.pow(F.col("x") - F.col("fx"), 2) + F.pow(F.col("y") - F.col("fy"), 2)
    return pairs.where(F.col(target_id) != F.col(feature_id)).withColumn("d2", d).groupBy(target_id).agg(F.min(F.struct("d2", feature_id)).alias("b")).select(target_id, f"b.{feature_id}", "b.d2")


def descended(targets: DataFrame, f: DataFrame, target_id: str, feature_id: str, group: str, side: float) -> DataFrame:
    """nearest_of for targets that are far from all features: from cells as large as everything down to those of `side`.

    A cell knows the box of its features and two of them. A target goes on with the cells whose box is
    no farther than the nearest of the features so known, so a large group is never gone through.
    """
    ends = f.agg(F.max("fx") - F.min("fx"), F.max("fy") - F.min("fy")).first()
    whole, k = max(ends[0] or 0.0, ends[1] or 0.0), 0
    while side * 4**k < whole:
        k += 1

    def cells_of(step: float) -> DataFrame:
        spot = F.struct(feature_id, "fx", "fy")
        return f.groupBy(group, F.floor(F.col("fx") / step).alias("i"), F.floor(F.col("fy") / step).alias("j")).agg(
            F.min("fx").alias("x1"), F.max("fx").alias("x2"), F.min("fy").alias("y1"), F.max("fy").alias("y2"), F.array(F.min_by(spot, feature_id), F.max_by(spot, feature_id)).alias("known")
        )

    def pruned(cand: DataFrame) -> DataFrame:
        out = lambda c: F.greatest(F.col(f"{c}1") - F.col(c), F.col(c) - F.col(f"{c}2"), F.lit(0.0))
        away = F.filter("known", lambda s: s[feature_id] != F.col(target_id))
        seen = F.array_min(F.transform(away, lambda s: F.pow(F.col("x") - s["fx"], 2) + F.pow(F.col("y") - s["fy"], 2)))
        measured = materialise(cand.withColumns({"_low": F.pow(out("x"), 2) + F.pow(out("y"), 2), "_seen": seen}).select(target_id, group, "x", "y", "i", "j", "_low", "_seen"))
        most = measured.groupBy(target_id).agg(F.min("_seen").alias("_most"))
        near = measured.join(most, target_id).where(F.col("_most").isNull() | (F.col("_low") <= F.col("_most") * (1 + 1e-12)))
        return near.select(target_id, group, "x", "y", "i", "j")

    now = pruned(targets.join(cells_of(side * 4**k), group))
    for level in reversed(range(k)):
        finer = cells_of(side * 4**level).withColumns({"pi": F.floor(F.col("i") / 4), "pj": F.floor(F.col("j") / 4)})
        up = now.select(target_id, group, "x", "y", F.col("i").alias("pi"), F.col("j").alias("pj"))
        now = pruned(up.join(finer, [group, "pi", "pj"]))
    return nearest_of(now.join(f.withColumns({"i": F.floor(F.col("fx") / side), "j": F.floor(F.col("fy") / side)}), [group, "i", "j"]), target_id, feature_id)


def combined_polygons(features: DataFrame, key: str, polygons: str, order: str) -> DataFrame:
    """key, polygons: the polygons of all a key's features one after another, in their order; features without polygons add none. For keys whose parts fit one geometry."""
    parts = features.where(F.col(polygons).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(polygons).alias("p")))).alias("_l"))
    return parts.select(key, F.flatten(F.transform("_l", lambda s: s["p"])).alias(polygons))


def track_offsets(points: DataFrame, key: str, order: list[str], x: str, y: str) -> DataFrame:
    """points with step (the way from the point before; 0 at the first) and offset (the way from the first), in plane units."""
    w = Window.partitionBy(key).orderBy(*order)
    step = F.coalesce(F.hypot(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)), F.lit(0.0))
    return points.withColumn("step", step).withColumn("offset", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)))
