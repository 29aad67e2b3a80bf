"""Covers, edge joins, overlays and lines against plain re-implementations."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cinderline.functions import geometry
from cinderline.operators import cover, lines, overlay, spatial

RINGS = "rings array<array<struct<x:double,y:double>>>"


def shapes(spark, rows, key="gid"):
    return spark.createDataFrame([(k, None if rings is None else [[{"x": float(x), "y": float(y)} for x, y in r] for r in rings]) for k, rings in rows], f"{key} long, {RINGS}")


def square(x, y, w):
    return [(x, y), (x + w, y), (x + w, y + w), (x, y + w)]


def star(r, cx, cy, size, n):
    """A ring about its middle, from which all of it can be seen."""
    reach = [size * r.uniform(0.3, 1) for _ in range(n)]
    return [(round(cx + q * math.cos(2 * math.pi * k / n), 6), round(cy + q * math.sin(2 * math.pi * k / n), 6)) for k, q in enumerate(reach)]


def pairs_of(ring):
    return list(zip(ring, [*ring[1:], ring[0]], strict=True))


def edges_of(rings):
    return [e for ring in rings for e in pairs_of(ring)]


def on_edge(rings, x, y):
    return any((bx - ax) * (y - ay) == (by - ay) * (x - ax) and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by) for (ax, ay), (bx, by) in edges_of(rings))


def inside(rings, x, y):
    return sum((ay > y) != (by > y) and x < ax + (y - ay) / (by - ay) * (bx - ax) for (ax, ay), (bx, by) in edges_of(rings)) % 2 == 1 and not on_edge(rings, x, y)


def area(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in pairs_of(ring)) / 2


@pytest.fixture(scope="module")
def some():
    r = random.Random(1)
    polygons = {
        1: [square(0, 0, 1), square(5, 5, 1)], 2: [square(0, 0, 4), square(1, 1, 1)], 3: [star(r, 2, 2, 3, 300)], 4: [star(r, 1, 4, 1, 9), star(r, 6, 1, 2, 50)],
        5: [square(2, 2, 0.001)], 6: [square(-3, -3, 20)], 7: [], 8: None,
    }
    points = [(i, r.uniform(-4, 8), r.uniform(-4, 8)) for i in range(1500)] + [(2000 + i, float(a), float(b)) for i, (a, b) in enumerate([(0, 0), (1, 1), (0.5, 0.5), (5.5, 5.5), (1, 2), (4, 4), (2, 2), (1.5, 1.5), (0, 2), (2.0005, 2.0005)])]
    return polygons, points


@pytest.mark.parametrize("size", [0.05, 1.0, 30.0])
def test_points_in_polygons(spark, some, size):
    """Several parts, holes, hundreds of corners, tiny and huge shapes, points on corners and borders; grids of any size."""
    polygons, points = some
    p = spark.createDataFrame([*points, (9000, None, 1.0), (9001, 1.0, None)], "pid long, x double, y double")
    got = spatial.points_in_polygons(p, shapes(spark, polygons.items()), "pid", "gid", size).collect()
    want = {(i, k) for i, x, y in points for k, rings in polygons.items() if rings and inside(rings, x, y)}
    assert set(map(tuple, got)) == want and len(got) == len(want)


@pytest.mark.parametrize("few", [0, cover.FEW])
def test_crowded_cells_are_cut(spark, some, monkeypatch, few):
    """Where many points lie, few of them meet edges, and hardly any a list of edges; the pairs are those of the plain test."""
    monkeypatch.setattr(cover, "FEW", few)
    monkeypatch.setattr(cover, "MOST_POINTS", 16)
    polygons, points = some
    r = random.Random(2)
    points = points + [(3000 + i, r.uniform(-1, 6), r.uniform(-1, 6)) for i in range(3000)] + [(7000 + i, 1.0, y / 8) for i, y in enumerate(range(40))]
    p = spark.createDataFrame(points, "pid long, x double, y double")
    cells = cover.polygon_cover(shapes(spark, polygons.items()), "gid", 30.0)

    def met(cells):
        at = [(F.floor((F.col(k) - o) / cover.side_of(F.col("level"), 30.0)) == F.col(c)) for k, c, o in (("x", "i", cover.ORIGIN[0]), ("y", "j", cover.ORIGIN[1]))]
        found = p.join(cells, at[0] & at[1])
        return found.where("size(edges) > 0").count(), found.where(F.size("edges") > cover.PLAIN).count()

    placed = p.crossJoin(cells.select("level").distinct()).withColumns({c: F.floor((F.col(k) - o) / cover.side_of(F.col("level"), 30.0)) for k, c, o in (("x", "i", cover.ORIGIN[0]), ("y", "j", cover.ORIGIN[1]))})
    before, after = met(cells), met(cover.cut_where_crowded(cells, placed, "gid", 30.0))
    assert after[0] * 3 < before[0] and after[1] * 4 < before[1]
    got = spatial.points_in_polygons(p, shapes(spark, polygons.items()), "pid", "gid", 30.0).collect()
    assert sorted(map(tuple, got)) == sorted((i, g) for g, rings in polygons.items() if rings for i, x, y in points if inside(rings, x, y))


def test_cover_is_bounded_by_the_outline(spark):
    """A polygon a hundred times as large has as many cells; few cells have many edges, and inner ones have none."""
    ring = star(random.Random(2), 0, 0, 1, 200)
    rows = [(1, [ring]), (2, [[(100 * x, 100 * y) for x, y in ring]])]
    cells = cover.polygon_cover(shapes(spark, rows), "gid", 1.0)
    n = {r.gid: (r.cells, r.edges, r.inner) for r in cells.groupBy("gid").agg(F.count("*").alias("cells"), F.max(F.size("edges")).alias("edges"), F.count_if(F.size("edges") == 0).alias("inner")).collect()}
    assert all(c < 800 and e <= cover.MOST_EDGES and i > 0 for c, e, i in n.values()) and n[2][0] < 2 * n[1][0]


def test_no_shapes(spark):
    none, p = shapes(spark, [(1, None), (2, [])]), spark.createDataFrame([(1, 0.0, 0.0)], "pid long, x double, y double")
    assert spatial.points_in_polygons(p, none, "pid", "gid", 1.0).count() == 0 and spatial.points_in_polygons(p, none.limit(0), "pid", "gid", 1.0).count() == 0
    assert overlay.repaired(none, "gid", 1.0).count() == 0 and overlay.raster_regions(spark.createDataFrame([], "k long, row long, col long"), "k").count() == 0
    assert spatial.polygon_pairs(none, none.withColumnRenamed("gid", "other"), "gid", "other", 1.0).count() == 0


def test_places_of_several_parts(spark):
    boundary = shapes(spark, [(1, [square(0, 0, 1), square(5, 5, 1)])], "bid")
    places = spark.createDataFrame([(1, 0.5, 0.5, None), (2, 5.5, 5.5, None), (3, 3.0, 3.0, None), (4, 3.0, 3.0, [[{"x": 4.5, "y": 4.5}, {"x": 5.2, "y": 4.5}, {"x": 5.2, "y": 5.2}]])], f"pid long, x double, y double, {RINGS}")
    assert sorted(map(tuple, spatial.places_in_boundaries(places, boundary, "pid", "bid", 1.0).collect())) == [(1, 1, "contains"), (2, 1, "contains"), (4, 1, "intersects")]


def test_edge_joins_against_all_edges(spark):
    """Intersections found edge by edge equal those of all edges with all edges; one inside the other has no common edge."""
    r = random.Random(4)
    a = [(i, [star(r, r.uniform(0, 6), r.uniform(0, 6), 1, r.choice([3, 5, 40]))]) for i in range(12)] + [(20, [square(0, 0, 9), square(1, 1, 7)]), (21, [square(2, 2, 0.1)]), (22, None)]
    b = [(i, [star(r, r.uniform(0, 6), r.uniform(0, 6), 1, r.choice([3, 5, 40]))]) for i in range(12)] + [(20, [square(3, 3, 1)]), (21, [square(0, 0, 9)]), (22, [square(9, 0, 1)])]
    left, right = shapes(spark, a, "a"), shapes(spark, b, "b").withColumnRenamed("rings", "other")
    want = left.crossJoin(right).where(geometry.polygons_intersect(F.col("rings"), F.col("other"))).select("a", "b").collect()
    got = spatial.polygon_pairs(left, right.withColumnRenamed("other", "rings"), "a", "b", 0.5).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 10
    far = left.crossJoin(right).where("rings is not null").withColumn("d", geometry.polygons_distance(F.col("rings"), F.col("other"))).where("d > 0")
    want = {(x.a, x.b): x.d for x in far.select("a", "b", "d").collect()}
    got = {(x.a, x.b): x.distance for x in spatial.outline_distances(far, ["a", "b"], "rings", "other").collect()}
    assert want.keys() == got.keys() and len(got) > 10 and all(abs(got[k] - d) < 1e-9 for k, d in want.items())


def test_many_corners(spark):
    """Outlines of thousands of corners: their distance without all pairs of edges."""
    ring = lambda x: [(x + math.cos(k / 2000 * math.tau), math.sin(k / 2000 * math.tau)) for k in range(2000)]
    df = shapes(spark, [(1, [ring(0)])]).join(shapes(spark, [(1, [ring(5)])]).withColumnRenamed("rings", "other"), "gid")
    assert abs(spatial.outline_distances(df, ["gid"], "rings", "other").first().distance - 3) < 1e-9


def test_boxless_rows_are_counted_first(spark):
    a = spark.createDataFrame([(i, None, None, None, None) for i in range(5)], "a long, min_x double, min_y double, max_x double, max_y double")
    b = a.withColumnRenamed("a", "b")
    with pytest.raises(ValueError):
        spatial.box_join(a, b, "a", "b", 1.0, unboxed=True, most_unboxed=4)


def cut_to(ring, window):
    for a, b in pairs_of(window):
        side = lambda p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])  # noqa: B023, E731
        out = []
        for u, v in pairs_of(ring) if ring else []:
            fu, fv = side(u), side(v)
            if (fu < 0) != (fv < 0):
                out.append((u[0] + fu / (fu - fv) * (v[0] - u[0]), u[1] + fu / (fu - fv) * (v[1] - u[1])))
            if fv >= 0:
                out.append(v)
        ring = out
    return ring


def common_area(a, ca, b, cb):
    """Of two stars, by the triangles from their middles."""
    left = lambda t: t if area(t) > 0 else t[::-1]
    return sum(abs(area(c)) for u, v in pairs_of(a) for x, y in pairs_of(b) if (c := cut_to(left([ca, u, v]), left([cb, x, y]))))


def test_overlay_of_concave_shapes(spark):
    r = random.Random(3)
    draw = lambda: [(c := (r.uniform(0, 4), r.uniform(0, 4)), star(r, *c, 2, r.choice([3, 7, 20]))) for _ in range(4)]
    a, b = draw(), draw()
    left, right = shapes(spark, [(i, [s]) for i, (_, s) in enumerate(a)], "a"), shapes(spark, [(i, [s]) for i, (_, s) in enumerate(b)], "b")
    pairs = spark.createDataFrame([(4 * i + j, i, j) for i in range(4) for j in range(4)], "k long, a long, b long")
    total = lambda how: {x.k: x.s for x in overlay.overlay(pairs, left, right, "k", "a", "b", 0.5, how).groupBy("k").agg(F.sum("area").alias("s")).collect()}
    got = {how: total(how) for how in ("intersection", "union", "difference")}
    for i, (ca, x) in enumerate(a):
        for j, (cb, y) in enumerate(b):
            both, k = common_area(x, ca, y, cb), 4 * i + j
            assert abs(got["intersection"].get(k, 0) - both) < 1e-5
            assert abs(got["union"][k] - (area(x) + area(y) - both)) < 1e-5 and abs(got["difference"].get(k, 0) - (area(x) - both)) < 1e-5


def test_overlay_of_shared_borders(spark):
    """Borders on each other, holes, several parts, one shape equal to the other."""
    left = shapes(spark, [(1, [square(0, 0, 4), square(1, 1, 1)]), (2, [square(0, 0, 2), square(5, 0, 1)]), (3, None)], "a")
    right = shapes(spark, [(1, [square(0, 0, 2)]), (2, [square(2, 0, 2)]), (3, [square(0, 0, 4)])], "b")
    pairs = spark.createDataFrame([(10 * i + j, i, j) for i in (1, 2, 3) for j in (1, 2, 3)], "k long, a long, b long")
    rings = lambda how: sorted((x.k, round(x.area, 9), len(x.ring)) for x in overlay.overlay(pairs, left, right, "k", "a", "b", 1.0, how).where("k < 30").collect())
    assert rings("intersection") == [(11, 3, 6), (12, 4, 4), (13, -1, 4), (13, 16, 4), (21, 4, 4), (23, 4, 4)]
    assert rings("difference") == [(11, 12, 6), (12, 11, 8), (21, 1, 4), (22, 1, 4), (22, 4, 4), (23, 1, 4)]
    assert rings("union") == [(11, 16, 4), (12, -1, 4), (12, 16, 4), (13, 16, 4), (21, 1, 4), (21, 4, 4), (22, 1, 4), (22, 8, 4), (23, 1, 4), (23, 16, 4)]


def test_repair(spark):
    rows = [(1, [[(0, 0), (2, 2), (2, 0), (0, 2)]]), (2, [square(0, 0, 1)]), (3, [square(0, 0, 4) * 2]), (4, [[(0, 0), (2, 0), (2, 2), (1, 2), (1, 3), (1, 2), (0, 2)]]), (5, [square(0, 0, 4), square(1, 1, 2)]), (6, [[(0, 0), (1, 0)]])]
    got = sorted((x.gid, round(x.area, 9), [(p.x, p.y) for p in x.ring]) for x in overlay.repaired(shapes(spark, rows), "gid", 1.0).collect())
    plain = lambda r: [(float(x), float(y)) for x, y in r]
    assert got == [
        (1, 1.0, plain([(0, 0), (1, 1), (0, 2)])), (1, 1.0, plain([(1, 1), (2, 0), (2, 2)])), (2, 1.0, plain(square(0, 0, 1))), (3, 16.0, plain(square(0, 0, 4))), (4, 4.0, plain(square(0, 0, 2))),
        (5, -4.0, plain([(1, 1), (1, 3), (3, 3), (3, 1)])), (5, 16.0, plain(square(0, 0, 4))),
    ]


def test_regions_of_cells(spark):
    """A ring with a hole, cells that touch at corners, repeated cells, rows that count downward; a comb, whose ring is long."""
    block = [(r, c) for r in range(3) for c in range(3) if (r, c) != (1, 1)]
    comb = [(r, c) for r in range(40) for c in range(40) if c == 0 or r % 2 == 0]
    held = set(comb)
    comb_length = float(sum((r + i, c + j) not in held for r, c in comb for i, j in ((0, 1), (1, 0), (0, -1), (-1, 0))))
    around = [sum((r - i, c - j) in held for i in (0, 1) for j in (0, 1)) for r in range(41) for c in range(41)]
    comb_corners = sum(n in (1, 3) for n in around)  # no two of its cells touch at a corner only
    rows = [(1, r, c) for r, c in block] + [(1, 4, 4), (1, 5, 5), (2, 0, 0), (2, 0, 0)] + [(3, r, c) for r, c in comb]
    cells = spark.createDataFrame(rows, "k long, row long, col long")
    got = sorted((x.k, x.area, x.length, len(x.ring)) for x in overlay.raster_regions(cells, "k").collect())
    assert got == [(1, -1.0, 4.0, 4), (1, 1.0, 4.0, 4), (1, 1.0, 4.0, 4), (1, 9.0, 12.0, 4), (2, 1.0, 4.0, 4), (3, float(len(comb)), comb_length, comb_corners)]
    down = sorted((x.k, x.area, x.ring[0].x, x.ring[0].y) for x in overlay.raster_regions(cells.where("k = 1"), "k", (10.0, 50.0), (0.5, -0.25)).collect())
    assert [a for _, a, *_ in down] == [-0.125, 0.125, 0.125, 1.125] and (1, 1.125, 10.0, 49.25) in down


def test_union(spark):
    rows = [(1, i, [[{"x": float(x), "y": float(y)} for x, y in square(i * 0.5, 0, 1)]]) for i in range(8)] + [(1, 20, [[{"x": float(x), "y": float(y)} for x, y in square(10, 10, 1)]]), (2, 1, None)]
    got = overlay.united(spark.createDataFrame(rows, f"k long, i long, {RINGS}"), "k", "i", 0.5).collect()
    assert sorted((x.k, x.area, len(x.ring)) for x in got) == [(1, 1.0, 4), (1, 4.5, 4)]


def test_envelope(spark):
    wanted = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (1, "a"), (2, "a")], "area long, name string")
    ring = lambda *rings: [[{"x": float(x), "y": float(y)} for x, y in r] for r in rings]
    features = spark.createDataFrame([(1, "a", ring(square(-1, 1, 3), square(5, 5, 9))), (1, "b", ring(square(2, 2, 3), square(3, 3, 1))), (1, "x", ring(square(0, 0, 1))), (2, "z", ring(square(0, 0, 1)))], f"area long, name string, {RINGS}")
    areas = spark.createDataFrame([(1, ring(square(0, 0, 10))), (2, ring(square(0, 0, 10)))], f"area long, {RINGS}")
    parts, missing = overlay.envelope(wanted, features, areas, "area", "name", 1.0)
    rows = sorted((x["name"], x["part"], len(x["rings"]), x["size"]) for x in parts.select("name", "part", "rings", "size").collect())
    assert rows == [("a", 0, 1, 6.0), ("a", 1, 1, 25.0), ("b", 0, 2, 8.0)] and sorted(map(tuple, missing.collect())) == [(1, ["c"]), (2, ["a"])]


def test_stitched(spark):
    """Shuffled and turned segments, two lines of a key, a junction, a loop, repeated and empty segments."""
    r = random.Random(2)
    path = [(float(i), (i * 7 % 5) / 2) for i in range(60)]
    def some(points, key):
        out = [(key, *a, *b) if r.random() < 0.5 else (key, *b, *a) for a, b in zip(points, points[1:], strict=False)]
        r.shuffle(out)
        return out
    rows = [*some(path, 1), *some([(100.0, 0.0), (101.0, 0.0)], 1), *some(path[:9], 2)[:8], (2, 0.0, 0.0, 0.0, 0.0), *some([(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)], 3), *some([(0.0, 0.0), (1.0, 0.0), (2.0, 1.0)], 4), (4, 1.0, 0.0, 2.0, -1.0)]
    got = {}
    for x in lines.stitched(spark.createDataFrame(rows + rows[:5], "k long, ax double, ay double, bx double, by double"), "k").collect():
        got.setdefault((x.k, tuple(x.line.u)), []).append((x.place, x.x, x.y)) if x.k != 4 else got.setdefault((4, tuple(x.line.u), tuple(x.line.v)), []).append((x.place, x.x, x.y))
    lined = {k: [p[1:] for p in sorted(v)] for k, v in got.items()}
    assert lined[1, (0.0, 0.0)] == path and lined[1, (100.0, 0.0)] == [(100.0, 0.0), (101.0, 0.0)] and lined[2, (0.0, 0.0)] == path[:9]
    assert not any(k[0] == 3 for k in lined) and sorted(len(v) for k, v in lined.items() if k[0] == 4) == [2, 2, 2]


def test_stitched_in_batches(spark):
    """Lines of many small keys, junctions and loops among them, and one key that batches cut: as by rounds of joins."""
    r = random.Random(5)
    rows = [(f"k{k}", *(float(r.randrange(4)) for _ in range(4))) for k in range(150) for _ in range(r.randrange(1, 9))] + [(None, 0.0, 0.0, 1.0, 1.0), ("k1", None, 0.0, 1.0, 1.0), ("k2", -0.0, 0.0, 3.0, 3.0)]
    rows += [("long", float(i), 0.0, float(i + 1), 0.0) if i % 2 else ("long", float(i + 1), 0.0, float(i), 0.0) for i in range(40)]
    loose = spark.createDataFrame(rows, "k string, ax double, ay double, bx double, by double")
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = sorted(map(repr, lines.strung_by_rounds(loose, "k").collect()))
    for batch in ("7", was):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            assert sorted(map(repr, lines.stitched(loose, "k").collect())) == want and len(want) > 500
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)


def test_parts_of_lines(spark):
    line = geometry.ring_of([(0, 0), (4, 0), (4, 3), (4, 3), (0, 3)])
    one = spark.range(1)
    cut = lambda a, b: [tuple(p) for p in one.select(lines.line_slice(line, F.lit(float(a)), F.lit(float(b))).alias("s")).first().s or []]
    assert cut(1, 5) == [(1, 0), (4, 0), (4, 1)] and cut(-3, 99) == [(0, 0), (4, 0), (4, 3), (0, 3)] and cut(4, 4) == [(4, 0)] and cut(5, 2) == []
    ring = geometry.ring_of([(0, 0), (10, 0), (10, 1), (0, 1)])
    way = lambda a, b: [tuple(p) for p in one.select(lines.ring_way(ring, F.lit(a), F.lit(b)).alias("s")).first().s]
    assert way(0, 1) == [(0, 0), (10, 0)] and way(0, 3) == [(0, 0), (0, 1)] and way(1, 2) == [(10, 0), (10, 1)] and way(3, 2) == [(0, 1), (10, 1)] and way(2, 2) == [(10, 1)]


def test_near_lines_and_shapes(spark):
    r = random.Random(6)
    points = [(i, r.uniform(-1, 5), r.uniform(-1, 5)) for i in range(400)] + [(900, None, 0.0)]
    p = spark.createDataFrame(points, "pid long, x double, y double")
    route = [[(0, 0), (3, 1), (3, 4)], [(4, 4)], []]
    rows = [(i, [{"x": float(x), "y": float(y)} for x, y in line]) for i, line in enumerate(route)]
    away = lambda x, y, a, b: math.hypot(x - a[0] - (t := max(0, min(1, ((x - a[0]) * (b[0] - a[0]) + (y - a[1]) * (b[1] - a[1])) / (((b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2) or 1)))) * (b[0] - a[0]), y - a[1] - t * (b[1] - a[1]))
    want = {(i, k) for i, x, y in points[:-1] for k, line in enumerate(route) if line and min(away(x, y, a, b) for a, b in zip(line, line[1:] or line, strict=False)) <= 0.5}
    assert set(map(tuple, lines.near_lines(p, spark.createDataFrame(rows, "lid long, line array<struct<x:double,y:double>>"), "pid", "lid", 0.5).collect())) == want
    lake = [square(0, 0, 3), square(1, 1, 1)]
    want = {(i, 1) for i, x, y in points[:-1] if inside(lake, x, y) or min(away(x, y, a, b) for a, b in edges_of(lake)) <= 0.2}
    assert set(map(tuple, lines.near_shapes(p, shapes(spark, [(1, lake)]), "pid", "gid", 0.2).collect())) == want


def test_nearest_feature_of_outliers(spark):
    """Targets far from a group of many features descend to the few that may be nearest; ties take the least id, a feature is not its own."""
    r = random.Random(8)
    features = [(i, "a", r.gauss(0, 1), r.gauss(0, 1)) for i in range(600)] + [(1000 + i, "b", 50.0, 50.0 + i % 2) for i in range(4)]
    targets = [(5000 + i, "a", r.uniform(-900, 900), r.uniform(-900, 900)) for i in range(25)] + [(1000, "b", 50.0, 50.0), (6000, "b", -400.0, 50.5), (7000, "none", 0.0, 0.0), (8000, "a", None, 0.0)] + [(i, g, x, y) for i, g, x, y in features[:5]]
    f = spark.createDataFrame(features, "f long, g string, x double, y double")
    t = spark.createDataFrame(targets, "t long, g string, x double, y double")
    got = {row.t: row.f for row in spatial.nearest_feature(t, f, "t", "f", "g", 0.05).collect()}
    want = {}
    for i, g, x, y in targets:
        near = [((x - fx) ** 2 + (y - fy) ** 2, k) for k, h, fx, fy in features if h == g and k != i and x is not None]
        if near:
            want[i] = min(near)[1]
    assert got == want


def test_short_passages(spark):
    """Passages of one or two words, of any length and script, are found in all texts that hold them, inside of words too."""
    from cinderline.operators import search

    texts = {1: "alpha beta gamma", 2: "Beta  gam", 3: "é😀x", 4: "", 5: None, 6: "xé"}
    passages = {1: "pha beta", 2: "a", 3: "é", 4: "beta  gam", 5: "😀", 6: "zz top", 7: "gamma", 8: "", 9: None, 10: "mma"}
    df = lambda d, k: spark.createDataFrame(list(d.items()), f"{k} long, text string")
    plain = lambda s: " ".join((s or "").split())
    want = {(t, p) for t, x in texts.items() for p, y in passages.items() if plain(y) and plain(y) in plain(x)}
    got = search.passages_in_texts(df(texts, "t"), df(passages, "p"), "t", "p").collect()
    assert set(map(tuple, got)) == want and len(got) == len(want)


def test_fine_boxes_meet_on_fine_grids_alone(spark, monkeypatch):
    """Boxes of one size are dealt to one grid; a large one draws the small ones to its own grid only, and each pair comes once."""
    seen, deal = [], spatial.by_cell
    monkeypatch.setattr(spatial, "by_cell", lambda left, right, keys: seen.append((left, right)) or deal(left, right, keys))
    box = lambda i, x, s: (i, float(x), 0.0, float(x + s), float(s))
    cols = "id long, min_x double, min_y double, max_x double, max_y double"
    small = spark.createDataFrame([box(i, i / 10, 0.05) for i in range(40)], cols)
    pairs = {tuple(r) for r in spatial.box_join(small.withColumnRenamed("id", "a"), small.withColumnRenamed("id", "b"), "a", "b", 0.1).collect()}
    assert pairs == {(i, i) for i in range(40)}
    assert [{r[0] for r in df.select("_grid").distinct().collect()} for df in seen[0]] == [{0}, {0}] and len(seen) == 1
    large = spark.createDataFrame([box(-1, -500, 1000)], cols)
    for left, right in ((small, large), (large, small)):
        got = spatial.box_join(left.withColumnRenamed("id", "a"), right.withColumnRenamed("id", "b"), "a", "b", 0.1).collect()
        assert len(got) == 40 and {tuple(sorted(r)) for r in got} == {(-1, i) for i in range(40)}


def test_distances_of_many_rows_at_once(spark):
    """The distances that tasks work out in arrays are those of the expressions for one row, for outlines of different sizes."""
    r = random.Random(7)
    rows = [(k, [star(r, 0, 0, 1, r.randint(3, 9))], [star(r, 3 + r.random(), r.uniform(-3, 3), 1, r.randint(3, 9))], r.uniform(-2, 2), r.uniform(-2, 2)) for k in range(60)]
    df = spark.createDataFrame([(k, *([[{"x": x, "y": y} for x, y in c] for c in p] for p in (a, b)), x, y) for k, a, b, x, y in rows], f"k long, a {RINGS[6:]}, b {RINGS[6:]}, x double, y double")
    a, b = geometry.all_edges(F.col("a")), geometry.all_edges(F.col("b"))
    got = df.select(geometry.outlines_apart(a, b), geometry.polygons_distance(F.col("a"), F.col("b")), geometry.outline_distance(a, F.col("x"), F.col("y")), geometry.ring_distance(F.col("a")[0], F.col("x"), F.col("y"))).collect()
    assert all(g[0] == pytest.approx(g[1], abs=1e-9) and g[2] == pytest.approx(g[3], abs=1e-9) for g in got) and any(g[2] == 0 for g in got) and any(g[2] > 0 for g in got)


def test_tiers_are_summed_up_before_they_move(spark):
    """The strongest tier is found by numbers, without sorting all pairs."""
    pairs = spark.createDataFrame([(1, "near", 3.0), (1, "inside", 0.0), (1, "regional", 20.0), (2, "regional", 12.0)], "p long, tier string, miles double")
    by = spatial.tier_rollup(pairs, "p")
    assert sorted(map(tuple, by.collect())) == [(1, "inside", 3, 0.0), (2, "regional", 1, 12.0)]
    assert "SortAggregate" not in by._jdf.queryExecution().executedPlan().toString()


def test_corridors_are_dealt_along_lines(spark, monkeypatch):
    """A slanting edge goes to the cells beside it, not to all of its box; near points are found all the same."""
    seen, deal = [], lines.by_cell
    monkeypatch.setattr(lines, "by_cell", lambda left, right, keys: seen.append(right) or deal(left, right, keys))
    r = random.Random(3)
    spots = [(k, r.uniform(-1, 11), r.uniform(-1, 11)) for k in range(400)]
    ways = {1: [(0, 0), (10, 10)], 2: [(10, 0), (10, 10), (0, 9.99)], 3: [(5, 5)]}
    p = spark.createDataFrame(spots, "p long, x double, y double")
    line = spark.createDataFrame([(k, [{"x": float(x), "y": float(y)} for x, y in w]) for k, w in ways.items()], "l long, line array<struct<x:double,y:double>>")
    got = {tuple(g) for g in lines.near_lines(p, line, "p", "l", 0.2).collect()}

    def away(x, y, a, b):
        length = (b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2
        t = max(0, min(1, ((x - a[0]) * (b[0] - a[0]) + (y - a[1]) * (b[1] - a[1])) / length)) if length else 0
        return math.hypot(x - a[0] - t * (b[0] - a[0]), y - a[1] - t * (b[1] - a[1]))

    assert got == {(k, n) for k, x, y in spots for n, w in ways.items() if min(away(x, y, a, b) for a, b in zip(w, w[1:] or w, strict=False)) <= 0.2}
    assert seen[0].where("_shape = 1").count() < 200  # of 26 * 26 cells of its box


def test_points_of_cells_are_told_in_arrays(spark):
    """Points against covers of stars by a plan without lambdas over edges, with the result of the plain test; points on an edge are outside."""
    r = random.Random(11)
    rings = {k: [star(r, r.uniform(-2, 2), r.uniform(-2, 2), 1.5, 12)] for k in range(5)} | {9: [square(0, 0, 1)]}
    spots = [(k, r.uniform(-3, 3), r.uniform(-3, 3)) for k in range(300)] + [(900, 0.0, 0.5), (901, 1.0, 1.0), (902, 0.5, 0.5)]
    p, s = spark.createDataFrame(spots, "p long, x double, y double"), shapes(spark, rings.items())
    found = spatial.points_in_polygons(p, s, "p", "gid", 0.25)
    wanted = p.crossJoin(s).where(geometry.polygon_contains(F.col("rings"), F.col("x"), F.col("y"))).select("p", "gid")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect()))
    assert "ArrowEvalPython" in found._jdf.queryExecution().executedPlan().toString()


def test_outlines_go_along_to_the_cells(spark):
    """Boundaries beside perimeters and circles: few edges are measured where the boxes meet, without a join of pairs, and all are as far apart as by joins of edges; which pairs have a tier is known without most distances."""
    r = random.Random(12)
    shape = lambda k, size, long=7: [star(r, r.gauss(-120, 0.4), r.gauss(44, 0.4), size, (5, 7, long)[k % 3])]
    b = shapes(spark, [(k, shape(k, 0.2, 30) + ([square(-120.3, 43.9, 0.05)] if k % 4 == 0 else [])) for k in range(20)] + [(90, None), (91, [])], "bid")
    rows = [(100 + k, r.gauss(-120, 0.6), r.gauss(44, 0.6), (0.0, 50.0, 5000.0, None)[k % 4], f"fire {k}", shape(k, 0.1) if k % 3 < 2 else None) for k in range(60)]
    q = spark.createDataFrame([(*x, g and [[{"x": a, "y": c} for a, c in ring] for ring in g]) for *x, g in rows], f"iid long, lon double, lat double, acres double, name string, {RINGS}")
    found = spatial.boundary_proximity(b, q, "bid", "iid")
    want = spatial.long_proximity(b.where("size(rings) > 0"), q, "bid", "iid", 30.0)
    tiers = lambda df: {(x.bid, x.iid): (x.tier, round(x.miles, 6)) for x in df.collect()}
    told = tiers(want.withColumn("tier", spatial.proximity_tier(F.col("miles"), F.col("acres"))).where("tier is not null"))
    assert tiers(found) == told and {t for t, _ in told.values()} == {"inside", "near", "regional"}
    known = spatial.boundary_incidents(b, q, "bid", "iid", carried=("name",)).collect()
    assert sorted(map(tuple, known)) == sorted((k, i, f"fire {i - 100}") for k, i in told)
    short = lambda df: df.where("size(flatten(rings)) < 16")
    plan = spatial.boundary_proximity(short(b), short(q), "bid", "iid")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") <= 2


def test_rounded_miles(spark):
    """As F.round has it: halves, their neighbours, and what lies between; the compiled plan has no decimal numbers but there."""
    r = random.Random(13)
    half = [k / 10_000 + 0.00005 for k in range(3000)]
    rows = [*half, *(math.nextafter(v, 9) for v in half), *(math.nextafter(v, 0) for v in half), *(r.uniform(0, 3000) for _ in range(20_000)), 0.0, 30.0, None]
    df = spark.createDataFrame([(v,) for v in rows], "v double").select("v", geometry.rounded_miles(F.col("v")).alias("a"), F.round("v", 4).alias("b"))
    assert df.where("not (a <=> b)").count() == 0


def test_incidents_within(spark):
    """Pairs within a distance of rings and circles, with what an incident has to say; each distance is told by all edges."""
    r = random.Random(11)
    points = [(i, r.gauss(-120, 0.7), r.gauss(44, 0.7)) for i in range(500)]
    incidents = [(k, r.gauss(-120, 0.7), r.gauss(44, 0.7), 50_000.0 * (k % 3)) for k in range(30)]
    ring = lambda k, x, y: star(random.Random(k), x, y, 0.3, 7) if k % 3 else None
    rows = [(k, x, y, acres, f"fire {k}", (q := ring(k, x, y)) and [{"x": a, "y": b} for a, b in q]) for k, x, y, acres in incidents]
    q = spark.createDataFrame(rows, "iid long, lon double, lat double, acres double, name string, ring array<struct<x:double,y:double>>")
    p = spark.createDataFrame([*points, (900, None, None)], "pid long, lon double, lat double")
    got = sorted(map(tuple, spatial.incidents_within(p, q, "pid", "iid", carried=("name",)).collect()))
    ground, want = spatial.GROUND, []
    for i, px, py in points:
        for k, x, y, acres in incidents:
            flat = lambda a, b, px=px, py=py: ((a - px) * ground * math.cos(math.radians(py)), (b - py) * ground)
            if (around := ring(k, x, y)) is None:
                away = math.hypot(*flat(x, y)) - max(math.sqrt(acres * 4046.86 / math.pi), 500.0)
            else:
                line = [flat(a, b) for a, b in around]
                to = lambda a, b: math.hypot(a[0] + (t := max(0, min(1, -(a[0] * (b[0] - a[0]) + a[1] * (b[1] - a[1])) / math.dist(a, b) ** 2))) * (b[0] - a[0]), a[1] + t * (b[1] - a[1]))
                away = 0 if inside([line], 0, 0) else min(to(a, b) for a, b in pairs_of(line))
            if away <= 30 * 1609.344:
                want.append((i, k, f"fire {k}"))
    assert got == sorted(want) and 0 < len(want) < 15_000


def test_nearest_feature_in_dense_places(spark, monkeypatch):
    """Clusters within a cell, with many features in one spot and targets beside them: cells are quartered until few features are near, and the nearest ones are found."""
    monkeypatch.setattr(spatial, "MOST_NEAR", 12)
    r = random.Random(9)
    rows = [(i, "a", r.gauss(0, 0.01), r.gauss(0, 0.01)) for i in range(150)] + [(200 + i, "a", 0.3, 0.3) for i in range(30)] + [(300 + i, "a", r.gauss(0.31, 1e-7), r.gauss(0.3, 1e-7)) for i in range(40)] + [(400 + i, "b", r.uniform(-1, 1), 0.0) for i in range(20)]
    p = spark.createDataFrame(rows, "t long, g string, x double, y double")
    got = {row.t: (row.f, row.d2) for row in spatial.nearest_feature(p, p.withColumnRenamed("t", "f"), "t", "f", "g", 0.05).collect()}
    want = {i: min(((x - u) ** 2 + (y - v) ** 2, k) for k, h, u, v in rows if h == g and k != i) for i, g, x, y in rows}
    assert {i: k for i, (k, _) in got.items()} == {i: k for i, (_, k) in want.items()} and all(got[i][1] == pytest.approx(d) for i, (d, _) in want.items())
