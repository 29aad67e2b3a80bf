"""Polygons as quadtree covers: cells that an edge crosses carry those edges alone, cells inside carry none.

A polygon begins with the few cells of its box's size. A cell of many edges is cut into four, as deep
as the grid goes; each child gets the edges that touch it, and children without edges that lie outside
go. Whether a cell's lower left corner is inside is known for every cell: from the first cells' full
count of crossings, then along the two sides that lead from a cell's corner to its child's. A point
needs the edges of its own cell only: it is inside if its corner is, turned by each edge between them.
The rows of a cover are bounded by the outline, not by the area. Where many points lie, cells with edges
are cut once more before points meet them, so that most pairs are found in cells inside without a test.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cinderline.functions.geometry import all_edges, by_sizes, edge_columns, ragged
from cinderline.sources.tables import dealt, materialise

#: Edges that a cell may carry before it is cut, the deepest level under the given size, and the most levels above it.
MOST_EDGES, DEEPEST, HIGHEST = 8, -12, 40
#: Where the grids begin: numbers that no coordinate is, so that corners lie on no edge.
ORIGIN = (0.013703599908137, 0.009109383701528)
#: A cover of so many rows at most is sent to all tasks instead of dealing out the points.
FEW = 200_000
#: Points in a cell from which it is cut further, edges of a cell up to which points are told in plain columns, and edges that are cut at once.
MOST_POINTS, PLAIN, AT_ONCE = 512, 2, 200_000


def side_of(level: Column, size: float) -> Column:
    return size * F.pow(F.lit(2.0), level)


@dataclass
class Cells:
    """Some cells in arrays: the row that each comes from, its place, whether its corner is inside, and all edges (ax, ay, bx, by) with the cell they are of, in order."""

    row: np.ndarray
    level: np.ndarray
    i: np.ndarray
    j: np.ndarray
    odd: np.ndarray
    owner: np.ndarray
    edges: np.ndarray

    def counts(self) -> np.ndarray:
        return np.bincount(self.owner, minlength=len(self.row))

    def side(self, size: float) -> np.ndarray:
        return size * 2.0**self.level

    def some(self, keep: np.ndarray) -> Cells:
        e = keep[self.owner]
        return Cells(*(v[keep] for v in (self.row, self.level, self.i, self.j, self.odd)), (np.cumsum(keep) - 1)[self.owner[e]], self.edges[:, e])


def joined(parts: list[Cells]) -> Cells:
    at = np.cumsum([0, *(len(p.row) for p in parts)])
    stacked = (np.concatenate([getattr(p, k) for p in parts]) for k in ("row", "level", "i", "j", "odd"))
    return Cells(*stacked, np.concatenate([p.owner + k for p, k in zip(parts, at[:-1], strict=True)]), np.concatenate([p.edges for p in parts], 1))


def odd_counts(owner: np.ndarray, which: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner[which], minlength=n) % 2 == 1


def within_cells(c: Cells, size: float) -> Cells:
    """The cells with those of their edges that have a point in them, a hair's breadth around included; those that are empty and outside go."""
    side = c.side(size)
    hair = side * 1e-9
    x0, y0 = ORIGIN[0] + c.i * side, ORIGIN[1] + c.j * side
    x1, y1, x2, y2 = (v[c.owner] for v in (x0 - hair, y0 - hair, x0 + side + hair, y0 + side + hair))
    ax, ay, bx, by = c.edges
    touch = (np.minimum(ax, bx) <= x2) & (np.maximum(ax, bx) >= x1) & (np.minimum(ay, by) <= y2) & (np.maximum(ay, by) >= y1)
    turns = [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for x in (x1, x2) for y in (y1, y2)]
    touch &= (np.minimum.reduce(turns) <= 0) & (np.maximum.reduce(turns) >= 0)
    c = Cells(c.row, c.level, c.i, c.j, c.odd, c.owner[touch], c.edges[:, touch])
    return c.some((c.counts() > 0) | c.odd)


def first_cells(lists: pa.Array, size: float) -> Cells:
    """The few cells of their box's size that shapes (arrays of edges) begin with. Edges with a coordinate that is missing or infinite are none."""
    a, b = lists.flatten().flatten()
    edges = np.stack([k.to_numpy(zero_copy_only=False) for k in (*a.flatten(), *b.flatten())]).astype(float)
    real = np.isfinite(edges).all(0)
    of, edges = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())[real], edges[:, real]
    rows, start, n = np.unique(of, return_index=True, return_counts=True)
    if not len(rows):
        return Cells(rows, *(np.zeros(0, int) for _ in range(3)), np.zeros(0, bool), of, edges)
    low = [np.minimum.reduceat(np.minimum(edges[k], edges[k + 2]), start) for k in (0, 1)]
    high = [np.maximum.reduceat(np.maximum(edges[k], edges[k + 2]), start) for k in (0, 1)]
    wide = np.maximum(np.maximum(high[0] - low[0], high[1] - low[1]), size * 2.0**DEEPEST)
    level = np.clip(np.ceil(np.log2(wide / size)), DEEPEST, HIGHEST).astype(int)
    side = size * 2.0**level
    (i0, j0), (i1, j1) = ([np.floor((v[k] - ORIGIN[k]) / side).astype(int) for k in (0, 1)] for v in (low, high))
    across = j1 - j0 + 1
    cells = (i1 - i0 + 1) * across
    shape, k = np.repeat(np.arange(len(rows)), cells), np.arange(cells.sum()) - np.repeat(np.cumsum(cells) - cells, cells)
    # Each cell begins with all edges of its shape.
    owner = np.repeat(np.arange(len(shape)), n[shape])
    e = edges[:, np.arange(len(owner)) - np.repeat(np.cumsum(n[shape]) - n[shape], n[shape]) + np.repeat(start[shape], n[shape])]
    i, j = i0[shape] + k // across[shape], j0[shape] + k % across[shape]
    x, y = (ORIGIN[0] + i * side[shape])[owner], (ORIGIN[1] + j * side[shape])[owner]
    ax, ay, bx, by = e
    # From far to the left, where nothing is inside.
    with np.errstate(divide="ignore", invalid="ignore"):
        left = ((ay > y) != (by > y)) & (ax + (y - ay) / (by - ay) * (bx - ax) <= x)
    return within_cells(Cells(rows[shape], level[shape], i, j, odd_counts(owner, left, len(shape)), owner, e), size)


def given_cells(cells: pa.RecordBatch) -> Cells:
    """Rows of a cover."""
    lists = cells.column("edges")
    a, b = lists.flatten().flatten()
    edges = np.stack([k.to_numpy(zero_copy_only=False) for k in (*a.flatten(), *b.flatten())])
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    return Cells(np.arange(len(n)), *(cells.column(k).to_numpy(zero_copy_only=False).astype(int) for k in ("level", "i", "j")), cells.column("odd").to_numpy(zero_copy_only=False).astype(bool), np.repeat(np.arange(len(n)), n), edges)


def quartered(c: Cells, size: float) -> Cells:
    """Each cell's four children, without those that are empty and outside."""
    side, n, children = c.side(size) / 2, len(c.row), []
    x0, y0 = ((origin + k * 2 * side)[c.owner] for k, origin in ((c.i, ORIGIN[0]), (c.j, ORIGIN[1])))
    ax, ay, bx, by = c.edges
    for di in (0, 1):
        for dj in (0, 1):
            x, y = (ORIGIN[0] + (c.i * 2 + di) * side)[c.owner], (ORIGIN[1] + (c.j * 2 + dj) * side)[c.owner]
            with np.errstate(divide="ignore", invalid="ignore"):
                up, along = ay + (x0 - ax) / (bx - ax) * (by - ay), ax + (y - ay) / (by - ay) * (bx - ax)
                first = ((ax > x0) != (bx > x0)) & ((up > y0) != (up > y))
                between = first != (((ay > y) != (by > y)) & ((along > x0) != (along > x)))
            children.append(Cells(c.row, c.level - 1, c.i * 2 + di, c.j * 2 + dj, c.odd != odd_counts(c.owner, between, n), c.owner, c.edges))
    return joined([within_cells(child, size) for child in children])


def cut(c: Cells, size: float, more: Callable[[Cells], np.ndarray]) -> Cells:
    """The cells, those that are to be cut by their children, again and again."""
    done = []
    while (large := more(c)).any():
        done.append(c.some(~large))
        c = quartered(c.some(large), size)
    return joined([*done, c])


def cover_rows(c: Cells, kept: list[pa.Array], names: list[str]) -> pa.RecordBatch:
    point = lambda k: pa.StructArray.from_arrays([pa.array(c.edges[k]), pa.array(c.edges[k + 1])], ["x", "y"])
    ends = np.concatenate([[0], np.cumsum(c.counts())]).astype(np.int32)
    edges = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([point(0), point(2)], ["a", "b"]))
    return pa.RecordBatch.from_arrays([*(k.take(pa.array(c.row)) for k in kept), pa.array(c.level.astype(np.int32)), pa.array(c.i), pa.array(c.j), edges, pa.array(c.odd)], [*names, "level", "i", "j", "edges", "odd"])


def some_at_a_time(batch: pa.RecordBatch, weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Slices of rows of about AT_ONCE together, or of one row."""
    part = np.cumsum(weights) // AT_ONCE
    for k in np.unique(part):
        first, last = np.searchsorted(part, [k, k + 1])
        yield batch.slice(first, last - first)


def cover_schema(df: DataFrame, keys: list[str]) -> StructType:
    cell = StructType.fromDDL("level int, i long, j long, edges array<struct<a: struct<x: double, y: double>, b: struct<x: double, y: double>>>, odd boolean")
    return StructType([*(df.schema[k] for k in keys), *cell.fields])


def polygon_cover(polygons: DataFrame, key: str, size: float, most_edges: int = MOST_EDGES) -> DataFrame:
    """key, level, i, j, edges, odd: the cells of each polygon's cover, in which every point of it lies once.

    polygons: rings, an array of rings, holes and the rings of several polygons alike; null or empty
    rings have no cells. Cells are of side size * 2**level. odd: whether the cell's lower left corner is
    inside; a cell without edges is inside wholly.
    """
    drawn = polygons.where("size(rings) > 0").select(key, all_edges(F.col("rings")).alias("edges"))
    return edge_cover(drawn, key, size, most_edges)


def edge_cover(shapes: DataFrame, key: str, size: float, most_edges: int = MOST_EDGES) -> DataFrame:
    """As polygon_cover, of shapes that are arrays of edges (a, b) in any order. A shape's cells are cut in arrays, by the task that has it."""

    def covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in some_at_a_time(batch, pc.list_value_length(batch.column("edges")).to_numpy()):
                c = cut(first_cells(b.column("edges"), size), size, lambda c: (c.counts() > most_edges) & (c.level > DEEPEST))
                yield cover_rows(c, [b.column(key)], [key])

    drawn = dealt(shapes.where("size(edges) > 0").select(key, "edges"))
    return materialise(drawn.mapInArrow(covered, cover_schema(drawn, [key])))


def cut_where_crowded(cover: DataFrame, points: DataFrame, key: str, size: float) -> DataFrame:
    """A cover of the cells in which points (level, i, j) lie. Cells with edges are cut as deep as their points, if spread evenly, ask for until MOST_POINTS are in one."""
    counts = points.groupBy("level", "i", "j").agg(F.count("*").alias("_n"))
    halvings = F.ceil(F.log2(F.col("_n") / MOST_POINTS) / 2).cast("int")
    known = materialise(cover.join(counts, ["level", "i", "j"]).withColumn("deep", F.greatest(F.col("level") - F.greatest(halvings, F.lit(0)), F.least("level", F.lit(DEEPEST)))).select(key, "level", "i", "j", "edges", "odd", "deep"))
    crowded = (F.size("edges") > 0) & (F.col("deep") < F.col("level"))

    def covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            steps = batch.column("level").to_numpy() - batch.column("deep").to_numpy()
            for b in some_at_a_time(batch, pc.list_value_length(batch.column("edges")).to_numpy() * 2**steps):
                deep = b.column("deep").to_numpy()
                yield cover_rows(cut(given_cells(b), size, lambda c: (c.counts() > 0) & (c.level > deep[c.row])), [b.column(key)], [key])

    many = dealt(known.where(crowded))
    return materialise(known.where(~crowded).drop("deep").unionByName(many.mapInArrow(covered, cover_schema(known, [key]))))


def covered_points(points: DataFrame, cover: DataFrame, point_id: str, key: str, size: float, on: tuple[str, ...] = ()) -> DataFrame:
    """Pairs (point, key) with the point (x, y) inside, boundaries left out. Points go to one cell of each level that the cover has. on: columns of both that must be equal, too."""

    def placed() -> DataFrame:
        levels = sorted(r.level for r in cover.select("level").distinct().collect())  # at most HIGHEST - DEEPEST + 1
        spread = points.select(point_id, *on, "x", "y", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>")).alias("level"))
        side = side_of(F.col("level"), size)
        return spread.withColumns({"i": F.floor((F.col("x") - ORIGIN[0]) / side), "j": F.floor((F.col("y") - ORIGIN[1]) / side)})

    if not on:
        cover = cut_where_crowded(cover, placed(), key, size)
    p, x, y, side = placed(), F.col("x"), F.col("y"), side_of(F.col("level"), size)
    x0, y0 = ORIGIN[0] + F.col("i") * side, ORIGIN[1] + F.col("j") * side
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*on, "level", "i", "j"]
    few = cover.count() <= FEW

    def met(cells: DataFrame) -> DataFrame:
        # Points of few partitions are dealt to all tasks: a point may be in many shapes.
        return p.repartition(n).join(F.broadcast(cells), keys) if few else p.repartition(n, *keys).hint("merge").join(cells.repartition(n, *keys), keys)

    # Cells without edges are inside wholly; at few edges a point is told in plain columns, so no list goes along with a pair; the others in arrays.
    edges = F.size("edges")
    whole = met(cover.where((edges == 0) & F.col("odd")).select(*keys, key)).select(point_id, key)
    told = met(plain_cells(cover.where(edges.between(1, PLAIN)), [*keys, key], x0, y0)).where(inside_of_plain(x, y)).select(point_id, key)
    parted = met(cover.where(edges > PLAIN)).where(inside_of_cell(F.col("edges"), F.col("odd"), x0, y0, x, y)).select(point_id, key)
    return whole.unionByName(told).unionByName(parted)


def plain_cells(cells: DataFrame, kept: list[str], x0: Column, y0: Column) -> DataFrame:
    """Cells of PLAIN edges at most in plain columns, with all worked out that is no point's: where an edge meets the cell's left side (`up`), and on which side of it the corner is."""
    parts, odd = {}, F.col("odd")
    for n in range(PLAIN):
        ax, ay, bx, by = (F.coalesce(F.get("edges", F.lit(n))[k][c], F.lit(math.nan)) for k in "ab" for c in "xy")
        up = F.when((ax > x0) != (bx > x0), ay + (x0 - ax) / F.nullif(bx - ax, F.lit(0.0)) * (by - ay))
        odd = odd != F.coalesce(up > y0, F.lit(False))
        dy = F.coalesce(F.nullif(by - ay, F.lit(0.0)), F.lit(1.0))
        parts |= {f"_{k}{n}": v for k, v in {"ax": ax, "ay": ay, "bx": bx, "by": by, "dy": dy, "up": F.coalesce(up, F.lit(-math.inf))}.items()}
    return cells.select(*kept, x0.alias("_x0"), F.coalesce(odd, F.lit(False)).alias("_odd"), *(v.alias(k) for k, v in parts.items()))


def inside_of_plain(x: Column, y: Column) -> Column:
    """Whether a point is inside a cell of plain_cells, and on no edge, as inside_of_cell tells it. So short that the compiled loop of a join stays below the 8,000 bytes up to which the JVM compiles it; an edge that is missing is of NaN, which nothing lies between."""
    inside, off = F.col("_odd"), F.lit(True)
    for n in range(PLAIN):
        ax, ay, bx, by, dy, up = (F.col(f"_{k}{n}") for k in ("ax", "ay", "bx", "by", "dy", "up"))
        along = ax + (y - ay) / dy * (bx - ax)
        inside = inside != (((ay > y) != (by > y)) & ((along > F.col("_x0")) != (along > x)))
        inside = inside != (up > y)
        off &= ((bx - ax) * (y - ay) != (by - ay) * (x - ax)) | (x < F.least(ax, bx)) | (x > F.greatest(ax, bx)) | (y < F.least(ay, by)) | (y > F.greatest(ay, by))
    return off & inside


def inside_of_cell(edges: Column, odd: Column, x0: Column, y0: Column, x: Column, y: Column) -> Column:
    """Whether a point is inside, and on no edge, from whether a cell's corner is and the edges between them: as between a corner and its child (quartered) and on_edge, some thousand rows at a time."""

    @F.arrow_udf("boolean")
    def inside(a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array, odd: pa.Array, x0: pa.Array, y0: pa.Array, x: pa.Array, y: pa.Array) -> pa.Array:
        drawn, (o, u0, v0, u, v) = [ragged(e) for e in (a, b, c, d)], (k.to_numpy(zero_copy_only=False) for k in (odd, x0, y0, x, y))
        out = np.zeros(len(u), bool)
        for (n,), rows in by_sizes(drawn[0][2]):
            ax, ay, bx, by = (e[s[rows, None] + np.arange(n)] for e, s, _ in drawn)
            p0, q0, p, q = (k[rows, None] for k in (u0, v0, u, v))
            with np.errstate(divide="ignore", invalid="ignore"):
                up, along = ay + (p0 - ax) / (bx - ax) * (by - ay), ax + (q - ay) / (by - ay) * (bx - ax)
                first = ((ax > p0) != (bx > p0)) & ((up > q0) != (up > q))
                crossed = first != (((ay > q) != (by > q)) & ((along > p0) != (along > p)))
            on = ((bx - ax) * (q - ay) == (by - ay) * (p - ax)) & (p >= np.minimum(ax, bx)) & (p <= np.maximum(ax, bx)) & (q >= np.minimum(ay, by)) & (q <= np.maximum(ay, by))
            out[rows] = (o[rows].astype(bool) != (crossed.sum(1) % 2 == 1)) & ~on.any(1)
        return pa.array(out)

    return inside(*edge_columns(edges), odd, x0, y0, x, y)
