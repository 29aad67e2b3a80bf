"""Rasters of one band beside a text header, read by windows: each window is a partition that reads its rows' bytes alone."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cinderline.functions.geometry import all_edges, rings_bounds

#: Cells of a window at most, but for rows that are longer.
WINDOW = 1 << 20
#: The number types of headers.
TYPES = {("SIGNEDINT", 8): "i1", ("SIGNEDINT", 16): "i2", ("SIGNEDINT", 32): "i4", ("UNSIGNEDINT", 8): "u1", ("UNSIGNEDINT", 16): "u2", ("UNSIGNEDINT", 32): "u4", ("FLOAT", 32): "f4", ("FLOAT", 64): "f8"}
CELLS = "file string, row long, col long, x double, y double, value double"


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path there."""
    return fs.FileSystem.from_uri("file://" + path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path)


def parsed_header(text: str) -> dict:
    """A header's numbers: rows and columns, the middle of the first cell, cell sizes, number type, value of no data. ValueError for what is not one band by rows."""
    raw = {k.lower(): v.strip() for k, v in (line.split(None, 1) for line in text.splitlines() if len(line.split(None, 1)) == 2)}
    if raw.get("nbands", "1") != "1" or raw.get("layout", "BIL").upper() not in ("BIL", "BSQ", "BIP"):
        raise ValueError("only rasters of one band")
    bits = int(raw.get("nbits", "8"))
    kind = TYPES.get((raw.get("pixeltype", "UNSIGNEDINT").upper(), bits))
    if kind is None:
        raise ValueError(f"no numbers of {bits} bits and type {raw.get('pixeltype')}")
    return {
        "nrows": int(raw["nrows"]), "ncols": int(raw["ncols"]), "ulx": float(raw["ulxmap"]), "uly": float(raw["ulymap"]), "xdim": float(raw["xdim"]), "ydim": float(raw["ydim"]),
        "type": (">" if raw.get("byteorder", "I").upper() == "M" else "<") + kind, "nodata": float(raw["nodata"]) if "nodata" in raw else None,
    }


def window_of(h: dict, bounds: tuple[float, float, float, float] | None) -> tuple[int, int, int, int]:
    """First and last row and column of the cells whose middles lie within bounds (min x, min y, max x, max y); all without bounds."""
    if bounds is None:
        return 0, h["nrows"] - 1, 0, h["ncols"] - 1
    min_x, min_y, max_x, max_y = bounds
    first = lambda d: max(0, math.ceil(d - 1e-9))
    last = lambda d, n: min(n - 1, math.floor(d + 1e-9))
    return first((h["uly"] - max_y) / h["ydim"]), last((h["uly"] - min_y) / h["ydim"], h["nrows"]), first((min_x - h["ulx"]) / h["xdim"]), last((max_x - h["ulx"]) / h["xdim"], h["ncols"])


class Window(InputPartition):
    def __init__(self, path: str, header: dict, rows: tuple[int, int], cols: tuple[int, int]):
        self.path, self.header, self.rows, self.cols = path, header, rows, cols


class RasterReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options["path"].split(",") if p]
        self.bounds = tuple(float(options[k]) for k in ("min_x", "min_y", "max_x", "max_y")) if "min_x" in options else None
        self.cells = int(options.get("window", WINDOW))

    def headers(self) -> Iterator[tuple[str, dict]]:
        """The .bil files that the paths name, or that lie in folders that they name, with their headers."""
        for path in self.paths:
            where, inner = located(path)
            info = where.get_file_info(inner)
            found = [inner] if info.type == fs.FileType.File else sorted(f.path for f in where.get_file_info(fs.FileSelector(inner)) if f.path.lower().endswith(".bil"))
            for one in found:
                with where.open_input_stream(one[:-4] + ".hdr") as f:
                    text = f.read().decode()
                yield path[: len(path) - len(inner)] + one if path.endswith(inner) else one, parsed_header(text)

    def partitions(self) -> list[Window]:
        out = []
        for path, h in self.headers():
            top, bottom, left, right = window_of(h, self.bounds)
            if left <= right:
                step = max(1, self.cells // (right - left + 1))
                out += [Window(path, h, (r, min(bottom, r + step - 1)), (left, right)) for r in range(top, bottom + 1, step)]
        return out or [Window("", {}, (0, -1), (0, -1))]

    def read(self, window: Window) -> Iterator[pa.RecordBatch]:
        h, (top, bottom), (left, right) = window.header, window.rows, window.cols
        if top > bottom:
            return
        width = np.dtype(h["type"]).itemsize
        where, inner = located(window.path)
        with where.open_input_file(inner) as f:
            for row in range(top, bottom + 1):
                data = f.read_at((right - left + 1) * width, (row * h["ncols"] + left) * width)
                values = np.frombuffer(data, h["type"]).astype(np.float64)
                cols = np.arange(left, left + len(values))
                held = np.ones(len(values), bool) if h["nodata"] is None else values != h["nodata"]
                n = int(held.sum())
                if n:
                    columns = [pa.array([window.path] * n), pa.array(np.full(n, row, np.int64)), pa.array(cols[held].astype(np.int64)), pa.array(h["ulx"] + cols[held] * h["xdim"]), pa.array(np.full(n, h["uly"] - row * h["ydim"])), pa.array(values[held])]
                    yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in CELLS.split(", ")])


class RasterSource(DataSource):
    """spark.read.format("raster").option("path", ...): cells of one or several rasters, those of no data left out. Options: min_x, min_y, max_x, max_y (of cell middles), window (cells a partition)."""

    @classmethod
    def name(cls) -> str:
        return "raster"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema) -> RasterReader:
        return RasterReader(dict(self.options))


def read_rasters(spark: SparkSession, path: str, bounds: tuple[float, float, float, float] | None = None, window: int = WINDOW) -> DataFrame:
    """file, row, col, x, y, value of the cells of the rasters at a path: a .bil file or a folder of them, on any file system that the library reads ranges of (local, hdfs, s3)."""
    spark.dataSource.register(RasterSource)
    reader = spark.read.format("raster").option("path", path).option("window", window)
    for k, v in zip(("min_x", "min_y", "max_x", "max_y"), bounds or (), strict=False):
        reader = reader.option(k, v)
    return reader.load()


def write_rasters(cells: DataFrame, path: str, ncols: int, block: int, origin: tuple[float, float], size: tuple[float, float], nodata: int = -9999) -> DataFrame:
    """Writes cells (row, col, value: whole numbers) as 32-bit rasters of `block` rows each, under the path, and returns file, row (the first one), n.

    Each block is one task's: no more than its rows are held. Cells that are missing have no data;
    origin is the middle of cell (0, 0), size a cell's width and height.
    """

    def write(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        first = int(key[0]) * block
        grid = np.full((block, ncols), nodata, "<i4")
        grid[pdf["row"].to_numpy() - first, pdf["col"].to_numpy()] = pdf["value"].to_numpy()
        where, inner = located(path)
        where.create_dir(inner, recursive=True)
        header = {"BYTEORDER": "I", "LAYOUT": "BIL", "NROWS": block, "NCOLS": ncols, "NBANDS": 1, "NBITS": 32, "PIXELTYPE": "SIGNEDINT", "ULXMAP": origin[0], "ULYMAP": origin[1] - first * size[1], "XDIM": size[0], "YDIM": size[1], "NODATA": nodata}
        name = f"{inner}/block-{first:012d}"
        for end, data in ((".hdr", "".join(f"{k} {v!r}\n".replace("'", "") for k, v in header.items()).encode()), (".bil", grid.tobytes())):
            with where.open_output_stream(name + end) as f:
                f.write(data)
        return pd.DataFrame({"file": [name + ".bil"], "row": [first], "n": [len(pdf)]})

    return cells.select("row", "col", "value").groupBy(F.floor(F.col("row") / block).alias("block")).applyInPandas(write, "file string, row long, n long")


def covered_cells(zones: DataFrame, key: str, origin: tuple[float, float], size: tuple[float, float]) -> DataFrame:
    """key, row, col of the cells whose middles lie in a zone (rings), by scan lines: where a row's line through the middles crosses the outline, an odd number of crossings to the left is inside.

    origin: the middle of cell (0, 0), rows counting downward; size: a cell's width and height. Rows are
    taken one by one, so nothing larger than a zone's crossings with a line is held. Middles on a left or
    lower border belong to the zone.
    """
    box = zones.where("size(rings) > 0").select(key, all_edges(F.col("rings")).alias("_e"), rings_bounds(F.col("rings")).alias("b"))
    first, last = F.ceil((origin[1] - F.col("b.max_y")) / size[1]), F.floor((origin[1] - F.col("b.min_y")) / size[1])
    lines = box.where(first <= last).select(key, "_e", F.explode(F.sequence(first, last)).alias("row")).withColumn("_y", origin[1] - F.col("row") * size[1])

    def crossing(e: Column) -> Column:
        return e["a"]["x"] + (F.col("_y") - e["a"]["y"]) / (e["b"]["y"] - e["a"]["y"]) * (e["b"]["x"] - e["a"]["x"])

    met = F.filter("_e", lambda e: (e["a"]["y"] > F.col("_y")) != (e["b"]["y"] > F.col("_y")))
    xs = lines.select(key, "row", F.array_sort(F.transform(met, crossing)).alias("_x")).where("size(_x) > 1")
    spans = F.transform(F.sequence(F.lit(0), F.floor(F.size("_x") / 2).cast("int") - 1), lambda k: F.struct(F.ceil((F.get("_x", 2 * k) - origin[0]) / size[0]).alias("lo"), (F.ceil((F.get("_x", 2 * k + 1) - origin[0]) / size[0]) - 1).alias("hi")))
    return xs.select(key, "row", F.explode(F.filter(spans, lambda s: s["lo"] <= s["hi"])).alias("s")).select(key, "row", F.explode(F.sequence("s.lo", "s.hi")).alias("col"))


def zonal(cells: DataFrame, zones: DataFrame, key: str, origin: tuple[float, float], size: tuple[float, float]) -> DataFrame:
    """key, n, mean, least, greatest of the cells (row, col, value; rows and columns of the whole grid) in each zone that has any."""
    return covered_cells(zones, key, origin, size).join(cells, ["row", "col"]).groupBy(key).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("least"), F.max("value").alias("greatest"))
