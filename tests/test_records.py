"""Imports, boundaries, grids, lines and lists beyond what the queries show."""

import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cinderline.functions import geometry
from cinderline.operators import merge, spatial
from cinderline.sources import documents, records


def test_typed_import(spark):
    types = {"unit": "long", "low": "double"}
    known = spark.createDataFrame([(1,), (2,)], "unit long")
    good = spark.createDataFrame([("1", " 5.5"), ("2", "")], "unit string, low string")
    assert sorted(map(tuple, records.typed_import(good, types, known, "unit").collect())) == [(1, 5.5), (2, None)]
    with pytest.raises(ValueError, match="missing columns: low"):
        records.typed_import(good.drop("low"), types, known, "unit")
    for bad, said in ((("3", "1"), "unknown unit: 3"), (("1", "cold"), "no double in low: cold"), ((None, "1"), "unknown unit: null")):
        with pytest.raises(PySparkException, match=said):
            records.typed_import(spark.createDataFrame([bad], "unit string, low string"), types, known, "unit").collect()
    assert records.typed_import(good.limit(0), types, known, "unit").count() == 0


def test_boundaries_that_are_missing_or_broken_are_empty(spark, tmp_path):
    good = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"slug": "a"}, "geometry": {"type": "Point", "coordinates": [1, 2]}}]}
    (tmp_path / "good.geojson").write_text(json.dumps(good))
    (tmp_path / "cut.geojson").write_text(json.dumps(good)[:-3])
    read = lambda name: records.boundary_features(spark, str(tmp_path / name)).collect()
    assert [(r.longitude, r.latitude) for r in read("good.geojson")] == [(1.0, 2.0)]
    assert read("cut.geojson") == [] and read("none.geojson") == []


def test_grid_cells(spark, tmp_path):
    grid = np.array([[1, -9999, 3], [4, 5, -9999]], dtype="<i4")
    (tmp_path / "dem.bil").write_bytes(grid.tobytes())
    got = records.read_grid(spark, str(tmp_path / "dem.bil"), 3, nodata=-9999)
    assert sorted((r.row, r.col, r.value) for r in got.collect()) == [(0, 0, 1.0), (0, 2, 3.0), (1, 0, 4.0), (1, 1, 5.0)]
    with pytest.raises(PySparkException, match="no rows of 4"):
        records.read_grid(spark, str(tmp_path / "dem.bil"), 4).collect()


def test_lines(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    bent = geometry.ring_of([(0, 0), (3, 4), (3, 10)])
    assert one(geometry.line_length(bent)) == 11.0
    assert tuple(one(geometry.nearest_on_line(bent, F.lit(5.0), F.lit(7.0)))) == (2.0, 8.0)
    assert tuple(one(geometry.nearest_on_line(bent, F.lit(3.0), F.lit(20.0)))) == (10.0, 11.0)
    short = geometry.ring_of([(1, 1)])
    assert one(geometry.line_length(short)) == 0.0 and one(geometry.nearest_on_line(short, F.lit(0.0), F.lit(0.0))) is None


def test_combined_polygons_keep_their_order(spark):
    square = lambda x: [[{"x": x, "y": 0.0}, {"x": x + 1, "y": 0.0}, {"x": x + 1, "y": 1.0}, {"x": x, "y": 0.0}]]
    rows = [("u", 2, [square(5.0)]), ("u", 1, [square(1.0), square(2.0)]), ("u", 3, None), ("w", 1, None)]
    df = spark.createDataFrame(rows, "unit string, n int, polygons array<array<array<struct<x:double,y:double>>>>")
    got = spatial.combined_polygons(df, "unit", "polygons", "n").collect()
    assert [(r.unit, [p[0][0].x for p in r.polygons]) for r in got] == [("u", [1.0, 2.0, 5.0])]


def test_reseeding_again_changes_nothing(spark):
    state = spark.createDataFrame([(1, "areas", "old", True), (2, "areas", "gone", True), (2, "camps", "camp", True)], "id long, dataset string, name string, active boolean")
    seeded = spark.createDataFrame([(1, "new"), (3, "more")], "id long, name string")
    once = merge.reseeded(state, seeded, "id", "dataset", "areas")
    want = [(1, "areas", "new", True), (2, "areas", "gone", False), (2, "camps", "camp", True), (3, "areas", "more", True)]
    assert sorted(map(tuple, once.collect())) == want
    assert sorted(map(tuple, merge.reseeded(once, seeded, "id", "dataset", "areas").collect())) == want
    assert sorted(map(tuple, merge.reseeded(state, seeded.limit(0), "id", "dataset", "areas").where("active").collect())) == [(2, "camps", "camp", True)]


def test_alerts_that_are_no_json_need_review(spark):
    df = spark.createDataFrame([("{",), (None,), ('{"data":[]}',)], "body string")
    assert [(r.alerts, r.matching, r.extracted_text, r.needs_review) for r in documents.parse_alerts(df, "body", "fire").collect()] == [(0, 0, "", True), (0, 0, "", True), (0, 0, "", False)]


def test_bound_shapes_and_dealt_rows(spark):
    """A text is parsed once, whatever is asked of it; rows of one partition are dealt to all."""
    from cinderline.sources.tables import dealt

    text = '{"type":"GeometryCollection","geometries":[{"type":"Point","coordinates":[5,6]},{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}]}'
    df = spark.createDataFrame([(text,)], "t string")
    for read in (geometry.geojson_polygons, geometry.geojson_points):
        assert df.select(read(F.col("t")).alias("p"))._jdf.queryExecution().analyzed().toString().count("parse_json") == 1
    assert [tuple(p) for p in df.select(geometry.geojson_points(F.col("t")).alias("p")).first().p] == [(5, 6), (0, 0), (1, 0), (1, 1), (0, 0)]
    assert dealt(spark.range(0, 1000, 1, 1)).rdd.getNumPartitions() == 4


def test_pages_are_held_some_at_a_time(spark, monkeypatch):
    """Pages of one batch come out in parts, and all of them do."""
    seen = []
    frame = spark.range(1).select(F.lit(1).alias("page_id"), F.lit("").alias("html"))
    monkeypatch.setattr(type(frame), "mapInArrow", lambda self, f, schema: seen.append(f))
    documents.extract_pages(frame, "fire")
    batch = pa.RecordBatch.from_pydict({"page_id": list(range(600)), "html": ["<title>a</title><p>open fire in the forest", None, "<h1>b</h1>"] * 200})
    parts = list(seen[0](iter([batch])))
    assert [p.num_rows for p in parts] == [256, 256, 88] and [i for p in parts for i in p.column(0).to_pylist()] == list(range(600))
    assert parts[0].to_pylist()[0]["excerpts"] == ["open fire in the forest"] and parts[0].to_pylist()[1]["body"] == ""


def test_streams_are_not_looked_through_for_objects():
    """Objects in a stream's bytes are none of the file's; long runs of digits cost no more than their length; codes of two bytes."""
    from cinderline.sources import pdf

    inner = b"<" + b"0007" * 20_000 + b"> Tj 7 0 obj << /Not /This >> endobj"
    data = b"%%PDF-1.4\n7 0 obj << /Real /One >> endobj\n8 0 obj << /Length %d >>\nstream\n%s\nendstream\nendobj\n9 0 obj << /Last 1 >> endobj" % (len(inner), inner)
    held = pdf.objects(data)
    assert b"/Real" in held[7][0] and held[8][1] == inner and b"/Last" in held[9][0]
    assert pdf.page_text(b"BT /F1 12 Tf <00010002> Tj <0003> Tj <0009> Tj ET", {b"/F1": (2, {1: "a", 2: "é", 3: "b"})}) == "aéb"
