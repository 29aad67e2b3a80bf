"""Wildfire answers, whole pages, rasters, PDF files, staleness by timers, audit rows, simpler outlines: small cases."""

import math
import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinderline.functions import geometry
from cinderline.operators import overlay, pages, simplify, wildfires
from cinderline.plans.files import sample_pdf
from cinderline.sources import audit, pdf, rasters
from cinderline.streaming import freshness
from tests.test_shapes import area, pairs_of, shapes, square

NOW = datetime(2024, 1, 31, 12, tzinfo=timezone.utc)
INCIDENT = "iid long, name string, acres double, percent_contained double, discovered_at timestamp, behavior string, information_url string, personnel string, short_description string, lon double, lat double, rings array<array<struct<x:double,y:double>>>"


@pytest.fixture(scope="module")
def incidents(spark):
    ring = [[{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 1.0, "y": 1.0}]]
    rows = [(i, f"F{i}", 50.0 if i < 8 else 500.0, 10.0, NOW, None, "https://x" if i == 7 else None, p, " a " if i % 2 else "  ", 1.5, 2.5, ring if i == 1 else None) for i, p in enumerate(["12", "7.9", "x", "", None, "3", "4", "5", "6"])]
    return spark.createDataFrame(rows, INCIDENT)


def test_contexts(spark, incidents):
    """The nearest five, ties by id; minor without a large fire or a page; none without matches."""
    places = spark.createDataFrame([(1,), (2,), (3,), (4,), (1,)], "pid long")
    matches = spark.createDataFrame([*((1, i, 5.0 - i % 2, "near") for i in range(7)), (1, 8, 29.04, "regional"), (2, 3, 0.0, "inside"), (2, 4, 9.96, "near"), (3, 7, 3.0, "near")], "pid long, iid long, miles double, tier string")
    got = {r.pid: r for r in wildfires.contexts(places, matches, incidents, NOW, "pid", "iid").collect()}
    assert [(got[p].status, got[p].minor) for p in (1, 2, 3, 4)] == [("near", False), ("inside", True), ("near", False), ("none", False)]
    assert [i.incident_id for i in got[1].incidents] == ["1", "3", "5", "0", "2"] and got[4].incidents == [] and got[1].as_of == "2024-01-31T12:00:00Z"
    assert [(i.distance_miles, i.personnel, i.short_description) for i in got[2].incidents] == [(0.0, None, "a"), (10.0, None, None)]
    assert [(i.personnel, i.short_description) for i in got[1].incidents[:1]] == [(7, "a")]
    stale = wildfires.contexts(places, matches, incidents, None, "pid", "iid").collect()
    assert len(stale) == 4 and {(r.status, r.minor, r.as_of, len(r.incidents)) for r in stale} == {("stale", False, None, 0)}
    assert stale[0].__fields__ == list(got.values())[0].__fields__


def test_last_sync(spark):
    syncs = lambda *rows: spark.createDataFrame(list(rows), "finished_at timestamp, success boolean")
    old = NOW - timedelta(hours=6, seconds=1)
    assert wildfires.last_sync(syncs((NOW - timedelta(hours=6), True), (NOW, False)), NOW) is not None
    assert wildfires.last_sync(syncs((old, True), (NOW, False)), NOW) is None and wildfires.last_sync(syncs(), NOW) is None


def test_map_features(spark, incidents):
    import json

    pairs = spark.createDataFrame([(1, 1), (1, 2)], "pid long, iid long")
    got = {r.iid: r for r in wildfires.map_features(pairs, incidents, NOW, "pid", "iid").collect()}
    assert json.loads(got[1].geometry) == {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]} and got[1].kind == "wildfire"
    assert json.loads(got[2].geometry) == {"type": "Point", "coordinates": [1.5, 2.5]} and got[2].kind == "wildfire_incident"
    assert wildfires.map_features(pairs, incidents, None, "pid", "iid").count() == 0


@pytest.mark.parametrize(
    "text,status,policy,confidence,evidence",
    [
        ("Hello. No fire restrictions. Stage 2!", "none", "allowed", 0.93, "No fire restrictions."), ("STAGE II  now", "stage_2", "prohibited", 0.9, "STAGE II now"), ("in stage 1.", "stage_1", "developed_sites_only", 0.82, "in stage 1."),
        ("A campfire is\nprohibited", "unknown", "unknown", 0.35, "A campfire is prohibited"), ("campfires here are banned", "full", "prohibited", 0.78, "campfires here are banned"), ("nothing", "unknown", "unknown", 0.35, None), (None, "unknown", "unknown", 0.35, None),
    ],
)
def test_stated_claim(spark, text, status, policy, confidence, evidence):
    c = spark.createDataFrame([(text,)], "t string").select(pages.stated_claim(F.col("t")).alias("c")).first().c
    assert (c.status, c.policy, c.confidence, c.evidence) == (status, policy, confidence, [evidence] if evidence else []) and len(c.reasons) == (status == "unknown")


def test_usage_cost(spark):
    df = spark.createDataFrame([("big-1", 1000, 500, 100), ("small", None, None, 7), ("none", 1, 1, 1), (None, 1, 1, 1)], "m string, i long, c long, o long")
    cost = pages.usage_cost(F.col("m"), {"input": F.col("i"), "cache_creation": F.col("c"), "output": F.col("o")}, [("^big", 3.0, 15.0), ("small|big", 1.0, 5.0)])
    assert [r.x for r in df.select(cost.alias("x")).collect()] == [0.006, 0.000035, None, None]


def test_layer_claims(spark):
    sources = spark.createDataFrame([(1, 1, None), (2, 1, "unit b"), (3, 1, "nit B"), (4, 1, "C"), (5, 9, None)], "sid long, lid long, data_source string")
    features = spark.createDataFrame([(1, 0, '{"Status": 7, "DataSource": "Unit A"}'), (1, 1, '{"status": "2", "source": "Unit B", "Comments": "east"}'), (1, 2, '{"Status": 0, "Source": "Unit B"}'), (2, 0, None)], "lid long, n long, attributes string")
    got = {r.sid: (r.found, r.status, r.area, r.confidence) for r in pages.layer_claims(sources, features, "sid", "lid", "n").collect()}
    assert got == {1: (True, "unknown", None, 0.35), 2: (True, "stage_2", "east", 0.95), 3: (True, "stage_2", "east", 0.95), 4: (False, "unknown", None, 0.35), 5: (False, "unknown", None, 0.35)}


def test_review_rows(spark):
    units = spark.createDataFrame([(1,), (2,), (3,)], "u long")
    o = spark.createDataFrame([(1, 1, False, "full", ["e"], "x", 0.9, NOW), (2, 1, True, "advisory", None, "x", 0.1, NOW), (3, 2, False, "none", [], "x", 0.5, NOW), (4, 2, False, "none", [], "x", 0.5, NOW)], "o long, u long, current boolean, status string, errors array<string>, source_type string, confidence double, created_at timestamp")
    got = {r.u: (r.observations, r.current, r.best and r.best.o) for r in pages.review_rows(units, o, "u", "o").collect()}
    assert got == {1: (2, 1, 2), 2: (2, 0, 4), 3: (0, 0, None)}


# Files

@pytest.mark.parametrize("packed", [True, False])
def test_pdf_round_trip(packed):
    plain = ["First (line) with \\ and 100%\nsecond", "next page"]
    assert pdf.pdf_pages(sample_pdf(plain, packed)) == plain
    other = ["Ζεύς 中文 😀 ½\nline", ""]
    assert pdf.pdf_pages(sample_pdf(other, packed)) == [other[0], ""]


def test_pdf_operators():
    """Arrays with gaps, octal and hexadecimal strings, quotation operators, positions on one line, objects packed in a stream, contents in pieces."""
    import zlib

    content = rb"BT /F1 9 Tf 1 0 0 1 72 700 Tm [(Ca) 20 (mp) -300 (fires)] TJ 0 -12 Td (\101\102\(x\)\n) Tj (next) ' <4869> Tj 30 0 Td (there) Tj T* (a(b)c) Tj ET"
    page, font = b"<< /Type /Page /Parent 2 0 R /Contents [7 0 R 8 0 R] >>", b"<< /Type /Font /Subtype /Type1 >>"
    index = b"5 0 6 %d " % len(page)
    packed, first = zlib.compress(index + page + font), len(index)
    file = b"%PDF-1.5\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj 2 0 obj << /Type /Pages /Kids [5 0 R] /Count 1 >> endobj\n4 0 obj << /Type /ObjStm /N 2 /First " + str(first).encode() + b" /Filter /FlateDecode /Length " + str(len(packed)).encode() + b" >>\nstream\n" + packed + b"\nendstream endobj\n"
    cut = content.index(b"(next)")
    for n, part in ((7, content[:cut]), (8, content[cut:])):
        file += b"%d 0 obj << /Length 9 0 R >>\nstream\n%s\nendstream endobj\n" % (n, part)
    assert pdf.pdf_pages(file + b"9 0 obj 3 endobj") == ["Camp fires\nAB(x)\nnextHi there\na(b)c"]


def test_pdf_files(spark, tmp_path):
    for name, data in (("a.pdf", sample_pdf(["one  two", "three"])), ("b.pdf", sample_pdf([""])), ("c.pdf", b"no pdf"), ("e.pdf", b"%PDF-1.4 1 0 obj << /Type /Catalog >>\nstream\nx")):
        (tmp_path / name).write_bytes(data)
    got = {r.path[-5:]: (r.page_count, r.text, r.extraction_status, r.extraction_error is None) for r in pdf.read_pdfs(spark, str(tmp_path)).collect()}
    assert got["a.pdf"] == (2, "one two\n\nthree", "ok", True) and got["b.pdf"] == (1, "", "needs_review", False)
    assert all(got[n][:3] == (None, "", "needs_review") for n in ("c.pdf", "e.pdf"))


HEADER = "BYTEORDER I\nLAYOUT BIL\nNROWS {r}\nNCOLS {c}\nNBANDS 1\nNBITS 32\nPIXELTYPE SIGNEDINT\nULXMAP 10\nULYMAP 50\nXDIM 0.5\nYDIM 0.25\nNODATA -1\n"


def test_raster_windows(spark, tmp_path):
    """Windows are planned from the bounds, read their own bytes, and are many partitions; cells of no data go."""
    grid = np.arange(60 * 40, dtype="<i4").reshape(60, 40)
    grid[5, 3] = -1
    (tmp_path / "dem.bil").write_bytes(grid.tobytes())
    (tmp_path / "dem.hdr").write_text(HEADER.format(r=60, c=40))
    path = str(tmp_path / "dem.bil")
    whole = rasters.read_rasters(spark, path, window=200).collect()
    assert {(r.row, r.col): r.value for r in whole} == {(i, j): float(grid[i, j]) for i in range(60) for j in range(40) if grid[i, j] >= 0}
    assert all(r.x == 10 + 0.5 * r.col and r.y == 50 - 0.25 * r.row for r in whole[:50])
    bounds = (11.0, 47.5, 12.6, 49.0)
    some = {(r.row, r.col) for r in rasters.read_rasters(spark, str(tmp_path), bounds, 10).collect()}
    assert some == {(i, j) for i in range(60) for j in range(40) if 11.0 <= 10 + 0.5 * j <= 12.6 and 47.5 <= 50 - 0.25 * i <= 49.0 and grid[i, j] >= 0}
    reader = rasters.RasterReader({"path": path, "window": "10", **{k: str(v) for k, v in zip(("min_x", "min_y", "max_x", "max_y"), bounds, strict=True)}})
    parts = reader.partitions()
    assert len(parts) == 4 and all(p.cols == (2, 5) and p.rows[1] - p.rows[0] < 2 for p in parts)
    # A file cut off behind the window is read all the same: nothing outside is touched.
    (tmp_path / "dem.bil").write_bytes(grid[:11].tobytes())
    assert sum(b.num_rows for p in parts for b in reader.read(p)) == len(some)
    assert rasters.read_rasters(spark, path, (90.0, 0.0, 91.0, 1.0)).count() == 0


@pytest.mark.parametrize("line", ["NBANDS 3", "PIXELTYPE FLOAT\nNBITS 8", "LAYOUT TIF"])
def test_raster_headers(line):
    with pytest.raises(ValueError):
        rasters.parsed_header(HEADER.format(r=1, c=1) + line)


def test_covered_cells(spark):
    """Scan lines of a ring with a hole and of a concave ring, against the test of every middle."""
    from tests.test_shapes import inside, star

    zones = {1: [square(0.3, -5.7, 5), square(1.3, -4.7, 2)], 2: [star(random.Random(3), 4.1, -4.2, 4, 11)], 3: []}
    got = {(r.gid, r.row, r.col) for r in rasters.covered_cells(shapes(spark, zones.items()), "gid", (0.0, 0.0), (0.5, 0.5)).collect()}
    assert got == {(k, i, j) for k, z in zones.items() if z for i in range(-20, 40) for j in range(-10, 40) if inside(z, 0.5 * j, -0.5 * i)}


# Runs

def test_audited(spark, tmp_path):
    path, seen = str(tmp_path / "audit"), []
    df = spark.range(10)
    assert audit.audited(df, "good", lambda d: d.write.parquet(str(tmp_path / "out")), path, {"even": F.count_if(F.col("id") % 2 == 0)}, {"by": "me"})
    with pytest.raises(ValueError):
        audit.audited(df, "bad", lambda d: (_ for _ in ()).throw(ValueError("first line\nsecond")), path)
    assert not audit.audited(df, "quiet", lambda d: seen.append(1) or d.select(F.raise_error(F.lit("x")).alias("e")).write.parquet(str(tmp_path / "no")), path, fail=False)
    rows = {r.job: r for r in audit.audit_rows(spark, path).collect()}
    assert rows["good"].success and rows["good"].counts == {"rows": 10, "even": 5} and rows["good"].metadata == {"by": "me"}
    assert not rows["bad"].success and (rows["bad"].error_class, rows["bad"].error_message, rows["bad"].counts) == ("ValueError", "first line", None)
    assert not rows["quiet"].success and rows["quiet"].finished_at >= rows["quiet"].started_at and len({r.run_id for r in rows.values()}) == 3


def test_freshness_over_batches(spark, tmp_path):
    """A key turns stale without an event of its own, once others move the watermark; results do not depend on the batches."""
    hour = lambda h: datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(hours=h)
    events = [("a", 0), ("b", 1), ("a", 3), ("a", 3), ("b", 30), ("c", 31), ("a", 60), ("c", 61), (None, 62), ("d", 100)]
    for files in (1, 3, 10):
        folder = str(tmp_path / f"in{files}")
        for k in range(files):
            part = events[k * len(events) // files : (k + 1) * len(events) // files]
            spark.createDataFrame([(x, hour(h)) for x, h in part], "k string, t timestamp").coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema("k string, t timestamp").option("maxFilesPerTrigger", 1).parquet(folder)
        got = freshness.with_ordered_state(spark, freshness.freshness_changes(stream, "k", "t", 10 * 3600, 20 * 3600, "0 seconds"))
        rows = sorted((r.k, r.at.replace(tzinfo=timezone.utc), r.state) for r in got.collect())
        want = [("a", 0, "current"), ("a", 13, "stale"), ("a", 60, "current"), ("a", 70, "stale"), ("b", 1, "current"), ("b", 11, "stale"), ("b", 30, "current"), ("b", 40, "stale"), ("c", 31, "current"), ("c", 41, "stale"), ("c", 61, "current"), ("c", 71, "stale"), ("d", 100, "current")]
        assert rows == [(k, hour(h), s) for k, h, s in want]


def test_status_changes_are_forgotten(spark, tmp_path):
    """Text keys; a key's state goes by a timer, so that its next value is a first one again."""
    from cinderline.streaming import live

    hour = lambda h: datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(hours=h)
    for k, rows in enumerate([[("a", 0, "x"), ("b", 1, "x")], [("a", 2, "y"), ("b", 30, "x")], [("b", 60, "x")], [("a", 61, "y")]]):
        spark.createDataFrame([(x, hour(h), 0, v) for x, h, v in rows], "k string, t timestamp, n long, v string").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = lambda: spark.readStream.schema("k string, t timestamp, n long, v string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    got = lambda **o: sorted((r.k, r.at.replace(tzinfo=timezone.utc), r.before, r.after) for r in live.drained(live.status_changes(stream(), "k", "t", "n", "v", **o)).collect())
    kept = [("a", hour(0), None, "x"), ("a", hour(2), "x", "y"), ("b", hour(1), None, "x")]
    assert got() == kept
    assert got(forget=40 * 3600, late="0 seconds") == sorted([*kept, ("a", hour(61), None, "y")])


# Simpler outlines

def test_simplified_neighbours(spark):
    """Neighbours share each border as before, an island and its hole keep corners, nothing is farther off than the tolerance."""
    r = random.Random(7)
    line = [(5 + r.uniform(-0.2, 0.2), y / 4) for y in range(1, 40)]
    left = [(0, 0), (5, 0), *line, (5, 10), (0, 10)]
    right = [(5, 0), (10, 0), (10, 10), (5, 10), *reversed(line)]
    island = [(20 + 2 * math.cos(k / 60 * math.tau), 2 * math.sin(k / 60 * math.tau)) for k in range(60)]
    tiny = [(30 + 0.01 * x, 0.01 * y) for x, y in island]
    rows = [(1, [left]), (2, [right]), (3, [[(round(x, 9), round(y, 9)) for x, y in island]]), (4, [[(round(x, 9), round(y, 9)) for x, y in tiny]]), (5, None)]
    got = {}
    for x in simplify.simplified(shapes(spark, rows), "gid", 0.5, 2.0).collect():
        got.setdefault(x.gid, []).append([(p.x, p.y) for p in x.ring])
    assert sorted(got) == [1, 2, 3, 4] and all(len(v) == 1 for v in got.values())
    assert abs(area(got[1][0]) + area(got[2][0]) - 100) < 1e-9 and len(got[1][0]) < 10 and len(got[2][0]) < 10
    border = {frozenset(e) for e in pairs_of(got[1][0])} & {frozenset(e) for e in pairs_of(got[2][0])}
    assert border and 3 <= len(got[3][0]) < 20 and len(got[4][0]) >= 3 and area(got[4][0]) > 0
    away = lambda p, a, b: math.hypot(p[0] - a[0] - (t := max(0, min(1, ((p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1])) / ((b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2)))) * (b[0] - a[0]), p[1] - a[1] - t * (b[1] - a[1]))
    for k, ring in ((1, left), (2, right), (3, island)):
        assert max(min(away(p, a, b) for a, b in pairs_of(got[k][0])) for p in ring) <= 0.5 + 1e-9


def test_kept_points():
    line = np.array([(0, 0), (1, 1.4), (2, 3), (3, 1.6), (4, 0)], float)
    assert simplify.fewer(line, 0.5, 0).tolist() == [0, 2, 4] and simplify.fewer(line, 5, 0).tolist() == [0, 4] and simplify.fewer(line, 5, 1).tolist() == [0, 2, 4]
    loop = np.array([(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)], float)
    assert len(simplify.fewer(loop, 9, 2)) == 4


def test_clip_to_a_window(spark):
    ring, window = geometry.ring_of([(0, 0), (4, 0), (0, 4)]), geometry.ring_of([(1, -1), (3, 1), (1, 3)])
    one = spark.range(1).select(geometry.ring_area(overlay.clipped(ring, window)).alias("a"), F.size(overlay.clipped(ring, geometry.ring_of([(9, 9), (10, 9), (10, 10)]))).alias("n")).first()
    assert (one.a, one.n) == (3.5, 0)


def test_equal_names_are_cut_by_place_and_then_by_their_own_id(spark):
    names = spark.createDataFrame([(1, 2, "elk lake", "elk lake", 1), (4, 1, "elk lake", "elk lake", 1), (3, 1, "elk lake", "elk lake", 1)], "name_id long, place_id long, name string, normalized_name string, weight int")
    places = spark.createDataFrame([(1, True, 5, "lake"), (2, True, 5, "lake")], "place_id long, active boolean, search_rank int, place_type string")
    assert [r.name_id for r in pages.matching_names(names, places, "elk lake", [], 2, tie="name_id").collect()] == [3, 4]


def test_halves_are_rounded_as_sql_casts_them(spark):
    from cinderline.plans import catalogue

    df = spark.createDataFrame([(900.5,), (901.5,), (-0.5,), (900.51,), (None,)], "v double")
    assert [r[0] for r in df.select(catalogue.whole("v")).collect()] == [900, 902, 0, 901, None]


def test_matches_are_summed_up_without_the_details(spark):
    """The severest tier and the minor flag are numbers that are summed up where the matches are; details join the listed incidents only."""
    places = spark.createDataFrame([(1,), (2,)], "p long")
    matches = spark.createDataFrame([(1, k, float(k), "near" if k else "inside") for k in range(8)], "p long, i long, miles double, tier string")
    text = "string"
    rows = [(k, f"Fire {k}", 5.0, 0.0, None, "active", "", "3", " smoke ") for k in range(8)]
    details = spark.createDataFrame(rows, f"i long, name {text}, acres double, percent_contained double, discovered_at timestamp, behavior {text}, information_url {text}, personnel {text}, short_description {text}")
    got = wildfires.contexts(places, matches, details, datetime(2024, 1, 31), "p", "i", 2)
    rows = {r.p: r for r in got.collect()}
    assert (rows[1].status, rows[1].minor, [i.name for i in rows[1].incidents]) == ("inside", True, ["Fire 0", "Fire 1"]) and (rows[2].status, rows[2].minor, rows[2].incidents) == ("none", False, [])
    assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()
