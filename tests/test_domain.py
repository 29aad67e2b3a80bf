"""The domain's own cases on literal rows."""

from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cinderline.functions import geometry, labels, text
from cinderline.operators import history, joins, localized, merge, resolve, search, spatial, stats
from cinderline.sources import documents, records
from cinderline.streaming import live

CLAIM = "unit_id long, source string, source_type string, status string, policy string, confidence double, review_status string, scope string, created_at timestamp, claim_id long"


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def claims(spark, *rows):
    at = datetime(2024, 7, 1)
    full = [(u, f"s{i}", kind, status, policy, 0.9, review, None, at, i) for i, (u, kind, status, policy, review) in enumerate(rows)]
    return spark.createDataFrame(full, CLAIM)


@pytest.mark.parametrize(
    ("pairs", "outcome", "status"),
    [
        ((("full", "prohibited"), ("stage_2", "prohibited")), "published", "full"),  # labels differ, same answer
        ((("full", "prohibited"), ("stage_1", "developed_sites_only")), "conflict", "unknown"),
        ((("full", "unknown"), ("stage_2", "unknown")), "conflict", "unknown"),
        ((("year_round", "developed_sites_only"), ("stage_2", "prohibited")), "published", "stage_2"),
        ((("year_round", "developed_sites_only"), ("none", "")), "conflict", "unknown"),
        ((("unknown", "unknown"), ("stage_1", "prohibited")), "published", "stage_1"),
        ((("unknown", "unknown"),), "published", "unknown"),
        ((("year_round", "prohibited"), ("full", "prohibited"), ("year_round", "allowed")), "published", "full"),
    ],
)
def test_resolution(spark, pairs, outcome, status):
    got = resolve.resolve_claims(claims(spark, *((1, "fs_fire_page", s, p, "accepted") for s, p in pairs))).collect()
    assert [(r.outcome, r.status) for r in got] == [(outcome, status)]


def test_resolution_ignores_unreviewed_and_keeps_state(spark):
    c = claims(spark, (1, "fs_fire_page", "full", "prohibited", "needs_review"), (2, "inciweb_feed", "stage_1", "prohibited", "accepted"), (2, "arcgis_feature_layer", "stage_1", "allowed", "auto_accepted"))
    r = resolve.publish(spark.createDataFrame([(1,), (2,)], "unit_id long"), resolve.resolve_claims(c)).orderBy("unit_id").collect()
    assert [(x.outcome, x.policy, x.candidates) for x in r] == [("unknown", "unknown", 0), ("published", "allowed", 2)]
    old = spark.createDataFrame([(1, "danger"), (2, "low")], "unit_id long, rating string")
    now = spark.createDataFrame([(1, "unknown", "x"), (2, "published", "y")], "unit_id long, outcome string, rating string")
    assert {x.unit_id: x.rating for x in resolve.published_state(now, old, ("rating",)).collect()} == {1: "danger", 2: "y"}


def test_history(spark):
    at = lambda d: datetime(2024, 1, d)
    h = spark.createDataFrame([(1, at(1), 1, "a"), (1, at(2), 2, "a"), (1, at(3), 3, None), (1, at(4), 4, "b"), (1, at(5), 5, "a"), (2, at(1), 6, None)], "k long, t timestamp, i long, v string")
    assert [r.i for r in history.collapse_repeats(h, "k", ["t", "i"], "v").orderBy("i").collect()] == [1, 3, 4, 5, 6]
    assert [r.v for r in history.carry_forward(h, "k", ["t", "i"], "v").orderBy("i").collect()] == ["a", "a", "a", "b", "a", None]
    assert [r.changed for r in history.content_changed(h, "k", ["t", "i"], "v").orderBy("i").collect()] == [True, False, False, True, True, False]
    assert [(r.k, r.i) for r in history.latest_per_key(h, "k", "t", "i").orderBy("k").collect()] == [(1, 5), (2, 6)]
    again = history.replaced_history(history.replaced_history(h.withColumn("o", F.lit("live")), h, "o", "backfill"), h, "o", "backfill")
    assert again.count() == 12


@pytest.mark.parametrize(("bounds", "on", "active"), [((11, 1, 3, 31), "2024-01-15", True), ((11, 1, 3, 31), "2024-06-15", False), ((6, 1, 9, 30), "2024-06-01", True), ((2, 30, 9, 30), "2024-06-01", False), ((6, None, 9, 30), "2024-06-01", False)])
def test_season(spark, bounds, on, active):
    assert value(spark, labels.season_active(*(F.lit(b).cast("int") for b in bounds), labels.as_day(on))) is active


def test_rule_activity(spark):
    none = F.lit(None).cast("int")
    d = lambda s: F.lit(s).cast("date")
    active = lambda kind, a, b: value(spark, labels.rule_active(F.lit(kind), d(a), d(b), (none,) * 4, labels.as_day("2024-06-01")))
    assert active("permanent", None, "2020-01-01") and not active("temporary", None, "2024-05-31") and active("temporary", "2024-06-01", None) and active("seasonal", None, None)


def test_text(spark):
    v = lambda c: value(spark, c)
    assert v(text.normalize_name(F.lit("Mt. O'Hood NF & Trl"))) == "mount ohood national forest and trail"
    assert v(text.normalize_name(F.lit(None).cast("string"))) == ""
    assert v(text.slugify(F.lit("Blue Lk Campground"))) == "blue-lake"
    assert v(text.short_slug(F.lit("--A b!!c d--"), 5)) == "a-b-c"
    assert v(text.contains_evidence(F.lit("No  fires now"), F.lit("No fires"))) is True
    assert v(text.decode_entities(F.lit("&amp;lt; &lt;"))) == "&lt; <"
    assert v(text.incident_id(F.lit(" {ab-1} "))) == "AB-1" and v(text.incident_id(F.lit("{}"))) is None
    assert v(text.incident_name(F.lit("Bear Creek Fire"))) == "bear creek"
    assert v(text.lenient_number(F.lit("x"))) is None and v(text.lenient_number(F.lit(" 1e3 "))) == 1000
    assert str(v(text.lenient_date(F.lit("July 4, 2024")))) == "2024-07-04" and v(text.lenient_date(F.lit("soon"))) is None
    assert text.phrases("red blue lake") == ["red blue lake", "red blue", "blue lake"]
    assert v(text.json_in_text(F.lit('say {"a": {"b": 1}} end'))) == '{"a": {"b": 1}}'
    assert v(labels.keyword_class(F.lit(None).cast("string"), (("a", "b"),))) == "unknown"
    assert v(labels.first_sentence(F.lit("All is well. No fire here! End."), "(?i)fire")) == "No fire here!"
    assert v(labels.band_label(F.lit(2000), 2000, 12000)) == "2,000-4,000 ft" and v(labels.band_label(F.lit(12000), 2000, 12000)) == "12,000+ ft"


def test_geometry(spark):
    v = lambda c: value(spark, c)
    square = geometry.ring_of([(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)])
    hole = geometry.ring_of([(1, 1), (2, 1), (2, 2), (1, 2)])
    x = F.lit(1.5)
    assert v(geometry.ring_contains(square, x, x)) and not v(geometry.polygon_contains(F.array(square, hole), x, x)) and not v(geometry.ring_contains(square, F.lit(5.0), x))
    assert v(geometry.ring_area(square)) == 16 and tuple(v(geometry.ring_centroid(square))) == (2, 2)
    assert v(geometry.ring_distance(square, F.lit(7.0), F.lit(8.0))) == 5 and v(geometry.ring_distance(square, x, x)) == 0
    none = F.lit(None).cast("double")
    assert v(geometry.boxes_overlap((none,) * 4, (x,) * 4)) is True
    got = v(geometry.geojson_polygons(F.lit('{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]],[[0,0],[1,1]]]}}')))
    assert len(got) == 1 and len(got[0]) == 1 and v(geometry.geojson_polygons(F.lit("nonsense"))) is None


def test_polygons(spark):
    v = lambda c: value(spark, c)
    box = lambda x0, y0, x1, y1: geometry.ring_of([(x0, y0), (x1, y0), (x1, y1), (x0, y1)])
    big, hole = box(0, 0, 10, 10), box(2, 2, 8, 8)
    ringed = F.array(big, hole)
    meet = lambda a, b: v(geometry.polygons_intersect(a, b))
    assert meet(F.array(big), F.array(box(4, 4, 5, 5))) and meet(F.array(box(4, 4, 5, 5)), F.array(big)) and meet(F.array(big), F.array(box(10, 10, 12, 12)))
    assert not meet(ringed, F.array(box(4, 4, 5, 5))) and meet(ringed, F.array(box(4, 4, 9, 5))) and not meet(F.array(big), F.array(box(11, 0, 12, 1)))
    assert v(geometry.polygons_distance(ringed, F.array(box(4, 4, 5, 5)))) == 2 and v(geometry.polygons_distance(F.array(big), F.array(box(13, 14, 15, 15)))) == 5
    # The boundary, a hole's too, is not inside.
    for x, y, inside in ((0.0, 5.0, False), (5.0, 0.0, False), (10.0, 10.0, False), (2.0, 5.0, False), (1.0, 5.0, True), (5.0, 5.0, False)):
        assert v(geometry.polygon_contains(ringed, F.lit(x), F.lit(y))) is inside
    many = '{"type":"GeometryCollection","geometries":[{"type":"Point","coordinates":[9,8]},{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]},{"type":"LineString","coordinates":[[5,5],[6,6]]}]}'
    assert len(v(geometry.geojson_polygons(F.lit(many)))) == 1 and [tuple(p) for p in v(geometry.geojson_points(F.lit(many)))] == [(9, 8), (0, 0), (1, 0), (1, 1), (0, 0), (5, 5), (6, 6)]
    assert v(geometry.geojson_points(F.lit('{"type":"Point"}'))) is None and v(geometry.geojson_polygons(F.lit('{"type":"Point","coordinates":[1,2]}'))) is None


def test_boxes(spark):
    """Small boxes, one as large as all, and rows without a box."""
    rows = [(i, x, x, x + 0.5, x + 0.5) for i, x in enumerate(map(float, range(0, 300, 3)))] + [(1000, -1e5, -1e5, 1e5, 1e5), (1001, None, 0.0, 1.0, 1.0)]
    kind = "{} long, min_x double, min_y double, max_x double, max_y double"
    a, b = spark.createDataFrame(rows, kind.format("a")), spark.createDataFrame(rows, kind.format("b"))
    got = [(r.a, r.b) for r in spatial.box_join(a, b, "a", "b", 0.25).collect()]
    want = {(i, i) for i in range(100)} | {(1000, i) for i in range(100)} | {(i, 1000) for i in range(100)} | {(1000, 1000)}
    assert len(got) == len(set(got)) and set(got) == want
    full = [(r.a, r.b) for r in spatial.box_join(a, b, "a", "b", 0.25, unboxed=True).collect()]
    assert len(full) == len(set(full)) == len(want) + 2 * len(rows) - 1


def test_nearest_feature_far_away(spark):
    """Clusters and outliers, far sparser than the first cells."""
    import numpy as np

    rng = np.random.default_rng(7)
    xy = [*rng.normal(0, 0.001, (60, 2)).tolist(), *rng.normal(500, 200, (12, 2)).tolist(), [9e4, -9e4]]
    rows = [(i, "g", x, y) for i, (x, y) in enumerate(xy)] + [(900, "alone", 0.0, 0.0)]
    p = spark.createDataFrame(rows, "t long, g string, x double, y double")
    got = {r.t: r.f for r in spatial.nearest_feature(p, p.withColumnRenamed("t", "f"), "t", "f", "g", 0.01).collect()}
    d = ((np.array(xy)[:, None] - np.array(xy)[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    assert got == {i: int(d[i].argmin()) for i in range(len(xy))}


def test_boundary_proximity(spark):
    mile = 1609.344 / (6_378_137.0 * 3.141592653589793 / 180)
    square = lambda x, y, s: [[(x - s, y - s), (x + s, y - s), (x + s, y + s), (x - s, y + s)]]
    kind = "array<array<struct<x:double,y:double>>>"
    b = spark.createDataFrame([(1, square(-120.0, 44.0, 1.0))], f"b long, rings {kind}")
    q = [(1, -120.0, 44.0, 10.0, square(-120.0, 44.0, 0.1)), (2, -120.0, 45.0 + 5 * mile, 10.0, None), (3, -120.0, 45.0 + 20 * mile + 0.2, 500.0, square(-120.0, 45.2 + 20 * mile, 0.2)), (4, -120.0, 45.0 + 20 * mile, 10.0, None), (5, -119.0, 45.0, 5.0, square(-118.99, 45.01, 0.01))]
    got = {r.q: (r.tier, round(r.miles, 2)) for r in spatial.boundary_proximity(b, spark.createDataFrame(q, f"q long, lon double, lat double, acres double, rings {kind}"), "b", "q").collect()}
    assert got == {1: ("inside", 0.0), 2: ("near", 4.69), 3: ("regional", 20.0), 5: ("inside", 0.0)}


def test_passages(spark):
    texts = spark.createDataFrame([(1, "one  two\nthree four"), (2, "xone two threex"), (3, ""), (4, None), (5, "two")], "t long, text string")
    items = spark.createDataFrame([(1, "one two three"), (2, "two"), (3, "e two"), (4, " "), (5, None), (6, "one two five"), (7, "one missing three")], "p long, text string")
    assert sorted((r.t, r.p) for r in search.passages_in_texts(texts, items, "t", "p").collect()) == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3), (5, 2)]


def test_search_units(spark):
    units = spark.createDataFrame([(1, "Deschutes National Forest", "deschutes national forest", "national_forest"), (1, "Deschutes", "deschutes", "national_forest"), (2, "Crater Lake", "crater lake", "national_park")], "unit_id long, name string, normalized_name string, unit_type string")
    run = lambda q: {r.unit_id: r.score for r in search.search_units(units, q).collect()}
    assert run("deschutes") == {1: 2400 + 130 + 1900 + 1800 + 1100 + 720 + 340} and run("lake") == {} and run("park") == {2: 2400 + 120 + 760} and run("") == {}
    assert [search.clamped_limit(x) for x in (0, 99, "7", "x", None)] == [1, 20, 7, 8, 8]


def test_localized_rules(spark):
    ok = {"title": "t", "affected_area": "a", "status": "full", "campfire_policy": "prohibited", "duration_type": "seasonal", "area_type": "trail", "geometry_source_type": "none", "effective_start": None, "effective_end": "2023-01-01", "season_start_month": 6, "season_start_day": 1, "season_end_month": 9, "season_end_day": 30, "evidence_quotes": ["fires are  prohibited"], "geometry_json": None}
    ok |= {c: "unknown" for c in localized.ALLOWED if c.endswith("stove_policy") or c == "charcoal_policy"}
    kind = ", ".join(f"{k} {'int' if k.startswith('season') else 'array<string>' if k == 'evidence_quotes' else 'string'}" for k in ok)

    def errors(**changes):
        df = spark.createDataFrame([tuple((ok | changes).values())], kind)
        return df.select(localized.localized_errors(F.lit("fs_fire_page"), F.lit("Here fires are prohibited."), labels.as_day("2024-01-31"), df.columns).alias("e")).first()["e"]

    assert errors() == [] and errors(duration_type="temporary") == ["past"] and errors(season_start_month=13) == ["past", "range_season_start_month"]
    assert errors(evidence_quotes=None) == ["missing_evidence"] and errors(evidence_quotes=["elsewhere"]) == ["quote", "restrictive"] and errors(geometry_json='{"type":"Box"}') == ["geometry"] and errors(effective_start="soon") == ["bad_start"]


def test_proximity(spark):
    points = spark.createDataFrame([(1, -120.0, 44.0)], "p long, lon double, lat double")
    mile = 1609.344 / (6_378_137.0 * 3.141592653589793 / 180)
    inc = [(1, 0.0, 45.0), (2, 5.0, 45.0), (3, 20.0, 500.0), (4, 20.0, 10.0), (5, 50.0, 500.0)]
    incidents = spark.createDataFrame([(i, -120.0, 44.0 + d * mile, a) for i, d, a in inc], "q long, lon double, lat double, acres double")
    assert {r.q: r.tier for r in spatial.proximity(points, incidents, "p", "q").collect()} == {1: "inside", 2: "near", 3: "regional"}


def test_proximity_takes_the_perimeter_first(spark):
    points = spark.createDataFrame([(1, -119.1, 44.005), (2, -120.05, 44.0), (3, -118.8, 44.005)], "p long, lon double, lat double")
    # A strip of a degree to the east of its point, with a circle that it does not fill, and the same incident without it.
    strip = [(-120.0, 44.0), (-119.0, 44.0), (-119.0, 44.01), (-120.0, 44.01), (-120.0, 44.0)]
    kind = "q long, lon double, lat double, acres double, ring array<struct<x:double,y:double>>"
    got = spatial.proximity(points, spark.createDataFrame([(1, -120.0, 44.0, 50_000.0, strip), (2, -120.0, 44.0, 50_000.0, None)], kind), "p", "q").collect()
    assert {(r.p, r.q): r.tier for r in got} == {(1, 1): "inside", (2, 1): "near", (3, 1): "near", (2, 2): "inside"}
    assert abs(next(r.miles for r in got if (r.p, r.q) == (2, 1)) - 2.49) < 0.02


STATE = "irwin_id string, acres double, perimeter string, active boolean, first_seen long, last_seen long"


def test_snapshots(spark):
    state = spark.createDataFrame([("A", 1.0, "p", True, 1, 1), ("B", 2.0, None, True, 1, 1)], STATE)
    new = spark.createDataFrame([("A", 5.0, None), ("C", 3.0, "q")], "irwin_id string, acres double, perimeter string")
    got = {r.irwin_id: tuple(r)[1:] for r in merge.guarded_merge(state, new, "irwin_id", [["perimeter"]], F.lit(9).cast("long")).collect()}
    assert got == {"A": (5.0, "p", True, 1, 9), "B": (2.0, None, False, 1, 1), "C": (3.0, "q", True, 9, 9)}
    assert merge.guarded_merge(state, new.limit(0), "irwin_id", [["perimeter"]], F.lit(9).cast("long")).collect() == state.collect()
    up = merge.keyed_upsert(spark.createDataFrame([(1, None, 5)], "a long, b long, v long"), spark.createDataFrame([(1, None, 6), (2, 3, 7)], "a long, b long, v long"), ["a", "b"], ["v"])
    assert sorted(tuple(r) for r in up.fillna(-1).collect()) == [(1, -1, 6), (2, 3, 7)]


def test_joins(spark):
    left = spark.createDataFrame([(1, "U", "bear"), (2, "V", "bear"), (3, "V", "fox"), (4, "V", "elk")], "i long, unit string, name string")
    right = spark.createDataFrame([("U", "bear", "x", 1), ("W", "bear", "y", 2), ("W", "fox", "z", 3)], "unit string, name string, url string, n long")
    assert {r.i: r.url for r in joins.exact_then_unique(left, right, ["unit", "name"], "name", "url", "n").collect()} == {1: "x", 2: None, 3: "z", 4: None}
    with pytest.raises(Exception, match="no match"):
        joins.all_matched(left, right.select("name").distinct(), ["name"]).collect()
    assert value(spark, joins.without_tokens(F.array(*map(F.lit, "aab")), F.array(F.lit("b")))) == ["a", "a"]
    assert joins.prefer_existing(left.where("i < 3").select("i"), left.select("i"), "i").count() == 4


def test_statistics(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "z"), ("a", "y"), ("b", "x")], "p string, l string")
    assert {r.p: r.labels for r in stats.joined_labels(df, "p", "l").collect()} == {"a": "x, y and z", "b": "x"}
    assert value(spark, stats.first_distinct(F.array(*map(F.lit, ["b", "", "a", "b", "c"])), 2)) == ["b", "a"]
    paged = stats.page_assign(spark.range(1000).withColumn("id", (F.col("id") * 7919) % 1000), "id", 100).orderBy("id").collect()
    assert [r.place for r in paged] == list(range(1, 1001)) and paged[-1].page == 10


def test_pages_of_many_rows(spark):
    rows = spark.range(400_000).select(F.concat(F.lit("https://x.org/"), F.sha1(F.col("id").cast("string"))).alias("url"), F.col("id").alias("updated"))
    paged = stats.page_assign(rows, "url", 45_000)
    assert tuple(paged.agg(F.count_distinct("place"), F.min("place"), F.max("place"), F.max("page")).first()) == (400_000, 1, 400_000, 9)
    ordered = paged.orderBy("url").select("place").limit(1000).collect()
    assert [r.place for r in ordered] == list(range(1, 1001))


def test_none_evidence_stays_in_its_line(spark):
    from cinderline.operators import answers

    run = lambda *q: value(spark, answers.validation_errors(F.lit("none"), F.lit("unknown"), F.array(*map(F.lit, q)), F.lit(" ".join(q)), F.lit("fs_fire_page"), F.lit(None).cast("date"), labels.as_day("2024-01-31")))
    assert run("restrictions apply\nnew line: not lifted") == ["none"] and run("restrictions apply", "not lifted") == ["none"] and run("restrictions are lifted") == []


def test_records(spark, tmp_path):
    import zipfile

    csv = tmp_path / "a.csv"
    csv.write_text("﻿id,name,lat\n1,Mt Hood,45.4\n2,,x\n", encoding="utf-8")
    df = records.mapped(records.read_records(spark, str(csv)), {"id": {"columns": ["id"], "type": "long"}, "name": {"columns": ["title", "name"], "default": "none"}, "lat": {"columns": ["lat"], "type": "double"}})
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, "Mt Hood", 45.4), (2, "none", None)]
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/OR.txt", "id|name\n1|a\n")
        z.writestr("x/readme", "no")
    assert [tuple(r) for r in records.read_zip(spark, str(tmp_path / "a.zip"), "*.txt", ["id", "name"]).collect()] == [("1", "a")]
    good = '{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"n":"a"},"geometry":{"type":"Point","coordinates":[1.5,2]}}]}'
    (tmp_path / "a.geojson").write_text(good)
    assert [(r.longitude, r.latitude) for r in records.read_records(spark, str(tmp_path / "a.geojson")).select("longitude", "latitude").collect()] == [(1.5, 2.0)]
    (tmp_path / "b.geojson").write_text(good[:-1] + ',"exceededTransferLimit":true}')
    with pytest.raises(Exception, match="incomplete"):
        records.read_records(spark, str(tmp_path / "b.geojson")).collect()
    with pytest.raises(ValueError, match="too many"):
        records.page_offsets(6000)
    for bad, why in ((good[:-2], "collection|delimiter|Expecting"), ("[1]", "collection"), ('{"error":{"code":400}}', "no features"), ('{"features":[{"a":1} {"b":2}]}', "collection")):
        (tmp_path / "c.geojson").write_text(bad)
        with pytest.raises(Exception, match=why):
            records.read_records(spark, str(tmp_path / "c.geojson")).collect()
    (tmp_path / "d.geojson").write_text('\ufeff{ "features" : [ ] , "type":"FeatureCollection"}', encoding="utf-8")
    assert records.read_features(spark, str(tmp_path / "d.geojson")).count() == 0
    one = '{"type":"Feature","properties":{"n":%d,"s":"' + "x" * 900 + '"},"geometry":{"type":"Point","coordinates":[%d.5,2]}}'
    (tmp_path / "big.geojson").write_text('{"type":"FeatureCollection","features":[' + ",\n".join(one % (i, i) for i in range(145_000)) + "]}")
    assert (tmp_path / "big.geojson").stat().st_size > 140_000_000
    big = records.read_features(spark, str(tmp_path / "big.geojson")).agg(F.count("*"), F.sum("longitude"), F.max(F.try_variant_get("properties", "$.n", "int"))).first()
    assert tuple(big) == (145_000, sum(range(145_000)) + 72_500.0, 144_999)
    (tmp_path / "lines.txt").write_text("\n".join(one % (i, i) for i in range(5)) + "\n\n")
    assert records.read_feature_lines(spark, str(tmp_path / "lines.txt")).count() == 5


def test_documents(spark):
    html = "<html><head><title>Fire &amp; rain</title><script>fire fire fire fire</script></head><body><h1>Fire news</h1><p>Campfires are not allowed here.</p><a href='/x'>fire map</a></body></html>"
    r = documents.extract_pages(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string"), "fire").orderBy("page_id").collect()
    assert r[0].title == "Fire & rain" and r[0].excerpts == ["Campfires are not allowed here."] and r[0].links[0].href == "/x" and "script" not in r[0].body and r[1].body == ""
    feeds = spark.createDataFrame([("{",), ('{"error":{}}',), ("{}",), ('{"features":[],"exceededTransferLimit":true}',), ('{"features":[]}',)], "b string")
    assert [x.p for x in feeds.select(documents.feed_problem(F.col("b")).alias("p")).collect()] == ["not JSON", "error object", "no features", "cut short", None]
    rss = "<rss><item><title><![CDATA[ORWWF Bear Creek Fire]]></title><link>http://h/1</link></item></rss>"
    x = documents.parse_rss(spark.createDataFrame([(rss,)], "b string"), "b").first()
    assert (x.unit, x.name, x.link) == ("ORWWF", "bear creek", "https://h/1")
    alerts = spark.createDataFrame([('{"data":[{"title":"Fire ban","description":"d","category":"Danger","lastIndexedDate":"2024-07-01 00:00"},{"title":"Road"}]}',), ("nope",)], "b string")
    a = documents.parse_alerts(alerts, "b", "fire").collect()
    assert (a[0].extracted_text, a[0].alerts, a[0].matching, a[0].modified, a[0].needs_review) == ("Danger: Fire ban: d", 2, 1, "2024-07-01", False) and a[1].needs_review


def test_streams(spark, tmp_path):
    rows = [(1, datetime(2024, 1, 1, h), h, v) for h, v in enumerate("aabba")] + [(2, datetime(2024, 1, 1), 9, "a")]
    table = spark.createDataFrame(rows, "k long, t timestamp, i long, v string")
    table.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    q = live.status_changes(stream, "k", "t", "i", "v").writeStream.format("memory").queryName("changes").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(((r.k, r.before, r.after) for r in spark.table("changes").collect()), key=repr)
    batch = sorted(((r.k, r.from_v, r.v) for r in history.collapse_repeats(table, "k", ["t", "i"], "v").collect()), key=repr)
    assert [(k, b or "", a) for k, b, a in got] == [(k, b or "", a) for k, b, a in batch]
    kept = {"df": spark.createDataFrame([("A", 1.0, "p", True, 1, 1)], STATE)}
    sink = live.snapshot_sink(lambda: kept["df"], lambda df: kept.update(df=spark.createDataFrame(df.collect(), STATE)), "irwin_id", [["perimeter"]], F.lit(9).cast("long"))
    empty = spark.createDataFrame([], "irwin_id string, acres double, perimeter string")
    sink(empty, 0)
    sink(spark.createDataFrame(pd.DataFrame({"irwin_id": ["B"], "acres": [2.0], "perimeter": ["q"]})), 1)
    assert {r.irwin_id: r.active for r in kept["df"].collect()} == {"A": False, "B": True}
    newest = live.snapshot_sink(lambda: kept["df"], lambda df: kept.update(df=spark.createDataFrame(df.collect(), STATE)), "irwin_id", [["perimeter"]], F.lit(9).cast("long"), order="acres")
    newest(spark.createDataFrame([("B", 7.0, "q"), ("B", 3.0, "q")], "irwin_id string, acres double, perimeter string"), 2)
    assert {r.irwin_id: r.acres for r in kept["df"].where("active").collect()} == {"B": 7.0}
