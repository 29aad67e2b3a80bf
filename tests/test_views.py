"""Readers of manifests and geometry files, quantiles by rank, named views on rows with nulls."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cinderline.functions import words
from cinderline.operators import answers, resolve, stats, views
from cinderline.sources import records, tables


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_manifest(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"dataset": {"slug": "a", "name": "A"}, "parts": [{"slug": "x"}, {"slug": None}]}, indent=1))
    path = str(tmp_path / "m.json")
    assert [tuple(r) for r in records.read_manifest(spark, path, "dataset", ("slug",)).select("slug", "name").collect()] == [("a", "A")]
    assert [r.slug for r in records.read_manifest(spark, path, "parts").collect()] == ["x", None]
    with pytest.raises(ValueError, match="has no year"):
        records.read_manifest(spark, path, "dataset", ("year",))
    with pytest.raises(Exception, match="no slug in the manifest"):
        records.read_manifest(spark, path, "parts", ("slug",)).collect()


def test_geometry_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    point = {"type": "Point", "coordinates": [1, 2]}
    feature = {"type": "Feature", "geometry": point, "properties": {"map_subfeatures": [{"part_name": "n"}], "other": 1}}
    for name, value in {"a.json": point, "b.json": feature, "sub/c.json": {"type": "FeatureCollection", "features": [feature, {"type": "Feature", "geometry": None}]}, "d.json": {"type": "FeatureCollection", "features": []}}.items():
        (tmp_path / name).write_text(json.dumps(value))
    rows = [("a", "a.json", None), ("b", "b.json", None), ("c", "sub/c.json", None), ("d", "d.json", None), ("e", "b.json", "{}"), ("f", "", None), ("g", None, None)]
    rules = spark.createDataFrame(rows, "rule string, geometry_path string, geometry_json string")
    got = {r.rule: r for r in records.with_geometry_files(rules, str(tmp_path)).collect()}
    assert len(got) == 7 and all(json.loads(got[k].geometry_json) == point for k in "abc")
    assert json.loads(got["b"].map_subfeatures) == json.loads(got["c"].map_subfeatures) == [{"part_name": "n"}] and got["a"].map_subfeatures is None
    assert got["e"].geometry_json == "{}" and got["d"].geometry_json is got["f"].geometry_json is got["g"].geometry_json is None
    with pytest.raises(Exception, match="no file zz.json"):
        records.with_geometry_files(spark.createDataFrame([("h", "zz.json", None)], rules.schema), str(tmp_path)).collect()


def test_exactly_one(spark):
    df = spark.createDataFrame([(1, "a", 5), (1, "b", 6), (2, "a", 7), (2, "a", 8)], "x int, y string, v int")
    want = lambda *rows: spark.createDataFrame(list(rows), "x int, y string")
    assert sorted(tuple(r) for r in records.exactly_one(df, ["x", "y"], want((1, "a"), (1, "b"), (1, "a"))).collect()) == [(1, "a", 5), (1, "b", 6)]
    for bad, n in (((2, "a"), 2), ((3, "a"), 0)):
        with pytest.raises(Exception, match=f"found {n} for"):
            records.exactly_one(df, ["x", "y"], want((1, "a"), bad)).collect()


def test_exact_quantiles_of_a_hot_group(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": np.where(rng.random(30_000) < 0.7, "hot", rng.integers(0, 40, 30_000).astype(str)), "v": np.round(rng.normal(size=30_000), 2)})
    pdf.loc[:20, "g"] = None
    pdf.loc[pdf.index % 17 == 0, "v"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("v", F.nanvl("v", F.lit(None)))
    df = df.unionByName(spark.createDataFrame([("nulls", None)], "g string, v double"))
    got = {r.g: r for r in stats.exact_quantiles(df, ["g"], "v", {"lo": 0.1, "mid": 0.5, "top": 1.0}).collect()}
    want = pdf.dropna(subset=["v"]).groupby("g", dropna=False)["v"]
    assert len(got) == want.ngroups and "nulls" not in got
    for g, values in want:
        r = got[None if g is None or g != g else g]
        assert np.allclose([r.lo, r.mid, r.top], np.quantile(values, [0.1, 0.5, 1.0]))
    assert stats.exact_quantiles(df.where("false"), ["g"], "v", {"lo": 0.1}).count() == 0


def test_words(spark):
    none = F.lit(None).cast("string")
    assert one(spark, words.policy_label(none)) == "Unknown" and one(spark, words.policy_label(F.lit("no__fires here"))) == "No Fires Here"
    assert one(spark, words.date_range_label(F.lit("2024-07-04"), F.lit("no day"))) == "Since Jul 4, 2024"
    assert one(spark, words.duration_label(F.lit("seasonal"), none, none, F.lit("06-01"), none)) == "Seasonal 06-01"
    assert one(spark, words.stove_label(F.lit("allowed_with_shutoff_valve"), F.lit(True))) == "Allowed with shutoff valve"
    assert one(spark, words.subtitle(F.lit("peak"), none, none, F.lit("other"), none, F.lit(""))) == "Peak"
    assert one(spark, words.approximate(none, none)) is False and one(spark, words.approximate(F.lit("derived_x"), none)) is True


def test_views_of_nothing(spark):
    units = spark.createDataFrame([(1, "a", "A", True), (2, "b", "B", False), (3, "c", "C", None)], "unit_id long, slug string, name string, active boolean")
    statuses = spark.createDataFrame([], "unit_id long, status string, policy string, confidence double, review_status string, source_url string, source_title string, last_checked_at timestamp")
    sources = spark.createDataFrame([], "unit_id long, source_slug string, source_name string, source_type string, source_address string, source_checked_at timestamp")
    listed = views.status_list(units, statuses, sources, spark.createDataFrame([], "unit_id long, climate double"))
    (r,) = listed.collect()
    assert (r.unit_id, r.status, r.policy, r.confidence, r.review_status, r.sources) == (1, "unknown", "unknown", 0.0, "needs_review", [])
    (m,) = views.overview_map(units.select("slug", F.lit("{}").alias("geometry")), listed).collect()
    assert (m.slug, m.last_checked_label, m.map_status, m.source_url) == ("a", "not checked", "unknown", None)
    rules = spark.createDataFrame([], "unit_id long, slug string, title string, status string, policy string, geometry_source_type string, accuracy string, parts array<double>, subfeatures array<struct<indexes:array<int>,part_name:string>>")
    assert [(f.kind, f.feature_slug) for f in views.unit_map(units.select("slug"), listed, rules).collect()] == [("land_unit_boundary", "a")]


def test_one_rule_and_four(spark):
    schema = "unit_id long, rule_id long, title string, duration_type string, policy string, confidence double, evidence_quotes array<string>, source_url string"
    rows = [(1, 1, "Lake", "temporary", "allowed", 0.5, ["q"], "u"), *((2, i, f"T{i}", "permanent", "" if i else "prohibited", None, None, f"u{i}") for i in range(4))]
    a, b = resolve.localized_outcome(spark.createDataFrame(rows, schema)).orderBy("unit_id").collect()
    assert a.summary == "Accepted localized fire-use restriction is active: Lake." and a.evidence_quotes == ["q"]
    assert (b.affected_area, b.policy, b.confidence, b.source_url, b.evidence_quotes) == ("T0, T1, T2,  and 1 more", "prohibited", 0.0, "u0", [])


def test_rejections_keep_reasons(spark):
    claims = spark.createDataFrame([(1, "accepted", ["a"]), (2, "needs_review", None), (3, "accepted", None), (4, "rejected", None)], "claim_id long, review_status string, needs_review_reasons array<string>")
    decisions = spark.createDataFrame([(1, False, "wrong"), (2, False, " "), (4, True, "no")], "claim_id long, accept boolean, reason string")
    got = {r.claim_id: (r.review_status, r.needs_review_reasons, r.changed) for r in resolve.review_claims(claims, decisions).collect()}
    assert got == {1: ("rejected", ["a", "Reviewer rejected: wrong"], True), 2: ("rejected", [], True), 3: ("accepted", [], False), 4: ("accepted", [], True)}


def test_overrides_leave_other_claims_alone(spark):
    schema = "authority string, text string, status string, policy string, fire_danger_rating string, ifpl_level string, effective_start date, effective_end date, order_number string, affected_area string, summary string, evidence_quotes array<string>, confidence double, needs_review_reasons array<string>"
    text = "Fire Danger: LOW\nIFPL: I\nPUR: Seasonal Restrictions"
    row = lambda authority, t: (authority, t, "full", "prohibited", "X", None, None, None, "1", "a", "s", ["q"], None, None)
    got = answers.current_pur(spark.createDataFrame([row("official_usfs", text), row("official_nps", text), row(None, text), row("official_usfs", None)], schema)).collect()
    assert [(r.status, r.order_number, r.confidence) for r in got] == [("advisory", None, 0.9)] + [("full", "1", None)] * 3


def test_steps_are_removed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "shared_dir", lambda _: str(tmp_path))  # so that no other test's steps go
    step = tables.materialise(spark.range(5))
    assert step.count() == 5 and len(list(tmp_path.glob("steps-*/step-*"))) == 1
    tables.remove_steps(spark)
    assert not list(tmp_path.glob("steps-*"))
    tables.remove_steps(spark)


def test_local_session_without_a_folder_gets_one(spark, monkeypatch):
    class Conf:
        def get(self, name, default=None):
            return default if name == "spark.checkpoint.dir" else spark.conf.get(name, default)

    class Session:
        conf, sparkContext = Conf(), spark.sparkContext

    monkeypatch.setattr(tables, "LOCAL", {})
    first = tables.shared_dir(Session)
    assert first == tables.shared_dir(Session) and tables.LOCAL == {spark.sparkContext.applicationId: first}
