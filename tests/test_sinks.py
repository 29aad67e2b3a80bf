"""Sinks: what is written, read again."""

import hashlib
import json
import pathlib

from pyspark.sql import functions as F

from cinderline.sources import sinks


def test_features(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", ("Point", [1.0, 2.0])), (2, None, None)], "id int, name string, g struct<type:string,coordinates:array<double>>")
    sinks.write_features(rows, str(tmp_path / "f"), "g", "id", "name")
    got = sorted((json.loads(r.value) for r in spark.read.text(str(tmp_path / "f")).collect()), key=lambda x: x["properties"]["id"])
    assert got[0] == {"type": "Feature", "geometry": {"type": "Point", "coordinates": [1.0, 2.0]}, "properties": {"id": 1, "name": "a"}}
    assert got[1] == {"type": "Feature", "geometry": None, "properties": {"id": 2, "name": None}}


def test_manifest(spark, tmp_path):
    rows = spark.range(100).select(F.col("id"), (F.col("id") % 7).alias("unit"), F.lit('a "b", c').alias("s")).repartition(3)
    manifest = sinks.write_delimited(rows, str(tmp_path / "c"), "unit").collect()
    assert {(r.row_count, r.units) for r in manifest} == {(100, 7)}
    for r in manifest:
        raw = pathlib.Path(tmp_path / "c" / r.file).read_bytes()
        assert len(raw) == r.bytes and hashlib.sha256(raw).hexdigest() == r.sha256


def test_sitemap(spark, tmp_path):
    rows = spark.createDataFrame([(f"https://x.org/{i:02d}?a&b", "2024-01-02" if i else None) for i in range(23)], "url string, at string").withColumn("at", F.to_timestamp("at"))
    sinks.write_sitemap(rows, str(tmp_path / "s"), "url", "at", 10)
    got = spark.read.text(str(tmp_path / "s")).groupBy("page").count().collect()
    assert sorted((r.page, r["count"]) for r in got) == [(1, 10), (2, 10), (3, 3)]
    lines = {r.value for r in spark.read.text(str(tmp_path / "s")).collect()}
    assert "<url><loc>https://x.org/00?a&amp;b</loc></url>" in lines and "<url><loc>https://x.org/01?a&amp;b</loc><lastmod>2024-01-02</lastmod></url>" in lines
