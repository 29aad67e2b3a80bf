"""Sinks: GeoJSON features, delimited files with a manifest, sitemap pages. Every task writes its own rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderline.operators.stats import page_assign


def feature_lines(df: DataFrame, geometry: str, *properties: str) -> DataFrame:
    """value: one GeoJSON feature a line, of a geometry column (a struct, or null) and properties; nulls stay as null members."""
    feature = F.struct(F.lit("Feature").alias("type"), F.col(geometry).alias("geometry"), F.struct(*properties).alias("properties"))
    return df.select(F.to_json(feature, {"ignoreNullFields": "false"}).alias("value"))


def write_features(df: DataFrame, path: str, geometry: str, *properties: str) -> None:
    feature_lines(df, geometry, *properties).write.mode("overwrite").text(path)


def write_delimited(df: DataFrame, path: str, unit: str) -> DataFrame:
    """Writes CSV with headers and returns its manifest, from what was written: a row for each file (name, bytes, sha256), with the number of rows and of distinct units in all."""
    spark = df.sparkSession
    df.write.mode("overwrite").option("header", True).csv(path)
    written = spark.read.schema(df.schema).option("header", True).csv(path)
    totals = written.agg(F.count("*").alias("row_count"), F.count_distinct(unit).alias("units")).first()
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.lit(totals["row_count"]).alias("row_count"), F.lit(totals["units"]).alias("units"))


def xml_escape(c: Column) -> Column:
    """The ampersand first, so that no escape is escaped again."""
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


def sitemap_entries(df: DataFrame, url: str, updated: str, size: int = 45_000) -> DataFrame:
    """page, value: a url element for each row, pages of `size` rows in the order of the addresses. A row without an update has no lastmod."""
    day = F.date_format(updated, "yyyy-MM-dd")
    entry = F.concat(F.lit("<url><loc>"), xml_escape(F.col(url)), F.lit("</loc>"), F.coalesce(F.concat(F.lit("<lastmod>"), day, F.lit("</lastmod>")), F.lit("")), F.lit("</url>"))
    return page_assign(df.select(url, updated), url, size).select("page", entry.alias("value"))


def write_sitemap(df: DataFrame, path: str, url: str, updated: str, size: int = 45_000) -> None:
    """A folder for each page."""
    sitemap_entries(df, url, updated, size).write.mode("overwrite").partitionBy("page").text(path)
