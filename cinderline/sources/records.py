"""Readers of record files, and the declarative mapping from their columns to the engine's."""

from __future__ import annotations

import fnmatch
import io
import json
import re
import zipfile
from collections.abc import Iterator
from itertools import islice
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderline.functions.text import clean, first_present, normalize_name


BLANK = re.compile(r"[ \t\n\r]*")


def clean_headers(df: DataFrame) -> DataFrame:
    """Column names without byte-order marks and blanks around them."""
    return df.toDF(*(c.replace("﻿", "").replace("ï»¿", "").strip() for c in df.columns))


def read_delimited(spark: SparkSession, path: str | list[str], sep: str = ",") -> DataFrame:
    return clean_headers(spark.read.option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"').csv(path))


def read_zip(spark: SparkSession, path: str, entry: str, columns: list[str], sep: str = "|") -> DataFrame:
    """Delimited records of the entries of ZIP files whose names match a glob. Each archive is opened in the task that holds it."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        if fnmatch.fnmatch(name, entry):
                            with z.open(name) as f:
                                for part in pd.read_csv(f, sep=sep, dtype=str, encoding="utf-8-sig", chunksize=10_000, keep_default_na=False):
                                    part.columns = [c.strip() for c in part.columns]
                                    yield part.reindex(columns=columns)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, ", ".join(f"`{c}` string" for c in columns))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """properties (variant), geometry (GeoJSON text), longitude, latitude of each feature of collections of any size.

    A file is read by one task, feature by feature. One that is no JSON, has no features or says that
    it was cut short stops the query; Spark passes over files of no bytes. Collections of many gigabytes belong in lines (read_feature_lines).
    """

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                rows = feature_texts(content.decode("utf-8-sig"))
                while part := list(islice(rows, 1000)):
                    yield pd.DataFrame({"value": part})

    return feature_rows(spark.read.format("binaryFile").load(path).select("content").mapInPandas(texts, "value string"))


def read_feature_lines(spark: SparkSession, path: str) -> DataFrame:
    """As read_features, from files with a feature a line, which are split among tasks."""
    return feature_rows(spark.read.text(path).where("trim(value) <> ''"))


def feature_texts(whole: str) -> Iterator[str]:
    """The source text of each feature of a collection; ValueError if it is not whole JSON, has no array of features, or is incomplete."""
    decoder, at, flagged, found = json.JSONDecoder(), 0, False, False

    def skip(signs: str = "") -> str:
        """Passes white space, and one of the signs, which is returned."""
        nonlocal at
        at = BLANK.match(whole, at).end()
        if signs:
            if whole[at : at + 1] not in tuple(signs):
                raise ValueError(f"not a feature collection: at character {at}")
            at += 1
        return whole[at - 1 : at]

    skip("{")
    while True:
        skip()
        if whole[at : at + 1] == "}":
            break
        key, at = decoder.raw_decode(whole, at)
        skip(":")
        skip()
        if key == "features" and whole[at : at + 1] == "[":
            at, found = at + 1, True
            skip()
            if whole[at : at + 1] == "]":
                at += 1
            else:
                while True:
                    skip()
                    start = at
                    at = decoder.raw_decode(whole, at)[1]
                    yield whole[start:at]
                    if skip(",]") == "]":
                        break
        else:
            value, at = decoder.raw_decode(whole, at)
            flagged |= key == "exceededTransferLimit" and value is True
            flagged |= key == "properties" and isinstance(value, dict) and value.get("exceededTransferLimit") is True
        if skip(",}") == "}":
            break
    if flagged:
        raise ValueError("the export is incomplete")
    if not found:
        raise ValueError("not a feature collection: no features")


def feature_rows(lines: DataFrame) -> DataFrame:
    """lines: value, the text of one feature."""
    one = lines.select(F.parse_json("value").alias("f"))
    point = F.when(F.try_variant_get("f", "$.geometry.type", "string") == "Point", F.try_variant_get("f", "$.geometry.coordinates", "array<double>"))
    return one.select(F.try_variant_get("f", "$.properties", "variant").alias("properties"), F.to_json(F.try_variant_get("f", "$.geometry", "variant")).alias("geometry"), F.get(point, F.lit(0)).alias("longitude"), F.get(point, F.lit(1)).alias("latitude"))


def read_records(spark: SparkSession, path: str, **options: Any) -> DataFrame:
    """By the path's ending: .csv, .psv, .tsv, .geojson or .json, .zip (with entry and columns), .parquet."""
    end = path.rsplit(".", 1)[-1].lower()
    if end in ("csv", "psv", "tsv", "txt"):
        return read_delimited(spark, path, options.get("sep") or {"csv": ",", "psv": "|", "tsv": "\t"}.get(end, "|"))
    if end in ("geojson", "json"):
        return read_features(spark, path)
    if end == "zip":
        return read_zip(spark, path, options["entry"], options["columns"], options.get("sep", "|"))
    if end == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"no reader for {path}")


def mapped(df: DataFrame, mapping: dict[str, dict]) -> DataFrame:
    """A column for each entry: the first of its candidate columns that is not blank (columns that do not exist count as blank), else its default; then its values, a translation that leaves other values or takes its default, and its type."""
    there = set(df.columns)

    def column(name: str, m: dict) -> Column:
        have = [F.col(f"`{c}`") for c in m.get("columns", []) if c in there]
        out = first_present(*have) if have else F.lit(None).cast("string")
        out = F.coalesce(out, F.lit(m.get("default")).cast("string"))
        if "values" in m:
            table = F.create_map(*(F.lit(x) for kv in m["values"].items() for x in kv))
            out = F.coalesce(F.try_element_at(table, out), F.lit(m["other"]) if "other" in m else out)
        return (out.try_cast(m["type"]) if "type" in m else out).alias(name)

    return df.select(*(column(k, m) for k, m in mapping.items()))


def place_names(places: DataFrame, place_id: str, name: str, aliases: str, sep: str = ";") -> DataFrame:
    """A row for each place's name (weight 100) and each alias (weight 60), normalised; repeats of a place's normalised name keep the heaviest."""
    main = F.array(F.struct(clean(F.col(name)).alias("name"), F.lit("primary").alias("kind"), F.lit(100).alias("weight")))
    more = F.transform(F.filter(F.transform(F.split(F.coalesce(aliases, F.lit("")), sep), lambda a: F.trim(a)), lambda a: a != ""), lambda a: F.struct(a.alias("name"), F.lit("alias").alias("kind"), F.lit(60).alias("weight")))
    rows = places.select(place_id, F.explode(F.concat(main, more)).alias("n")).select(place_id, "n.*").withColumn("normalized_name", normalize_name(F.col("name")))
    return rows.groupBy(place_id, "normalized_name").agg(F.max_by(F.struct("name", "kind", "weight"), F.struct("weight", "name")).alias("n")).select(place_id, "normalized_name", "n.*")


def required(df: DataFrame, columns: list[str]) -> DataFrame:
    lost = [c for c in columns if c not in df.columns]
    if lost:
        raise ValueError(f"missing columns: {', '.join(lost)}")
    return df


def page_offsets(total: int, size: int = 250, most: int = 20) -> list[int]:
    """Offsets of a paged download; more pages than allowed is an error, since a part would pass for the whole."""
    pages = -(-total // size)
    if pages > most:
        raise ValueError("too many pages")
    return [size * i for i in range(max(1, pages))]


def read_manifest(spark: SparkSession, path: str, part: str | None = None, required: tuple[str, ...] = ()) -> DataFrame:
    """One row for each JSON document (a file each), or for the object or array of objects in its member `part`. A missing required member stops the query."""
    df = spark.read.option("multiLine", True).json(path)
    if part:
        kind = df.schema[part].dataType
        df = df.select(F.inline(part)) if kind.typeName() == "array" else df.select(f"{part}.*")
    for name in required:
        if name not in df.columns:
            raise ValueError(f"{path} has no {name}")
        df = df.withColumn(name, F.when(F.col(name).isNull(), F.raise_error(F.lit(f"no {name} in the manifest")).cast(df.schema[name].dataType)).otherwise(F.col(name)))
    return df


def with_geometry_files(rules: DataFrame, folder: str) -> DataFrame:
    """rules (geometry_path: below the folder, or null; geometry_json: text or null) with the geometry and the member map_subfeatures (JSON text) of the file that a path names.

    Of a collection the first feature counts; a rule's own geometry goes before its file's. A path without a file stops the query.
    """
    spark = rules.sparkSession
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(folder).select(F.substring_index(F.col("_metadata.file_path"), folder.rstrip("/") + "/", -1).alias("_at"), F.try_parse_json("value").alias("_j"))
    first = F.coalesce(F.try_variant_get("_j", "$.features[0]", "variant"), F.when(F.try_variant_get("_j", "$.type", "string") != "FeatureCollection", F.col("_j")))
    geometry = F.when(F.try_variant_get(first, "$.type", "string") == "Feature", F.try_variant_get(first, "$.geometry", "variant")).otherwise(first)
    files = files.select("_at", F.to_json(geometry).alias("_geometry"), F.to_json(F.try_variant_get(first, "$.properties.map_subfeatures", "variant")).alias("map_subfeatures"))
    named = F.nullif("geometry_path", F.lit(""))
    joined = rules.withColumn("_named", named).join(files, F.col("_at") == F.col("_named"), "left")
    found = F.when(F.col("_named").isNotNull() & F.col("_at").isNull(), F.raise_error(F.concat(F.lit("no file "), F.col("_named")))).otherwise(F.col("_geometry"))
    return joined.withColumn("geometry_json", F.coalesce("geometry_json", found)).drop("_at", "_named", "_geometry")


def exactly_one(df: DataFrame, keys: list[str], wanted: DataFrame) -> DataFrame:
    """df's row for each wanted combination of keys; one that has no row, or several, stops the query."""
    counted = df.join(wanted.select(*keys).distinct(), keys, "left_semi").groupBy(*keys).agg(F.count("*").alias("_n"), F.any_value(F.struct(*(c for c in df.columns if c not in keys))).alias("_row"))
    joined = wanted.select(*keys).distinct().join(counted, keys, "left")
    said = F.concat(F.lit("expected one row, found "), F.coalesce("_n", F.lit(0)).cast("string"), F.lit(" for "), F.concat_ws(", ", *(F.col(k).cast("string") for k in keys)))
    kind = counted.schema["_row"].dataType
    return joined.select(*keys, F.when(F.coalesce("_n", F.lit(0)) == 1, F.col("_row")).otherwise(F.raise_error(said).cast(kind)).alias("_row")).select(*keys, "_row.*")


def typed_import(df: DataFrame, types: dict[str, str], known: DataFrame, key: str) -> DataFrame:
    """df's columns with their types. A column that is missing, a text that is no value of its type, and a key that is not among the known ones stop the query; an empty text is null."""

    def typed(name: str, kind: str) -> Column:
        text = F.nullif(F.trim(F.col(name).cast("string")), F.lit(""))
        value = text.try_cast(kind)
        return F.when(text.isNotNull() & value.isNull(), F.raise_error(F.concat(F.lit(f"no {kind} in {name}: "), text)).cast(kind)).otherwise(value).alias(name)

    rows = required(df, list(types)).select(*(typed(c, k) for c, k in types.items()))
    there = known.select(F.col(key), F.lit(True).alias("_known")).distinct()
    joined = rows.join(there, key, "left")
    checked = F.when(F.col("_known").isNull(), F.raise_error(F.concat(F.lit(f"unknown {key}: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast(rows.schema[key].dataType)).otherwise(F.col(key))
    return joined.withColumn(key, checked).select(*types)


def boundary_features(spark: SparkSession, path: str) -> DataFrame:
    """As read_features, but a file that is missing, or none of whose text is a whole collection, has no features: maps are drawn without it."""

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                try:
                    values = list(feature_texts(content.decode("utf-8-sig")))
                except ValueError:
                    values = []
                yield pd.DataFrame({"value": values}, dtype="object")

    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return feature_rows(spark.createDataFrame([], "value string"))
    return feature_rows(spark.read.format("binaryFile").load(path).select("content").mapInPandas(texts, "value string"))


def read_grid(spark: SparkSession, path: str, width: int, kind: str = "<i4", nodata: float | None = None) -> DataFrame:
    """path, row, col, value of each cell of raw raster files (rows of `width` cells, numpy type `kind`), without cells of no data. A file is read by one task, a row of cells at a time; a part of a row stops the query."""

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for where, content in zip(pdf["path"], pdf["content"], strict=True):
                grid = np.frombuffer(content, dtype=kind)
                if len(grid) % width:
                    raise ValueError(f"{where}: {len(grid)} cells are no rows of {width}")
                for row, values in enumerate(grid.reshape(-1, width)):
                    there = np.ones(width, bool) if nodata is None else values != nodata
                    yield pd.DataFrame({"path": where, "row": row, "col": np.flatnonzero(there), "value": values[there].astype("f8")})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(cells, "path string, row long, col long, value double")
