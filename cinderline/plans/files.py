"""Driver queries of files: tables are written in a format by tasks, and read back by the library's sources."""

from __future__ import annotations

import io
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderline.plans.catalogue import Tables, query
from cinderline.plans.shapes import corner
from cinderline.sources import pdf, rasters, records, sinks, web_pages
from cinderline.sources.tables import steps_dir


def new_folder(t: Tables) -> str:
    return f"{steps_dir(t.spark)}/files-{uuid.uuid4().hex}"


def write_files(rows: DataFrame, folder: str) -> int:
    """Writes rows (name, content) as files under the folder, each by the task that has it; their number."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, inner = rasters.located(folder)
        where.create_dir(inner, recursive=True)
        for pdf_ in batches:
            for name, content in zip(pdf_["name"], pdf_["content"], strict=True):
                with where.open_output_stream(f"{inner}/{name}") as f:
                    f.write(bytes(content))
            yield pd.DataFrame({"n": [len(pdf_)]})

    return rows.mapInPandas(write, "n long").agg(F.sum("n")).first()[0] or 0


# Rasters

@query("""WITH c AS (SELECT p_partkey // 50 AS r, p_partkey % 50 AS c, p_size AS v FROM part), z AS (SELECT s_suppkey AS zone, s_suppkey % 50 + 0.25 AS cx, s_suppkey * 2 // 5 + 0.25 AS cy FROM supplier)
    SELECT zone, count(*) AS n, round(avg(v), 6) AS mean, CAST(min(v) AS DOUBLE) AS least, CAST(max(v) AS DOUBLE) AS greatest FROM z JOIN c ON abs(c - cx) + abs(r - cy) < 2.7 GROUP BY 1""")
def raster_zones(t: Tables) -> DataFrame:
    """Parts as cells of a raster in blocks of rows, and the mean over diamonds."""
    folder = new_folder(t)
    cells = t.part.select(F.floor(F.col("p_partkey") / 50).alias("row"), (F.col("p_partkey") % 50).alias("col"), F.col("p_size").alias("value"))
    rasters.write_rasters(cells, folder, 50, 16, (0.0, 0.0), (1.0, 1.0)).count()
    read = rasters.read_rasters(t.spark, folder, window=400).select((-F.round("y")).cast("long").alias("row"), "col", "value")
    cx, cy, h = F.col("s_suppkey") % 50 + 0.25, -(F.floor(F.col("s_suppkey") * 2 / 5) + 0.25), 2.7
    diamond = F.array(corner(cx - h, cy), corner(cx, cy - h), corner(cx + h, cy), corner(cx, cy + h))
    zones = t.supplier.select(F.col("s_suppkey").alias("zone"), F.array(diamond).alias("rings"))
    return rasters.zonal(read, zones, "zone", (0.0, 0.0), (1.0, 1.0)).withColumn("mean", F.round("mean", 6))


@query("""SELECT CAST(p_partkey // 50 AS BIGINT) AS row, CAST(p_partkey % 50 AS BIGINT) AS col, CAST(p_size AS DOUBLE) AS value FROM part WHERE p_partkey % 50 BETWEEN 7 AND 31 AND p_partkey // 50 BETWEEN 3 AND 1000000""")
def raster_window(t: Tables) -> DataFrame:
    """The cells of a window, of which no others are read."""
    folder = new_folder(t)
    cells = t.part.select(F.floor(F.col("p_partkey") / 50).alias("row"), (F.col("p_partkey") % 50).alias("col"), F.col("p_size").alias("value"))
    rasters.write_rasters(cells, folder, 50, 16, (0.0, 0.0), (1.0, 1.0)).count()
    return rasters.read_rasters(t.spark, folder, (6.5, -1e6, 31.5, -2.5), 100).select((-F.round("y")).cast("long").alias("row"), "col", "value")


# PDF

def sample_pdf(pages: list[str], packed: bool = True) -> bytes:
    """A file of some pages, a string a line: in the one-byte encoding if that has all characters, else by codes with a map to Unicode."""
    simple = all(ord(c) < 127 or c in "éèêëàâçùûüôöîïñóíáúäß" for p in pages for c in p)
    codes = {c: k + 1 for k, c in enumerate(sorted({c for p in pages for c in p} - {"\n"}))}

    def string(line: str) -> bytes:
        if not simple:
            return b"<" + "".join(f"{codes[c]:04X}" for c in line).encode() + b">"
        raw = line.encode("cp1252")
        for sign in (b"\\", b"(", b")"):
            raw = raw.replace(sign, b"\\" + sign)
        return b"(" + raw.replace(b"\r", b"\\r") + b")"

    def stream(data: bytes, head: bytes = b"") -> bytes:
        data = zlib.compress(data) if packed else data
        return b"<< %s/Length %d%s >>\nstream\n%s\nendstream" % (head, len(data), b" /Filter /FlateDecode" if packed else b"", data)

    chars = "\n".join(f"<{k:04X}> <{c.encode('utf-16-be').hex()}>" for c, k in codes.items())
    cmap = f"1 begincodespacerange\n<0000> <FFFF>\nendcodespacerange\n{len(codes)} beginbfchar\n{chars}\nendbfchar".encode()
    font = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>" if simple else b"<< /Type /Font /Subtype /Type0 /ToUnicode 4 0 R >>"
    kids = b" ".join(b"%d 0 R" % (5 + 2 * k) for k in range(len(pages)))
    parts = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [%s] /Count %d /Resources << /Font << /F1 3 0 R >> >> >>" % (kids, len(pages)), font, stream(cmap)]
    for k, p in enumerate(pages):
        lines = b"".join(b"%s Tj\n0 -12 Td\n" % string(x) for x in p.split("\n"))
        parts += [b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (6 + 2 * k), stream(b"BT\n/F1 12 Tf\n72 720 Td\n" + lines + b"ET")]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (k + 1, x) for k, x in enumerate(parts)) + b"trailer << /Root 1 0 R >>\n%%EOF"


@query(r"""SELECT page_id, CAST(2 AS BIGINT) AS page_count, CASE WHEN page_id % 9 = 0 THEN 'needs_review' ELSE 'ok' END AS status, sha256(CASE WHEN page_id % 9 = 0 THEN '' ELSE t || chr(10) || chr(10) || url END) AS text_sha256
    FROM (SELECT page_id, url, array_to_string(list_filter(list_transform(string_split(html, chr(10)), lambda x: trim(regexp_replace(x, '[ \t\r]+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS t FROM pages)""")
def pdf_texts(t: Tables) -> DataFrame:
    """Pages as PDF files (every ninth without any text), and what is read from them."""
    folder = new_folder(t)

    @F.pandas_udf("binary")
    def made(page: pd.Series, html: pd.Series, url: pd.Series) -> pd.Series:
        return pd.Series([sample_pdf(["", ""] if k % 9 == 0 else [h.replace("\r", " "), u], k % 2 == 0) for k, h, u in zip(page, html, url, strict=True)])

    write_files(t.pages.select(F.concat(F.lit("page-"), "page_id", F.lit(".pdf")).alias("name"), made("page_id", "html", "url").alias("content")), folder)
    read = pdf.read_pdfs(t.spark, folder)
    return read.select(F.regexp_extract("path", r"page-(\d+)\.pdf", 1).cast("long").alias("page_id"), "page_count", F.col("extraction_status").alias("status"), F.sha2("text", 256).alias("text_sha256"))


# Records

@query("SELECT p_partkey, p_name, CAST(p_size AS BIGINT) AS p_size, (SELECT count(*) FROM part) AS row_count, (SELECT count(DISTINCT p_brand) FROM part) AS units, true AS hashed FROM part")
def delimited_files(t: Tables) -> DataFrame:
    """Parts as CSV with a manifest, read back beside what the manifest says."""
    folder = new_folder(t)
    manifest = sinks.write_delimited(t.part.select("p_partkey", F.col("p_name").alias(" p_name "), "p_size", "p_brand"), folder, "p_brand")
    said = manifest.agg(F.max("row_count").alias("row_count"), F.max("units").alias("units"), F.min(F.length("sha256") == 64).alias("hashed"))
    rows = records.read_records(t.spark, f"{folder}/*.csv").select(F.col("p_partkey").cast("long").alias("p_partkey"), "p_name", F.col("p_size").cast("long").alias("p_size"))
    return rows.join(F.broadcast(said))  # one row


def blocks(df: DataFrame, key: str, size: int) -> DataFrame:
    """df in blocks of so many keys, of which each becomes a file."""
    return df.withColumn("_block", F.floor(F.col(key) / size))


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def zip_files(t: Tables) -> DataFrame:
    """Customers in archives of two entries each, of which one holds records."""
    folder = new_folder(t)

    def zipped(pdf_: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("about.md", "none")
            z.writestr("text/places.txt", "﻿" + pdf_[["c_custkey", "c_name", "c_mktsegment"]].to_csv(sep="|", index=False))
        return pd.DataFrame({"name": [f"block-{pdf_['_block'].iloc[0]}.zip"], "content": [out.getvalue()]})

    write_files(blocks(t.customer, "c_custkey", 400).groupBy("_block").applyInPandas(zipped, "name string, content binary"), folder)
    read = records.read_records(t.spark, f"{folder}/*.zip", entry="text/*.txt", columns=["c_custkey", "c_name", "c_mktsegment"])
    return read.select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", "c_mktsegment")


@query("SELECT vec_id, label, round(embedding[1]::DOUBLE, 6) AS x, round(embedding[2]::DOUBLE, 6) AS y FROM embeddings")
def feature_files(t: Tables) -> DataFrame:
    """Spots as feature collections, a file for each block of ids."""
    folder = new_folder(t)
    point = F.struct(F.lit("Point").alias("type"), F.array(F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double")).alias("coordinates"))
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct("vec_id", "label").alias("properties")))
    whole = blocks(t.embeddings.withColumn("_f", feature), "vec_id", 100).groupBy("_block").agg(F.concat(F.lit('{"type": "FeatureCollection", "features": ['), F.array_join(F.collect_list("_f"), ", "), F.lit("]}")).alias("_c"))
    write_files(whole.select(F.concat(F.lit("block-"), "_block", F.lit(".geojson")).alias("name"), F.encode("_c", "UTF-8").alias("content")), folder)
    read = records.read_records(t.spark, f"{folder}/*.geojson")
    of = lambda name, kind: F.try_variant_get("properties", f"$.{name}", kind)
    return read.select(of("vec_id", "long").alias("vec_id"), of("label", "int").alias("label"), F.round("longitude", 6).alias("x"), F.round("latitude", 6).alias("y"))


@query("SELECT s_nationkey AS unit_id, s_suppkey AS source_id, s_name AS name FROM supplier")
def manifest_files(t: Tables) -> DataFrame:
    """A JSON document for each unit, whose member lists its sources."""
    folder = new_folder(t)
    source = F.to_json(F.struct(F.col("s_nationkey").alias("unit_id"), F.col("s_suppkey").alias("source_id"), F.col("s_name").alias("name")))
    whole = t.supplier.groupBy("s_nationkey").agg(F.concat(F.lit('{"version": 1,\n"sources": ['), F.array_join(F.collect_list(source), ",\n"), F.lit("]}")).alias("_c"))
    write_files(whole.select(F.concat(F.lit("unit-"), "s_nationkey", F.lit(".json")).alias("name"), F.encode("_c", "UTF-8").alias("content")), folder)
    read = records.read_manifest(t.spark, f"{folder}/*.json", "sources", ("unit_id", "source_id"))
    return read.select(F.col("unit_id").cast("int").alias("unit_id"), "source_id", "name")


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)")
def looked_up_orders(t: Tables) -> DataFrame:
    """The one order of each large line; none and several would stop the query."""
    wanted = t.lineitem.where("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return records.exactly_one(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus"), ["o_orderkey"], wanted)


# Pages

TEXT_SQL = r"trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace({0}, '<[^>]*>', '', 'g'), '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#x27;', ''''), '&amp;', '&'), '[ \t\r\n\f\v]+', ' ', 'g'))"


@query(f"""WITH p AS (SELECT page_id, url, html, regexp_replace(regexp_replace(html, '(?s)<(script|style)>.*?</(script|style)>', '', 'g'), '(?s)<!--.*?-->', '', 'g') AS h FROM pages),
    l AS (SELECT page_id, url, unnest(regexp_extract_all(h, '<a href="([^"]*)">', 1)) AS href, unnest(regexp_extract_all(h, '(?s)<a href="[^"]*">(.*?)</a>', 1)) AS label FROM p),
    k AS (SELECT page_id, count(*) AS n, string_agg(href, ',' ORDER BY href) AS hrefs FROM l WHERE regexp_matches({TEXT_SQL.format('label')} || ' ' || {TEXT_SQL.format('href')}, '(?i)the|que|der') GROUP BY 1)
    SELECT page_id, {TEXT_SQL.format("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} AS title, sha256({TEXT_SQL.format("regexp_extract(h, '(?s)<body>(.*)', 1)")}) AS body_sha256, coalesce(n, 0) AS links,
    {TEXT_SQL.format("regexp_extract(h, '(?s)<h1>(.*?)</h1>', 1)")} AS heading FROM p LEFT JOIN k USING (page_id)""")
def page_documents(t: Tables) -> DataFrame:
    d = web_pages.page_documents(t.pages, keywords="the|que|der")
    return d.select("page_id", "title", F.sha2("body", 256).alias("body_sha256"), F.size("links").alias("links"), F.coalesce(F.get("headings", F.lit(0)), F.lit("")).alias("heading"))
