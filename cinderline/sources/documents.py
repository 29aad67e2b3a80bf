"""Documents: pages, alerts and feeds as text and fields."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderline.functions.text import clean, decode_entities, incident_name

SKIPPED = ("script", "style", "noscript", "svg")
#: Tags whose text is a unit of its own.
BLOCKS = frozenset("p div li ul ol h1 h2 h3 h4 h5 h6 td th tr table section article header footer nav main aside br title blockquote pre".split())


class PageText(HTMLParser):
    """A small helper: title, headings, links and visible text blocks of one page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.headings, self.links, self.blocks, self.canonical = "", [], [], [], None
        self.skip, self.inside, self.href, self.buffer, self.link_text = 0, "", None, [], []

    def flush(self) -> None:
        text = " ".join("".join(self.buffer).split())
        if text:
            if self.inside == "title":
                self.title = self.title or text
            else:
                self.blocks.append(text)
                if self.inside in ("h1", "h2", "h3"):
                    self.headings.append(text)
        self.buffer = []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in SKIPPED:
            self.skip += 1
        elif tag in BLOCKS:
            self.flush()
            self.inside = tag
        elif tag == "a":
            self.href, self.link_text = a.get("href"), []
        elif tag == "link" and a.get("rel") == "canonical":
            self.canonical = self.canonical or a.get("href")

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag in BLOCKS:
            self.flush()
            self.inside = ""
        elif tag == "a" and self.href is not None:
            self.links.append((self.href, " ".join("".join(self.link_text).split())))
            self.href = None

    def handle_data(self, data):
        if not self.skip:
            self.buffer.append(data)
            if self.href is not None:
                self.link_text.append(data)


#: Pages whose results are held at a time.
PAGES = 256

PAGE = "page_id long, title string, canonical string, headings array<string>, links array<struct<href:string,text:string>>, excerpts array<string>, body string"
PAGE_NAMES = ["page_id", "title", "canonical", "headings", "links", "excerpts", "body"]
PAGE_TYPES = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.struct([("href", pa.string()), ("text", pa.string())])), pa.list_(pa.string()), pa.string()]


def extract_pages(pages: DataFrame, keywords: str, page_id: str = "page_id", html: str = "html", least: int = 15, most: int = 80, cut: int = 900) -> DataFrame:
    """Title, canonical address, headings, links whose text matches the keywords, matching text blocks (each once, in order) and the visible text. A null page is empty."""
    import re

    wanted = re.compile(keywords, re.I)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A batch's texts stay in Arrow's memory; Python has those of some pages, and what is read from them, at a time.
        for batch in batches:
            for start in range(0, batch.num_rows, PAGES):
                some = batch.slice(start, PAGES)
                rows = []
                for pid, source in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    p = PageText()
                    p.feed(source or "")
                    p.close()
                    p.flush()
                    found = [b[:cut] for b in p.blocks if len(b) >= least and wanted.search(b)]
                    links = [{"href": h, "text": t} for h, t in p.links if wanted.search(t)]
                    rows.append((pid, p.title, p.canonical, p.headings, links, list(dict.fromkeys(found))[:most], " ".join(p.blocks)))
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), PAGE_TYPES, strict=True)], names=PAGE_NAMES)

    return pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(html).alias("html")).mapInArrow(parse, PAGE)


def page_title(html: Column) -> Column:
    """The first title element's text, cleaned, by expressions alone."""
    return clean(decode_entities(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))


ALERTS = "data array<struct<title string, description string, category string, url string, lastIndexedDate string>>"


def parse_alerts(df: DataFrame, body: str, keywords: str) -> DataFrame:
    """From an alert list in JSON: extracted_text (a line for each matching alert), alerts, matching, modified, needs_review (what cannot be parsed)."""
    parsed = F.from_json(body, ALERTS, {"mode": "PERMISSIVE"})
    bad = F.try_parse_json(F.col(body)).isNull() | parsed["data"].isNull()
    hit = F.filter(parsed["data"], lambda a: F.concat_ws(" ", a["title"], a["description"], a["category"]).rlike(f"(?i){keywords}"))
    line = F.transform(hit, lambda a: clean(F.concat_ws(": ", a["category"], a["title"], a["description"])))
    return df.withColumns({
        "extracted_text": F.coalesce(F.array_join(line, "\n"), F.lit("")), "alerts": F.coalesce(F.size(parsed["data"]), F.lit(0)), "matching": F.coalesce(F.size(hit), F.lit(0)),
        "modified": F.array_max(F.transform(parsed["data"], lambda a: F.substring(a["lastIndexedDate"], 1, 10))), "needs_review": F.coalesce(bad, F.lit(True)),
    })


def parse_rss(df: DataFrame, body: str, *keep: str) -> DataFrame:
    """A row for each item of an RSS text: the columns to keep, n (its place, from 0), title, link, description, unit (first word of the title, upper case) and name."""

    def tag(item: Column, name: str) -> Column:
        raw = F.regexp_extract(item, rf"(?is)<{name}[^>]*>(.*?)</{name}>", 1)
        return F.trim(decode_entities(F.regexp_replace(raw, r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", "$1")))

    items = df.select(*keep, F.posexplode(F.regexp_extract_all(F.coalesce(F.col(body), F.lit("")), F.lit(r"(?is)<item\b[^>]*>(.*?)</item>"), F.lit(1))).alias("n", "item"))
    parts = F.split(tag(F.col("item"), "title"), " ", 2)
    return items.select(*keep, "n", tag(F.col("item"), "title").alias("title"), F.regexp_replace(tag(F.col("item"), "link"), "^http://", "https://").alias("link"), tag(F.col("item"), "description").alias("description"), F.upper(F.get(parts, F.lit(0))).alias("unit"), incident_name(F.get(parts, F.lit(1))).alias("name"))


def feed_problem(body: Column) -> Column:
    """Why a feature download cannot be used: not JSON, an error object, no features, cut short; null if it can."""
    v = F.try_parse_json(body)
    return (
        F.when(v.isNull(), "not JSON")
        .when(F.try_variant_get(v, "$.error", "variant").isNotNull(), "error object")
        .when(F.try_variant_get(v, "$.features", "array<variant>").isNull(), "no features")
        .when(F.coalesce(F.try_variant_get(v, "$.exceededTransferLimit", "boolean"), F.lit(False)), "cut short")
    )
