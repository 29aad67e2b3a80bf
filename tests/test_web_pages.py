"""Pages against plain re-implementations, over all pages of a table and on small ones."""

import re
from html import unescape

import duckdb
import pytest

from cinderline.sources import documents, web_pages
from tests.conftest import SMALL

TABLE = SMALL.replace("sf0.001", "sf0.01")


@pytest.fixture(scope="module")
def pages():
    return duckdb.sql(f"SELECT page_id, url, html FROM '{TABLE}/pages.parquet' ORDER BY page_id").fetchall()


def shown(html):
    """Without scripts, styles and comments."""
    return re.sub(r"(?s)<!--.*?-->", "", re.sub(r"(?s)<(script|style)>.*?</\1>", "", html))


def words(html):
    return " ".join(unescape(re.sub(r"<[^>]*>", "", html)).split())


def brute_blocks(html):
    """Runs of text between tags that end a block, each with the block tag before it; regular expressions alone."""
    out, tag = [], ""
    parts = re.split(r"(<[^>]*>)", shown(html))
    buffer = ""
    for part in [*parts, "<p>"]:
        name = re.match(r"<(/?)([a-z0-9]+)", part)
        if name is None:
            buffer += "" if part.startswith("<!") else part
        elif name[2] in documents.BLOCKS:
            text = " ".join(unescape(buffer).split())
            if text:
                out.append((tag, text))
            buffer, tag = "", "" if name[1] else name[2]
    return out


def test_extracted_pages(spark, pages):
    """Titles, headings, links, excerpts and visible text of every page of the table."""
    df = spark.read.parquet(f"{TABLE}/pages.parquet")
    got = {r.page_id: r for r in documents.extract_pages(df, "the|que|der").collect()}
    assert len(got) == len(pages) == df.count()
    for page, _, html in pages:
        r, blocks = got[page], brute_blocks(html)
        text = [b for t, b in blocks if t != "title"]
        links = [(unescape(h), words(t)) for h, t in re.findall(r'(?s)<a href="([^"]*)">(.*?)</a>', shown(html))]
        assert r.title == next(b for t, b in blocks if t == "title") and r.body == " ".join(text)
        assert r.headings == [b for t, b in blocks if t in ("h1", "h2", "h3")]
        assert [tuple(x) for x in r.links] == [x for x in links if re.search("(?i)the|que|der", x[1])]
        found = [b[:900] for b in text if len(b) >= 15 and re.search("(?i)the|que|der", b)]
        assert r.excerpts == list(dict.fromkeys(found))[:80]


def test_documents_of_all_pages(spark, pages):
    """Whole texts of elements: those of items, paragraphs that another one ends, the article, and the body."""
    df = spark.read.parquet(f"{TABLE}/pages.parquet")
    got = {r.page_id: r for r in web_pages.page_documents(df, keywords="the|que|der").collect()}
    for page, url, html in pages:
        h, r = shown(html), got[page]
        assert r.body == words(re.search(r"(?s)<body>(.*)", h)[1]) and r.title == words(re.search(r"(?s)<title>(.*?)</title>", h)[1])
        texts = [("li", m.start(), m[1]) for m in re.finditer(r"(?s)<li>(.*?)</li>", h)] + [("p", m.start(), m[1]) for m in re.finditer(r"(?s)<p>(.*?)(?=<p>|</p>|</article>)", h)]
        texts += [(t, m.start(), m[1]) for t in ("div", "article") for m in re.finditer(rf"(?s)<{t}[^>]*>(.*?)(?:</{t}>|$)", h)]
        found = [w[:900] for _, _, x in sorted(texts, key=lambda x: x[1]) if len(w := words(x)) >= 15 and re.search("(?i)the|que|der", w)]
        assert r.excerpts == list(dict.fromkeys(found))[:80]
        assert r.canonical_url == url and r.extracted_text.startswith(f"Title: {r.title}\nCanonical URL: {url}\n") and r.extracted_text.endswith(f"\nBody:\n{r.body}")


ALERTS = """<html><head><title> Forest  page </title><link rel="canonical" href="https://x.org/a/"><meta name="last-modified" content="2024-01-02"></head><body><h1>Home</h1><a href="fire">Fire info</a><a href="/b">other</a><a href="HTTP://y.org/ban">x</a>
<main><h2>Forest Alerts</h2><h3>Filter &amp; Sort Alerts</h3><ul><li class="usa-card big"><h3>Camp&nbsp;fire rules</h3><p>Campfires prohibited<p>until May</li><li class="usa-card"><h4>Prescribed fire</h4>Smoke map here</li></ul>
<h5>Open fires</h5><p>No open fires</p><p>at all</p><h6>Road</h6><script>fire restrictions</script></main><h2>Contact</h2><h3>Fire restrictions office</h3></body></html>"""


def test_alerts(spark):
    rows = spark.createDataFrame([(1, ALERTS, "https://z.org"), (2, None, None), (3, "", "https://z.org"), (4, "<p>one<p>two <b>bold</p> three", None), (4, "<p>one<p>two <b>bold</p> three", None)], "page_id long, html string, url string")
    got = {r.page_id: r for r in web_pages.page_documents(rows).collect()}
    r = got[1]
    assert (r.title, r.canonical_url, r.modified, r.headings[:2]) == ("Forest page", "https://x.org/a/", "2024-01-02", ["Home", "Forest Alerts"])
    assert [tuple(x) for x in r.links] == [("Fire info", "https://x.org/a/fire"), ("x", "HTTP://y.org/ban")]
    assert r.alert_titles == ["Camp fire rules", "Prescribed fire", "Open fires", "Road"]
    assert [tuple(x) for x in r.restriction_alerts] == [("Camp fire rules", "Camp fire rules Camp fire rulesCampfires prohibiteduntil May"), ("Open fires", "Open fires No open fires at all")]
    assert r.body.startswith("Forest Alerts") and "script" not in r.body and "Forest alerts listed: 4" in r.extracted_text
    assert (got[2].title, got[2].body, got[2].links, got[3].canonical_url) == (None, "", [], "https://z.org") and got[4].body == "onetwo bold three"
    none = ALERTS.replace("Campfires prohibited", "closed").replace("Camp&nbsp;fire rules", "Gate").replace("Open fires", "Gate 2").replace("open fires", "cars")
    assert web_pages.NO_ALERTS in web_pages.document(1, none, None, re.compile("fire"))[-1]


def test_references_without_a_semicolon_stay(spark):
    """&amp and &#38 that nothing ends are text, as in the query's SQL; those that are ended are read."""
    html = '<html><head><title>a&&amp</title></head><body><h1>x &lt y &lt; z &#38 &#38;</h1><a href="/fires?a=1&copy=2">fire</a></body></html>'
    got = web_pages.page_documents(spark.createDataFrame([(1, html, "https://x.org/")], "page_id long, html string, url string")).first()
    assert got.title == "a&&amp" and got.headings[0] == "x &lt y < z &#38 &" and got.links[0].href == "https://x.org/fires?a=1&copy=2"
