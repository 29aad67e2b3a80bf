"""Text functions: names, slugs, cleaning, containment, lenient numbers and dates, fingerprints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cinderline.functions.rules import NAME_TOKENS, SLUG_STOPS


def words(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def normalize_name(name: Column) -> Column:
    """Lower case, "&" as a word, no apostrophes, everything else but a-z and 0-9 as blanks, abbreviations written out. A null is empty."""
    base = F.regexp_replace(F.regexp_replace(F.replace(F.lower(F.coalesce(name, F.lit(""))), F.lit("&"), F.lit(" and ")), "['`]", ""), "[^a-z0-9]+", " ")
    table = F.create_map(*(F.lit(x) for kv in NAME_TOKENS.items() for x in kv))
    return F.array_join(F.transform(words(base), lambda w: F.coalesce(F.try_element_at(table, w), w)), " ")


def slugify(name: Column) -> Column:
    return F.array_join(words(F.regexp_replace(normalize_name(name), SLUG_STOPS, "")), "-")


def place_slug(dataset: Column, name: Column, external_id: Column, lat: Column, lon: Column) -> Column:
    """dataset-name-suffix; without an external id the suffix is a hash of the record. lat, lon: as text."""
    digest = F.substring(F.sha1(F.concat_ws(":", dataset, name, F.coalesce(lat, F.lit("")), F.coalesce(lon, F.lit("")))), 1, 8)
    suffix = F.coalesce(F.nullif(F.trim(external_id), F.lit("")), digest)
    return F.regexp_replace(F.concat_ws("-", dataset, slugify(name), slugify(suffix)), "-+", "-")


def canonical_json(text: Column) -> Column:
    """The same JSON with the keys of all objects sorted and no blanks; null for what is no JSON."""
    return F.to_json(F.try_parse_json(text))


def short_slug(text: Column, most: int = 72) -> Column:
    """Lower case, runs of other characters as "-", none at the ends, at most so many characters."""
    body = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.regexp_replace(F.substring(body, 1, most), "-+$", "")


def snake(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def clean(text: Column) -> Column:
    """No-break spaces and runs of white space as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(F.translate(text, " ", " "), r"\s+", " "))


def evidence_text(text: Column) -> Column:
    """As clean, over all of Unicode's spaces."""
    return F.trim(F.regexp_replace(F.translate(text, "  ", "  "), r"(?U)\s+", " "))


def contains_evidence(haystack: Column, needle: Column) -> Column:
    return evidence_text(haystack).contains(evidence_text(needle))


def labelize(text: Column) -> Column:
    return F.initcap(F.replace(text, F.lit("_"), F.lit(" ")))


def decode_entities(text: Column) -> Column:
    """The five named entities and two numeric quotes, the ampersand last so that nothing is decoded twice."""
    pairs = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&amp;", "&"))
    return reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), F.lit(kv[1])), pairs, text)


def escape_markup(text: Column) -> Column:
    pairs = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))
    return reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), F.lit(kv[1])), pairs, text)


def incident_id(value: Column) -> Column:
    """Without braces, trimmed, upper case; empty is null."""
    return F.nullif(F.upper(F.trim(F.regexp_replace(value, "[{}]", ""))), F.lit(""))


def incident_name(value: Column) -> Column:
    """Lower case without a trailing "fire"."""
    return F.trim(F.regexp_replace(F.lower(F.trim(value)), r"\s*fire$", ""))


def lenient_number(value: Column) -> Column:
    return F.trim(value.cast("string")).try_cast("double")


def lenient_date(value: Column, formats: tuple[str, ...] = ("yyyy-MM-dd", "MM/dd/yyyy", "MMMM d, yyyy", "MMM d, yyyy")) -> Column:
    return F.coalesce(*(F.to_date(F.try_to_timestamp(value, F.lit(f))) for f in formats))


def fingerprint(*fields: Column) -> Column:
    """SHA-256 over the fields that are not null, one a line."""
    return F.sha2(F.array_join(F.array_compact(F.array(*(f.cast("string") for f in fields))), "\n"), 256)


def phrases(query: str) -> list[str]:
    """A normalised query and its runs of three and two words, each once."""
    tokens = query.split()
    runs = [" ".join(tokens[i : i + n]) for n in range(min(len(tokens), 3), 1, -1) for i in range(len(tokens) - n + 1)]
    return list(dict.fromkeys([query, *runs]))


def first_present(*columns: Column) -> Column:
    """The first that is neither null nor blank."""
    return F.coalesce(*(F.when(F.trim(c.cast("string")) != "", c) for c in columns))


def month_day_label(month: Column, day: Column) -> Column:
    return F.when(month.isNotNull() & day.isNotNull(), F.format_string("%02d-%02d", month, day))


def json_in_text(text: Column) -> Column:
    """From the first opening to the last closing brace; {} without them."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(found != "", found).otherwise("{}")
