"""Derived answers about statuses, policies, seasons, tiers and reviews."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from cinderline.functions.rules import FEET_PER_METER, NEAR_MILES, POLICY_SEVERITY, REGIONAL_ACRES, REGIONAL_MILES, SOURCE_PRECEDENCE, lookup


def effective_policy(status: Column, policy: Column) -> Column:
    """A status of none without a stated policy allows fires; otherwise an empty policy is unknown."""
    stated = F.coalesce(F.nullif(policy, F.lit("")), F.lit("unknown"))
    return F.when((status == "none") & (stated == "unknown"), "allowed").otherwise(stated)


def direction(before: Column, after: Column) -> Column:
    """first, tightened or eased; updated where the grade is the same or a policy has none."""
    rank = lambda p: lookup(p, POLICY_SEVERITY, -1)
    return (
        F.when(before.isNull(), "first")
        .when((rank(before) < 0) | (rank(after) < 0), "updated")
        .when(rank(after) > rank(before), "tightened")
        .when(rank(after) < rank(before), "eased")
        .otherwise("updated")
    )


def season_active(start_month: Column, start_day: Column, end_month: Column, end_day: Column, on: Column) -> Column:
    """Whether a day lies in a recurring season, which may cross the year's end. False if a bound is missing or no day of that year."""
    year = F.year(on)

    def real(month: Column, day: Column) -> Column:
        return F.to_date(F.try_to_timestamp(F.format_string("%04d-%02d-%02d", year, month, day), F.lit("yyyy-MM-dd")))

    start, end, now = start_month * 100 + start_day, end_month * 100 + end_day, F.month(on) * 100 + F.dayofmonth(on)
    inside = F.when(start <= end, (now >= start) & (now <= end)).otherwise((now >= start) | (now <= end))
    return F.coalesce(real(start_month, start_day).isNotNull() & real(end_month, end_day).isNotNull() & inside, F.lit(False))


def window_active(start: Column, end: Column, on: Column) -> Column:
    """Whether a day lies in a window with open ends where a bound is null."""
    return (start.isNull() | (on >= start)) & (end.isNull() | (on <= end))


def rule_active(duration: Column, start: Column, end: Column, season: tuple[Column, Column, Column, Column], on: Column) -> Column:
    """Permanent rules always, seasonal ones with all four numbers by their season, all others by their dates."""
    recurring = (duration == "seasonal") & season[0].isNotNull() & season[1].isNotNull() & season[2].isNotNull() & season[3].isNotNull()
    return F.when(duration == "permanent", F.lit(True)).when(recurring, season_active(*season, on)).otherwise(window_active(start, end, on))


def proximity_tier(miles: Column, acres: Column) -> Column:
    return (
        F.when(miles <= 0, "inside")
        .when(miles <= NEAR_MILES, "near")
        .when((miles <= REGIONAL_MILES) & (F.coalesce(acres, F.lit(0.0)) >= REGIONAL_ACRES), "regional")
    )


def keyword_class(text: Column, ladder: tuple[tuple[str, str], ...], default: str = "unknown") -> Column:
    """The label of the first pattern that the lower-case text matches."""
    low = F.lower(F.coalesce(text, F.lit("")))
    first, *rest = ladder
    out = F.when(low.rlike(first[0]), first[1])
    for pattern, label in rest:
        out = out.when(low.rlike(pattern), label)
    return out.otherwise(default)


def first_sentence(text: Column, pattern: str, most: int = 500) -> Column:
    """The first sentence that matches, cut to so many characters; null without one."""
    plain = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.substring(F.get(F.filter(F.split(plain, r"(?<=[.!?])\s+"), lambda s: s.rlike(pattern)), F.lit(0)), 1, most)


def review_decision(status: Column, confidence: Column, official: Column, automatic: Column, hard_reasons: Column, none_evidence: Column) -> Column:
    """auto_accepted by the metadata path or the official path, else needs_review. hard_reasons: whether any reason blocks."""
    active = status.isin("advisory", "closure", "full", "stage_1", "stage_2", "year_round")
    by_metadata = automatic & (confidence >= 0.8)
    by_authority = official & F.when(status == "none", (confidence >= 0.85) & none_evidence).otherwise(active & (confidence >= 0.9))
    return F.when(F.coalesce(~hard_reasons & (by_metadata | by_authority), F.lit(False)), "auto_accepted").otherwise("needs_review")


def poll_minutes(minutes: Column, day: Column, cap: int, first: tuple[int, int] = (6, 1), last: tuple[int, int] = (9, 30)) -> Column:
    """A poll interval, capped in the fire season."""
    md = F.month(day) * 100 + F.dayofmonth(day)
    return F.when(md.between(first[0] * 100 + first[1], last[0] * 100 + last[1]), F.least(minutes, F.lit(cap))).otherwise(minutes)


def band_label(low: Column, width: int, top: int, unit: str = "ft") -> Column:
    """"0-2,000 ft" and so on; from top open-ended."""
    n = lambda c: F.format_number(c, 0)
    return F.when(low >= top, F.concat(n(low), F.lit(f"+ {unit}"))).otherwise(F.concat(n(low), F.lit("-"), n(low + width), F.lit(f" {unit}")))


def fahrenheit(celsius: Column) -> Column:
    return celsius * 9.0 / 5.0 + 32.0


def feet(meters: Column) -> Column:
    return meters * FEET_PER_METER


def significant(url: Column, acres: Column) -> Column:
    """An incident with a page of its own, or a large one."""
    return (F.coalesce(url, F.lit("")) != "") | (F.coalesce(acres, F.lit(0.0)) >= REGIONAL_ACRES)


def in_box(lat: Column, lon: Column, geometry: Column, min_lat: float = 37.0, max_lat: float = 49.1, min_lon: float = -125.1, max_lon: float = -116.0) -> Column:
    """Whether a record lies in the box (fixed values: where the data begin and end); a record at (0, 0) with a geometry has no point of its own and stays."""
    y, x = F.coalesce(lat, F.lit(0.0)), F.coalesce(lon, F.lit(0.0))
    return ((y == 0) & (x == 0) & geometry.isNotNull()) | (y.between(min_lat, max_lat) & x.between(min_lon, max_lon))


def class_allowed(kind: Column, allowed: list[str]) -> Column:
    """An empty list allows all."""
    return F.coalesce(kind, F.lit("")).isin(*allowed) if allowed else F.lit(True)


def custom_order(value: Column, order: list[str]) -> Column:
    """A value's place in a stated order; those not in it come last."""
    return lookup(value, {v: i for i, v in enumerate(order)}, len(order))


def candidate_score(status: Column, errors: Column, source_type: Column, confidence: Column, created_at: Column) -> Column:
    """Sorts candidates for review, the greatest first: status, validity, source, confidence in per cent, time."""
    by_status = F.when(status.isin("closure", "full", "stage_2", "stage_1", "partial", "year_round"), 600).when(status == "none", 500).when(status == "advisory", 350).otherwise(0)
    valid = F.when(F.coalesce(F.size(errors), F.lit(0)) <= 0, 50).otherwise(0)
    return F.struct(by_status.alias("status"), valid.alias("valid"), lookup(source_type, SOURCE_PRECEDENCE, 0).alias("source"), F.round(F.coalesce(confidence, F.lit(0.0)) * 100).cast("int").alias("confidence"), F.coalesce(created_at, F.timestamp_seconds(F.lit(0))).alias("created_at"))


def as_day(value: date | str) -> Column:
    return F.lit(str(value)).cast("date")
