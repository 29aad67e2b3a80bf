"""How answers are worded: labels of policies, stoves, durations, dates, transitions, and subtitles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cinderline.functions.labels import effective_policy
from cinderline.functions.rules import STATE_BY_MARKET, STATE_BY_UNIT, STATE_NAMES, lookup
from cinderline.functions.text import lenient_date

DAY = "MMM d, yyyy"


def stated(value: Column, default: str = "unknown") -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def capitals(value: Column) -> Column:
    """Underscores as blanks, runs of blanks as one, each word with a capital."""
    return F.initcap(F.trim(F.regexp_replace(F.translate(value, "_", " "), r"\s+", " ")))


def policy_label(policy: Column) -> Column:
    return F.when(policy == "fire_pan_required", "Fire pan required").otherwise(capitals(stated(policy)))


def stove_label(policy: Column, shutoff: Column) -> Column:
    """shutoff: whether a valve is required, which is added unless the label says so."""
    named = {"allowed_with_shutoff_valve": "Allowed with shutoff valve", "developed_sites_only": "Developed sites only", "fire_pan_required": "Fire pan required"}
    label = F.coalesce(lookup(policy, named, None), capitals(stated(policy)))
    return F.when(F.coalesce(shutoff, F.lit(False)) & ~F.lower(label).contains("shutoff"), F.concat(label, F.lit("; shutoff valve required"))).otherwise(label)


def day_label(day: Column) -> Column:
    return F.date_format(lenient_date(day.cast("string")), DAY)


def date_range_label(start: Column, end: Column) -> Column:
    """Of days as dates or text; what is no day counts as missing."""
    a, b = day_label(start), day_label(end)
    return F.coalesce(F.concat(a, F.lit(" to "), b), F.concat(F.lit("Since "), a), F.concat(F.lit("Through "), b), F.lit("Current"))


def duration_label(duration: Column, start: Column, end: Column, season_start: Column, season_end: Column) -> Column:
    season = F.concat_ws(" to ", season_start, season_end)
    return (
        F.when(duration == "permanent", "Permanent").when(duration == "incident", "Incident")
        .when(duration == "seasonal", F.trim(F.concat(F.lit("Seasonal "), season))).otherwise(date_range_label(start, end))
    )


def change_label(policy: Column) -> Column:
    """A policy as the change log words it."""
    named = {"prohibited": "No campfires", "developed_sites_only": "Developed sites only", "allowed": "Campfires allowed", "unknown": "Unknown"}
    return F.coalesce(lookup(stated(policy), named, None), policy_label(policy))


def transition_labels(from_status: Column, from_policy: Column, to_status: Column, to_policy: Column) -> tuple[Column, Column]:
    """Before and after: the policies, or the statuses where the effective policy did not change. The first change has no before."""
    before, after = effective_policy(from_status, from_policy), effective_policy(to_status, to_policy)
    same = from_status.isNotNull() & (before == after)
    first = F.when(same, capitals(stated(from_status))).when(from_status.isNotNull(), change_label(before))
    return first, F.when(same, capitals(stated(to_status))).otherwise(change_label(after))


def checked_label(checked_at: Column) -> Column:
    """checked_at: a timestamp."""
    return F.coalesce(F.date_format(checked_at, DAY), F.lit("not checked"))


def state_code(slug: Column, market: Column) -> Column:
    return F.coalesce(lookup(slug, STATE_BY_UNIT, None), lookup(market, STATE_BY_MARKET, None), F.lit("other"))


def state_of_market(market: Column) -> Column:
    """The state that a market's name contains; null without one."""
    return F.when(market.contains("california") | market.contains("tahoe"), "ca").when(market.contains("washington"), "wa").when(market.contains("oregon"), "or")


def approximate(source_type: Column, accuracy: Column) -> Column:
    return F.coalesce(accuracy == "approximate", F.lit(False)) | F.coalesce(F.startswith(source_type, F.lit("derived_")), F.lit(False))


def subtitle(kind: Column, unit: Column, forest: Column, state: Column, county: Column, quad: Column) -> Column:
    """The kind, the unit or else the forest's name, state, county and quad, as far as there are any, joined by strokes."""
    where = F.when(state != "other", lookup(state, STATE_NAMES, None))
    named = F.when(F.nullif(county, F.lit("")).isNotNull(), F.when(county.endswith(" County"), county).otherwise(F.concat(county, F.lit(" County"))))
    return F.concat_ws(" / ", capitals(kind), F.coalesce(unit, forest), where, named, F.concat(F.nullif(quad, F.lit("")), F.lit(" quad")))
