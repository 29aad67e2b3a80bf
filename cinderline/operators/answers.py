"""Validation, escalation and the answers that are shown: verdicts, contexts, groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderline.functions.rules import lookup
from cinderline.functions.text import contains_evidence

#: Statuses that need evidence of a restriction, the evidence, and evidence of none.
RESTRICTIVE = ("advisory", "partial", "stage_1", "stage_2", "full", "closure", "year_round")
RESTRICTIVE_EVIDENCE = r"(?iu)prohibit|restriction|ban|not allowed|not permitted|no campfires?|closed|closure|stage\s*(1|2|i|ii)|forest order|public[- ]use"
NONE_EVIDENCE = r"(?iu)no (?:current |active )?(?:public[- ]use |fire public use |fire |campfire )?restrictions(?: \(?PURS\)?)?(?: are)?(?: currently)?(?: in effect| in place)?|(?:fire ban|fire restrictions?) (?:is|are) not in effect|no active forest fire restriction alerts were listed|restrictions?.{0,80}(lifted|rescinded|ended)|lifted.{0,80}restrictions?|rescinded|campfires? are allowed"
#: Kinds of source whose text is a table, and those that only give context.
TABULAR, CONTEXT = ("arcgis_feature_layer",), ("inciweb_feed", "nifc_feature_layer")
#: Priorities of policies in combined answers; 0 for all others.
POLICY_PRIORITY = {"prohibited": 5, "developed_sites_only": 4, "fire_pan_required": 3, "allowed_with_shutoff_valve": 2, "allowed": 1, "unknown": 0}


def validation_errors(status: Column, policy: Column, quotes: Column, text: Column, source_type: Column, end: Column, today: Column) -> Column:
    """Array of error codes of a parsed claim, empty if it is valid.

    quote: a quote that is not in the text, unless it is only supporting and another one carries the
    status. restrictive, none: no evidence for the status in the quotes that carry it together with
    the text, else in all quotes, without quotes in the text. past: the restriction has ended.
    context: a source that may not set a policy has set one.
    """
    said = F.filter(F.coalesce(quotes, F.array().cast("array<string>")), lambda q: q.isNotNull())
    whole, tabular = F.coalesce(text, F.lit("")), source_type.isin(*TABULAR)
    restrictive = status.isin(*RESTRICTIVE)

    def carries(q: Column) -> Column:
        return F.when(status == "none", q.rlike(NONE_EVIDENCE)).otherwise(restrictive & q.rlike(RESTRICTIVE_EVIDENCE))

    carrying = F.filter(said, carries)
    lost = F.exists(said, lambda q: (F.trim(q) != "") & ~contains_evidence(whole, q) & (carries(q) | (F.size(carrying) == 0)))
    evidence = F.when(F.size(carrying) > 0, F.concat(F.array_join(carrying, "\n"), F.lit("\n"), whole)).when(F.size(said) == 0, whole).otherwise(F.array_join(said, "\n"))
    checks = (
        ("quote", ~tabular & lost),
        ("restrictive", ~tabular & restrictive & ~evidence.rlike(RESTRICTIVE_EVIDENCE)),
        ("past", ~tabular & restrictive & (end < today)),
        ("none", ~tabular & (status == "none") & ~evidence.rlike(NONE_EVIDENCE)),
        ("context", source_type.isin(*CONTEXT) & (F.coalesce(policy, F.lit("")) != "unknown")),
    )
    return F.array_compact(F.array(*(F.when(F.coalesce(cond, F.lit(False)), code) for code, cond in checks)))


def should_escalate(source_type: Column, confidence: Column, valid: Column, status: Column, text: Column, conflicts: Column, failed: Column) -> Column:
    ambiguous = (status == "unknown") & text.rlike(r"(?i)restriction|campfire|public use|forest order|prohibit")
    overlapping = F.regexp_count(text, F.lit(r"(?i)forest order|order number|order no\.?|order #")) > 1
    needed = (F.coalesce(confidence, F.lit(0.0)) < 0.7) | ~valid | ambiguous | overlapping | conflicts
    return F.coalesce(~source_type.isin(*TABULAR) & ~failed & needed, F.lit(False))


def claim_scope(rules: Column, danger: Column, level: Column, order: Column, area: Column, status: Column, policy: Column) -> Column:
    """forestwide without local rules; with them mixed if anything else speaks of the whole, else localized."""
    said = lambda c: F.coalesce(c, F.lit("")) != ""
    only_local = (status == "partial") & (policy == "unknown")
    whole = said(danger) | said(level) | said(order) | (said(area) & ~only_local) | ~status.isin("unknown", "partial")
    return F.when(rules == 0, "forestwide").when(F.coalesce(whole, F.lit(True)), "mixed").otherwise("localized")


def status_group(review: Column, status: Column) -> Column:
    """none, active or unknown: only reviewed claims count, and an unknown status is none of them."""
    known = F.coalesce(review.isin("accepted", "auto_accepted"), F.lit(False))
    return F.when(known & (status == "none"), "none").when(known & (F.coalesce(status, F.lit("")) != "unknown"), "active").otherwise("unknown")


def strongest_of(*policies: Column) -> Column:
    """The policy of the highest priority among a row's, the first of equals."""
    stated = [F.coalesce(F.nullif(p, F.lit("")), F.lit("unknown")) for p in policies]
    return reduce(lambda a, b: F.when(lookup(b, POLICY_PRIORITY, 0) > lookup(a, POLICY_PRIORITY, 0), b).otherwise(a), stated)


def strongest_in_group(policy: Column) -> Column:
    """Aggregate over a group's policies; among equals the first by name."""
    stated = F.coalesce(F.nullif(policy, F.lit("")), F.lit("unknown"))
    return F.coalesce(F.min_by(stated, F.struct(-lookup(stated, POLICY_PRIORITY, 0), stated)), F.lit("unknown"))


def verdict(forests: Column, rules: Column, policy: Column) -> Column:
    """outside, local_ban, area_ban, limited, clear or unsure."""
    return (
        F.when(forests == 0, "outside").when((rules > 0) & (policy == "prohibited"), "local_ban").when(policy == "prohibited", "area_ban")
        .when(policy.isin("developed_sites_only", "fire_pan_required", "allowed_with_shutoff_valve"), "limited").when(policy == "allowed", "clear").otherwise("unsure")
    )


def trip_checks(places: DataFrame, forests: DataFrame, rules: DataFrame) -> DataFrame:
    """place_id, policy, verdict, confidence. places: place_id, confidence; forests and rules: place_id, policy, confidence, a row for each match.

    Each side is reduced to one row a place before the join, so matches never multiply.
    """
    reduced = lambda df, p: df.groupBy("place_id").agg(strongest_in_group(F.col("policy")).alias(f"{p}_policy"), F.count("*").alias(f"{p}_n"), F.min("confidence").alias(f"{p}_confidence"))
    joined = places.join(reduced(forests, "f"), "place_id", "left").join(reduced(rules, "r"), "place_id", "left")
    policy = strongest_of(F.col("f_policy"), F.col("r_policy"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    return joined.select("place_id", policy.alias("policy"), verdict(n("f_n"), n("r_n"), policy).alias("verdict"), F.least("confidence", "f_confidence", "r_confidence").alias("confidence"))


def gated_context(rollup: DataFrame, syncs: DataFrame, as_of: Column, hours: float = 6.0) -> DataFrame:
    """rollup with status stale and no incidents unless the last successful sync is recent. syncs: finished_at, success; one number is taken from them."""
    last = syncs.where("success").agg(F.max("finished_at").alias("_last"))
    fresh = F.coalesce(F.unix_timestamp("_last") >= F.unix_timestamp(as_of) - int(hours * 3600), F.lit(False))
    joined = rollup.crossJoin(F.broadcast(last))  # one row
    return joined.withColumns({"status": F.when(fresh, F.col("tier")).otherwise("stale"), "n": F.when(fresh, F.col("n")).otherwise(0)}).drop("_last", "tier")


#: Codes of a layer of stages.
STAGE_CODES = {"0": ("none", "allowed"), "1": ("stage_1", "developed_sites_only"), "2": ("stage_2", "prohibited")}


def stage_code(*fields: Column) -> tuple[Column, Column, Column]:
    """status, policy and confidence from the first field that is set."""
    code = F.coalesce(*(f.cast("string") for f in fields))
    status = lookup(code, {k: v[0] for k, v in STAGE_CODES.items()}, "unknown")
    return status, lookup(code, {k: v[1] for k, v in STAGE_CODES.items()}, "unknown"), F.when(status == "unknown", 0.35).otherwise(0.95)


#: What an official page shows, in a pattern each; the summary and quotes that stand for it; reasons for review that are settled by it.
PUR_SHOWN = (r"(?i)PUR:\s*Seasonal Restrictions", r"(?i)Fire Danger:\s*(?:LOW|MODERATE)", r"(?i)IFPL:\s*I")
PUR_MODERATE = r"(?i)Fire Danger:\s*MODERATE"
PUR_SUMMARY = ("Current public-use restrictions are in Seasonal Restrictions/Phase A with ", " fire danger and IFPL I.")
PUR_QUOTES = ("Fire Danger: ", "IFPL: I", "PUR: Seasonal Restrictions")
PUR_SETTLED = r"(?i)Seasonal Restrictions|Phase A|campfire policy|effective dates|template|informational page"
PAGE_SETTLED = r"(?i)LLM parsing is disabled or unavailable|campfire policy|effective dates|permanent|backcountry"


def current_pur(claims: DataFrame) -> DataFrame:
    """Claims of an official forest page whose text shows seasonal public-use restrictions with low or moderate danger and level I: advisory, with fires allowed.

    claims: authority, text, status, policy, fire_danger_rating, ifpl_level, effective_start, effective_end, order_number,
    affected_area, summary, evidence_quotes, confidence, needs_review_reasons.
    """
    text = F.coalesce("text", F.lit(""))
    shown = reduce(lambda c, p: c & text.rlike(p), PUR_SHOWN, F.col("authority") == "official_usfs")
    danger = F.when(text.rlike(PUR_MODERATE), "MODERATE").otherwise("LOW")
    summary = F.concat(F.lit(PUR_SUMMARY[0]), danger, F.lit(PUR_SUMMARY[1]))
    quotes = F.array(F.concat(F.lit(PUR_QUOTES[0]), danger), *map(F.lit, PUR_QUOTES[1:]))
    values = {"status": F.lit("advisory"), "policy": F.lit("allowed"), "fire_danger_rating": danger, "ifpl_level": F.lit("I"), "summary": summary, "evidence_quotes": quotes}
    return overridden(claims, shown, values, 0.9, PUR_SETTLED)


def page_overrides(claims: DataFrame, pages: DataFrame) -> DataFrame:
    """Claims of an official park page whose text matches the pattern stated for its source: status, policy, area, summary and quote of the page's row.

    claims as for current_pur, with source_type and source_slug. pages: source_slug (once), pattern
    (a regular expression), page_status, page_policy, page_area, page_summary, page_quote; curated by
    hand, so it is small; Spark broadcasts it if its size allows.
    """
    joined = claims.join(pages, "source_slug", "left")
    shown = (F.col("authority") == "official_nps") & (F.col("source_type") == "nps_fire_page") & F.regexp_like(F.coalesce("text", F.lit("")), F.col("pattern"))
    values = {"status": F.col("page_status"), "policy": F.col("page_policy"), "affected_area": F.col("page_area"), "summary": F.col("page_summary"), "evidence_quotes": F.array("page_quote")}
    return overridden(joined, shown, values, 0.95, PAGE_SETTLED).select(*claims.columns)


def overridden(claims: DataFrame, shown: Column, values: dict[str, Column], least: float, settled: str) -> DataFrame:
    """Where `shown`, the values instead of the claim's, nothing in the other details, at least this confidence, and no reason for review that the override settles."""
    shown = F.coalesce(shown, F.lit(False))
    details = {c: F.lit(None) for c in ("fire_danger_rating", "ifpl_level", "effective_start", "effective_end", "order_number", "affected_area")}
    reasons = F.coalesce("needs_review_reasons", F.array().cast("array<string>"))
    fixed = details | values | {"confidence": F.greatest(F.coalesce("confidence", F.lit(0.0)), F.lit(least)), "needs_review_reasons": F.filter(reasons, lambda r: ~F.coalesce(r.rlike(settled), F.lit(False)))}
    return claims.withColumn("_shown", shown).withColumns({c: F.when(F.col("_shown"), v).otherwise(F.col(c)) for c, v in fixed.items()}).drop("_shown")
