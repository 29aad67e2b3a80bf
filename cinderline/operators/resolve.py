"""Truth resolution: many claims about a unit become one published answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderline.functions.labels import effective_policy
from cinderline.functions.rules import ACTIVE_ORDERS, POLICY_PRECEDENCE, SOURCE_PRECEDENCE, STATUS_SEVERITY, lookup
from cinderline.operators.history import latest_per_key
from cinderline.operators.localized import rule_order
from cinderline.operators.stats import first_distinct


def eligible(claims: DataFrame) -> DataFrame:
    """Accepted claims about the whole unit."""
    return claims.where(F.col("review_status").isin("accepted", "auto_accepted") & (F.col("scope").isNull() | F.col("scope").isin("forestwide", "mixed")))


def resolve_claims(claims: DataFrame, precedence: Column | None = None, unit: str = "unit_id") -> DataFrame:
    """One row a unit: outcome (published, conflict), status, policy, confidence, claim_id, candidates.

    claims: unit, source, source_type, status, policy, confidence, review_status, scope, created_at,
    claim_id, already limited to current ones. Of each source only the newest eligible claim counts.
    Unknown statuses are set aside, and year-round ones beside an emergency order. The rest conflict
    if they differ in status and either in the effective policy too or all have an unknown one;
    otherwise the most severe is published, then the best source, confidence, newest, largest id. If
    everything is unknown, the best unknown claim is published. Two shuffles in all: one for the
    newest by source, one by unit, both reduced before they move.
    """
    newest = latest_per_key(eligible(claims), [unit, "source"], "created_at", "claim_id")
    severity = lookup(F.col("status"), STATUS_SEVERITY, 0)
    rank = precedence if precedence is not None else lookup(F.col("source_type"), SOURCE_PRECEDENCE, 0)
    rows = newest.withColumns({
        "effective": effective_policy(F.col("status"), F.col("policy")),
        "key": F.struct(severity.alias("severity"), rank.alias("rank"), "confidence", "created_at", "claim_id"),
        "plain": F.struct(rank.alias("rank"), "confidence", "created_at", "claim_id"),
        "answer": F.struct("status", "policy", "confidence", "claim_id"),
    })
    known, order = F.col("status") != "unknown", F.col("status").isin(*ACTIVE_ORDERS)
    base = known & (F.col("status") != "year_round")
    per = lambda cond, suffix: [
        F.collect_set(F.when(cond, F.col("status"))).alias(f"statuses_{suffix}"),
        F.collect_set(F.when(cond, F.col("effective"))).alias(f"policies_{suffix}"),
        F.max_by(F.when(cond, F.col("answer")), F.when(cond, F.col("key"))).alias(f"answer_{suffix}"),
    ]
    # Sets of statuses and policies are bounded by their vocabularies.
    by = rows.groupBy(unit).agg(F.bool_or(order).alias("ordered"), F.count("*").alias("candidates"), F.max_by("answer", "plain").alias("fallback"), *per(known, "all"), *per(base, "base"))
    pick = lambda name: F.when(F.col("ordered"), F.col(f"{name}_base")).otherwise(F.col(f"{name}_all"))
    conflict = (F.size(pick("statuses")) > 1) & ((F.size(pick("policies")) > 1) | (F.get(pick("policies"), F.lit(0)) == "unknown"))
    answer = F.coalesce(pick("answer"), F.col("fallback"))
    return by.select(
        unit,
        F.when(conflict, "conflict").otherwise("published").alias("outcome"),
        F.when(conflict, "unknown").otherwise(answer["status"]).alias("status"),
        F.when(conflict, "unknown").otherwise(effective_policy(answer["status"], answer["policy"])).alias("policy"),
        F.when(conflict, 0.0).otherwise(answer["confidence"]).alias("confidence"),
        F.when(~conflict, answer["claim_id"]).alias("claim_id"),
        "candidates",
    )


def publish(units: DataFrame, resolved: DataFrame, unit: str = "unit_id") -> DataFrame:
    """All units: those without any candidate have outcome unknown."""
    return units.join(resolved, unit, "left").withColumns({
        "outcome": F.coalesce("outcome", F.lit("unknown")), "status": F.coalesce("status", F.lit("unknown")), "policy": F.coalesce("policy", F.lit("unknown")),
        "confidence": F.coalesce("confidence", F.lit(0.0)), "candidates": F.coalesce("candidates", F.lit(0)).cast("long"),
    })


def published_state(resolved: DataFrame, previous: DataFrame, keep: tuple[str, ...], unit: str = "unit_id") -> DataFrame:
    """Resolved rows with the columns `keep`: an unknown or conflicting outcome leaves what was published before in place."""
    old = previous.select(unit, *(F.col(c).alias(f"_{c}") for c in keep))
    held = F.col("outcome").isin("unknown", "conflict")
    return resolved.join(old, unit, "left").withColumns({c: F.when(held, F.coalesce(F.col(f"_{c}"))).otherwise(F.col(c)) for c in keep}).drop(*(f"_{c}" for c in keep))


def localized_outcome(active_rules: DataFrame, unit: str = "unit_id") -> DataFrame:
    """What a unit's active rules say where no claim about the whole does: status partial, the first policy in precedence, and the areas, quotes and confidence of the rules.

    active_rules: unit, rule_id, title, duration_type, policy, confidence, evidence_quotes, source_url; few a unit.
    """
    order = rule_order(F.col("duration_type"), F.col("title"), F.col("rule_id"))
    quotes = F.coalesce("evidence_quotes", F.array().cast("array<string>"))
    by = active_rules.groupBy(unit).agg(
        first_in_precedence(F.col("policy")).alias("policy"), F.coalesce(F.max("confidence"), F.lit(0.0)).alias("confidence"),
        F.array_sort(F.collect_list(F.struct(order.alias("o"), "title", quotes.alias("quotes"), "source_url"))).alias("_rules"),
    )
    titles, n = F.slice(F.transform("_rules", lambda r: r["title"]), 1, 3), F.size("_rules")
    area = F.concat_ws(", ", titles, F.when(n > 3, F.concat(F.lit(" and "), (n - 3).cast("string"), F.lit(" more"))))
    one = F.concat(F.lit("Accepted localized fire-use restriction is active: "), F.get(titles, F.lit(0)), F.lit("."))
    return by.select(
        unit, F.lit("localized").alias("outcome"), F.lit("partial").alias("status"), "policy", "confidence", area.alias("affected_area"),
        F.when(n == 1, one).otherwise(F.concat(F.lit("Accepted localized fire-use restrictions are active, including "), area, F.lit("."))).alias("summary"),
        first_distinct(F.flatten(F.transform("_rules", lambda r: r["quotes"])), 4).alias("evidence_quotes"), F.get("_rules", F.lit(0))["source_url"].alias("source_url"),
    )


def publish_with_rules(published: DataFrame, active_rules: DataFrame, unit: str = "unit_id") -> DataFrame:
    """published, where units without any candidate take the outcome of their active rules, if they have some; columns affected_area, summary, evidence_quotes and source_url are added, null for all others."""
    local = localized_outcome(active_rules, unit).select(unit, F.struct("outcome", "status", "policy", "confidence", "affected_area", "summary", "evidence_quotes", "source_url").alias("_l"))
    joined = published.join(local, unit, "left")
    own = (F.col("outcome") == "unknown") & F.col("_l").isNotNull()
    taken = {c: F.when(own, F.col("_l")[c]).otherwise(F.col(c)) for c in ("outcome", "status", "policy", "confidence")}
    added = {c: F.when(own, F.col("_l")[c]) for c in ("affected_area", "summary", "evidence_quotes", "source_url")}
    return joined.withColumns(taken | added).drop("_l")


def review_claims(claims: DataFrame, decisions: DataFrame) -> DataFrame:
    """The claims after a reviewer's decisions (claim_id once each; accept; reason), and which of them changed.

    Accepted ones are accepted, all others rejected, with the stated reason, unless it is blank, after those they had.
    """
    joined = claims.join(decisions.select("claim_id", F.col("accept").alias("_accept"), F.col("reason").alias("_reason")), "claim_id", "left")
    had = F.coalesce("needs_review_reasons", F.array().cast("array<string>"))
    said = ~F.col("_accept") & (F.trim(F.coalesce("_reason", F.lit(""))) != "")
    return joined.withColumns({
        "changed": F.col("_accept").isNotNull(),
        "review_status": F.when(F.col("_accept"), "accepted").when(~F.col("_accept"), "rejected").otherwise(F.col("review_status")),
        "needs_review_reasons": F.when(said, F.array_append(had, F.concat(F.lit("Reviewer rejected: "), F.col("_reason")))).otherwise(had),
    }).drop("_accept", "_reason")


def resolve_touched(reviewed: DataFrame, precedence: Column | None = None, unit: str = "unit_id") -> DataFrame:
    """The published answers of the units of which a claim changed, each resolved once from all its claims."""
    touched = reviewed.where("changed").select(unit).distinct()
    return publish(touched, resolve_claims(reviewed.join(touched, unit, "left_semi"), precedence, unit), unit)


def first_in_precedence(policy: Column, order: tuple[str, ...] = POLICY_PRECEDENCE, default: str = "unknown") -> Column:
    """Aggregate: the group's policy that stands first in the order; an empty one counts as the default."""
    stated = F.coalesce(F.nullif(policy, F.lit("")), F.lit(default))
    place = lookup(stated, {p: i for i, p in enumerate(order)}, None)
    return F.coalesce(F.min_by(F.when(place.isNotNull(), stated), place), F.lit(default))


def strongest(value: Column, ranks: dict[str, int]) -> Column:
    """Aggregate: the value of the highest rank (0 where it has none), of equal ones the first by name."""
    return F.min_by(value, F.struct(-lookup(value, ranks, 0), value))
