"""Rules on source maps and on findings that are to be published."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mentions import filled

# What fields of a source map may hold.
TIERS = ["official", "official-mirror", "high-confidence-third-party"]
OFFICIAL = ["official", "official-mirror"]
MISMATCHES = ["wrong_plan", "stale_period", "non_official_only"]
STATES = ["available_official", "available_non_official_only", "not_found"]
PAGINATION = ["single_page", "next_link", "query_param", "path_segment"]
HINTS = {"doc_type": ["annual_report", "investment_report"], "pagination": ["single_page", "next_link", "page_param"]}
ENTRY_OVERRIDES = ["requires_js", "force_render_wait_ms", "pagination_mode", "notes"]
SYSTEM_OVERRIDES = ["requires_javascript", "pagination_mode", "document_format_hint", "request_timeout_seconds", "rate_limit_per_minute", "force_canonical_host"]
FORMATS = ["html", "pdf", "mixed"]
SEVERITIES = ["info", "warning", "blocker"]
ACTIONS = ["compare", "explain"]

PREFIX = "override_"


def listed(c: Column) -> Column:
    """The parts of a list between semicolons, trimmed, without blank ones."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), filled), lambda x: x.isNotNull())


def entries(cells: DataFrame) -> DataFrame:
    """Source-map entries from text cells: lists between semicolons, limits that aren't whole numbers as -1, ``override_`` columns as a map of those that are filled."""
    columns = [c for c in cells.columns if c.startswith(PREFIX)]
    pairs = F.array_compact(F.array(*[F.when(filled(F.col(c)).isNotNull(), F.struct(F.lit(c.removeprefix(PREFIX)).alias("key"), filled(F.col(c)).alias("value"))) for c in columns])) if columns else F.array().cast("array<struct<key:string,value:string>>")
    whole = lambda c: F.coalesce(F.trim(F.col(c)).try_cast("int"), F.lit(-1)).alias(c)
    return cells.select(
        "plan_id", F.trim("seed_url").alias("seed_url"), *[listed(F.col(c)).alias(c) for c in ("allowed_domains", "doc_type_hints", "pagination_hints")], whole("max_pages"), whole("max_depth"),
        *[filled(F.col(c)).alias(c) for c in ("source_authority_tier", "mismatch_reason")], F.map_from_entries(pairs).alias("overrides"),
    )


def broken(rows: DataFrame, key: list[str], rules: dict[str, Column | list[Column]]) -> DataFrame:
    """One row for every rule that a row breaks, one for each way where a rule lists several; unknown is not broken."""
    each = [(code, bad) for code, ways in rules.items() for bad in (ways if isinstance(ways, list) else [ways])]
    return rows.select(*key, F.explode(F.array_compact(F.array(*[F.when(bad, F.lit(code)) for code, bad in each]))).alias("code"))


def entry_findings(rows: DataFrame) -> DataFrame:
    """Broken rules of entries: plan_id, seed_url, code."""
    domains, hints, pages, o = F.col("allowed_domains"), F.col("doc_type_hints"), F.col("pagination_hints"), F.col("overrides")
    tier = F.col("source_authority_tier")
    outside = lambda c, values: F.exists(c, lambda x: ~x.isin(values))
    annual = F.array_contains(hints, "annual_report")
    mode, js, wait = (o[k] for k in ("pagination_mode", "requires_js", "force_render_wait_ms"))
    return broken(rows, ["plan_id", "seed_url"], {
        "invalid_url": ~F.coalesce(F.col("seed_url").rlike(r"(?i)^https?://[^/?#]"), F.lit(False)),
        "missing_allowed_domains": F.size(domains) == 0,
        "invalid_allowed_domain": F.exists(domains, lambda x: ~F.contains(x, F.lit(".")) | x.rlike(r"\s")),
        "missing_authority_tier": annual & tier.isNull(),
        "invalid_authority_tier": ~tier.isin(TIERS),
        "invalid_doc_type_hint": outside(hints, HINTS["doc_type"]),
        "invalid_pagination_hint": outside(pages, HINTS["pagination"]),
        "invalid_mismatch_reason": ~F.col("mismatch_reason").isin(MISMATCHES),
        "invalid_crawl_constraints": (F.col("max_pages") < 1) | (F.col("max_depth") < 0),
        "invalid_override_key": outside(F.map_keys(o), ENTRY_OVERRIDES),
        "invalid_override_value": [~mode.isin(PAGINATION), ~js.isin("true", "false"), wait.isNotNull() & (F.coalesce(wait.try_cast("int"), F.lit(-1)) <= 0)],
    })


def record_findings(records: DataFrame) -> DataFrame:
    """Broken rules between fields of records (plan_id, plan_period): tier, state, reason, identities and overrides, a map of texts."""
    tier, state, why, o = F.col("source_authority_tier"), F.col("official_resolution_state"), F.coalesce("mismatch_reason", F.lit("")), F.col("system_overrides")
    seen, wanted = F.col("observed_plan_identity"), F.col("expected_plan_identity")
    no = lambda c: ~F.coalesce(c, F.lit(False))
    positive = lambda k: o[k].isNotNull() & (F.coalesce(o[k].try_cast("int"), F.lit(0)) <= 0)
    return broken(records, ["plan_id", "plan_period"], {
        "invalid_tier": no(tier.isin(TIERS)),
        "invalid_state": no(state.isin(STATES)),
        "invalid_reason": (why != "") & ~why.isin(MISMATCHES),
        "official_needs_official_tier": (state == "available_official") & no(tier.isin(OFFICIAL)),
        "non_official_with_official_tier": (state == "available_non_official_only") & tier.isin(OFFICIAL),
        "wrong_plan_without_identity": (why == "wrong_plan") & seen.isNull(),
        "wrong_plan_with_same_identity": (why == "wrong_plan") & (seen == wanted),
        "identity_without_wrong_plan": (why != "wrong_plan") & seen.isNotNull(),
        "non_official_needs_reason": (state == "available_non_official_only") & (why != "non_official_only"),
        "mismatch_needs_official": why.isin("wrong_plan", "stale_period") & no(state == "available_official"),
        "reason_needs_non_official": (why == "non_official_only") & no(state == "available_non_official_only"),
        "unknown_override": F.exists(F.map_keys(o), lambda k: ~k.isin(SYSTEM_OVERRIDES)),
        "invalid_pagination_mode": ~o["pagination_mode"].isin(PAGINATION),
        "invalid_document_format": ~o["document_format_hint"].isin(FORMATS),
        "invalid_requires_javascript": ~o["requires_javascript"].isin("true", "false"),
        "invalid_request_timeout": positive("request_timeout_seconds"),
        "invalid_rate_limit": positive("rate_limit_per_minute"),
        "invalid_canonical_host": o["force_canonical_host"] == "",
    })


def conflicting_overrides(records: DataFrame) -> DataFrame:
    """Plans whose records differ in their overrides; none and an empty map are alike."""
    text = F.coalesce(F.to_json(F.array_sort(F.map_entries("system_overrides"))), F.lit("[]"))
    return records.groupBy("plan_id").agg(F.min(text).alias("a"), F.max(text).alias("b")).where("a <> b").select("plan_id", F.lit("conflicting_overrides").alias("code"))


def artifact_findings(findings: DataFrame, actions: DataFrame) -> DataFrame:
    """What keeps an artifact (artifact_id) from being published: code by artifact.

    Findings need id, entity, period, metric, a confidence from 0 to 1, a known severity, refs and citations. Actions
    name findings of their artifact; two or more findings need a comparison of two at least, all an explanation.
    """
    text = lambda c: filled(F.col(c)).isNull()
    bare = lambda c: (F.coalesce(F.size(c), F.lit(0)) == 0) | F.exists(c, lambda x: F.coalesce(filled(x), F.lit("")) == "")
    key = ["artifact_id"]
    fields = broken(findings, key, {
        **{f"missing_{c}": text(c) for c in ("finding_id", "entity", "period", "metric_family", "metric")}, "invalid_confidence": ~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)),
        "invalid_severity": ~F.coalesce("severity", F.lit("info")).isin(SEVERITIES), "missing_provenance": bare("provenance_refs"), "missing_citations": bare("citations"),
    })
    acts = broken(actions, key, {"invalid_action": ~F.coalesce(F.col("action").isin(ACTIONS), F.lit(False)), "missing_question": text("question"), "short_compare": (F.col("action") == "compare") & (F.size("finding_ids") < 2), "no_finding_ids": bare("finding_ids")})
    named = actions.select("artifact_id", F.explode("finding_ids").alias("finding_id"))
    unknown = named.join(findings.select("artifact_id", "finding_id"), ["artifact_id", "finding_id"], "left_anti").select("artifact_id", F.lit("unknown_finding").alias("code"))
    has = findings.groupBy("artifact_id").agg(F.count(F.lit(1)).alias("n"))
    done = actions.groupBy("artifact_id").agg(F.bool_or(F.col("action") == "compare").alias("_c"), F.bool_or(F.col("action") == "explain").alias("_e"))
    both = has.join(done, "artifact_id", "full_outer")
    off = lambda c: F.coalesce(F.col(c), F.lit(False))
    sets = broken(both, key, {"no_findings": F.col("n").isNull(), "wrong_actions": ~off("_e") | (off("_c") != (F.coalesce("n", F.lit(0)) >= 2))})
    return fields.union(acts).union(unknown).union(sets).distinct()
