"""Which plans have usable sources, year by year, and what was found for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import report_year

# Authority tiers that count as official, and the order of resolution states.
OFFICIAL = ["official", "official-mirror"]
STATES = ["not_found", "available_non_official_only", "available_official"]
MISMATCHES = ["wrong_plan", "stale_period", "non_official_only"]

# Hints in a title or address that tell the type of a document, first hit wins.
DOCUMENT_HINTS = {
    "annual_report": ["annual report", "acfr", "comprehensive annual financial report"],
    "board_packet": ["board packet", "board meeting", "trustee packet"],
    "alm_study": ["asset liability", "asset/liability", "alm study", "asset liability study"],
    "consultant_report": ["consultant report", "consultant", "investment consultant"],
}


def resolution(has_official: Column, has_any: Column) -> Column:
    return F.when(has_official, STATES[2]).when(has_any, STATES[1]).otherwise(STATES[0])


def document_type(title: Column, url: Column) -> Column:
    text = F.lower(F.concat_ws(" ", title, url))
    out = F
    for kind, hints in DOCUMENT_HINTS.items():
        out = out.when(text.rlike("|".join(hints)), kind)
    return out.otherwise("other")


def blocker(mismatch: Column, state: Column) -> Column:
    """Why a period can't be extracted; empty if it can."""
    return F.when(mismatch.isin(MISMATCHES), mismatch).when(state == STATES[1], "non_official_only").when(state == STATES[0], "official_source_unresolved").otherwise("")


def readiness(mismatch: Column, state: Column) -> Column:
    return F.when((mismatch == "non_official_only") | state.isin(STATES[:2]), "blocked_source").when(mismatch.isin(MISMATCHES), "blocked_quality").otherwise("ready")


def best_records(records: DataFrame, key: list[str]) -> DataFrame:
    """The best source record of every key: by resolution state, official tier, address. One partial aggregate."""
    rank = F.struct(F.array_position(F.array(*map(F.lit, STATES)), F.col("official_resolution_state")), F.col("source_authority_tier").isin(OFFICIAL), F.col("source_url"))
    rest = [c for c in records.columns if c not in key]
    return records.groupBy(*key).agg(F.max_by(F.struct(*rest), rank).alias("_best")).select(*key, "_best.*")


def year_grid(records: DataFrame, n_years: int = 5) -> DataFrame:
    """Every plan in each of the last ``n_years`` that any record names, with its best record or ``not_found``.

    Records need plan_id, year, cohort (the least one of a plan is taken). The
    last year is one row and so is broadcast; the grid has ``n_years`` rows a plan.
    """
    known = records.where("year IS NOT NULL")
    plans = known.groupBy("plan_id").agg(F.min("cohort").alias("cohort"))
    last = known.agg(F.max("year").alias("last"))
    grid = plans.join(F.broadcast(last)).select("plan_id", "cohort", F.explode(F.sequence(F.col("last") - (n_years - 1), F.col("last"))).alias("year"))
    best = best_records(known.select("plan_id", "year", "official_resolution_state", "source_authority_tier", "source_url", "mismatch_reason"), ["plan_id", "year"])
    rows = grid.join(best, ["plan_id", "year"], "left")
    state = F.coalesce("official_resolution_state", F.lit(STATES[0]))
    gap = F.when(state == STATES[2], "full").when(state == STATES[1], "partial").otherwise("missing")
    return rows.select("plan_id", "cohort", "year", state.alias("official_resolution_state"), gap.alias("coverage_gap_state"), readiness(F.col("mismatch_reason"), state).alias("readiness_state"), blocker(F.col("mismatch_reason"), state).alias("blocker_reason"), "source_url")


def readiness_summary(records: DataFrame) -> DataFrame:
    """Shares of unresolved, mismatched and stale records by cohort and by system type, in one pass."""
    n = F.count(F.lit(1))
    rate = lambda c: F.round(F.count_if(c) / n, 6)
    sets = records.groupingSets([["cohort"], ["system_type"]], "cohort", "system_type")
    return sets.agg(n.alias("total"), rate(F.col("official_resolution_state") != STATES[2]).alias("unresolved_rate"), rate(F.col("mismatch_reason").isNotNull()).alias("mismatch_rate"), rate(F.coalesce(F.col("mismatch_reason") == "stale_period", F.lit(False))).alias("stale_rate"))


def inventory(documents: DataFrame) -> DataFrame:
    """Number of documents of each type that were found for a plan, and whether managers or consultants are disclosed."""
    text = F.lower(F.concat_ws(" ", "title", "source_url"))
    rows = documents.withColumn("_type", document_type(F.col("title"), F.col("source_url")))
    counts = [F.count_if(F.col("_type") == t).alias(f"n_{t}") for t in [*DOCUMENT_HINTS, "other"]]
    return rows.groupBy("plan_id").agg(*counts, F.bool_or(text.rlike("manager|holding")).alias("has_manager_disclosure"), F.bool_or(text.rlike("consultant report|investment consultant")).alias("has_consultant_disclosure"))


def report_coverage(records: DataFrame, documents: DataFrame, system_types: DataFrame, n_years: int = 5, anchor: int = 2025) -> DataFrame:
    """Where the annual report of every plan and recent year is: by the source map, else by what was discovered, else not found.

    ``records`` (plan_id, plan_period, cohort, official_resolution_state,
    source_authority_tier, source_url, seq) are of the last year that their
    period names, the first by seq tells a plan's cohort; ``documents``
    (plan_id, title, source_url, source_authority_tier) of the year in title or
    address; ``system_types`` (plan_id, system_type) go by folded ids. The years
    end with the last one known, or with ``anchor`` if none is: one row, which
    is broadcast.
    """
    dated = records.withColumn("year", F.array_max(F.transform(F.regexp_extract_all("plan_period", F.lit(r"((?:19|20)\d{2})"), 1), lambda x: x.cast("int")))).where("year IS NOT NULL")
    text = F.lower(F.concat_ws(" ", "title", "source_url"))
    found = documents.select(
        "plan_id", "source_url", report_year(F.concat_ws(" ", "title", "source_url")).alias("year"), document_type(F.col("title"), F.col("source_url")).alias("kind"), F.coalesce(F.col("source_authority_tier").isin(OFFICIAL), F.lit(False)).alias("official"),
        text.rlike("manager|holding").alias("manager"), text.rlike("consultant report|investment consultant").alias("consultant"),
    )
    last = dated.select("year").union(found.select("year")).agg(F.coalesce(F.max("year"), F.lit(anchor)).alias("last"))
    cohorts = dated.groupBy("plan_id").agg(F.min_by("cohort", "seq").alias("cohort"))
    flags = found.groupBy("plan_id").agg(F.bool_or("manager").alias("manager"), F.bool_or("consultant").alias("consultant"))
    grid = cohorts.join(flags, "plan_id", "full_outer").join(F.broadcast(last)).select("plan_id", F.coalesce("cohort", F.lit("unknown")).alias("cohort"), "manager", "consultant", F.explode(F.sequence(F.col("last") - (n_years - 1), F.col("last"))).alias("year"))
    best = best_records(dated.select("plan_id", "year", "official_resolution_state", "source_authority_tier", "source_url"), ["plan_id", "year"]).select("plan_id", "year", "official_resolution_state", F.col("source_url").alias("_url"))
    reports = found.where("kind = 'annual_report'").groupBy("plan_id", "year").agg(F.max(F.struct("official", "source_url")).alias("_report"))
    types = system_types.groupBy(F.lower("plan_id").alias("_folded")).agg(F.max("system_type").alias("_type"))
    rows = grid.join(best, ["plan_id", "year"], "left").join(reports, ["plan_id", "year"], "left").withColumn("_folded", F.lower(F.btrim("plan_id"))).join(types, "_folded", "left")
    by_report = F.when(F.col("_report.official"), STATES[2]).when(F.col("_report").isNotNull(), STATES[1]).otherwise(STATES[0])
    return rows.select(
        "plan_id", F.col("year").alias("plan_year"), "cohort", F.coalesce("_type", "cohort").alias("system_type"), F.coalesce("official_resolution_state", by_report).alias("official_resolution_state"), F.coalesce("_url", "_report.source_url", F.lit("not_found")).alias("annual_report_source_url"),
        F.coalesce("manager", F.lit(False)).alias("manager_disclosure_available"), F.coalesce("consultant", F.lit(False)).alias("consultant_disclosure_available"),
    )


def peer_axes(plans: DataFrame) -> DataFrame:
    """Peer group of a plan: type (code or words), size by assets, state, and maturity by members, else by liabilities."""
    code = F.col("plan_type").try_cast("double")
    words = F.lower("plan_type")
    kind = F.when(code == F.floor(code), F.coalesce(F.element_at(F.create_map(*map(F.lit, (1, "general", 2, "teacher", 3, "safety"))), code.cast("int")), F.lit("unknown")))
    kind = kind.when(words.contains("teach"), "teacher").when(words.rlike("police|fire|safety"), "safety").when(words.rlike("general|employ"), "general").otherwise("unknown")
    assets = F.coalesce("mkt_assets", "act_assets")
    size = F.when(assets < 2e9, "small").when(assets >= 2e10, "large").when(assets.isNotNull(), "medium").otherwise("unknown")
    members = (F.col("active_members") > 0) & F.col("beneficiaries").isNotNull()
    support, cover = F.try_divide("beneficiaries", "active_members"), F.try_divide("act_liabilities", "act_assets")
    ripe = F.when(members, F.when(support >= 1.0, "mature").otherwise("growing")).when((F.col("act_assets") > 0) & F.col("act_liabilities").isNotNull(), F.when(cover >= 1.1, "mature").otherwise("growing")).otherwise("unknown")
    state = F.coalesce(F.nullif(F.upper(F.btrim("state")), F.lit("")), F.lit("unknown"))
    return plans.select("plan_id", kind.alias("type"), size.alias("size"), state.alias("state"), ripe.alias("maturity"))
