"""Registered queries of the pension operators: every one reads the tables of the data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import funding, history, holdings, quality
from ..sources import scans
from ..streaming import jobs
from . import domain as D

Query = Callable[[SparkSession, str], DataFrame]
ILLIQUID = ["PROMO", "ECONOMY"]


def panel(s: SparkSession, d: str) -> DataFrame:
    f = D.plan_funding(s, d)
    share = lambda c: F.col(c) / F.col("total_usd")
    wide = f.select("plan_id", "peer_group", "plan_period", "funded_ratio", share("employer_contributions_usd").alias("employer_share"), share("employee_contributions_usd").alias("employee_share"), share("benefit_payments_usd").alias("benefit_share"))
    return wide.unpivot(["plan_id", "peer_group", "plan_period"], ["funded_ratio", "employer_share", "employee_share", "benefit_share"], "metric_name", "metric_value").where("metric_value IS NOT NULL")


def peer_statistics(s: SparkSession, d: str) -> DataFrame:
    return funding.peer_statistics(panel(s, d), ["plan_period"])


def benchmark_panel(s: SparkSession, d: str) -> DataFrame:
    rows = panel(s, d)
    broad = funding.peer_statistics(rows, ["plan_period"])
    tight = funding.peer_statistics(rows, ["plan_period", "peer_group"]).select("plan_id", "plan_period", "metric_name", F.col("percentile").alias("tight_peer_percentile"), F.col("n_peers").alias("n_tight_peers"))
    return broad.join(tight, ["plan_id", "plan_period", "metric_name"]).select(
        "plan_id", "plan_period", "metric_name", "metric_value", F.col("percentile").alias("peer_percentile"), F.col("quartile_rank").alias("peer_quartile_rank"), "peer_median",
        F.round(F.round("metric_value", 6) - F.col("peer_median"), 6).alias("delta_vs_peer_median"), "tight_peer_percentile", "n_tight_peers",
    )


def health_inputs(s: SparkSession, d: str) -> DataFrame:
    f = D.plan_funding(s, d)
    change = funding.funding_trend(f).select("plan_id", "plan_period", "funded_ratio_change")
    n, ratio = F.col("n_orders"), F.col("funded_ratio")
    return f.join(change, ["plan_id", "plan_period"]).select(
        "plan_id", "plan_period", ratio.alias("funded_ratio_mva"), F.col("funded_ratio_change").alias("funded_ratio_trend"), F.round(0.05 + ratio / 20, 6).alias("assumed_return"), F.lit(0.065).alias("realistic_return"), F.lit(0.066).alias("peer_assumed_return_median"),
        F.col("employer_contributions_usd").alias("adc_usd"), F.col("employee_contributions_usd").alias("actual_contribution_usd"), (0.2 * F.col("benefit_payments_usd")).alias("normal_cost_usd"), (F.col("total_usd") - F.col("assets_usd")).alias("uaal_usd"),
        (0.05 * F.col("total_usd")).alias("amortization_payment_usd"), F.when(n % 3 == 0, True).when(n % 3 == 1, False).alias("amortization_is_closed"), (20 + n % 11).cast("double").alias("amortization_period_years"),
        F.round(100 * (F.col("employer_contributions_usd") - F.col("benefit_payments_usd")) / F.col("total_usd"), 4).alias("net_cash_flow_pct"), F.round(0.06 + ratio / 25, 6).alias("gasb_discount_rate"), (1995 + n % 25).cast("int").alias("mortality_table_year"),
    )


def weights(s: SparkSession, d: str) -> DataFrame:
    n = D.line_count(s, d)
    return holdings.position_weights(D.dealt(D.security_positions(s, d, n), n, "plan_id", "plan_period", "security_id"))


def factor_tilts(s: SparkSession, d: str) -> DataFrame:
    names = F.array(*map(F.lit, ("value", "quality", "size", "momentum")))
    pairs = F.arrays_zip(names.alias("factor"), F.slice("embedding", 1, 4).cast("array<double>").alias("z"))
    exposures = D.table(s, d, "embeddings").select(F.concat(F.lit("cusip:"), F.col("vec_id").cast("string")).alias("security_id"), F.inline(pairs).alias("factor", "z"))
    return holdings.factor_tilts(weights(s, d), exposures)


def allocation_drift(s: SparkSession, d: str) -> DataFrame:
    actual = D.plan_allocation(s, d).withColumnRenamed("allocation_pct", "weight")
    later = F.concat(F.lit("FY"), (F.substring("plan_period", 3, 4).cast("int") + 1).cast("string"))
    return holdings.allocation_drift(actual, actual.withColumn("plan_period", later), ILLIQUID)


def brinson(s: SparkSession, d: str) -> DataFrame:
    mine = D.plan_allocation(s, d).select("plan_id", "plan_period", F.col("asset_class").alias("bucket"), F.col("allocation_pct").alias("weight"), (F.col("allocation_pct") / 10).alias("ret"))
    classes = D.table(s, d, "part").select(F.col("p_type").alias("bucket")).distinct()
    even = classes.join(F.broadcast(classes.agg((1.0 / F.count(F.lit(1))).alias("weight"))))
    policy = mine.select("plan_id", "plan_period").distinct().join(F.broadcast(even)).withColumn("ret", F.col("weight") / 8)
    return holdings.brinson(mine, policy, 0.002)


def liquidity(s: SparkSession, d: str) -> DataFrame:
    outflow = D.plan_funding(s, d).select("plan_id", "plan_period", (F.col("benefit_payments_usd") - F.col("employer_contributions_usd")).alias("net_cash_outflow_usd"))
    return holdings.liquidity(D.security_positions(s, d), ILLIQUID, outflow)


FACT = ["plan_id", "metric_name", "valid_from"]
SHOWN = ["plan_id", "metric_name", "value", "valid_from", "asserted_at", "input_seq"]


def supersede(s: SparkSession, d: str) -> DataFrame:
    facts = D.core_facts(s, d)
    new = facts.where("superseded_at IS NULL AND input_seq % 10 = 0").withColumn("value", F.col("value") * 2)
    return history.supersede(facts, new, FACT, "2005-01-01").select("plan_id", "metric_name", "input_seq", "value", "valid_from", "superseded_at", "restated")


def artifact_versions(s: SparkSession, d: str) -> DataFrame:
    docs = D.table(s, d, "documents").select("source", "lang", F.col("doc_id").alias("fetched_at"), F.col("doc_id").alias("artifact_seq"), F.col("text").alias("content"))
    return history.artifact_versions(docs, ["source", "lang"]).select("source", "lang", "artifact_seq", "checksum", "status", "version")


def canonical_ids(s: SparkSession, d: str) -> DataFrame:
    """Suppliers lead to the next one within blocks of five; in every fourth block the last but one has two successors."""
    k = F.col("s_suppkey")
    keys = D.table(s, d, "supplier").where(k % 5 < 4)
    edges = keys.select(k.alias("source"), (k + 1).alias("target")).union(keys.where((F.floor(k / 5) % 4 == 3) & (k % 5 == 3)).select(k, (k + 1000000)))
    return history.canonical_ids(edges)


def anomalies(s: SparkSession, d: str) -> DataFrame:
    points = D.quality_points(s, d)
    classes = D.plan_allocation(s, d).select("plan_id", F.col("plan_period").alias("period"), "asset_class", "allocation_pct").join(points.select("plan_id", "period", "confidence"), ["plan_id", "period"])
    funded = quality.shifts(points, [], "funded_ratio", F.lit("funded_ratio"), 0.05, 0.10)
    return funded.unionByName(quality.shifts(classes, ["asset_class"], "allocation_pct", F.concat(F.lit("allocation:"), F.col("asset_class")), 0.05, 0.10))


def coverage(s: SparkSession, d: str) -> DataFrame:
    rows = D.manager_fund_positions(s, d).join(D.plan_dim(s, d), "plan_id")
    return quality.coverage_by_cohort(rows.select(F.col("peer_group").alias("cohort"), F.col("plan_period").alias("period"), (F.col("disclosure_state") == "disclosed").alias("manager_disclosed"), F.col("exposure_usd").isNotNull().alias("exposure_known")), ["manager_disclosed", "exposure_known"])


def telemetry(s: SparkSession, d: str) -> DataFrame:
    return D.table(s, d, "events").select(F.col("event_type").alias("metric"), "value", F.col("ts").alias("observed_at"), (F.col("user_id") % 10).alias("run_id"))


def sla_gate(s: SparkSession, d: str) -> DataFrame:
    observed = telemetry(s, d).groupBy("metric").agg(F.round(F.sum(F.col("value").cast("decimal(18,6)")).cast("double") / F.count(F.lit(1)), 6).alias("value"))
    limits = s.createDataFrame([("click", ">=", 0.95, True), ("error", "<=", 12.0, True), ("purchase", "<=", 0.08, False), ("review_latency", "<=", 12.0, True)], "metric string, op string, limit double, critical boolean")
    return quality.sla_gate(observed, limits)


def operation_summary(s: SparkSession, d: str) -> DataFrame:
    log = D.table(s, d, "conversations").where("text IS NOT NULL").select("role", F.char_length("text").alias("latency_ms"), F.when(F.col("turn") % 5 == 4, "error").otherwise("ok").alias("status"))
    return quality.operation_summary(log, ["role"])


def model_benchmark(s: SparkSession, d: str) -> DataFrame:
    cases = D.table(s, d, "documents").join(D.table(s, d, "labels"), "doc_id").select("source", F.col("quality").alias("expected"), F.when(F.char_length("text") > 300, 1).otherwise(0).alias("predicted"))
    return quality.model_benchmark(cases, ["source"])


def snapshot_diff(s: SparkSession, d: str) -> DataFrame:
    rows = D.plan_allocation(s, d).select("plan_id", "plan_period", "asset_class", F.round("allocation_pct", 2).alias("v"))
    return quality.snapshot_diff(rows.where("plan_period = 'FY1997'"), rows.where("plan_period = 'FY1998'"), ["plan_id", "asset_class"], "v")


def names(s: SparkSession, d: str) -> DataFrame:
    supplier = D.table(s, d, "supplier")
    return supplier.select(F.col("s_name").alias("name")).union(supplier.select(F.upper("s_name"))).union(D.table(s, d, "customer").select(F.replace("c_name", F.lit("#"), F.lit(" ")))).union(D.table(s, d, "part").select("p_name"))


def aliases(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    supplier = D.table(s, d, "supplier")
    return supplier.select(F.upper(F.replace("s_name", F.lit("#"), F.lit("  "))).alias("source_name")), supplier.select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("stable_id"), F.col("s_name").alias("alias"))


def alias_routing(s: SparkSession, d: str) -> DataFrame:
    sources, entities = aliases(s, d)
    return quality.alias_routing(sources, quality.alias_candidates(sources, entities))


def publications(s: SparkSession, d: str) -> DataFrame:
    e = D.table(s, d, "events")
    return history.publication_events(e.select(F.col("user_id").alias("system_id"), F.col("event_type").alias("source_id"), F.col("ts").alias("observed_at"), F.col("event_id").alias("input_seq"), F.col("props").alias("fingerprint"), F.when(F.col("event_type") == "signup", F.col("ts")).alias("published_at")))


def scenarios(s: SparkSession, d: str) -> DataFrame:
    f = D.plan_funding(s, d)
    metrics = f.select("plan_id", "plan_period", "funded_ratio", (F.col("employer_contributions_usd") / F.col("total_usd")).alias("employer_share")).unpivot(["plan_id", "plan_period"], ["funded_ratio", "employer_share"], "metric_name", "value")
    cases = s.createDataFrame([("base", {}, None), ("stress", {"funded_ratio": -0.1, "employer_share": 0.02}, None)], "name string, shocks map<string,double>, return_override double")
    return quality.scenarios(metrics, cases)


def entity_tokens(s: SparkSession, d: str) -> DataFrame:
    return D.table(s, d, "part").select("p_partkey", S.entity_token(F.col("p_name")).alias("token"), S.asset_class(F.col("p_type")).alias("asset_class"), S.rate_to_ratio(F.col("p_size").cast("double")).alias("ratio"))


def registry_audit(s: SparkSession, d: str) -> DataFrame:
    c = D.table(s, d, "customer").join(D.plan_dim(s, d), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.groupingSets([["peer_group"], ["c_mktsegment"], []], "peer_group", "c_mktsegment").agg(F.count(F.lit(1)).alias("n_members")).withColumnRenamed("c_mktsegment", "segment")


def ambiguous_names(s: SparkSession, d: str) -> DataFrame:
    rows = names(s, d).select("name", S.entity_token(F.col("name")).alias("norm")).where("norm <> ''")
    return rows.distinct().groupBy("norm").agg(F.count(F.lit(1)).alias("n_spellings")).where("n_spellings > 1")


def streamed_windows(s: SparkSession, d: str) -> DataFrame:
    rows = jobs.follow(s, d, "events").select(F.col("event_type").alias("metric"), "value", F.col("ts").cast("timestamp").alias("observed_at"))
    return jobs.drain(jobs.sla_windows(rows, "1 hour"), "update", ["window_start", "metric"])


def streamed_versions(s: SparkSession, d: str) -> DataFrame:
    docs = jobs.follow(s, d, "documents").where("doc_id IS NOT NULL").select((F.col("doc_id") % 500).alias("artifact"), F.col("doc_id").alias("artifact_seq"), F.sha2("text", 256).alias("fingerprint"))
    return jobs.drain(jobs.changes(docs, ["artifact"], ["artifact_seq"]), "append").select("artifact", "artifact_seq", "status", "version")


def latest_filings(s: SparkSession, d: str) -> DataFrame:
    rows = D.table(s, d, "orders").select(F.col("o_custkey").alias("filer"), F.col("o_orderdate").cast("date").alias("filing_date"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("accession"))
    return scans.latest_filing(rows, ["filer"])


def peer_store(s: SparkSession, d: str) -> DataFrame:
    rows = D.table(s, d, "orders").select(F.col("o_custkey").alias("ppd_id"), F.year("o_orderdate").alias("fy"), "o_orderkey", F.col("o_totalprice").alias("value"))
    return scans.last_wins(rows, ["ppd_id", "fy"], ["o_orderkey"])


QUERIES: dict[str, Query] = {
    "r1_sla_windows": streamed_windows,
    "r2_streamed_versions": streamed_versions,
    "s6_latest_filings": latest_filings,
    "k7_peer_store": peer_store,
    "w1_funding_trend": lambda s, d: funding.funding_trend(D.plan_funding(s, d)),
    "w2_benchmark_panel": benchmark_panel,
    "w3_anomalies": anomalies,
    "w4_peer_statistics": peer_statistics,
    "w5_plan_health": lambda s, d: funding.plan_health(health_inputs(s, d)),
    "w6_trend_change": lambda s, d: funding.trend_change(D.plan_funding(s, d)),
    "w7_publication_events": publications,
    "w9_cadence_profiles": lambda s, d: history.cadence_profiles(publications(s, d)),
    "w11_lifecycle": lambda s, d: quality.lifecycle(D.manager_fund_positions(s, d), D.tasks(s, D.line_count(s, d))),
    "w14_ambiguous_names": ambiguous_names,
    "j3_allocation_peers": lambda s, d: funding.allocation_peers(D.plan_allocation(s, d)),
    "j4_holdings_overlap": lambda s, d: holdings.holdings_overlap(D.manager_fund_positions(s, d), "NATION_0", "FY1998"),
    "j6_security_overlap": lambda s, d: holdings.security_overlap(weights(s, d)),
    "j11_alias_candidates": lambda s, d: quality.alias_candidates(*aliases(s, d)),
    "j12_alias_routing": alias_routing,
    "j14_snapshot_diff": snapshot_diff,
    "a1_position_weights": lambda s, d: weights(s, d).withColumn("weight", F.round("weight", 9)),
    "a3_concentration": lambda s, d: holdings.concentration(weights(s, d)),
    "a7_coverage": coverage,
    "a9_window_report": lambda s, d: quality.window_report(telemetry(s, d), F.date_trunc("day", "observed_at")),
    "a11_sla_gate": sla_gate,
    "a17_registry_audit": registry_audit,
    "a23_allocation_drift": allocation_drift,
    "a24_active_share": lambda s, d: holdings.active_share(weights(s, d), D.benchmark_weights(s, d)),
    "a25_factor_tilts": factor_tilts,
    "a26_brinson": brinson,
    "a28_liquidity": liquidity,
    "a30_operation_summary": operation_summary,
    "a32_model_benchmark": model_benchmark,
    "a34_quantile_summary": lambda s, d: quality.quantile_summary(D.table(s, d, "events"), ["event_type"]),
    "b1_as_of": lambda s, d: history.as_of(D.core_facts(s, d), "1998-06-15", "1998-06-20").select(*SHOWN),
    "b2_latest_known": lambda s, d: history.latest_known(D.core_facts(s, d), "1999-01-01", FACT).select(*SHOWN),
    "b3_active_overlaps": lambda s, d: history.active_overlaps(D.core_facts(s, d), ["plan_id"]).select("plan_id", "metric_name", "input_seq", "valid_from", "overlaps_until"),
    "b4_supersede": supersede,
    "b7_artifact_versions": artifact_versions,
    "b15_canonical_ids": canonical_ids,
    "q1_review_queue": lambda s, d: quality.review_queue(anomalies(s, d)),
    "u5_preferred_aliases": lambda s, d: quality.preferred_aliases(names(s, d)),
    "e1_clean_lines": lambda s, d: quality.clean_lines(D.table(s, d, "documents").select("doc_id", "text")),
    "e2_label_values": lambda s, d: quality.label_values(quality.clean_lines(D.table(s, d, "documents").select("doc_id", "text"))),
    "x1_scenarios": scenarios,
    "p1_entity_tokens": entity_tokens,
    "p14_normal_urls": lambda s, d: D.table(s, d, "pages").select("page_id", S.normal_url(F.col("url")).alias("url")),
    "p24_confidence_routing": lambda s, d: D.quality_points(s, d).select("plan_id", "period", S.routing(F.col("confidence")).alias("r")).select("plan_id", "period", "r.*"),
    "p38_redaction": lambda s, d: D.table(s, d, "documents").select("doc_id", F.sha2(S.redact(F.col("text")), 256).alias("redacted_sha256")),
    "p6_first_numbers": lambda s, d: D.table(s, d, "documents").select("doc_id", S.first_number(F.col("text")).alias("first_number"), S.money_scale(F.col("text")).alias("scale"), S.report_year(F.col("text")).alias("year")),
}
