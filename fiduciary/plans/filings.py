"""Registered queries of mentions, staging, entities, components and source maps, each beside its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.shared import cut
from ..operators import disclosures, mentions, sourcemap, staging
from . import domain as D
from . import statements
from .oracle import sql

Query = Callable[[SparkSession, str], DataFrame]


def text(*parts: Column | str) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def pick(k: Column, *values: str | None) -> Column:
    """One of the values by the remainder of a key."""
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (k % len(values) + 1).cast("int"))


def fee_labels(s: SparkSession, d: str) -> DataFrame:
    """A fee line for every order, some without manager, some with names in capitals, some not disclosed."""
    k = F.col("o_orderkey")
    digit = (k % 7).cast("string")
    name = F.when(k % 11 == 0, " ").when(k % 3 == 0, text("MANAGER  ", digit)).otherwise(text("Manager ", digit))
    value = F.when(k % 5 == 0, "Not  disclosed").when(k % 2 == 0, text((k % 90 + 1).cast("string"), " %")).otherwise(text("$", (k % 1000 + 1).cast("string"), pick(k, " million", " K", "")))
    label = text("Fee: ", name, ":", pick(k, "Management Fee", "performance_fee", "custody", ""), ":", pick(k, "Rate", "amount_usd"))
    return D.plan_orders(s, d).select("plan_id", "plan_period", label.alias("label"), value.alias("value"), F.lit("usd").alias("unit"), text("o:", k.cast("string")).alias("ref"))


def risk_labels(s: SparkSession, d: str) -> DataFrame:
    n = F.col("n_orders")
    row = lambda ref, when, label, value: F.when(when, F.struct(F.lit(ref).alias("ref"), F.lit(label).alias("label"), value.alias("value")))
    rows = F.array_compact(F.array(
        row("t:1", n % 3 != 0, "Risk:Derivatives: Interest-Rate Swaps:Policy_Limit", text("$", n.cast("string"), " million")),
        row("t:2", n % 3 == 1, "risk:derivatives:Interest-Rate Swaps:realized_exposure", text((n * 2).cast("string"), " thousand")),
        row("t:3", n % 4 == 0, "risk:securities lending::collateral", (n * 3).cast("string")),
        row("t:4", n % 8 == 0, "risk:securities lending::realized_exposure", F.lit("none")),
        row("t:5", n % 5 == 0, "risk:currency:x:policy_limit", F.lit("5")),
    ))
    return D.plan_funding(s, d).select("plan_id", "plan_period", F.inline(rows)).withColumn("unit", F.lit("thousand_usd"))


def consultant_blocks(s: SparkSession, d: str) -> DataFrame:
    n = F.col("n_orders")
    digit = (n % 4).cast("string")
    blocks = F.array_compact(F.array(
        F.when(n % 3 != 0, text("Consultant: Firm ", digit, " | general  ")), F.when(n % 6 == 1, text("CONSULTANT:FIRM ", digit, "|")), F.when(n % 5 == 0, "consultant: N/A | none"),
        F.when(n % 2 == 0, text(" recommendation: Firm ", digit, "|", pick(n, "Fees", "", " "), "|cut|", pick(n, "Approved", "partially  adopted", "tabled"))),
        F.when(n % 7 == 0, text("Attribution:unknown|fees|lower|", pick(n, "Direct", "inferred", ""))), F.lit("Consultants: none of these"),
    ))
    return D.plan_funding(s, d).select("plan_id", "plan_period", F.explode(blocks).alias("text"))


def consultants(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    found = mentions.consultant_mentions(consultant_blocks(s, d))
    return D.plan_funding(s, d), found, mentions.consultant_entities(found)


def staged(s: SparkSession, d: str) -> DataFrame:
    rows = staging.staged_facts(statements.history_families(s, d), "2024-06-30", "v1")
    return rows.select("fact_id", "plan_id", "plan_period", "metric_family", "metric_name", "value", "manager_name", "fund_name", "confidence", F.array_join("evidence_refs", ",").alias("refs"))


def held(s: SparkSession, d: str) -> DataFrame:
    p = D.manager_fund_positions(s, d).withColumn("completeness", F.when(F.col("disclosure_state") == "not_disclosed", "not_disclosed").otherwise("partial"))
    return p.withColumn("manager_name", F.when(F.col("manager_name").endswith("3"), "  ").otherwise(F.col("manager_name")))


def warning_rows(s: SparkSession, d: str) -> DataFrame:
    """Warnings of fees and of consultants."""
    fees = mentions.fees(mentions.fee_lines(fee_labels(s, d)))
    told = fees.select("plan_id", "plan_period", "manager_name", F.explode(F.split("warnings", ",")).alias("code")).where("code <> ''")
    return staging.warnings_union({"investment_fee": told, "consultant": mentions.consultant_warnings(*consultants(s, d))})


def finding_rows(s: SparkSession, d: str) -> DataFrame:
    """A finding for every line of an order: lines of one flag and quantity class repeat each other."""
    lines = D.table(s, d, "lineitem")
    code = F.when(F.col("l_returnflag") == "R", "schema_invalid").otherwise("confidence_out_of_range")
    severity = F.when(F.col("l_linestatus") == "F", "error").otherwise("warning")
    return lines.select(code.alias("code"), text("plan:", (F.col("l_suppkey") % 10).cast("string")).alias("plan_id"), text("FY", F.year("l_shipdate").cast("string")).alias("plan_period"), F.when(F.col("l_linenumber") > 1, F.col("l_returnflag")).alias("metric_name"), F.when(F.col("l_linenumber") <= 3, F.lower("l_linestatus")).otherwise("any").alias("message"), F.lit("p.1").alias("evidence_refs"), severity.alias("severity"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_linestatus").alias("seq"))


def anomaly_rows(s: SparkSession, d: str) -> DataFrame:
    o = D.plan_orders(s, d)
    decisions = o.select("plan_id", "plan_period", F.lit("funded_ratio").alias("metric_name"), F.col("o_orderkey").alias("row_id"), F.when(F.col("o_orderpriority") == "1-URGENT", "high").otherwise("none").alias("review_priority"), (F.col("o_orderstatus") == "F").alias("publish_blocked"))
    return staging.parser_anomalies(staging.distinct_findings(finding_rows(s, d)), decisions)


def known_entities(s: SparkSession, d: str) -> DataFrame:
    """Suppliers as managers, of which every seventh was merged into the first."""
    k = F.col("s_suppkey")
    ident = staging.entity_ids(F.lit("manager"), F.col("s_name"), F.array(text("nation ", F.col("s_nationkey").cast("string"))))
    return D.table(s, d, "supplier").select(ident.alias("stable_id"), pick(k, "manager", "manager", "fund").alias("entity_type"), F.col("s_name").alias("display_name"), F.lit("old").alias("metadata"), F.when(k % 7 == 0, "manager:first").alias("merged_into"), k.alias("key"))


def upserts(s: SparkSession, d: str) -> DataFrame:
    """Updates for every second supplier, twice, and customers as new entities."""
    old = known_entities(s, d)
    again = old.where("key % 2 = 0").select("stable_id", "entity_type", "display_name", F.explode(F.array(F.lit(1), F.lit(2))).alias("seq"))
    new = D.table(s, d, "customer").select(staging.entity_ids(F.lit("plan"), F.col("c_name"), F.array(F.lit(" "))).alias("stable_id"), F.lit("plan").alias("entity_type"), F.col("c_name").alias("display_name"), F.lit(1).alias("seq"))
    return staging.upsert_entities(old.drop("key"), again.union(new).withColumn("metadata", text("v", F.col("seq").cast("string"))))


def merges(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers, and wishes to merge a part of them into the supplier with the next key of theirs."""
    old = known_entities(s, d)
    by = old.select("key", "stable_id")
    wish = by.where("key % 4 = 1").select(F.col("stable_id").alias("source"), (F.col("key") + 1).alias("key")).join(by.withColumnRenamed("stable_id", "target"), "key").select("source", "target")
    return old.drop("key"), staging.valid_merges(old, wish)


def refused_merges(s: SparkSession, d: str) -> DataFrame:
    """Wishes of suppliers to merge, with neighbours, with themselves and with what is no supplier."""
    old = known_entities(s, d)
    of = lambda name, rule: old.where(rule).select(F.col("stable_id").alias("source"), name.alias("_k"))
    by = old.select(F.col("key").alias("_k"), F.col("stable_id").alias("target"))
    k = F.col("key")
    near = of(k + 1, "key % 4 = 1").union(of(k + 1, "key % 8 = 2")).union(of(k + 2, "key % 12 = 1")).union(of(k, "key % 5 = 0")).join(by, "_k").select("source", "target")
    far = old.where("key % 9 = 4").select(F.col("stable_id").alias("source"), F.lit("manager:nobody").alias("target"))
    return staging.merge_rejects(old, near.union(far).union(far.select("target", "source")))


def merged_links(s: SparkSession, d: str) -> DataFrame:
    _, valid = merges(s, d)
    ids = known_entities(s, d).select("stable_id", F.col("key").alias("l_suppkey"))
    links = D.table(s, d, "lineitem").join(ids, "l_suppkey").select("stable_id", F.when(F.col("l_returnflag") == "A", " ").otherwise(F.col("l_returnflag")).alias("source_table"), (F.col("l_partkey") % 50).cast("string").alias("source_record_id"), text(" p.", F.col("l_linenumber").cast("string")).alias("ref"))
    out = staging.entity_links(links, valid)
    return out.withColumn("refs", F.array_join("refs", ","))


def chains(s: SparkSession, d: str) -> DataFrame:
    """Every event supersedes the one before it of the same user and type."""
    before = F.lag("event_id").over(Window.partitionBy("user_id", "event_type").orderBy("event_id"))
    return staging.artifact_chains(D.table(s, d, "events").select(F.col("event_id").alias("artifact_id"), before.alias("supersedes")))


CLASSES = {"equity": "w_equity", "bonds": "w_bonds", "cash": "w_cash"}


def peers(s: SparkSession, d: str) -> DataFrame:
    """Customers as survey records of plans and years; later keys replace earlier ones."""
    k, b = F.col("c_custkey"), F.col("c_acctbal")
    share = F.round(F.abs(b) / 20000, 4)
    rows = staging.peer_universe(D.table(s, d, "customer").select(
        F.col("c_nationkey").alias("ppd_id"), (2000 + k % 9).alias("fy"), k.alias("seq"), F.col("c_mktsegment").alias("peer_group"), F.when(b > 5000, 100 * share).when(b > 0, share).alias("funded_ratio_ava"), F.when(b < 500, -F.round(b / 10000, 4)).alias("funded_ratio_mva"), (b + 2000).alias("mkt_assets"), F.when(k % 4 > 0, 20000.0).otherwise(0.0).alias("act_liabilities"),
        share.alias("w_equity"), F.round(b, 2).cast("double").alias("w_bonds"), F.when(k % 3 == 0, float("nan")).when(k % 3 == 1, 1.0).alias("w_cash")), CLASSES)
    return rows.withColumns({c: F.round(c, 9) for c in ("funded_ratio_ava", "funded_ratio_mva")}).drop("mkt_assets", "act_liabilities")


def component_inputs(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    doc = F.concat_ws("/", "plan_id", "plan_period").alias("document_id")
    o = D.plan_orders(s, d)
    family = F.when(F.col("o_orderpriority") == "1-URGENT", "fee").when(F.col("o_orderpriority") == "2-HIGH", "performance").otherwise("funded")
    facts = o.where("o_orderstatus = 'F'").select(doc, family.alias("metric_family"), F.col("o_orderpriority").alias("ref"))
    relations = D.manager_fund_positions(s, d).where("disclosure_state = 'disclosed'").select(doc, "manager_name", F.when(F.col("fund_name") != "Brand#11", F.col("fund_name")).alias("fund_name"), F.lit(None).cast("string").alias("ref"))
    warned = o.where("o_orderstatus = 'P'").select(doc, F.lit("p.9").alias("ref"))
    return facts, relations, warned, o.select(doc)


def components(s: SparkSession, d: str) -> DataFrame:
    return staging.component_status(*component_inputs(s, d), tasks=D.tasks(s, D.line_count(s, d)))


def wrong_components(s: SparkSession, d: str) -> DataFrame:
    """Status rows of which some are lost, renamed, doubled or altered."""
    c, n = cut(components(s, d)), F.col("row_count")
    is_ = lambda name: F.col("component_name") == name
    rows = c.where(~(is_("plan_period") & (n == 0))).withColumns({
        "component_name": F.when(is_("document_version") & (n > 0), "version").otherwise(F.col("component_name")), "status": F.when(is_("fee_observation") & (n > 2), "done").otherwise(F.col("status")),
        "confidence": F.when(is_("manager_entity"), 1.0).otherwise(F.col("confidence"))})
    return staging.component_findings(rows.union(c.where(is_("benchmark_version")).withColumns({"status": F.lit("not_disclosed"), "row_count": F.lit(0).cast("long"), "confidence": F.lit(None).cast("double"), "n_refs": F.lit(0).cast("long")})))


def outcomes(s: SparkSession, d: str) -> DataFrame:
    lines = D.table(s, d, "lineitem")
    return lines.select(F.col("l_linestatus").alias("stage"), F.col("l_returnflag").alias("domain"), F.col("l_linenumber").alias("record_count"), F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 7), F.lit(1)).alias("error_count"), F.lit(1).alias("attempt_count"))


def telemetry(s: SparkSession, d: str) -> DataFrame:
    f = D.plan_funding(s, d).select(text(F.col("plan_id"), "/", F.col("plan_period")).alias("run_id"), "n_orders", F.round("funded_ratio", 6).alias("completeness"), F.col("employer_contributions_usd").alias("latency"))
    return staging.stage_telemetry(f, {"n_orders": "ingestion", "completeness": "extraction", "latency": "review"})


def evaluated(s: SparkSession, d: str) -> DataFrame:
    """Orders as cases by priority: expected are the parts of lines on sale, actual those that were not returned."""
    lines = D.table(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_discount") > 0.03, F.col("l_partkey"))).alias("expected"), F.collect_set(F.when(F.col("l_returnflag") != "R", F.col("l_partkey"))).alias("actual"))
    o = D.table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("suite"), (F.col("o_orderstatus") != "P").alias("schema_valid"), (F.col("o_totalprice") < 400000).alias("safe"))
    return staging.evaluation(o.join(lines, "l_orderkey"), {"schema_validity_rate": 0.9, "citation_coverage_rate": 0.6, "no_hallucination_rate": 0.2})


def envelopes(s: SparkSession, d: str) -> DataFrame:
    o, k = D.table(s, d, "orders"), F.col("o_orderkey")
    return staging.missing_envelope(o.select(
        k.alias("row_id"), F.when(k % 3 == 0, " ").otherwise("run").alias("run_id"), F.when(k % 5 != 0, "h").alias("config_hash"), F.lit("1").alias("code_version"), F.col("o_orderstatus").alias("input_snapshot_id"),
        F.when(F.col("o_orderstatus") != "P", "2024").alias("generated_at"), F.when(k % 2 == 0, k).alias("seed"), F.when(k % 4 == 0, F.array()).otherwise(F.array(k.cast("string"))).alias("source_artifact_ids")), seeded=True)


def queue(s: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = D.table(s, d, "part").select(F.col("p_name").alias("source_name"), k.alias("source_record_id"), pick(k, "review", "linked").alias("status"), pick(k, "high", "none", "medium", "low").alias("review_priority"), F.lit(0.5).alias("confidence"), F.array(F.struct(F.col("p_brand").alias("stable_id")), F.struct(F.col("p_type").alias("stable_id"))).alias("candidates"))
    return staging.alias_queue(rows).withColumn("candidate_ids", F.array_join("candidate_ids", ","))


def seeds(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    date = F.date_format("o_orderdate", "yyyy-MM-dd")
    rows = D.table(s, d, "orders").select("o_orderkey", pick(k, "", "FY1", None).alias("plan_period"), pick(k, "v2", "").alias("benchmark_version"), F.when(k % 5 == 0, "").when(k % 5 == 1, "2024-01-01").alias("ingestion_date"), date.alias("effective_date"), F.when(k % 2 == 0, "").alias("valid_from"), F.when(k % 7 == 0, "2025-01-01").alias("asserted_at"), pick(k, " ", None, "2025-02-02").alias("superseded_at"))
    return staging.seed_defaults(rows).drop("superseded_at")


def text_refs(s: SparkSession, d: str) -> DataFrame:
    k = F.col("l_orderkey").cast("string")
    refs = F.element_at(F.array(text(" p.", k, ", ,p.1,p.", k), text('["p.', k, '", " p.2 ", "p.2"]'), text("[p.", k, ", p.3]"), F.lit(" ")), (F.col("l_orderkey") % 4 + 1).cast("int"))
    return D.table(s, d, "lineitem").where("l_linenumber = 1").select("l_orderkey", F.array_join(staging.refs_from_text(refs), ";").alias("refs"))


def securities(s: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = D.table(s, d, "part").select(
        "p_partkey", F.when(k % 2 == 0, text("ab-", k.cast("string"))).alias("cusip"), F.when(k % 3 == 0, text(" t", k.cast("string"))).alias("ticker"), text(F.col("p_name"), " ").alias("security_name"), text(" ", F.col("p_type")).alias("asset_class"),
        F.when(k % 5 == 0, float("nan")).otherwise((F.col("p_size") - 10) / 20).alias("confidence"), F.lit("2024-06-30").alias("as_of"), F.when(k % 4 == 0, "2024-01-01").alias("valid_from"), F.lit(None).cast("string").alias("asserted_at"), F.lit(" m ").alias("manager_name"), F.lit(None).cast("string").alias("fund_name"))
    return staging.staged_securities(rows, disclosures.security_id(F.col("cusip"), F.col("ticker"), F.col("security_name"))).select("p_partkey", "security_id", "security_name", "ticker", "asset_class", "confidence", "valid_from", "asserted_at", "manager_name", "fund_name")


def source_entries(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    n = k.cast("string")
    cells = D.table(s, d, "orders").select(
        text("plan:", n).alias("plan_id"), text(pick(k, "https://", "HTTP://", "ftp://", ""), "site", n, ".example/x").alias("seed_url"), pick(k, "a.example; b.example", "localhost;c.example", " ; ", "a b.example", "z.example").alias("allowed_domains"),
        pick(k, "annual_report", "investment_report;annual_report", "brochure").alias("doc_type_hints"), pick(k, "next_link", "", "query_param").alias("pagination_hints"), pick(k, "10", "0", "ten", "5", " 7 ", "3").alias("max_pages"), pick(k, "0", "1", "2", "3", "-1").alias("max_depth"),
        pick(k, "official", "", "private", "official-mirror").alias("source_authority_tier"), pick(k, "", "wrong_plan", "other").alias("mismatch_reason"), pick(k, "true", "yes", None).alias("override_requires_js"), pick(k, "250", "0", "soon", "", "1").alias("override_force_render_wait_ms"), pick(k, "", "single_page", "scroll", "").alias("override_pagination_mode"), pick(k, None, "x", None, None, None, None, None).alias("override_colour"))
    return sourcemap.entries(cells)


def source_records(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    keys = F.array(pick(k, "pagination_mode", "rate_limit_per_minute", "colour", "force_canonical_host", "requires_javascript"))
    return D.plan_orders(s, d).select(
        text("plan:", (k % 97).cast("string")).alias("plan_id"), text("o:", k.cast("string")).alias("plan_period"), pick(k, "official", "high-confidence-third-party", "private", "official-mirror").alias("source_authority_tier"), pick(k, "available_official", "available_non_official_only", "not_found", "lost", "available_official").alias("official_resolution_state"),
        pick(k, None, "wrong_plan", "non_official_only", "stale_period", None, "else", None).alias("mismatch_reason"), F.lit("a").alias("expected_plan_identity"), pick(k, None, "a", "b").alias("observed_plan_identity"), F.when(k % 2 == 0, F.map_from_arrays(keys, F.array(pick(k, "next_link", "0", "")))).alias("system_overrides"))


def artifacts(s: SparkSession, d: str) -> DataFrame:
    """Orders as artifacts: lines as findings, and lines of some suppliers as actions."""
    lines = D.table(s, d, "lineitem")
    finding = text("f", F.col("l_linenumber").cast("string"))
    found = lines.where("l_quantity > 15").select(F.col("l_orderkey").alias("artifact_id"), finding.alias("finding_id"), F.lit("plan").alias("entity"), F.when(F.col("l_returnflag") != "R", "FY1").alias("period"), F.lit("f").alias("metric_family"), F.lit("m").alias("metric"), (F.col("l_discount") * 11).cast("double").alias("confidence"), F.when(F.col("l_linestatus") == "F", "fatal").alias("severity"), F.array(F.lit("p.1")).alias("provenance_refs"), F.when(F.col("l_tax") > 0.01, F.array(F.lit("p.1"))).alias("citations"))
    acts = lines.where("l_suppkey % 4 < 3").select(F.col("l_orderkey").alias("artifact_id"), F.when(F.col("l_suppkey") % 4 == 0, "explain").when(F.col("l_suppkey") % 4 == 1, "compare").when(F.col("l_tax") > 0.05, "guess").otherwise("explain").alias("action"), F.lit("why").alias("question"), F.array_distinct(F.array(finding, F.lit("f1"))).alias("finding_ids"))
    return sourcemap.artifact_findings(found, acts)


def overlap_rows(s: SparkSession, d: str) -> DataFrame:
    """Securities under their class as name, some without; promoted ones have a state that isn't known."""
    p = D.security_positions(s, d)
    return staging.overlap_inputs(p.withColumns({"security_name": F.nullif("asset_class", F.lit("ECONOMY")), "disclosure_state": F.when(F.col("asset_class") == "PROMO", "partly").otherwise(F.col("disclosure_state"))}))


QUERIES: dict[str, Query] = {
    "j5_overlap_inputs": overlap_rows,
    "e7_fees": lambda s, d: mentions.fees(mentions.fee_lines(fee_labels(s, d))),
    "e9_risk_observations": lambda s, d: mentions.risk_observations(D.plan_funding(s, d), mentions.risk_topics(risk_labels(s, d))),
    "e9_risk_diagnostics": lambda s, d: mentions.risk_diagnostics(D.plan_funding(s, d), mentions.risk_topics(risk_labels(s, d))),
    "e10_consultants": lambda s, d: consultants(s, d)[2],
    "e10_consultant_rows": lambda s, d: mentions.consultant_rows(*consultants(s, d)),
    "e10_consultant_warnings": lambda s, d: mentions.consultant_warnings(*consultants(s, d)),
    "e11_staged_facts": staged,
    "e11_relationships": lambda s, d: staging.relationships(held(s, d), "2024-06-30").select("relationship_id", "plan_id", "plan_period", "manager_name", "fund_name", "completeness"),
    "e12_staged_securities": securities,
    "e14_stage_ledger": lambda s, d: staging.stage_ledger(outcomes(s, d)),
    "u6_warnings": warning_rows,
    "u7_distinct_findings": lambda s, d: staging.distinct_findings(finding_rows(s, d)),
    "d5_parser_anomalies": anomaly_rows,
    "b8_artifact_chains": chains,
    "b10_upserted_entities": upserts,
    "b10_merge_rejects": refused_merges,
    "b10_merged_entities": lambda s, d: staging.merge_entities(*merges(s, d)),
    "b10_entity_links": merged_links,
    "b11_active_entities": lambda s, d: staging.active_entities(staging.merge_entities(*merges(s, d))).select("stable_id", "entity_type"),
    "b17_peer_universe": lambda s, d: peers(s, d).drop("allocations"),
    "b18_peer_funding": lambda s, d: staging.peer_funding(peers(s, d)),
    "b18_peer_allocations": lambda s, d: staging.peer_allocations(peers(s, d)),
    "a18_components": components,
    "a19_component_findings": wrong_components,
    "a10_stage_telemetry": telemetry,
    "a31_evaluation": evaluated,
    "d6_missing_envelopes": envelopes,
    "q5_alias_queue": queue,
    "p29_seed_defaults": seeds,
    "p37_text_refs": text_refs,
    "d2_entry_findings": lambda s, d: sourcemap.entry_findings(source_entries(s, d)),
    "d3_record_findings": lambda s, d: sourcemap.record_findings(source_records(s, d)),
    "d3_conflicting_overrides": lambda s, d: sourcemap.conflicting_overrides(source_records(s, d)),
    "d7_artifact_findings": artifacts,
}


def views(sql_of_views: str, select: str) -> str:
    """A query over views of the domain and those given."""
    head = sql("SELECT 1 FROM plan_funding, plan_orders, manager_fund_positions, plan_allocation")
    return head[: head.rindex("\nSELECT 1")] + ",\n" + sql_of_views + "\n" + select


def token(c: str) -> str:
    return f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"


def strip(c: str) -> str:
    return rf"nullif(regexp_replace({c}, '^\s+|\s+$', '', 'g'), '')"


def fold(c: str) -> str:
    return rf"trim(regexp_replace(lower({c}), '\s+', ' ', 'g'))"


def digest(prefix: str, *parts: str) -> str:
    """An id as ``stable_id`` gives it."""
    return f"'{prefix}:' || substr(sha256(" + " || '|' || ".join(f"""coalesce('"' || {p} || '"', 'null')""" for p in parts) + "), 1, 20)"


def number(c: str) -> str:
    return rf"TRY_CAST(replace(regexp_extract({c}, '[-+]?\d[\d.,]*\d|[-+]?\d'), ',', '') AS DOUBLE)"


def scale(c: str, unit: str) -> str:
    return rf"CASE WHEN contains(lower({c}), 'million') THEN 'million_usd' WHEN regexp_matches(lower({c}), 'thousand|(^|[^a-z])k\b') THEN 'thousand_usd' ELSE '{unit}' END"


MULTIPLE = "CASE {0} WHEN 'million_usd' THEN 1e6 WHEN 'thousand_usd' THEN 1e3 ELSE 1 END"

FEES = rf"""fee_labels AS (SELECT plan_id, plan_period, 'o:' || o_orderkey AS ref,
      'Fee: ' || CASE WHEN o_orderkey % 11 = 0 THEN ' ' WHEN o_orderkey % 3 = 0 THEN 'MANAGER  ' || o_orderkey % 7 ELSE 'Manager ' || o_orderkey % 7 END || ':' || ['Management Fee', 'performance_fee', 'custody', ''][o_orderkey % 4 + 1] || ':' || ['Rate', 'amount_usd'][o_orderkey % 2 + 1] AS label,
      CASE WHEN o_orderkey % 5 = 0 THEN 'Not  disclosed' WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 90 + 1) || ' %' ELSE '$' || (o_orderkey % 1000 + 1) || [' million', ' K', ''][o_orderkey % 3 + 1] END AS value FROM plan_orders),
    fee_parts AS (SELECT *, {strip("string_split(label, ':')[2]")} AS manager_name, {fold("string_split(label, ':')[3]")} AS kind, {fold("string_split(label, ':')[4]")} AS field, {number('value')} AS v, {fold('value')} = 'not disclosed' AS gone FROM fee_labels),
    fee_values AS (SELECT *, CASE WHEN field = 'rate' THEN v END AS rate, CASE WHEN field = 'amount_usd' THEN v END AS amount, {scale('value', 'usd')} AS unit, {fold('manager_name')} AS key FROM fee_parts),
    fee_rows AS (SELECT plan_id, plan_period, manager_name, CASE WHEN kind IN ('management_fee', 'management fee') THEN 'management_fee' WHEN kind IN ('performance_fee', 'performance fee') THEN 'performance_fee' ELSE 'other_fee' END AS fee_type,
      round(CASE WHEN rate > 1 THEN rate / 100 ELSE rate END, 9) AS normalized_rate, round(amount * {MULTIPLE.format('unit')}, 6) AS amount_usd, ref AS evidence_ref,
      CASE WHEN gone OR (rate IS NULL AND amount IS NULL) THEN 'not_disclosed' WHEN rate IS NOT NULL AND amount IS NOT NULL THEN 'complete' ELSE 'partial' END AS completeness,
      key IS NOT NULL AND min(manager_name) OVER (PARTITION BY plan_id, plan_period, key) <> max(manager_name) OVER (PARTITION BY plan_id, plan_period, key) AS several FROM fee_values),
    fees AS (SELECT plan_id, plan_period, manager_name, fee_type, normalized_rate, amount_usd, completeness, evidence_ref,
      concat_ws(',', CASE WHEN several THEN 'ambiguous_manager_name' END, CASE completeness WHEN 'partial' THEN 'partial_fee_disclosure' WHEN 'not_disclosed' THEN 'non_disclosure' END) AS warnings FROM fee_rows)"""

RISKS = rf"""risk_lines AS (SELECT * FROM (SELECT plan_id, plan_period, unnest([
      {{'ref': 't:1', 'label': 'Risk:Derivatives: Interest-Rate Swaps:Policy_Limit', 'value': CASE WHEN n_orders % 3 <> 0 THEN '$' || n_orders || ' million' END}}, {{'ref': 't:2', 'label': 'risk:derivatives:Interest-Rate Swaps:realized_exposure', 'value': CASE WHEN n_orders % 3 = 1 THEN (n_orders * 2) || ' thousand' END}},
      {{'ref': 't:3', 'label': 'risk:securities lending::collateral', 'value': CASE WHEN n_orders % 4 = 0 THEN CAST(n_orders * 3 AS VARCHAR) END}}, {{'ref': 't:4', 'label': 'risk:securities lending::realized_exposure', 'value': CASE WHEN n_orders % 8 = 0 THEN 'none' END}}], recursive := true) FROM plan_funding) WHERE value IS NOT NULL),
    risk_cells AS (SELECT *, replace({fold("string_split(label, ':')[2]")}, ' ', '_') AS disclosure_type, coalesce({strip("string_split(label, ':')[3]")}, 'not_specified') AS topic, {fold("string_split(label, ':')[4]")} AS field, {number('value')} AS v FROM risk_lines),
    topics AS (SELECT plan_id, plan_period, disclosure_type, disclosure_type || ':' || trim(regexp_replace(lower(topic), '[^a-z0-9]+', '_', 'g'), '_') AS base, max(v) FILTER (WHERE field = 'policy_limit') AS policy_limit, max(v) FILTER (WHERE field = 'realized_exposure') AS realized_exposure, max(v) FILTER (WHERE field = 'collateral') AS collateral,
      arg_min(value, ref) AS txt, {scale('arg_min(value, ref)', 'thousand_usd')} AS unit, string_agg(ref, ',' ORDER BY ref) AS evidence_refs FROM risk_cells GROUP BY plan_id, plan_period, disclosure_type, topic),
    silent AS (SELECT plan_id, plan_period, disclosure_type FROM plan_funding CROSS JOIN (VALUES ('derivatives'), ('securities_lending')) t(disclosure_type) WHERE (plan_id, plan_period, disclosure_type) NOT IN (SELECT (plan_id, plan_period, disclosure_type) FROM topics))"""

CONSULTANTS = rf"""said AS (SELECT plan_id, plan_period, unnest([CASE WHEN n_orders % 3 <> 0 THEN 'Consultant: Firm ' || n_orders % 4 || ' | general  ' END, CASE WHEN n_orders % 6 = 1 THEN 'CONSULTANT:FIRM ' || n_orders % 4 || '|' END, CASE WHEN n_orders % 5 = 0 THEN 'consultant: N/A | none' END,
      CASE WHEN n_orders % 2 = 0 THEN ' recommendation: Firm ' || n_orders % 4 || '|' || ['Fees', '', ' '][n_orders % 3 + 1] || '|cut|' || ['Approved', 'partially  adopted', 'tabled'][n_orders % 3 + 1] END, CASE WHEN n_orders % 7 = 0 THEN 'Attribution:unknown|fees|lower|' || ['Direct', 'inferred', ''][n_orders % 3 + 1] END]) AS txt FROM plan_funding),
    said_parts AS (SELECT *, {fold("string_split(txt, ':')[1]")} AS kind, string_split(string_split(txt, ':')[2], '|') AS p FROM said WHERE txt IS NOT NULL),
    mentioned AS (SELECT plan_id, plan_period, kind, {strip('p[1]')} AS name, {strip('p[2]')} AS a, {strip('p[3]')} AS b, {strip('p[4]')} AS c, {fold('p[1]')} AS key, {fold('p[1]')} NOT IN ('', 'n/a', 'na', 'none', 'not disclosed', 'not_disclosed', 'undisclosed', 'unknown') AS known FROM said_parts),
    firms AS (SELECT plan_id, plan_period, key AS normalized_name, min(name) AS consultant_name, CASE WHEN known THEN 'consultant:' || {token('key')} ELSE 'consultant:not_disclosed:' || {token('plan_id')} || ':' || {token('plan_period')} END AS consultant_id,
      CASE WHEN NOT known THEN 'not_disclosed' WHEN min(name) <> max(name) THEN 'ambiguous' ELSE 'resolved' END AS linkage_status, 0.86::DOUBLE AS confidence FROM mentioned WHERE kind = 'consultant' AND key <> '' GROUP BY plan_id, plan_period, key, known),
    unheard AS (SELECT plan_id, plan_period, kind FROM plan_funding CROSS JOIN (VALUES ('consultant'), ('recommendation'), ('attribution')) t(kind) WHERE (plan_id, plan_period, kind) NOT IN (SELECT (plan_id, plan_period, kind) FROM mentioned)),
    consultant_warnings AS (SELECT plan_id, plan_period, code, count(*) AS n FROM (SELECT plan_id, plan_period, 'ambiguous_naming' AS code FROM firms WHERE linkage_status = 'ambiguous' UNION ALL SELECT plan_id, plan_period, 'missing_topic' FROM mentioned WHERE kind = 'recommendation' AND a IS NULL UNION ALL SELECT plan_id, plan_period, 'non_disclosure' FROM unheard WHERE kind = 'consultant') GROUP BY ALL)"""

FOUND = """found AS (SELECT CASE WHEN l_returnflag = 'R' THEN 'schema_invalid' ELSE 'confidence_out_of_range' END AS code, 'plan:' || l_suppkey % 10 AS plan_id, 'FY' || year(l_shipdate) AS plan_period, CASE WHEN l_linenumber > 1 THEN l_returnflag ELSE '' END AS metric_name, CASE WHEN l_linenumber <= 3 THEN lower(l_linestatus) ELSE 'any' END AS message, 'p.1' AS evidence_refs, arg_max(CASE WHEN l_linestatus = 'F' THEN 'error' ELSE 'warning' END, {'a': l_orderkey, 'b': l_linenumber, 'c': l_partkey, 'd': l_extendedprice, 'e': l_linestatus}) AS severity FROM lineitem GROUP BY ALL)"""

ENTITIES = f"""old AS (SELECT 'manager:' || {token('s_name')} || ':nation ' || s_nationkey AS stable_id, ['manager', 'manager', 'fund'][s_suppkey % 3 + 1] AS entity_type, s_name AS display_name, 'old' AS metadata, CASE WHEN s_suppkey % 7 = 0 THEN 'manager:first' END AS merged_into, s_suppkey AS key FROM supplier),
    valid AS (SELECT a.stable_id AS source, b.stable_id AS target FROM old a JOIN old b ON b.key = a.key + 1 WHERE a.key % 4 = 1 AND a.merged_into IS NULL AND b.merged_into IS NULL AND a.entity_type = b.entity_type),
    merged AS (SELECT stable_id, entity_type, display_name, metadata, coalesce(merged_into, target) AS merged_into FROM old LEFT JOIN valid ON source = stable_id)"""

PEERS = """peers AS (SELECT * EXCLUDE (ava, mva), round(CASE WHEN ava > 3 THEN ava / 100 ELSE ava END, 9) AS funded_ratio_ava, round(coalesce(CASE WHEN mva > 3 THEN mva / 100 ELSE mva END, CASE WHEN liabilities <> 0 THEN assets / liabilities END), 9) AS funded_ratio_mva, CAST(fy AS VARCHAR) AS plan_period FROM (SELECT c_nationkey AS ppd_id, 2000 + c_custkey % 9 AS fy, c_mktsegment AS peer_group, CASE WHEN c_acctbal > 5000 THEN 100 * round(abs(c_acctbal) / 20000, 4) WHEN c_acctbal > 0 THEN round(abs(c_acctbal) / 20000, 4) END AS ava, CASE WHEN c_acctbal < 500 THEN -round(c_acctbal / 10000, 4) END AS mva, c_acctbal + 2000 AS assets, CASE WHEN c_custkey % 4 > 0 THEN 20000.0::DOUBLE ELSE 0 END AS liabilities,
      round(abs(c_acctbal) / 20000, 4) AS equity, CAST(round(c_acctbal, 2) AS DOUBLE) AS bonds, CASE WHEN c_custkey % 3 = 1 THEN 1::DOUBLE END AS cash FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey, c_custkey % 9 ORDER BY c_custkey DESC) = 1))"""

RECORDS = """records AS (SELECT 'plan:' || o_orderkey % 97 AS plan_id, 'o:' || o_orderkey AS plan_period, ['official', 'high-confidence-third-party', 'private', 'official-mirror'][o_orderkey % 4 + 1] AS tier, tier IN ('official', 'official-mirror') AS official, ['available_official', 'available_non_official_only', 'not_found', 'lost', 'available_official'][o_orderkey % 5 + 1] AS state,
      coalesce([NULL, 'wrong_plan', 'non_official_only', 'stale_period', NULL, 'else', NULL][o_orderkey % 7 + 1], '') AS why, [NULL, 'a', 'b'][o_orderkey % 3 + 1] AS seen, CASE WHEN o_orderkey % 2 = 0 THEN ['pagination_mode', 'rate_limit_per_minute', 'colour', 'force_canonical_host', 'requires_javascript'][o_orderkey % 5 + 1] END AS k, ['next_link', '0', ''][o_orderkey % 3 + 1] AS v FROM plan_orders)"""

COMPONENTS = f"""payload AS (SELECT plan_id || '/' || plan_period AS document_id, 'm' AS k, CASE o_orderpriority WHEN '1-URGENT' THEN 'fee' WHEN '2-HIGH' THEN 'performance' ELSE 'funded' END AS family, NULL AS manager, NULL AS fund, o_orderpriority AS ref FROM plan_orders WHERE o_orderstatus = 'F'
      UNION ALL SELECT plan_id || '/' || plan_period, 'r', NULL, manager_name, nullif(fund_name, 'Brand#11'), NULL FROM manager_fund_positions WHERE disclosure_state = 'disclosed' UNION ALL SELECT plan_id || '/' || plan_period, 'w', NULL, NULL, NULL, 'p.9' FROM plan_orders WHERE o_orderstatus = 'P'),
    counted AS (SELECT document_id, count(k) AS n, count(*) FILTER (WHERE k = 'm') AS m, count(*) FILTER (WHERE k = 'r') AS r, count(DISTINCT ref) AS refs, count(DISTINCT manager) AS managers, count(DISTINCT fund) AS funds, count(*) FILTER (WHERE family = 'performance') AS perf, count(*) FILTER (WHERE family = 'fee') AS fee
      FROM (SELECT DISTINCT plan_id || '/' || plan_period AS document_id FROM plan_orders) LEFT JOIN payload USING (document_id) GROUP BY document_id),
    component_names AS (SELECT unnest({staging.COMPONENTS}) AS name),
    judged AS (SELECT document_id, refs, name AS component_name, CASE WHEN name IN ('pension_plan', 'source_document', 'document_version', 'plan_period') THEN least(n, 1) WHEN name IN ('benchmark_definition', 'benchmark_version') THEN least(m, 1) WHEN name = 'metric_observation' THEN m WHEN name = 'evidence_reference' THEN refs
      WHEN name IN ('investment_exposure', 'plan_manager_fund_position', 'manager_lifecycle_event') THEN r WHEN name = 'manager_entity' THEN managers WHEN name = 'fund_vehicle_entity' THEN funds WHEN name = 'performance_observation' THEN perf WHEN name = 'fee_observation' THEN fee ELSE 0 END AS row_count, m FROM counted CROSS JOIN component_names),
    component_rows AS (SELECT document_id, component_name, row_count, status, CASE status WHEN 'present' THEN 1 WHEN 'partial' THEN 0.5 END::DOUBLE AS confidence, CASE WHEN status = 'not_disclosed' THEN 0 ELSE refs END AS n_refs FROM (SELECT *, CASE WHEN component_name = 'performance_observation' AND row_count = 0 AND m > 0 THEN 'partial' WHEN row_count = 0 THEN 'not_disclosed'
      WHEN component_name IN ('manager_lifecycle_event', 'benchmark_definition', 'benchmark_version') THEN 'partial' ELSE 'present' END AS status FROM judged)),
    altered AS (SELECT document_id, CASE WHEN component_name = 'document_version' AND row_count > 0 THEN 'version' ELSE component_name END AS component_name, row_count, CASE WHEN component_name = 'fee_observation' AND row_count > 2 THEN 'done' ELSE status END AS status, CASE WHEN component_name = 'manager_entity' THEN 1 ELSE confidence END AS confidence, n_refs
      FROM component_rows WHERE NOT (component_name = 'plan_period' AND row_count = 0) UNION ALL SELECT document_id, component_name, 0, 'not_disclosed', NULL, 0 FROM component_rows WHERE component_name = 'benchmark_version')"""

ORACLES = {
    "j5_overlap_inputs": sql("SELECT plan_id, plan_period, CASE WHEN asset_class = 'ECONOMY' THEN security_id ELSE asset_class END AS manager_name, security_id AS fund_name, market_value_usd AS exposure_usd, CASE WHEN asset_class = 'PROMO' THEN 'not_disclosed' ELSE disclosure_state END AS disclosure_state FROM security_positions"),
    "e7_fees": views(FEES, "SELECT * FROM fees"),
    "e9_risk_observations": views(RISKS, f"""SELECT plan_id, plan_period, disclosure_type, base || ':' || field AS metric_name, CASE field WHEN 'collateral' THEN 'collateral_context' ELSE field END AS observation_kind, round(v * {MULTIPLE.format('unit')}, 6) AS value_usd, CAST(NULL AS DOUBLE) AS value_ratio, txt AS as_reported_text, 0.84::DOUBLE AS confidence, evidence_refs
      FROM (UNPIVOT topics ON policy_limit, realized_exposure, collateral INTO NAME field VALUE v) UNION ALL SELECT plan_id, plan_period, disclosure_type, disclosure_type || ':not_disclosed', 'not_disclosed', NULL, NULL, 'not_disclosed', 0, '' FROM silent"""),
    "e9_risk_diagnostics": views(RISKS, """SELECT * FROM (SELECT plan_id, plan_period, disclosure_type, base AS metric_name, CASE WHEN policy_limit IS NOT NULL AND realized_exposure IS NULL THEN 'policy_only' WHEN policy_limit IS NULL AND realized_exposure IS NOT NULL THEN 'realized_only' WHEN policy_limit IS NULL AND collateral IS NULL THEN 'not_disclosed' END AS code, evidence_refs FROM topics) WHERE code IS NOT NULL
      UNION ALL SELECT plan_id, plan_period, disclosure_type, disclosure_type || ':not_disclosed', 'not_disclosed', '' FROM silent"""),
    "e10_consultants": views(CONSULTANTS, "SELECT * FROM firms"),
    "e10_consultant_rows": views(CONSULTANTS, f"""SELECT m.plan_id, m.plan_period, kind, coalesce(name, 'not_disclosed') AS consultant_name, CASE WHEN known THEN 'consultant:' || {token('key')} ELSE 'consultant:not_disclosed:' || {token('m.plan_id')} || ':' || {token('m.plan_period')} END AS consultant_id,
      CASE WHEN NOT known THEN 'not_disclosed' WHEN f.linkage_status = 'ambiguous' THEN 'ambiguous' ELSE 'resolved' END AS linkage_status, coalesce(a, 'not_disclosed') AS topic, CASE WHEN kind <> 'consultant' THEN coalesce(b, 'not_disclosed') END AS detail,
      CASE kind WHEN 'recommendation' THEN CASE {fold('c')} WHEN 'approved' THEN 'adopted' WHEN 'partially adopted' THEN 'partially_adopted' ELSE 'not_disclosed' END WHEN 'attribution' THEN CASE lower(c) WHEN 'direct' THEN 'explicit' WHEN 'inferred' THEN 'implied' ELSE 'speculative' END END AS rating,
      CASE kind WHEN 'consultant' THEN 0.86 WHEN 'recommendation' THEN 0.8 ELSE 0.76 END::DOUBLE AS confidence FROM mentioned m LEFT JOIN firms f ON f.plan_id = m.plan_id AND f.plan_period = m.plan_period AND f.normalized_name = m.key
      UNION ALL SELECT plan_id, plan_period, kind, 'not_disclosed', 'consultant:not_disclosed:' || {token('plan_id')} || ':' || {token('plan_period')}, 'not_disclosed', 'not_disclosed', CASE WHEN kind <> 'consultant' THEN 'not_disclosed' END, CASE kind WHEN 'recommendation' THEN 'not_disclosed' WHEN 'attribution' THEN 'speculative' END, 0 FROM unheard"""),
    "e10_consultant_warnings": views(CONSULTANTS, "SELECT * FROM consultant_warnings"),
    "e11_staged_facts": views(f"history AS ({statements.HISTORY})", f"SELECT {digest('fact', 'plan_id', 'plan_period', 'metric_family', 'metric_name', 'manager_name', 'fund_name', chr(39) + '2024-06-30' + chr(39), chr(39) + 'v1' + chr(39), 'coalesce(refs, ' + chr(39) * 2 + ')')} AS fact_id, plan_id, plan_period, metric_family, metric_name, value, manager_name, fund_name, confidence, coalesce(refs, '') AS refs FROM history"),
    "e11_relationships": views("held AS (SELECT plan_id, plan_period, CASE WHEN right(manager_name, 1) <> '3' THEN manager_name WHEN disclosure_state = 'not_disclosed' THEN '[not_disclosed]' ELSE '[unknown_manager]' END AS manager_name, fund_name, CASE WHEN disclosure_state = 'not_disclosed' THEN disclosure_state ELSE 'partial' END AS completeness FROM manager_fund_positions)",
        f"SELECT {digest('rel', 'plan_id', 'plan_period', 'manager_name', 'fund_name', 'completeness', chr(39) + '2024-06-30' + chr(39))} AS relationship_id, * FROM held"),
    "e12_staged_securities": "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'cusip:AB' || p_partkey WHEN p_partkey % 3 = 0 THEN 'ticker:T' || p_partkey ELSE 'name:' || lower(p_name) END AS security_id, p_name AS security_name, CASE WHEN p_partkey % 3 = 0 THEN 'T' || p_partkey END AS ticker, lower(p_type) AS asset_class, CASE WHEN p_partkey % 5 <> 0 THEN greatest(0, least(1, (p_size - 10) / 20)) END::DOUBLE AS confidence, CASE WHEN p_partkey % 4 = 0 THEN '2024-01-01' ELSE '2024-06-30' END AS valid_from, '2024-06-30' AS asserted_at, 'm' AS manager_name, CAST(NULL AS VARCHAR) AS fund_name FROM part",
    "e14_stage_ledger": "SELECT l_linestatus AS stage, l_returnflag AS domain, CAST(sum(l_linenumber) AS BIGINT) AS record_count, count(*) FILTER (WHERE l_returnflag = 'R' AND l_linenumber = 7) AS error_count, count(*) AS attempt_count, CASE WHEN count(*) FILTER (WHERE l_returnflag = 'R' AND l_linenumber = 7) = 0 THEN 'ok' ELSE 'error' END AS status FROM lineitem GROUP BY ALL",
    "u6_warnings": views(FEES + ",\n" + CONSULTANTS, f"""SELECT *, {digest('warn', 'warning_domain', 'plan_id', 'plan_period', 'code', 'manager_name', 'fund_name', 'metric_name')} AS warning_id FROM (
      SELECT DISTINCT 'investment_fee' AS warning_domain, plan_id, plan_period, code, manager_name, CAST(NULL AS VARCHAR) AS fund_name, CAST(NULL AS VARCHAR) AS metric_name FROM (SELECT *, unnest(string_split(warnings, ',')) AS code FROM fees) WHERE code <> '' UNION ALL SELECT 'consultant', plan_id, plan_period, code, NULL, NULL, NULL FROM consultant_warnings)"""),
    "u7_distinct_findings": f"WITH {FOUND} SELECT * FROM found",
    "d5_parser_anomalies": views(FOUND, f"""SELECT DISTINCT plan_id, plan_period, metric_name, severity, code AS source, TRUE AS publish_blocked, {digest('parser-anomaly', 'plan_id', 'plan_period', 'metric_name', 'code')} AS anomaly_id FROM found WHERE severity = 'error'
      UNION ALL SELECT plan_id, plan_period, 'funded_ratio', 'warning', CAST(o_orderkey AS VARCHAR), FALSE, {digest('parser-anomaly', chr(39) + 'low_confidence' + chr(39), 'plan_id', 'plan_period', chr(39) + 'funded_ratio' + chr(39), 'o_orderkey')} FROM plan_orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F'"""),
    "b8_artifact_chains": "SELECT event_id AS artifact_id, min(event_id) OVER w AS root, row_number() OVER (w ORDER BY event_id) - 1 AS place FROM events WINDOW w AS (PARTITION BY user_id, event_type)",
    "b10_upserted_entities": f"WITH {ENTITIES} SELECT stable_id, entity_type, display_name, CASE WHEN key % 2 = 0 AND merged_into IS NULL THEN 'v2' ELSE metadata END AS metadata, merged_into FROM old UNION ALL SELECT 'plan:' || {token('c_name')}, 'plan', c_name, 'v1', NULL FROM customer",
    "b10_merge_rejects": f"""WITH {ENTITIES}, wish AS (SELECT DISTINCT source, target FROM (
      SELECT a.stable_id AS source, b.stable_id AS target FROM old a JOIN old b ON (a.key % 4 = 1 AND b.key = a.key + 1) OR (a.key % 8 = 2 AND b.key = a.key + 1) OR (a.key % 12 = 1 AND b.key = a.key + 2) OR (a.key % 5 = 0 AND b.key = a.key)
      UNION ALL SELECT stable_id, 'manager:nobody' FROM old WHERE key % 9 = 4 UNION ALL SELECT 'manager:nobody', stable_id FROM old WHERE key % 9 = 4))
      SELECT source, target, reason FROM (SELECT w.source, w.target, CASE WHEN w.source = w.target THEN 'same_id' WHEN a.stable_id IS NULL THEN 'unknown_source' WHEN b.stable_id IS NULL THEN 'unknown_target' WHEN a.entity_type <> b.entity_type THEN 'entity_type' WHEN a.merged_into IS NOT NULL THEN 'source_merged' WHEN b.merged_into IS NOT NULL THEN 'target_merged'
        WHEN (SELECT count(DISTINCT x.target) FROM wish x WHERE x.source = w.source) > 1 THEN 'several_targets' WHEN w.target IN (SELECT source FROM wish) THEN 'target_in_batch' END AS reason FROM wish w LEFT JOIN old a ON a.stable_id = w.source LEFT JOIN old b ON b.stable_id = w.target) WHERE reason IS NOT NULL""",
    "b10_merged_entities": f"WITH {ENTITIES} SELECT * FROM merged",
    "b10_entity_links": f"WITH {ENTITIES} SELECT coalesce(target, stable_id) AS stable_id, l_returnflag AS source_table, CAST(l_partkey % 50 AS VARCHAR) AS source_record_id, string_agg(DISTINCT 'p.' || l_linenumber, ',' ORDER BY 'p.' || l_linenumber) AS refs FROM lineitem JOIN old ON key = l_suppkey LEFT JOIN valid ON source = stable_id WHERE l_returnflag <> 'A' GROUP BY ALL",
    "b11_active_entities": f"WITH {ENTITIES} SELECT stable_id, entity_type FROM merged WHERE merged_into IS NULL",
    "b17_peer_universe": f"WITH {PEERS} SELECT ppd_id, fy, peer_group, funded_ratio_ava, funded_ratio_mva FROM peers",
    "b18_peer_funding": f"WITH {PEERS} SELECT ppd_id AS plan_id, plan_period, coalesce(funded_ratio_ava, funded_ratio_mva, 0) AS funded_ratio FROM peers",
    "b18_peer_allocations": f"WITH {PEERS} SELECT ppd_id AS plan_id, plan_period, peer_group, asset_class, CASE WHEN w <= 1 THEN w * 100 ELSE w END AS allocation_pct FROM (UNPIVOT peers ON equity, bonds, cash INTO NAME asset_class VALUE w) WHERE w >= 0",
    "a10_stage_telemetry": views("runs AS (SELECT plan_id || '/' || plan_period AS run_id, CAST(n_orders AS DOUBLE) AS n_orders, round(funded_ratio, 6) AS completeness, employer_contributions_usd AS latency FROM plan_funding)", "SELECT run_id, CASE metric_name WHEN 'n_orders' THEN 'ingestion' WHEN 'latency' THEN 'review' ELSE 'extraction' END AS stage, metric_name, value FROM (UNPIVOT runs ON n_orders, completeness, latency INTO NAME metric_name VALUE value)"),
    "a31_evaluation": """WITH c AS (SELECT o_orderpriority AS suite, o_orderstatus <> 'P' AS ok, o_totalprice < 400000 AS safe, list_distinct(list(l_partkey) FILTER (WHERE l_discount > 0.03)) AS e, list_distinct(list(l_partkey) FILTER (WHERE l_returnflag <> 'R')) AS a FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderpriority, o_orderstatus, o_totalprice),
      x AS (SELECT suite, ok, safe, coalesce(e, []) AS e, coalesce(a, []) AS a FROM c),
      r AS (SELECT suite, avg(ok::INT) AS s, avg(CASE WHEN len(e) = 0 THEN 1 ELSE len(list_intersect(e, a)) / len(e) END) AS k, avg(list_has_all(e, a)::INT) AS h, avg(safe::INT) AS f FROM x GROUP BY suite)
      SELECT suite, round(s, 6) AS schema_validity_rate, round(k, 6) AS citation_coverage_rate, round(h, 6) AS no_hallucination_rate, round(f, 6) AS safety_pass_rate, fails AS failures, CASE WHEN fails = '' THEN 'pass' ELSE 'fail' END AS status
      FROM (SELECT *, concat_ws(',', CASE WHEN s < 0.9 THEN 'schema_validity_rate' END, CASE WHEN k < 0.6 THEN 'citation_coverage_rate' END, CASE WHEN h < 0.2 THEN 'no_hallucination_rate' END, CASE WHEN f < 1 THEN 'unsafe_cases' END) AS fails FROM r)""",
    "d6_missing_envelopes": "SELECT * FROM (SELECT o_orderkey AS row_id, concat_ws(',', CASE WHEN o_orderkey % 3 = 0 THEN 'run_id' END, CASE WHEN o_orderkey % 5 = 0 THEN 'config_hash' END, CASE WHEN o_orderstatus = 'P' THEN 'generated_at' END, CASE WHEN o_orderkey % 2 <> 0 THEN 'seed' END, CASE WHEN o_orderkey % 4 = 0 THEN 'source_artifact_ids' END) AS missing FROM orders) WHERE missing <> ''",
    "q5_alias_queue": "SELECT p_name AS source_name, p_partkey AS source_record_id, p_brand || ',' || p_type AS candidate_ids, 0.5::DOUBLE AS confidence, ['high', 'none', 'medium', 'low'][p_partkey % 4 + 1] AS review_priority FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 4 IN (0, 2)",
    "p29_seed_defaults": """SELECT o_orderkey, coalesce(nullif(p, ''), 'UNKNOWN') AS plan_period, coalesce(nullif(b, ''), 'v1') AS benchmark_version, coalesce(nullif(i, ''), e) AS ingestion_date, e AS effective_date, e AS valid_from, coalesce(t, nullif(i, ''), e) AS asserted_at, coalesce(trim(u) <> '', FALSE) AS restated
      FROM (SELECT o_orderkey, ['', 'FY1', NULL][o_orderkey % 3 + 1] AS p, ['v2', ''][o_orderkey % 2 + 1] AS b, CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN '2024-01-01' END AS i, strftime(o_orderdate, '%Y-%m-%d') AS e, CASE WHEN o_orderkey % 7 = 0 THEN '2025-01-01' END AS t, [' ', NULL, '2025-02-02'][o_orderkey % 3 + 1] AS u FROM orders)""",
    "p37_text_refs": "SELECT l_orderkey, ['p.' || l_orderkey || CASE WHEN l_orderkey <> 1 THEN ';p.1' ELSE '' END, 'p.' || l_orderkey || CASE WHEN l_orderkey <> 2 THEN ';p.2' ELSE '' END, '[p.' || l_orderkey || ';p.3]', ''][l_orderkey % 4 + 1] AS refs FROM lineitem WHERE l_linenumber = 1",
    "a18_components": views(COMPONENTS, "SELECT * FROM component_rows"),
    "a19_component_findings": views(COMPONENTS, f"""SELECT DISTINCT document_id, component_name, code FROM (
      SELECT document_id, component_name, unnest([CASE WHEN component_name NOT IN (SELECT name FROM component_names) THEN 'unexpected_component' END, CASE WHEN NOT known THEN 'invalid_state' END, CASE WHEN known AND shown = (n_refs = 0) THEN 'evidence_refs' END,
        CASE WHEN known AND confidence IS DISTINCT FROM CASE status WHEN 'present' THEN 1 WHEN 'partial' THEN 0.5 END THEN 'confidence' END, CASE WHEN known AND NOT shown AND row_count <> 0 THEN 'row_count' END]) AS code FROM (SELECT *, status IN ('present', 'partial', 'not_disclosed') AS known, status IN ('present', 'partial') AS shown FROM altered)
      UNION ALL SELECT document_id, component_name, CASE WHEN count(DISTINCT status) > 1 THEN 'mixed_state' END FROM altered WHERE status <> 'done' GROUP BY ALL
      UNION ALL SELECT document_id, name, 'missing_component' FROM (SELECT DISTINCT document_id FROM altered) CROSS JOIN component_names WHERE (document_id, name) NOT IN (SELECT (document_id, component_name) FROM altered)) WHERE code IS NOT NULL"""),
    "d2_entry_findings": f"""WITH cells AS (SELECT 'plan:' || o_orderkey AS plan_id, ['https://', 'HTTP://', 'ftp://', ''][o_orderkey % 4 + 1] || 'site' || o_orderkey || '.example/x' AS seed_url, ['a.example; b.example', 'localhost;c.example', ' ; ', 'a b.example', 'z.example'][o_orderkey % 5 + 1] AS dom, ['annual_report', 'investment_report;annual_report', 'brochure'][o_orderkey % 3 + 1] AS hints,
        ['next_link', '', 'query_param'][o_orderkey % 3 + 1] AS pages, ['10', '0', 'ten', '5', ' 7 ', '3'][o_orderkey % 6 + 1] AS max_pages, ['0', '1', '2', '3', '-1'][o_orderkey % 5 + 1] AS max_depth, nullif(['official', '', 'private', 'official-mirror'][o_orderkey % 4 + 1], '') AS tier, nullif(['', 'wrong_plan', 'other'][o_orderkey % 3 + 1], '') AS why,
        ['true', 'yes', NULL][o_orderkey % 3 + 1] AS js, nullif(['250', '0', 'soon', '', '1'][o_orderkey % 5 + 1], '') AS wait, nullif(['', 'single_page', 'scroll', ''][o_orderkey % 4 + 1], '') AS mode, [NULL, 'x', NULL, NULL, NULL, NULL, NULL][o_orderkey % 7 + 1] AS colour FROM orders),
      lists AS (SELECT *, list_filter(list_transform(string_split(dom, ';'), lambda x: trim(x)), lambda x: x <> '') AS domains, string_split(hints, ';') AS h FROM cells)
      SELECT plan_id, seed_url, code FROM (SELECT plan_id, seed_url, unnest([CASE WHEN NOT regexp_matches(lower(seed_url), '^https?://[^/?#]') THEN 'invalid_url' END, CASE WHEN len(domains) = 0 THEN 'missing_allowed_domains' END, CASE WHEN len(list_filter(domains, lambda x: NOT contains(x, '.') OR contains(x, ' '))) > 0 THEN 'invalid_allowed_domain' END,
        CASE WHEN list_contains(h, 'annual_report') AND tier IS NULL THEN 'missing_authority_tier' END, CASE WHEN tier NOT IN ('official', 'official-mirror', 'high-confidence-third-party') THEN 'invalid_authority_tier' END, CASE WHEN list_contains(h, 'brochure') THEN 'invalid_doc_type_hint' END, CASE WHEN pages NOT IN ('', 'single_page', 'next_link', 'page_param') THEN 'invalid_pagination_hint' END,
        CASE WHEN why NOT IN ('wrong_plan', 'stale_period', 'non_official_only') THEN 'invalid_mismatch_reason' END, CASE WHEN coalesce(TRY_CAST(trim(max_pages) AS INT), -1) < 1 OR coalesce(TRY_CAST(max_depth AS INT), -1) < 0 THEN 'invalid_crawl_constraints' END, CASE WHEN colour IS NOT NULL THEN 'invalid_override_key' END,
        CASE WHEN mode NOT IN ('single_page', 'next_link', 'query_param', 'path_segment') THEN 'invalid_override_value' END, CASE WHEN js NOT IN ('true', 'false') THEN 'invalid_override_value' END, CASE WHEN wait IS NOT NULL AND coalesce(TRY_CAST(wait AS INT), -1) <= 0 THEN 'invalid_override_value' END]) AS code FROM lists) WHERE code IS NOT NULL""",
    "d3_record_findings": views(RECORDS, """SELECT plan_id, plan_period, code FROM (SELECT plan_id, plan_period, unnest([CASE WHEN tier = 'private' THEN 'invalid_tier' END, CASE WHEN state NOT IN ('available_official', 'available_non_official_only', 'not_found') THEN 'invalid_state' END, CASE WHEN why NOT IN ('', 'wrong_plan', 'stale_period', 'non_official_only') THEN 'invalid_reason' END,
        CASE WHEN state = 'available_official' AND NOT official THEN 'official_needs_official_tier' END, CASE WHEN state = 'available_non_official_only' AND official THEN 'non_official_with_official_tier' END, CASE WHEN why = 'wrong_plan' AND seen IS NULL THEN 'wrong_plan_without_identity' END, CASE WHEN why = 'wrong_plan' AND seen = 'a' THEN 'wrong_plan_with_same_identity' END,
        CASE WHEN why <> 'wrong_plan' AND seen IS NOT NULL THEN 'identity_without_wrong_plan' END, CASE WHEN state = 'available_non_official_only' AND why <> 'non_official_only' THEN 'non_official_needs_reason' END, CASE WHEN why IN ('wrong_plan', 'stale_period') AND state <> 'available_official' THEN 'mismatch_needs_official' END, CASE WHEN why = 'non_official_only' AND state <> 'available_non_official_only' THEN 'reason_needs_non_official' END,
        CASE k WHEN 'colour' THEN 'unknown_override' WHEN 'pagination_mode' THEN CASE WHEN v <> 'next_link' THEN 'invalid_pagination_mode' END WHEN 'requires_javascript' THEN 'invalid_requires_javascript' WHEN 'rate_limit_per_minute' THEN CASE WHEN coalesce(TRY_CAST(v AS INT), 0) <= 0 THEN 'invalid_rate_limit' END WHEN 'force_canonical_host' THEN CASE WHEN v = '' THEN 'invalid_canonical_host' END END]) AS code FROM records) WHERE code IS NOT NULL"""),
    "d3_conflicting_overrides": views(RECORDS, "SELECT plan_id, 'conflicting_overrides' AS code FROM records GROUP BY plan_id HAVING count(DISTINCT coalesce(k || '=' || v, '')) > 1"),
    "d7_artifact_findings": """WITH f AS (SELECT l_orderkey AS artifact_id, 'f' || l_linenumber AS finding_id, l_returnflag = 'R' AS no_period, CAST(l_discount * 11 AS DOUBLE) AS confidence, l_linestatus = 'F' AS fatal, l_tax > 0.01 AS cited FROM lineitem WHERE l_quantity > 15),
      a AS (SELECT l_orderkey AS artifact_id, CASE WHEN l_suppkey % 4 = 1 THEN 'compare' WHEN l_suppkey % 4 = 2 AND l_tax > 0.05 THEN 'guess' ELSE 'explain' END AS action, list_distinct(['f' || l_linenumber, 'f1']) AS ids FROM lineitem WHERE l_suppkey % 4 < 3),
      n AS (SELECT artifact_id, coalesce(n, 0) AS n, coalesce(c, FALSE) AS c, coalesce(e, FALSE) AS e FROM (SELECT artifact_id, count(*) AS n FROM f GROUP BY ALL) FULL JOIN (SELECT artifact_id, bool_or(action = 'compare') AS c, bool_or(action = 'explain') AS e FROM a GROUP BY ALL) USING (artifact_id))
      SELECT artifact_id, 'missing_period' AS code FROM f WHERE no_period UNION SELECT artifact_id, 'invalid_confidence' FROM f WHERE confidence > 1 UNION SELECT artifact_id, 'invalid_severity' FROM f WHERE fatal UNION SELECT artifact_id, 'missing_citations' FROM f WHERE NOT cited
      UNION SELECT artifact_id, 'invalid_action' FROM a WHERE action = 'guess' UNION SELECT artifact_id, 'short_compare' FROM a WHERE action = 'compare' AND len(ids) < 2 UNION SELECT x.artifact_id, 'unknown_finding' FROM (SELECT artifact_id, unnest(ids) AS id FROM a) x LEFT JOIN f ON f.artifact_id = x.artifact_id AND f.finding_id = x.id WHERE f.finding_id IS NULL
      UNION SELECT artifact_id, 'no_findings' FROM n WHERE n = 0 UNION SELECT artifact_id, 'wrong_actions' FROM n WHERE NOT e OR c <> (n >= 2)""",
}
