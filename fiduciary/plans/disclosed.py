"""Registered queries of disclosed rows, run quality and refresh plans, each beside its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import disclosures, history, validation
from . import domain as D
from . import registry
from .oracle import sql

Query = Callable[[SparkSession, str], DataFrame]


def flow_labels(s: SparkSession, d: str) -> DataFrame:
    """What a plan reports in a period, as labels and values in thousands; refunds are missing every second time."""
    f = D.plan_funding(s, d)
    pairs = {"Beginning  AUM": F.col("total_usd"), "Ending AUM": F.col("total_usd") + 50, "Employer Contributions": F.col("employer_contributions_usd"), "employee_contributions": F.col("employee_contributions_usd"), "Benefit Payments": F.col("benefit_payments_usd"), "Refunds": F.when(F.col("n_orders") % 2 == 0, F.lit(10.0))}
    rows = F.array(*[F.struct(F.lit(k).alias("label"), v.cast("double").alias("value")) for k, v in pairs.items()])
    return f.select("plan_id", "plan_period", F.inline(rows)).withColumn("unit", F.lit("thousand_usd"))


def financial_flows(s: SparkSession, d: str) -> DataFrame:
    return disclosures.financial_flows(flow_labels(s, d)).select("plan_id", "plan_period", "disclosure_level", "warnings", *[F.round(c, 2).alias(c) for c in ("benefit_payments", "refunds", "net_external_cash_flow_usd", "consistency_gap_usd")], "net_external_cash_flow_rate_pct")


def allocations(s: SparkSession, d: str) -> DataFrame:
    a = D.plan_allocation(s, d)
    by_percent = F.col("asset_class").isin("PROMO", "LARGE")
    return disclosures.allocations(a.select("plan_id", "plan_period", F.concat(F.lit("Allocation: "), "asset_class").alias("label"), F.when(by_percent, F.round("allocation_pct", 4) * 100).alias("percent_value"), F.when(~by_percent, F.round("allocation_pct", 4)).alias("amount_value"), F.lit("million_usd").alias("unit")))


def positions(s: SparkSession, d: str) -> DataFrame:
    """A supplier's deliveries as positions: market value always, commitment and unfunded for some, every fifth in capitals."""
    lines = D.position_lines(s, d)
    key = F.col("l_orderkey")
    name = F.when(key % 5 == 0, F.upper("s_name")).otherwise(F.col("s_name"))
    field = F.when(key % 3 == 0, "commitment").when(key % 3 == 1, " Unfunded").otherwise("market_value")
    return disclosures.manager_positions(lines.select("plan_id", "plan_period", F.concat(F.lit("position:"), name, F.lit(":"), F.col("p_brand"), F.lit(":"), field).alias("label"), F.col("net").cast("double").alias("value")))


def security_ids(s: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return D.table(s, d, "part").select("p_partkey", disclosures.security_id(F.when(k % 4 == 0, F.concat(F.lit(" ab-"), k.cast("string"))), F.when(k % 4 < 2, F.concat(F.lit("t"), k.cast("string"))).when(k % 4 == 2, " "), F.when(k % 8 < 7, F.col("p_name"))).alias("security_id"))


def survey_cells(s: SparkSession, d: str) -> DataFrame:
    k, b = F.col("c_custkey"), F.col("c_acctbal")
    cents = F.round(b * 100).cast("bigint")
    cell = F.when(k % 5 == 0, " N/A ").when(k % 5 == 1, F.concat(cents.cast("string"), F.lit(","), F.lit("000"))).when(k % 5 == 2, "inf").otherwise(F.concat(F.lit(" "), cents.cast("string"), F.lit(".0")))
    direct = F.when(k % 3 == 0, (k % 100).cast("double")).when(k % 3 == 1, (k % 7) / 8)
    return D.table(s, d, "customer").select("c_custkey", disclosures.cell_number(cell).alias("number"), disclosures.whole(F.concat(k.cast("string"), F.when(k % 2 == 0, ".0").otherwise(".5"))).alias("plan_number"), disclosures.funded_fraction(direct, F.lit(8.0), (k % 9).cast("double")).alias("funded_ratio"))


def runs(s: SparkSession, d: str) -> DataFrame:
    """A month of orders as a run."""
    rows = D.table(s, d, "orders").groupBy(F.date_trunc("month", F.col("o_orderdate").cast("timestamp")).cast("timestamp_ntz").alias("m")).agg(
        F.count(F.lit(1)).alias("records_total"), F.count_if(F.col("o_orderstatus") == "F").alias("records_complete"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("review_items"), F.count_if(F.col("o_orderkey") % 7 == 0).alias("parse_warnings"),
        F.count_if(F.col("o_orderkey") % 2 == 0).alias("cited_facts"), F.count_if(F.col("o_orderkey") % 40 == 0).alias("total_pages"), F.max("o_orderdate").alias("run_started_at"), F.sum(F.col("o_orderkey") % 24).alias("review_wait_hours"),
    )
    return disclosures.run_sla(rows.withColumns({"run_id": F.date_format("m", "yyyy-MM"), "source_published_at": F.col("m") + F.expr("INTERVAL 20 DAYS")}))


def latest(s: SparkSession, d: str) -> DataFrame:
    return registry.publications(s, d).groupBy("system_id", "source_id").agg(F.max("published_at").alias("published_at"))


def refresh(s: SparkSession, d: str) -> DataFrame:
    return disclosures.refresh_windows(history.cadence_profiles(registry.publications(s, d)), latest(s, d), "2024-05-20")


METRICS = ["funded_ratio", "aal_usd", "discount_rate", "participant_count"]


def parsed(s: SparkSession, d: str) -> DataFrame:
    """Four orders as the parsed rows of a document, one a metric; every 29th is missing and some break a rule."""
    k = F.col("o_orderkey")
    value = F.when(k % 4 == 0, (k % 11) / 4).when(k % 4 == 1, F.when(k % 33 == 0, -F.col("o_totalprice")).otherwise(F.col("o_totalprice"))).when(k % 4 == 2, (k % 23) / 20).when(k % 37 > 0, F.lit(5.0))
    ref = F.when(k % 6 == 0, "p.3#Table").when(k % 6 == 1, "text:4").when(k % 6 == 2, "table:x").when(k % 31 == 0, "Page 3").otherwise("p.1")
    rows = D.table(s, d, "orders").where("o_orderkey % 29 > 0").select(
        F.floor(k / 4).alias("document_id"), F.when(k % 41 == 0, " ").otherwise(F.concat(F.lit("P"), F.floor(k / 4).cast("string"))).alias("plan_id"), F.lit("FY2020").alias("plan_period"), F.element_at(F.array(*map(F.lit, METRICS)), (k % 4 + 1).cast("int")).alias("metric_name"), value.alias("normalized_value"),
        F.when(k % 43 == 0, F.lit(None)).otherwise(F.lit("usd")).alias("normalized_unit"), ((k % 53) / 51).alias("confidence"), F.when(k % 47 == 0, F.array().cast("array<string>")).otherwise(F.array(ref)).alias("evidence_refs"),
    )
    return rows.withColumns({c: F.lit("x") for c in validation.REQUIRED_FIELDS if c not in rows.columns})


def promotable(s: SparkSession, d: str) -> DataFrame:
    rows = parsed(s, d)
    return validation.promotable(rows, validation.findings(rows, METRICS)).select("document_id", "metric_name")


def system_types(s: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    c = D.table(s, d, "customer")
    registry_rows = c.where("c_custkey % 3 > 0").select(F.concat(F.when(k % 2 == 0, "PS-").otherwise("x-"), k.cast("string")).alias("stable_id"), F.col("c_mktsegment").alias("system_type"), k.alias("seq"))
    plans = c.select(F.concat(F.when(k % 4 == 0, "").when(k % 4 == 2, "ps-").otherwise(" X-"), k.cast("string")).alias("plan_id"), F.lit("cohort").alias("cohort"))
    return validation.system_types(plans, registry_rows)


def manifest_changes(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = D.table(s, d, "orders").select("o_orderkey", "o_orderstatus")
    return validation.key_changes(rows.where(k % 5 > 0), rows.where(k % 7 > 0).withColumn("o_orderstatus", F.when(k % 11 == 0, "X").otherwise(F.col("o_orderstatus"))), ["o_orderkey"], "o_orderstatus")


QUERIES: dict[str, Query] = {
    "d4_findings": lambda s, d: validation.findings(parsed(s, d), METRICS),
    "d4_promotable": promotable,
    "j17_system_types": system_types,
    "u8_key_changes": manifest_changes,
    "e5_financial_flows": financial_flows,
    "e6_allocations": allocations,
    "e8_manager_positions": positions,
    "p13_security_ids": security_ids,
    "p16_survey_cells": survey_cells,
    "a8_run_sla": runs,
    "w8_latest_publication": latest,
    "w10_refresh_windows": refresh,
}

PROFILES = """SELECT system_id, source_id, m AS f, months, l, CASE WHEN g IS NULL THEN 0.25 WHEN n < 3 THEN round(0.2::DOUBLE + 0.2::DOUBLE * (n / 3), 3) WHEN mean <= 0 THEN 0 ELSE round(least(0.35::DOUBLE + 0.45::DOUBLE * greatest(0, 1 - least(sd / mean, 1)) + 0.2::DOUBLE * least(n / 8, 1), 0.99), 3) END AS c FROM (
    SELECT system_id, source_id, round(coalesce(median(gap), 365), 3) AS m, median(gap) AS g, avg(gap) AS mean, stddev_pop(gap) AS sd, list_distinct(list(month(published_at))) AS months, count(*) AS n, max(published_at) AS l FROM (
    SELECT *, (epoch_us(published_at) - epoch_us(lag(published_at) OVER (PARTITION BY system_id, source_id ORDER BY published_at))) / 1e6::DOUBLE / 86400 AS gap FROM publications) GROUP BY system_id, source_id)"""
NEXT_MONTH = "(SELECT min(make_date(year({b}) + CASE WHEN x < month({b}) THEN 1 ELSE 0 END, x, 1)) FROM (SELECT unnest(months) AS x))::TIMESTAMP"
NOW = "TIMESTAMP '2024-05-20'"

PARSED = """SELECT k // 4 AS document_id, k, CASE WHEN k % 41 = 0 THEN ' ' ELSE 'P' || (k // 4) END AS plan_id, ['funded_ratio', 'aal_usd', 'discount_rate', 'participant_count'][k % 4 + 1] AS metric_name, CASE k % 4 WHEN 0 THEN (k % 11) / 4 WHEN 1 THEN CASE WHEN k % 33 = 0 THEN -o_totalprice ELSE o_totalprice END WHEN 2 THEN (k % 23) / 20 ELSE CASE WHEN k % 37 > 0 THEN 5 END END AS v
    FROM (SELECT *, o_orderkey AS k FROM orders) WHERE k % 29 > 0"""
FOUND = f"""SELECT DISTINCT document_id, plan_id, 'FY2020' AS plan_period, metric_name, code, detail FROM ({PARSED}) CROSS JOIN (VALUES ('schema_invalid', 'plan_id'), ('schema_invalid', 'normalized_unit'), ('confidence_out_of_range', ''), ('normalized_value_missing', ''), ('numeric_out_of_range', ''), ('provenance_missing', ''), ('provenance_invalid', '')) r(code, detail)
    WHERE CASE WHEN detail = 'plan_id' THEN k % 41 = 0 WHEN detail = 'normalized_unit' THEN k % 43 = 0 WHEN code = 'confidence_out_of_range' THEN k % 53 > 51 WHEN code = 'normalized_value_missing' THEN v IS NULL WHEN code = 'numeric_out_of_range' THEN (k % 4 = 0 AND v > 2) OR (k % 4 = 1 AND v < 0) OR (k % 4 = 2 AND v > 1) WHEN code = 'provenance_missing' THEN k % 47 = 0 ELSE k % 47 > 0 AND k % 31 = 0 AND k % 6 > 2 END
    UNION ALL SELECT document_id, p, 'FY2020', m, 'required_metric_missing', '' FROM (SELECT document_id, min(plan_id) AS p, list(metric_name) AS have FROM ({PARSED}) GROUP BY document_id) CROSS JOIN (VALUES ('funded_ratio'), ('aal_usd'), ('discount_rate'), ('participant_count')) q(m) WHERE NOT list_contains(have, m)"""

ORACLES = {
    "d4_findings": FOUND,
    "d4_promotable": f"SELECT document_id, metric_name FROM ({PARSED}) WHERE document_id NOT IN (SELECT document_id FROM ({FOUND}))",
    "j17_system_types": "SELECT CASE c_custkey % 4 WHEN 0 THEN '' WHEN 2 THEN 'ps-' ELSE ' X-' END || c_custkey AS plan_id, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment ELSE 'cohort' END AS system_type FROM customer",
    "u8_key_changes": """SELECT k AS o_orderkey, CASE WHEN k % 5 > 0 THEN o_orderstatus END AS before, CASE WHEN k % 7 = 0 THEN NULL WHEN k % 11 = 0 THEN 'X' ELSE o_orderstatus END AS after, CASE WHEN k % 7 = 0 THEN 'removed' WHEN k % 5 = 0 THEN 'added' ELSE 'changed' END AS change FROM (SELECT *, o_orderkey AS k FROM orders) WHERE CASE WHEN k % 5 = 0 THEN k % 7 > 0 ELSE k % 7 = 0 OR k % 11 = 0 END""",
    "e5_financial_flows": sql("""SELECT plan_id, plan_period, CASE WHEN n_orders % 2 = 0 AND c = 3 THEN 'complete' ELSE 'partial' END AS disclosure_level, CASE WHEN n_orders % 2 = 0 AND c = 3 THEN '' ELSE 'partial_disclosure' || CASE WHEN abs(g) > 1 THEN ',' ELSE '' END END || CASE WHEN abs(g) > 1 THEN 'consistency_gap' ELSE '' END AS warnings,
        round(-b * 1000, 2) AS benefit_payments, CASE WHEN n_orders % 2 = 0 THEN -10000.0::DOUBLE END AS refunds, round(net * 1000, 2) AS net_external_cash_flow_usd, round(g, 2) AS consistency_gap_usd, round(round(net * 1000, 6) / (total_usd * 1000) * 100, 6) AS net_external_cash_flow_rate_pct FROM (SELECT *, 50000 - net * 1000 AS g FROM (
        SELECT *, benefit_payments_usd AS b, coalesce(employer_contributions_usd, 0) + coalesce(employee_contributions_usd, 0) - coalesce(benefit_payments_usd, 0) - CASE WHEN n_orders % 2 = 0 THEN 10 ELSE 0 END AS net,
        CASE WHEN employer_contributions_usd IS NULL THEN 0 ELSE 1 END + CASE WHEN employee_contributions_usd IS NULL THEN 0 ELSE 1 END + CASE WHEN benefit_payments_usd IS NULL THEN 0 ELSE 1 END AS c FROM plan_funding))"""),
    "e6_allocations": sql("""SELECT plan_id, plan_period, lower(asset_class) AS category, CASE WHEN p THEN v * 100 END AS percent_value, CASE WHEN NOT p THEN round(v * 1e6::DOUBLE, 6) END AS amount_usd, CASE WHEN p THEN round(CASE WHEN v * 100 > 1 THEN v * 100 / 100 ELSE v * 100 END, 9) ELSE round(round(v * 1e6::DOUBLE, 6) / t, 9) END AS weight FROM (
        SELECT *, asset_class IN ('PROMO', 'LARGE') AS p, round(allocation_pct, 4) AS v, CAST(sum(CASE WHEN asset_class NOT IN ('PROMO', 'LARGE') THEN CAST(round(allocation_pct, 4) * 1e6::DOUBLE AS DECIMAL(28,6)) END) OVER (PARTITION BY plan_id, plan_period) AS DOUBLE) AS t FROM plan_allocation)"""),
    "e8_manager_positions": sql("""SELECT plan_id, plan_period, manager_name, p_brand AS fund_name, commitment, unfunded, market_value, CASE WHEN commitment IS NOT NULL AND unfunded IS NOT NULL AND market_value IS NOT NULL THEN 'complete' ELSE 'partial' END AS completeness, count(*) OVER (PARTITION BY plan_id, plan_period, lower(manager_name), p_brand) > 1 AS ambiguous FROM (
        SELECT plan_id, plan_period, CASE WHEN l_orderkey % 5 = 0 THEN upper(s_name) ELSE s_name END AS manager_name, p_brand, CAST(max(net) FILTER (WHERE l_orderkey % 3 = 0) AS DOUBLE) AS commitment, CAST(max(net) FILTER (WHERE l_orderkey % 3 = 1) AS DOUBLE) AS unfunded, CAST(max(net) FILTER (WHERE l_orderkey % 3 = 2) AS DOUBLE) AS market_value
        FROM position_lines GROUP BY ALL)"""),
    "p13_security_ids": "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'cusip:AB' || p_partkey WHEN p_partkey % 4 = 1 THEN 'ticker:T' || p_partkey WHEN p_partkey % 8 < 7 THEN 'name:' || lower(p_name) END AS security_id FROM part",
    "p16_survey_cells": """SELECT c_custkey, CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN c * 1000 WHEN 2 THEN NULL ELSE c END AS number, CASE WHEN k % 2 = 0 THEN k END AS plan_number, coalesce(CASE WHEN d > 3 THEN d / 100 ELSE d END, CASE WHEN k % 9 <> 0 THEN 8 / (k % 9) END) AS funded_ratio
        FROM (SELECT *, c_custkey AS k, CAST(round(c_acctbal * 100) AS DOUBLE) AS c, CASE c_custkey % 3 WHEN 0 THEN CAST(c_custkey % 100 AS DOUBLE) WHEN 1 THEN (c_custkey % 7) / 8 END AS d FROM customer)""",
    "a8_run_sla": """SELECT strftime(m, '%Y-%m') AS run_id, round(a / n, 6) AS completeness_rate, round(greatest((epoch_us(t) - epoch_us(m + INTERVAL 20 DAY)) / 3.6e9::DOUBLE, 0), 6) AS freshness_lag_hours, CASE WHEN u > 0 THEN round(h / u, 6) ELSE 0 END AS review_queue_latency_hours, round(w / n, 6) AS parse_warning_rate, CASE WHEN p > 0 THEN round(c * 10 / p, 6) ELSE 0 END AS citation_density_per_10_pages FROM (
        SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS m, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS a, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS u, count(*) FILTER (WHERE o_orderkey % 7 = 0) AS w, count(*) FILTER (WHERE o_orderkey % 2 = 0) AS c, count(*) FILTER (WHERE o_orderkey % 40 = 0) AS p, max(o_orderdate) AS t, CAST(sum(o_orderkey % 24) AS DOUBLE) AS h FROM orders GROUP BY 1)""",
    "w8_latest_publication": sql("SELECT system_id, source_id, max(published_at) AS published_at FROM publications GROUP BY system_id, source_id"),
    "w10_refresh_windows": sql(f"""SELECT system_id, source_id, round(i, 3) AS recommended_interval_days, e AS next_run_earliest, greatest(e, least(hi, t + j)) AS next_run_latest, c AS profile_confidence FROM (SELECT *, greatest(lo, least(hi, t - j)) AS e FROM (
        SELECT *, greatest(lo, least(hi, CASE WHEN t1 < {NOW} THEN CASE WHEN list_contains(months, month({NOW})) THEN {NOW} ELSE {NEXT_MONTH.format(b=NOW)} END ELSE t1 END)) AS t, to_seconds(CAST(round(i * (0.05::DOUBLE + (1 - c) * 0.3::DOUBLE) * 86400, 0) AS BIGINT)) AS j FROM (
        SELECT *, greatest(lo, l + INTERVAL 120 DAY) AS hi, CASE WHEN list_contains(months, month(t0)) THEN t0 ELSE {NEXT_MONTH.format(b=f"greatest(t0, {NOW})")} END AS t1 FROM (
        SELECT *, greatest({NOW}, l + INTERVAL 7 DAY) AS lo, l + to_seconds(CAST(round(i * 86400, 0) AS BIGINT)) AS t0 FROM (SELECT *, greatest(7, least(120, f)) AS i FROM ({PROFILES}))))))"""),
}
