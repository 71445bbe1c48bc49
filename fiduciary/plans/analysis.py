"""Registered queries of derived metrics, evidence, shocks and allocations, each beside its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import cut
from ..operators import metrics, stress
from . import domain as D
from .oracle import sql

Query = Callable[[SparkSession, str], DataFrame]


def raw_ref(key: str):
    """Reference as a person writes it, by the key of an order."""
    k = F.col(key)
    page = (k % 40 + 1).cast("string")
    return F.when(k % 6 == 0, F.concat(F.lit("Page "), page, F.lit(" # Table  "), (k % 3).cast("string"))).when(k % 6 == 1, F.concat(F.lit("p."), page)).when(k % 6 == 2, F.concat(F.lit("TEXT: Block"), page)).when(k % 6 == 3, F.concat(F.lit(" Note  to  Item*"), page)).when(k % 6 == 4, F.lit("  "))


def metric_facts(s: SparkSession, d: str) -> DataFrame:
    """An order as a fact of its plan: a liability, or an asset if it is filled."""
    k = F.col("o_orderkey")
    return D.plan_orders(s, d).select(
        "plan_id", "plan_period", F.when(F.col("o_orderstatus") == "F", "ava_usd").otherwise("aal_usd").alias("metric_name"), F.col("o_totalprice").alias("normalized_value"), ((k % 12) / 10.0).alias("confidence"),
        F.lpad(k.cast("string"), 12, "0").alias("fact_id"), F.array(raw_ref("o_orderkey"), raw_ref("o_orderkey")).alias("evidence_refs"), F.lit("r1").alias("report_id"), F.concat(F.lit("doc:"), (k % 100).cast("string")).alias("source_document_id"), F.col("o_orderdate").alias("valid_from"),
    )


def derived(s: SparkSession, d: str) -> DataFrame:
    f = D.plan_funding(s, d)
    cash = f.select(
        "plan_id", "plan_period", F.concat_ws("|", "plan_id", "plan_period").alias("cash_flow_id"), F.col("employer_contributions_usd").alias("employer_contributions_normalized"), F.col("employee_contributions_usd").alias("employee_contributions_normalized"),
        (-F.col("benefit_payments_usd")).alias("benefit_payments_normalized"), F.when(F.col("n_orders") % 2 == 0, F.lit(-100.0)).alias("refunds_normalized"), F.lit(None).cast("double").alias("confidence"), F.array().cast("array<string>").alias("evidence_refs"),
    )
    return metrics.derived_metrics(metric_facts(s, d), cash)


def derived_shown(s: SparkSession, d: str) -> DataFrame:
    return derived(s, d).select("plan_id", "plan_period", "metric_name", F.round("value", 6).alias("value"), "confidence", F.concat_ws(",", "source_fact_ids").alias("source_fact_ids"), F.concat_ws(",", "provenance_refs").alias("provenance_refs"))


def means(s: SparkSession, d: str) -> DataFrame:
    return metrics.weighted_means(derived(s, d)).select("metric_name", F.round("weighted_mean", 4).alias("weighted_mean"), "sample_count", F.round("confidence_weight_sum", 6).alias("confidence_weight_sum"))


def series(s: SparkSession, d: str) -> DataFrame:
    rows = metrics.series(derived(s, d))
    return rows.select("plan_id", "metric_name", "title", F.concat_ws(",", F.col("points.plan_period")).alias("periods"), F.round(F.element_at("points", -1)["value"], 6).alias("last_value"), F.round("peak", 6).alias("peak"))


def history_page(s: SparkSession, d: str) -> DataFrame:
    rows = metrics.history_filter(metric_facts(s, d), [" AVA_usd "], "1996-01-01", "1997-12-31")
    return metrics.page(rows.select("plan_id", "plan_period", "fact_id", "normalized_value"), ["fact_id"], 20, 50)


def evidence_rows(s: SparkSession, d: str) -> DataFrame:
    links, _ = metrics.evidence_links(metric_facts(s, d))
    rows = links.withColumn("locator", metrics.locator(links))
    return rows.select("fact_id", "raw_ref", "page_number", "section_hint", "snippet_anchor", "method", "locator")


def missing_evidence(s: SparkSession, d: str) -> DataFrame:
    return metrics.evidence_links(metric_facts(s, d))[1]


def funded_plans(s: SparkSession, d: str) -> DataFrame:
    return D.plan_funding(s, d).select("plan_id", "plan_period", F.col("assets_usd").alias("total_assets_usd"), F.col("total_usd").alias("liabilities_usd"), (0.6 * F.col("assets_usd")).alias("equity_usd"), F.when(F.col("n_orders") % 2 == 0, "total-plan").otherwise("sleeve").alias("equity_scope"), F.lit(12.0).alias("liability_duration_years"))


def funded_shocks(s: SparkSession, d: str) -> DataFrame:
    shocks = s.createDataFrame([(-0.2, None), (-0.1, -0.01), (0.1, 0.005)], "equity_shock_pct double, discount_rate_shock double")
    return stress.funded_shocks(funded_plans(s, d), shocks)


def alternatives(s: SparkSession, d: str) -> DataFrame:
    rows = D.manager_fund_positions(s, d)
    fee = F.col("exposure_usd")
    return rows.select("plan_id", "plan_period", F.concat(F.lit(" "), "manager_name", F.lit("/"), "fund_name").alias("fund_name"), F.lit(" Private_Equity ").alias("asset_class"), fee.alias("reported_fair_value_usd"), (fee / 50).alias("management_fees_usd"), F.when(fee > 50000, fee / 100).alias("carried_interest_usd"), (F.col("disclosure_state") == "not_disclosed").alias("explicit_not_disclosed"))


def fees(s: SparkSession, d: str) -> DataFrame:
    plans = D.plan_funding(s, d).select("plan_id", "plan_period", (F.col("total_usd") / 220).alias("investment_expense_usd"), F.col("assets_usd").alias("total_assets_usd"), F.col("funded_ratio").alias("net_return"), F.when(F.col("n_orders") % 2 == 0, 0.4).alias("policy_benchmark_return"))
    return stress.fee_effectiveness(plans, stress.alternatives_fees(alternatives(s, d)))


def asset_coverage(s: SparkSession, d: str) -> DataFrame:
    plans = D.plan_funding(s, d).select("plan_id", "plan_period", (F.col("total_usd") * 0.8).alias("total_assets_usd"))
    value = F.col("market_value_usd").cast("decimal(28,4)")
    held = cut(D.security_positions(s, d, exact=True).groupBy("plan_id", "plan_period", "asset_class", "disclosure_state").agg(F.sum(value).alias("market_value_usd"), F.sum("net").alias("net")))  # the lines are read once for both sides
    shares = held.groupBy("plan_id", "plan_period", "asset_class").agg(F.sum("net").alias("net")).select("plan_id", "plan_period", "asset_class", D.class_share().alias("allocation_pct"))
    reported = shares.where("asset_class <> 'SMALL'").join(plans, ["plan_id", "plan_period"]).select("plan_id", "plan_period", "asset_class", (F.col("allocation_pct") * F.col("total_assets_usd")).alias("market_value_usd"))
    return stress.coverage_of_assets(held, plans, reported)


def contribution_totals(s: SparkSession, d: str) -> DataFrame:
    w = D.plan_allocation(s, d).select("plan_id", "plan_period", F.col("asset_class").alias("bucket"), F.col("allocation_pct").alias("weight"))
    returns = w.where("bucket <> 'PROMO' OR plan_period <> 'FY1995'").select("plan_id", "plan_period", "bucket", (F.length("bucket") / 100).alias("ret"))
    return stress.contributions(w, returns, w.select("plan_id", "plan_period").distinct().withColumn("source_aggregate", F.lit(0.06)))


def allocation_search(s: SparkSession, d: str) -> DataFrame:
    """Three buckets a plan: shares of its flows as returns, on a grid of 1/20."""
    f = D.plan_funding(s, d).groupBy("plan_id").agg(*[F.round(F.sum(F.col(c).cast("decimal(18,2)")).cast("double") / F.sum(F.col("total_usd").cast("decimal(18,2)")).cast("double"), 4).alias(c[:8]) for c in ("employer_contributions_usd", "employee_contributions_usd", "benefit_payments_usd")])
    long = f.unpivot(["plan_id"], ["employer", "employee", "benefit_"], "bucket", "expected_return")
    rows = long.withColumns({"risk_penalty": 3 * F.col("expected_return") * F.col("expected_return"), "min_units": F.lit(1), "max_units": F.lit(12)})
    best = stress.best_allocations(rows, 3, 20, 2.0)
    return best.select("plan_id", "objective", F.concat_ws(",", F.transform("weights", lambda x: F.round(x * 20).cast("int").cast("string"))).alias("units"))


def experiments(s: SparkSession, d: str) -> DataFrame:
    f = D.plan_funding(s, d)
    year = F.substring("plan_period", 3, 4).cast("int")
    rows = f.select(F.concat_ws(":", "plan_id", year.cast("string")).alias("experiment_id"), "funded_ratio", "n_orders", "plan_id", year.alias("y"))
    tried = rows.select("experiment_id", F.col("funded_ratio").alias("objective_value"), F.when(F.col("n_orders") % 3 > 0, F.col("funded_ratio") / 2).alias("total_return"))
    pairs = rows.select(F.col("experiment_id").alias("left_id"), F.concat_ws(":", "plan_id", (F.col("y") + 1).cast("string")).alias("right_id"))
    return stress.experiment_comparison(tried, pairs)


QUERIES: dict[str, Query] = {
    "a4_derived_metrics": derived_shown,
    "a5_weighted_means": means,
    "a6_metric_series": series,
    "p33_history_page": history_page,
    "p10_evidence": evidence_rows,
    "b19_missing_evidence": missing_evidence,
    "j16_citations": lambda s, d: metrics.citation_rows(metric_facts(s, d)),
    "x3_funded_shocks": funded_shocks,
    "x5_experiments": experiments,
    "a2_asset_coverage": asset_coverage,
    "a21_fee_effectiveness": fees,
    "a22_alternatives_fees": lambda s, d: stress.alternatives_fees(alternatives(s, d)),
    "a27_contributions": contribution_totals,
    "a33_best_allocations": allocation_search,
}

REF = """CASE WHEN k % 6 = 0 THEN 'p.' || (k % 40 + 1) || '#Table ' || (k % 3) WHEN k % 6 = 1 THEN 'p.' || (k % 40 + 1) WHEN k % 6 = 2 THEN 'text:block' || (k % 40 + 1) WHEN k % 6 = 3 THEN 'Note to Item*' || (k % 40 + 1) END"""
RAW = """CASE WHEN k % 6 = 0 THEN 'Page ' || (k % 40 + 1) || ' # Table  ' || (k % 3) WHEN k % 6 = 1 THEN 'p.' || (k % 40 + 1) WHEN k % 6 = 2 THEN 'TEXT: Block' || (k % 40 + 1) WHEN k % 6 = 3 THEN 'Note  to  Item*' || (k % 40 + 1) END"""
FACTS = "SELECT *, o_orderkey AS k, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS fact_id, least(1, round((o_orderkey % 12) / 10.0::DOUBLE, 6)) AS c FROM plan_orders"
DERIVED = f"""SELECT plan_id, plan_period, unnest(['funded_gap_usd', 'unfunded_ratio']) AS metric_name, unnest([al.v - av.v, (al.v - av.v) / al.v]) AS value, least(al.c, av.c) AS confidence,
    CASE WHEN al.id < av.id THEN al.id || ',' || av.id ELSE av.id || ',' || al.id END AS source_fact_ids,
    array_to_string(list_sort(list_distinct([al.ref, av.ref])), ',') AS provenance_refs FROM (
    SELECT plan_id, plan_period, max_by(s, id) FILTER (WHERE NOT f) AS al, max_by(s, id) FILTER (WHERE f) AS av FROM (SELECT plan_id, plan_period, fact_id AS id, o_orderstatus = 'F' AS f, {{'v': o_totalprice, 'c': c, 'id': fact_id, 'ref': {RAW}}} AS s FROM ({FACTS})) GROUP BY plan_id, plan_period)
    WHERE al IS NOT NULL AND av IS NOT NULL
    UNION ALL SELECT plan_id, plan_period, 'net_cash_flow_usd', employer_contributions_usd + employee_contributions_usd - benefit_payments_usd - 100, NULL, plan_id || '|' || plan_period, '' FROM plan_funding WHERE n_orders % 2 = 0
    UNION ALL SELECT plan_id, plan_period, 'contribution_to_benefit_ratio', (employer_contributions_usd + employee_contributions_usd) / abs(benefit_payments_usd), NULL, plan_id || '|' || plan_period, '' FROM plan_funding"""

ORACLES = {
    "a4_derived_metrics": sql(f"SELECT plan_id, plan_period, metric_name, round(value, 6) AS value, confidence, source_fact_ids, provenance_refs FROM ({DERIVED}) WHERE value IS NOT NULL"),
    "a5_weighted_means": sql(f"SELECT metric_name, round(sum(value * coalesce(confidence, 1)) / sum(coalesce(confidence, 1)), 4) AS weighted_mean, count(*) AS sample_count, round(sum(coalesce(confidence, 1)), 6) AS confidence_weight_sum FROM ({DERIVED}) WHERE value IS NOT NULL GROUP BY metric_name"),
    "a6_metric_series": sql(f"""SELECT plan_id, metric_name, CASE metric_name WHEN 'funded_gap_usd' THEN 'Funded Gap Usd' WHEN 'unfunded_ratio' THEN 'Unfunded Ratio' WHEN 'net_cash_flow_usd' THEN 'Net Cash Flow Usd' ELSE 'Contribution To Benefit Ratio' END AS title,
        string_agg(plan_period, ',' ORDER BY plan_period) AS periods, round(arg_max(value, plan_period), 6) AS last_value, round(max(value), 6) AS peak FROM ({DERIVED}) WHERE value IS NOT NULL GROUP BY plan_id, metric_name"""),
    "p33_history_page": sql(f"""SELECT *, total_rows > 70 AS has_more FROM (SELECT plan_id, plan_period, fact_id, o_totalprice AS normalized_value, count(*) OVER () AS total_rows FROM ({FACTS})
        WHERE o_orderstatus = 'F' AND o_orderdate >= '1996-01-01' AND o_orderdate <= '1997-12-31' ORDER BY fact_id LIMIT 50 OFFSET 20)"""),
    "p10_evidence": sql(f"""SELECT fact_id, raw_ref, CASE WHEN k % 6 < 2 THEN CAST(k % 40 + 1 AS INTEGER) END AS page_number, CASE WHEN k % 6 = 0 THEN 'Table ' || (k % 3) WHEN k % 6 = 3 THEN raw_ref END AS section_hint, CASE WHEN k % 6 = 2 THEN raw_ref END AS snippet_anchor,
        CASE k % 6 WHEN 0 THEN 'table' WHEN 3 THEN NULL ELSE 'text' END AS method, 'doc:' || (k % 100) || CASE WHEN k % 6 < 2 THEN '#page=' || (k % 40 + 1) WHEN k % 6 = 2 THEN '#anchor=text%3Ablock' || (k % 40 + 1) ELSE '#section=Note%20to%20Item%2A' || (k % 40 + 1) END AS locator
        FROM (SELECT *, {REF} AS raw_ref FROM ({FACTS})) WHERE raw_ref IS NOT NULL"""),
    "b19_missing_evidence": sql(f"SELECT fact_id, 'missing_evidence' AS warning FROM ({FACTS}) WHERE k % 6 > 3"),
    "j16_citations": sql(f"SELECT fact_id, {REF} AS citation, CASE WHEN k % 6 > 3 THEN 'missing' ELSE 'cited' END AS status FROM ({FACTS})"),
    "x3_funded_shocks": sql("""SELECT plan_id, plan_period, CASE WHEN n_orders % 2 = 0 THEN 'total-plan' ELSE 'equity-sleeve' END AS scope_label, e AS equity_shock_pct, r AS discount_rate_shock, round(funded_ratio, 6) AS baseline_funded_ratio, round(a / l, 6) AS shocked_funded_ratio,
        round(a / l - funded_ratio, 6) AS funded_ratio_delta, round(da, 6) AS asset_delta_usd, round(dl, 6) AS liability_delta_usd, round(l - a, 6) AS shocked_uaal_usd FROM (SELECT *, assets_usd + da AS a, total_usd + dl AS l FROM (
        SELECT *, 0.6::DOUBLE * assets_usd * e AS da, coalesce(-12 * r * total_usd, 0) AS dl FROM plan_funding CROSS JOIN (VALUES (-0.2::DOUBLE, NULL), (-0.1::DOUBLE, -0.01::DOUBLE), (0.1::DOUBLE, 0.005::DOUBLE)) s(e, r))) WHERE l > 0"""),
    "x5_experiments": sql("""SELECT a.plan_id || ':' || substr(a.plan_period, 3) AS left_id, b.plan_id || ':' || substr(b.plan_period, 3) AS right_id, round(b.funded_ratio - a.funded_ratio, 9) AS objective_delta,
        CASE WHEN a.n_orders % 3 > 0 AND b.n_orders % 3 > 0 THEN round(b.funded_ratio / 2 - a.funded_ratio / 2, 9) END AS total_return_delta FROM plan_funding a JOIN plan_funding b ON a.plan_id = b.plan_id AND CAST(substr(b.plan_period, 3) AS INTEGER) = CAST(substr(a.plan_period, 3) AS INTEGER) + 1"""),
    "a2_asset_coverage": sql("""SELECT plan_id, plan_period, asset_class, CASE WHEN reported > 0 THEN round(coalesce(collected, 0) / reported, 6) END AS class_ratio, round(got / t, 6) AS coverage_ratio, CASE WHEN round(got / t, 6) >= 0.95 THEN 'total-plan' ELSE 'equity-sleeve' END AS scope_label FROM (
        SELECT *, coalesce(sum(collected) OVER (PARTITION BY plan_id, plan_period), 0) AS got FROM (
        SELECT coalesce(h.plan_id, r.plan_id) AS plan_id, coalesce(h.plan_period, r.plan_period) AS plan_period, coalesce(h.asset_class, r.asset_class) AS asset_class, collected, reported FROM (
        SELECT plan_id, plan_period, lower(asset_class) AS asset_class, CAST(sum(CAST(market_value_usd AS DECIMAL(28,4))) AS DOUBLE) AS collected FROM security_positions WHERE disclosure_state = 'disclosed' GROUP BY ALL) h
        FULL JOIN (SELECT a.plan_id, a.plan_period, lower(asset_class) AS asset_class, allocation_pct * (total_usd * 0.8::DOUBLE) AS reported FROM plan_allocation a JOIN plan_funding f ON a.plan_id = f.plan_id AND a.plan_period = f.plan_period WHERE asset_class <> 'SMALL') r
        ON h.plan_id = r.plan_id AND h.plan_period = r.plan_period AND h.asset_class = r.asset_class) JOIN (SELECT plan_id AS p, plan_period AS q, total_usd * 0.8::DOUBLE AS t FROM plan_funding) ON plan_id = p AND plan_period = q)"""),
    "a21_fee_effectiveness": sql("""SELECT f.plan_id, f.plan_period, round(total_usd / 220 / assets_usd * 10000, 4) AS expense_bps, round(round(total_usd / 220 / assets_usd * 10000, 4) - 40, 4) AS excess_bps, m AS alts_management_fees_usd, c AS alts_carried_interest_usd, CASE WHEN n_orders % 2 = 0 THEN round(funded_ratio - 0.4::DOUBLE, 6) END AS net_value_added
        FROM plan_funding f LEFT JOIN (SELECT plan_id, plan_period, round(sum(exposure_usd / 50), 6) AS m, round(sum(CASE WHEN exposure_usd > 50000 THEN exposure_usd / 100 END), 6) AS c FROM manager_fund_positions GROUP BY plan_id, plan_period) x ON f.plan_id = x.plan_id AND f.plan_period = x.plan_period WHERE assets_usd > 0"""),
    "a22_alternatives_fees": sql("""SELECT plan_id, plan_period, manager_name || '/' || fund_name AS fund_name, 'private_equity' AS asset_class, exposure_usd AS reported_fair_value_usd, m AS management_fees_usd, c AS carried_interest_usd, round(m + coalesce(c, 0), 6) AS total_fees_usd,
        CASE WHEN disclosure_state = 'not_disclosed' OR exposure_usd IS NULL THEN 'not_disclosed' ELSE 'disclosed' END AS disclosure_state FROM (SELECT *, exposure_usd / 50 AS m, CASE WHEN exposure_usd > 50000 THEN exposure_usd / 100 END AS c FROM manager_fund_positions)"""),
    "a27_contributions": sql("""SELECT plan_id, plan_period, round(t, 9) AS computed_total, round(t - 0.06::DOUBLE, 9) AS delta, n_missing, abs(t - 0.06::DOUBLE) <= 1e-6 AND n_missing = 0 AS within_tolerance FROM (
        SELECT plan_id, plan_period, sum(CASE WHEN NOT gone THEN allocation_pct * (length(asset_class) / 100) END) AS t, count(*) FILTER (WHERE gone) AS n_missing FROM (SELECT *, asset_class = 'PROMO' AND plan_period = 'FY1995' AS gone FROM plan_allocation) GROUP BY plan_id, plan_period)"""),
    "a33_best_allocations": sql("""SELECT plan_id, round(arg_max(o, {'o': round(o, 12), 'x': -x, 'y': -y, 'z': -z}), 9) AS objective, arg_max(x || ',' || y || ',' || z, {'o': round(o, 12), 'x': -x, 'y': -y, 'z': -z}) AS units FROM (
        SELECT plan_id, x, y, z, x / 20 * b - 2 * (x / 20) * (x / 20) * (3 * b * b) + (y / 20 * e - 2 * (y / 20) * (y / 20) * (3 * e * e)) + (z / 20 * m - 2 * (z / 20) * (z / 20) * (3 * m * m)) AS o FROM (
        SELECT plan_id, round(CAST(sum(CAST(employer_contributions_usd AS DECIMAL(18,2))) AS DOUBLE) / CAST(sum(CAST(total_usd AS DECIMAL(18,2))) AS DOUBLE), 4) AS m, round(CAST(sum(CAST(employee_contributions_usd AS DECIMAL(18,2))) AS DOUBLE) / CAST(sum(CAST(total_usd AS DECIMAL(18,2))) AS DOUBLE), 4) AS e,
        round(CAST(sum(CAST(benefit_payments_usd AS DECIMAL(18,2))) AS DOUBLE) / CAST(sum(CAST(total_usd AS DECIMAL(18,2))) AS DOUBLE), 4) AS b FROM plan_funding GROUP BY plan_id)
        CROSS JOIN range(1, 13) r1(x) CROSS JOIN range(1, 13) r2(y) CROSS JOIN range(1, 13) r3(z) WHERE x + y + z = 20) GROUP BY plan_id"""),
}
