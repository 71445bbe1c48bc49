"""Queries of the benchmark panel and of plan health in words, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import funding, peers
from . import domain as D
from .oracle import sql

Query = Callable[[SparkSession, str], DataFrame]

METHODS = ["Level percent, CLOSED", "open 30y", "layered bases", None, "other"]


def panel_inputs(s: SparkSession, d: str) -> DataFrame:
    f = D.plan_funding(s, d)
    change = funding.funding_trend(f).select("plan_id", "plan_period", F.col("funded_ratio_change").alias("change"))
    n, ratio, total, benefits, employer = (F.col(c) for c in ("n_orders", "funded_ratio", "total_usd", "benefit_payments_usd", "employer_contributions_usd"))
    columns = {
        "funded_ratio_ava": F.round(ratio, 6), "funded_ratio_mva": F.round(ratio * 0.95 + 0.02, 6), "funded_ratio_trend": F.col("change"), "aal_usd": total, "uaal_usd": total - F.col("assets_usd"),
        "assumed_return": F.round(0.05 + ratio / 20, 6), "discount_rate": F.round(0.06 + ratio / 25, 6), "inflation_rate": F.round(0.02 + (n % 4) / 400, 6), "payroll_growth_rate": F.when(n % 7 == 0, float("nan")).otherwise(F.round(ratio / 10, 6)),
        "amortization_period_years": (20 + n % 11).cast("double"), "amortization_method": F.get(F.array(*map(F.lit, METHODS)), (n % 5).cast("int")), "mortality_table_year": (1995 + n % 25).cast("int"),
        "adc_usd": employer, "actual_contribution_usd": F.col("employee_contributions_usd"), "payroll_usd": 4 * benefits,
        "net_return_1yr": F.round(F.col("change") + 0.06, 6), "net_return_3yr": F.round(0.05 + ratio / 30, 6), "net_return_5yr": F.when(n % 3 > 0, F.round(0.055 + ratio / 40, 6)), "net_return_10yr": F.lit(None).cast("double"),
        "policy_benchmark_return": F.lit(0.06), "realistic_return": F.lit(0.065), "net_external_cash_flow_pct": F.round(100 * (employer - benefits) / total, 4), "support_ratio": F.round(employer / benefits, 6),
        "benefit_payments_pct": F.round(100 * benefits / total, 4), "assets_payroll_ratio": F.round(F.col("assets_usd") / (4 * benefits), 6), "normal_cost_usd": 0.2 * benefits, "amortization_payment_usd": 0.05 * total,
    }
    return f.join(change, ["plan_id", "plan_period"]).select("plan_id", "plan_period", "peer_group", *[c.alias(name) for name, c in columns.items()])


QUERIES: dict[str, Query] = {"w2_whole_panel": lambda s, d: peers.benchmark_panel(panel_inputs(s, d))}

INPUTS = """inputs AS (SELECT plan_id, plan_period, peer_group, round(funded_ratio, 6) AS funded_ratio_ava, round(funded_ratio * 0.95::DOUBLE + 0.02::DOUBLE, 6) AS funded_ratio_mva, change AS funded_ratio_trend, total_usd AS aal_usd, total_usd - assets_usd AS uaal_usd,
    round(0.05::DOUBLE + funded_ratio / 20, 6) AS assumed_return, round(0.06::DOUBLE + funded_ratio / 25, 6) AS discount_rate, round(0.02::DOUBLE + CAST(n_orders % 4 AS DOUBLE) / 400, 6) AS inflation_rate, CASE WHEN n_orders % 7 = 0 THEN 'NaN'::DOUBLE ELSE round(funded_ratio / 10, 6) END AS payroll_growth_rate,
    CAST(20 + n_orders % 11 AS DOUBLE) AS amortization_period_years, ['Level percent, CLOSED', 'open 30y', 'layered bases', NULL, 'other'][CAST(n_orders % 5 AS INTEGER) + 1] AS amortization_method, CAST(1995 + n_orders % 25 AS INTEGER) AS mortality_table_year,
    employer_contributions_usd AS adc_usd, employee_contributions_usd AS actual_contribution_usd, 4 * benefit_payments_usd AS payroll_usd, round(change + 0.06::DOUBLE, 6) AS net_return_1yr, round(0.05::DOUBLE + funded_ratio / 30, 6) AS net_return_3yr,
    CASE WHEN n_orders % 3 > 0 THEN round(0.055::DOUBLE + funded_ratio / 40, 6) END AS net_return_5yr, CAST(NULL AS DOUBLE) AS net_return_10yr, 0.06::DOUBLE AS policy, 0.065::DOUBLE AS realistic, round(100 * (employer_contributions_usd - benefit_payments_usd) / total_usd, 4) AS net_external_cash_flow_pct,
    round(employer_contributions_usd / benefit_payments_usd, 6) AS support_ratio, round(100 * benefit_payments_usd / total_usd, 4) AS benefit_payments_pct, round(assets_usd / (4 * benefit_payments_usd), 6) AS assets_payroll_ratio, 0.2::DOUBLE * benefit_payments_usd AS normal_cost, 0.05::DOUBLE * total_usd AS payment FROM funding_changes),
scored AS (SELECT *, CASE WHEN contains(lower(amortization_method), 'open') THEN FALSE WHEN contains(lower(amortization_method), 'closed') OR contains(lower(amortization_method), 'layer') THEN TRUE END AS closed FROM inputs)"""

MADE = {
    "amortization_method_closed": "CASE closed WHEN TRUE THEN 1.0::DOUBLE WHEN FALSE THEN 0.0::DOUBLE END", "mortality_table_year": "CAST(mortality_table_year AS DOUBLE)",
    "adc_vs_actual_contribution_ratio": "CASE WHEN adc_usd <> 0 THEN round(actual_contribution_usd / adc_usd, 6) END", "contribution_pct_of_payroll": "CASE WHEN payroll_usd <> 0 THEN round(actual_contribution_usd / payroll_usd, 6) END",
}


def stats(peer: str) -> str:
    return f"""SELECT s.plan_id, s.plan_period, s.metric_name, s.v, count(o.v) AS n, avg(o.v) AS mean, CAST(printf('%.6f', median(o.v)) AS DOUBLE) AS peer_median, stddev_pop(o.v) AS spread, count(*) FILTER (WHERE o.v <= s.v) AS le
    FROM long s LEFT JOIN long o ON o.plan_period = s.plan_period AND o.metric_name = s.metric_name AND o.plan_id <> s.plan_id{peer} GROUP BY s.plan_id, s.plan_period, s.metric_name, s.v"""


def placed(prefix: str) -> str:
    pct = "CASE WHEN v IS NOT NULL AND n > 0 THEN round(100.0 * le / n, 4) END"
    return f"""{pct} AS {prefix}peer_percentile, CASE WHEN {pct} <= 25 THEN 1 WHEN {pct} <= 50 THEN 2 WHEN {pct} <= 75 THEN 3 WHEN {pct} IS NOT NULL THEN 4 END AS {prefix}peer_quartile_rank,
    CASE WHEN v IS NOT NULL AND n >= 2 AND spread > 1e-9 * greatest(abs(mean), 1) THEN round((round(v, 6) - mean) / spread, 4) END AS {prefix}peer_z_score"""


PERCENT = "printf('%.{0}f%%', 100 * ({1}))"
HEALTH = f"""health AS (SELECT plan_id, plan_period, dimension, rating, value, basis FROM (SELECT plan_id, plan_period, unnest([
  {{'dimension': 'funded_ratio_mva', 'rating': CASE WHEN funded_ratio_mva >= 0.9 THEN 'green' WHEN funded_ratio_mva >= 0.7 THEN 'yellow' ELSE 'red' END, 'value': round(funded_ratio_mva, 6), 'basis': 'MVA funded ratio ' || {PERCENT.format(1, 'funded_ratio_mva')} || '; bands >=90%/>=70%'}},
  {{'dimension': 'funded_ratio_trend', 'rating': CASE WHEN funded_ratio_trend IS NULL THEN 'unknown' WHEN funded_ratio_trend > 0.01 THEN 'green' WHEN funded_ratio_trend >= -0.01 THEN 'yellow' ELSE 'red' END, 'value': funded_ratio_trend,
    'basis': CASE WHEN funded_ratio_trend IS NULL THEN 'no valid trend in [-1, 1]' ELSE 'funded-ratio change ' || printf('%+.3f', funded_ratio_trend) || '; flat band +/-0.01' END}},
  {{'dimension': 'assumed_return', 'rating': CASE WHEN assumed_return - realistic > 0.01 OR coalesce(assumed_return - peer > 0.005, FALSE) THEN 'red' WHEN assumed_return - realistic > 0 THEN 'yellow' ELSE 'green' END, 'value': assumed_return,
    'basis': 'assumed ' || {PERCENT.format(2, 'assumed_return')} || '; vs realistic 6.50%: ' || {PERCENT.format(2, 'assumed_return - realistic').replace('%.', '%+.')} || coalesce('; vs peer median ' || {PERCENT.format(2, 'peer')} || ': ' || {PERCENT.format(2, 'assumed_return - peer').replace('%.', '%+.')}, '')}},
  {{'dimension': 'contribution_sufficiency', 'rating': CASE WHEN adc_usd > 0 AND actual_contribution_usd >= 0 THEN CASE WHEN actual_contribution_usd / adc_usd >= 1 THEN 'green' WHEN actual_contribution_usd / adc_usd >= 0.9 THEN 'yellow' ELSE 'red' END ELSE 'unknown' END,
    'value': CASE WHEN adc_usd > 0 AND actual_contribution_usd >= 0 THEN round(actual_contribution_usd / adc_usd, 4) END, 'basis': CASE WHEN adc_usd > 0 AND actual_contribution_usd >= 0 THEN 'paid ' || {PERCENT.format(0, 'round(actual_contribution_usd / adc_usd, 4)')} || ' of ADC; bands >=100%/>=90%' ELSE 'no valid non-negative ADC/actual' END}},
  {{'dimension': 'tread_water', 'rating': CASE WHEN gap IS NULL THEN 'unknown' WHEN gap >= 0 THEN 'green' WHEN gap >= -abs(required) * 0.1 THEN 'yellow' ELSE 'red' END, 'value': gap, 'basis': CASE WHEN gap IS NULL THEN 'insufficient valid inputs' ELSE 'contribution minus (normal cost + i*UAAL) = ' || format('{{:,}}', CAST(round(gap) AS BIGINT)) END}},
  {{'dimension': 'amortization', 'rating': CASE WHEN payment < assumed_return * uaal_usd THEN 'red' WHEN closed IS NULL OR closed THEN 'green' ELSE 'yellow' END, 'value': CASE WHEN NOT payment < assumed_return * uaal_usd AND NOT closed AND amortization_period_years > 25 THEN round(amortization_period_years, 1) END,
    'basis': CASE WHEN payment < assumed_return * uaal_usd THEN 'negative amortization: payment < interest on UAAL' WHEN closed IS NULL THEN 'not negatively amortizing' WHEN closed THEN 'closed/layered amortization' WHEN amortization_period_years > 25 THEN 'open amortization over ' || printf('%.0f', amortization_period_years) || 'y (> 25y)' ELSE 'open amortization' END}},
  {{'dimension': 'cash_flow_maturity', 'rating': CASE WHEN cash IS NULL THEN 'unknown' WHEN cash >= -3 THEN 'green' WHEN cash >= -5 THEN 'yellow' ELSE 'red' END, 'value': cash, 'basis': CASE WHEN cash IS NULL THEN 'no valid net cash flow % in [-100, 100]' ELSE 'net external cash flow ' || printf('%+.1f%%', cash) || ' of assets; bands >=-3.0/>=-5.0' END}},
  {{'dimension': 'gasb_crossover', 'rating': CASE WHEN discount_rate < assumed_return THEN 'red' ELSE 'green' END, 'value': discount_rate, 'basis': 'GASB discount ' || {PERCENT.format(2, 'discount_rate')} || CASE WHEN discount_rate < assumed_return THEN ' < assumed ' ELSE ' >= assumed ' END || {PERCENT.format(2, 'assumed_return')} || CASE WHEN discount_rate < assumed_return THEN ': crossover/depletion (blended rate)' ELSE ': no crossover' END}},
  {{'dimension': 'mortality_currency', 'rating': CASE WHEN mortality_table_year >= 2010 THEN 'green' WHEN mortality_table_year >= 2000 THEN 'yellow' ELSE 'red' END, 'value': CAST(mortality_table_year AS DOUBLE), 'basis': 'mortality base year ' || CAST(mortality_table_year AS VARCHAR) || '; green >=2010'}}], recursive := true)
  FROM (SELECT i.*, b.peer_median AS peer, i.normal_cost + i.assumed_return * i.uaal_usd AS required, CASE WHEN i.actual_contribution_usd >= 0 AND i.normal_cost >= 0 AND i.uaal_usd >= 0 THEN round(i.actual_contribution_usd - (i.normal_cost + i.assumed_return * i.uaal_usd), 6) END AS gap, i.net_external_cash_flow_pct AS cash
    FROM scored i JOIN broad b ON b.plan_id = i.plan_id AND b.plan_period = i.plan_period AND b.metric_name = 'assumed_return')))"""

LONG = ", ".join(f"{{'metric_name': '{m}', 'v': {MADE.get(m, m)}}}" for m in peers.METRICS)
SHOWN = " ".join(f"WHEN '{m}' THEN '{dim}'" for m, dim in peers.HEALTH.items())

ORACLES: dict[str, str] = {
    "w2_whole_panel": sql(f"""SELECT * FROM (WITH {INPUTS},
long AS (SELECT plan_id, plan_period, peer_group, metric_name, CASE WHEN isfinite(v) THEN v END AS v FROM (SELECT plan_id, plan_period, peer_group, unnest([{LONG}], recursive := true) FROM scored)),
broad AS ({stats('')}), tight AS ({stats(' AND o.peer_group = s.peer_group')}),
{HEALTH},
b AS (SELECT plan_id, plan_period, metric_name, round(v, 6) AS metric_value, {placed('')}, peer_median FROM broad), t AS (SELECT plan_id, plan_period, metric_name, {placed('tight_')} FROM tight)
SELECT b.plan_id, b.plan_period, b.metric_name, b.metric_value, peer_percentile, peer_quartile_rank, peer_z_score, peer_median, round(b.metric_value - peer_median, 6) AS delta_vs_peer_median,
  CASE WHEN starts_with(b.metric_name, 'net_return_') THEN round(b.metric_value - i.assumed_return, 6) END AS delta_vs_assumed_return, CASE WHEN starts_with(b.metric_name, 'net_return_') THEN round(b.metric_value - i.policy, 6) END AS delta_vs_policy_benchmark,
  tight_peer_percentile, tight_peer_quartile_rank, tight_peer_z_score, h.rating AS health_rating, h.basis AS health_basis, h.dimension AS health_dimension_name, h.value AS health_dimension_value
FROM b JOIN t ON t.plan_id = b.plan_id AND t.plan_period = b.plan_period AND t.metric_name = b.metric_name JOIN inputs i ON i.plan_id = b.plan_id AND i.plan_period = b.plan_period
LEFT JOIN health h ON h.plan_id = b.plan_id AND h.plan_period = b.plan_period AND h.dimension = CASE b.metric_name {SHOWN} END
UNION ALL SELECT plan_id, plan_period, 'health_scorecard.' || dimension, value, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, rating, basis, dimension, value FROM health)"""),
}
