"""The registered queries in DuckDB SQL, over the same tables."""

from __future__ import annotations

import re

# Views that the queries build on, each in terms of the tables and of those before it.
VIEWS = {
    "plan_dim": "SELECT n_nationkey, n_name AS plan_id, r_name AS peer_group FROM nation JOIN region ON n_regionkey = r_regionkey",
    "plan_orders": """SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, plan_id, peer_group, 'FY' || CAST(year(o_orderdate) AS VARCHAR) AS plan_period
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN plan_dim ON c_nationkey = n_nationkey""",
    "plan_funding": """SELECT *, assets_usd / total_usd AS funded_ratio FROM (SELECT plan_id, peer_group, plan_period,
        CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_usd,
        coalesce(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE o_orderstatus = 'F') AS DOUBLE), 0) AS assets_usd,
        CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE o_orderpriority = '1-URGENT') AS DOUBLE) AS employer_contributions_usd,
        CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE o_orderpriority = '2-HIGH') AS DOUBLE) AS employee_contributions_usd,
        CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE o_orderpriority = '3-MEDIUM') AS DOUBLE) AS benefit_payments_usd,
        count(*) AS n_orders FROM plan_orders GROUP BY plan_id, peer_group, plan_period)""",
    "position_lines": """SELECT plan_id, peer_group, plan_period, l_orderkey, l_partkey, l_linenumber, l_returnflag, l_shipdate, p_brand, p_type, s_name,
        CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4)) AS net
        FROM lineitem JOIN plan_orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey""",
    "plan_allocation": """SELECT plan_id, peer_group, plan_period, p_type AS asset_class,
        CAST(sum(net) AS DOUBLE) / CAST(sum(sum(net)) OVER (PARTITION BY plan_id, plan_period) AS DOUBLE) AS allocation_pct
        FROM position_lines GROUP BY plan_id, peer_group, plan_period, p_type""",
    "manager_fund_positions": """SELECT plan_id, plan_period, s_name AS manager_name, p_brand AS fund_name,
        CASE WHEN min(l_linenumber) = 1 AND max(l_linenumber) = 1 THEN NULL ELSE CAST(sum(net) AS DOUBLE) END AS exposure_usd,
        CASE min(l_returnflag) WHEN 'N' THEN 'disclosed' WHEN 'A' THEN 'known_not_invested' ELSE 'not_disclosed' END AS disclosure_state
        FROM position_lines GROUP BY plan_id, plan_period, s_name, p_brand""",
    "security_positions": """SELECT plan_id, plan_period, 'cusip:' || CAST(l_partkey AS VARCHAR) AS security_id, p_type AS asset_class, CAST(sum(net) AS DOUBLE) AS market_value_usd,
        CASE WHEN min(l_returnflag) = 'R' THEN 'not_disclosed' ELSE 'disclosed' END AS disclosure_state
        FROM position_lines GROUP BY plan_id, plan_period, l_partkey, p_type""",
    "weights": """SELECT plan_id, plan_period, security_id, mv / sum(mv) OVER (PARTITION BY plan_id, plan_period) AS weight FROM (
        SELECT plan_id, plan_period, security_id, CAST(sum(CAST(market_value_usd AS DECIMAL(28,4))) AS DOUBLE) AS mv FROM security_positions
        WHERE disclosure_state = 'disclosed' AND market_value_usd > 0 GROUP BY plan_id, plan_period, security_id)""",
    "benchmark_weights": "SELECT 'cusip:' || CAST(p_partkey AS VARCHAR) AS security_id, p_retailprice / sum(CAST(p_retailprice AS DECIMAL(18,2))) OVER () AS weight FROM part",
    "core_facts": """SELECT *, lead(asserted_at) OVER (PARTITION BY plan_id, metric_name, valid_from ORDER BY asserted_at, input_seq) AS superseded_at FROM (
        SELECT plan_id, o_orderpriority AS metric_name, o_totalprice AS value, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS valid_from,
        CAST(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS TIMESTAMP) AS valid_to, o_orderdate AS asserted_at, o_orderkey AS input_seq FROM plan_orders)""",
    "funding_changes": "SELECT *, round(funded_ratio - lag(funded_ratio) OVER (PARTITION BY plan_id ORDER BY plan_period), 6) AS change FROM plan_funding",
    "points": "SELECT plan_id, plan_period AS period, funded_ratio, 0.3::DOUBLE + 0.1::DOUBLE * (n_orders % 7) AS confidence FROM plan_funding",
    "allocation_points": "SELECT a.plan_id, a.plan_period AS period, asset_class, allocation_pct, confidence FROM plan_allocation a JOIN points p ON a.plan_id = p.plan_id AND a.plan_period = p.period",
    "moves": """SELECT plan_id, period, 'funded_ratio' AS metric, confidence, round(abs(funded_ratio - lag(funded_ratio) OVER (PARTITION BY plan_id ORDER BY period)), 6) AS shift, 0.05::DOUBLE AS warning, 0.10::DOUBLE AS critical FROM points
        UNION ALL SELECT plan_id, period, 'allocation:' || asset_class, confidence, round(abs(allocation_pct - lag(allocation_pct) OVER (PARTITION BY plan_id, asset_class ORDER BY period)), 6), 0.05, 0.10 FROM allocation_points""",
    "anomalies": """SELECT plan_id, period, metric, shift,
        round((CASE WHEN shift >= critical THEN 1 + (shift - critical) / (critical - warning) ELSE (shift - warning) / (critical - warning) END) * (0.5 + 0.5 * greatest(0, least(1, confidence))), 6) AS score,
        CASE WHEN shift >= critical THEN 'critical' ELSE 'warning' END AS severity,
        CASE WHEN shift >= critical AND confidence >= 0.75 THEN 'high' WHEN shift >= critical OR confidence >= 0.75 THEN 'medium' ELSE 'low' END AS priority
        FROM moves WHERE shift >= warning""",
    "publications": """SELECT DISTINCT user_id AS system_id, event_type AS source_id, CASE WHEN event_type = 'signup' OR b IS NULL OR b <> props THEN ts END AS published_at
        FROM (SELECT *, lag(props) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS b FROM events WHERE props IS NOT NULL OR event_type = 'signup')
        WHERE event_type = 'signup' OR b IS NULL OR b <> props""",
    "held": """SELECT DISTINCT plan_id, CAST(substr(plan_period, 3) AS INTEGER) AS year, trim(regexp_replace(lower(manager_name), '[^a-z0-9]+', ' ', 'g')) AS manager,
        trim(regexp_replace(lower(fund_name), '[^a-z0-9]+', ' ', 'g')) AS fund FROM manager_fund_positions""",
    "names": "SELECT s_name AS name FROM supplier UNION ALL SELECT upper(s_name) FROM supplier UNION ALL SELECT replace(c_name, '#', ' ') FROM customer UNION ALL SELECT p_name FROM part",
    "log": "SELECT role, length(text) AS latency_ms, CASE WHEN turn % 5 = 4 THEN 'error' ELSE 'ok' END AS status FROM conversations WHERE text IS NOT NULL",
    "doc_rows": "SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents",
    "clean": r"SELECT doc_id, 1 AS page, CAST(line_no AS INTEGER) AS line_no, trim(regexp_replace(raw, '[ \t\n\x0b\f\r]+', ' ', 'g')) AS line FROM doc_rows",
}


def sql(select: str) -> str:
    """A query with the views that it needs, directly or through others, in front."""
    needed, open_ = set(), [select]
    while open_:
        text = open_.pop()
        for name in VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                open_.append(VIEWS[name])
    head = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in VIEWS if name in needed)
    return f"WITH {head}\n{select}" if head else select


def peers(rows: str, groups: list[str]) -> str:
    """Statistics of every plan's metric against the others of its group, by a self-join."""
    same = " AND ".join(f"o.{g} = s.{g}" for g in [*groups, "metric_name"])
    key = ", ".join(f"s.{g}" for g in [*groups, "metric_name"])
    return f"""SELECT {key}, s.plan_id, s.metric_value, count(o.metric_value) AS n_peers, round(avg(o.metric_value), 6) AS peer_mean, round(median(o.metric_value), 6) AS peer_median,
      round(s.metric_value - round(avg(o.metric_value), 6), 6) AS delta_vs_mean, round(100.0 * count(*) FILTER (WHERE o.metric_value <= s.metric_value) / count(o.metric_value), 4) AS percentile,
      CASE WHEN count(o.metric_value) >= 2 AND stddev_pop(o.metric_value) > 1e-9 THEN round((s.metric_value - avg(o.metric_value)) / stddev_pop(o.metric_value), 4) END AS z_score
      FROM ({rows}) s LEFT JOIN ({rows}) o ON {same} AND o.plan_id <> s.plan_id GROUP BY {key}, s.plan_id, s.metric_value"""


PANEL = """SELECT plan_id, peer_group, plan_period, metric_name, metric_value FROM (
      UNPIVOT (SELECT plan_id, peer_group, plan_period, funded_ratio, employer_contributions_usd / total_usd AS employer_share, employee_contributions_usd / total_usd AS employee_share, benefit_payments_usd / total_usd AS benefit_share FROM plan_funding)
      ON funded_ratio, employer_share, employee_share, benefit_share INTO NAME metric_name VALUE metric_value)"""

HEALTH_INPUTS = """SELECT plan_id, plan_period, funded_ratio AS funded, change AS trend, round(0.05 + funded_ratio / 20, 6) AS rate, 0.065::DOUBLE AS realistic, 0.066::DOUBLE AS peer,
      employer_contributions_usd AS adc, employee_contributions_usd AS paid, 0.2::DOUBLE * benefit_payments_usd AS cost, total_usd - assets_usd AS uaal, 0.05::DOUBLE * total_usd AS payment,
      CASE n_orders % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS closed, CAST(20 + n_orders % 11 AS DOUBLE) AS years,
      round(100 * (employer_contributions_usd - benefit_payments_usd) / total_usd, 4) AS cash, round(0.06 + funded_ratio / 25, 6) AS gasb, CAST(1995 + n_orders % 25 AS INTEGER) AS mortality FROM funding_changes"""

ORACLES = {
    "p6_first_numbers": r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(text, '[-+]?\d[\d,.]*\d|[-+]?\d') AS ts FROM documents),
      u AS (SELECT doc_id, unnest(ts) AS token, generate_subscripts(ts, 1) AS pos FROM t),
      b AS (SELECT doc_id, pos, token, regexp_replace(token, '^[+-]+', '') AS body FROM u WHERE NOT regexp_full_match(regexp_replace(token, '[.,]', '', 'g'), '(19|20)\d{2}')),
      c AS (SELECT *, CASE WHEN contains(body, '.') AND contains(body, ',') THEN CASE WHEN strpos(reverse(body), '.') < strpos(reverse(body), ',') THEN replace(body, ',', '') ELSE replace(replace(body, '.', ''), ',', '.') END
        WHEN contains(body, ',') THEN CASE WHEN regexp_full_match(body, '[^,]*,\d{1,2}') THEN replace(body, ',', '.') ELSE replace(body, ',', '') END
        WHEN regexp_matches(body, '\..*\.|^[^.]*\.000$') THEN replace(body, '.', '') ELSE body END AS clean FROM b),
      v AS (SELECT doc_id, pos, CASE WHEN starts_with(token, '-') THEN -TRY_CAST(clean AS DOUBLE) ELSE TRY_CAST(clean AS DOUBLE) END AS v FROM c),
      n AS (SELECT doc_id, arg_min(v, pos) AS first_number FROM v WHERE v IS NOT NULL GROUP BY doc_id)
      SELECT t.doc_id, n.first_number, CASE WHEN regexp_matches(lower(text), 'billion|(^|[^a-z])bn\b') THEN 'billion_usd' WHEN regexp_matches(lower(text), 'million|(^|[^a-z])mm\b') THEN 'million_usd' WHEN regexp_matches(lower(text), 'thousand|(^|[^a-z])k\b') THEN 'thousand_usd' ELSE 'usd' END AS scale,
        list_max(list_concat(list_transform(regexp_extract_all(text, '(?:19|20)\d{2}'), lambda x: CAST(x AS INTEGER)), list_transform(regexp_extract_all(text, '(?:19|20)\d{2}\s*[-/]\s*(?:19|20)?\d{2}'),
          lambda x: CASE WHEN length(regexp_extract(x, '\d+$')) = 4 THEN CAST(right(x, 4) AS INTEGER) ELSE CAST(substr(x, 1, 4) AS INTEGER) // 100 * 100 + CAST(right(x, 2) AS INTEGER) + CASE WHEN CAST(right(x, 2) AS INTEGER) < CAST(substr(x, 3, 2) AS INTEGER) THEN 100 ELSE 0 END END))) AS year
      FROM t LEFT JOIN n ON n.doc_id = t.doc_id""",
    "r1_sla_windows": """SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS window_start, event_type AS metric, count(*) AS n, min(value) AS min_value, max(value) AS max_value, round(CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE) / count(*), 6) AS avg_value FROM events GROUP BY 1, 2""",
    "r2_streamed_versions": """SELECT artifact, artifact_seq, status, CAST(sum(CASE WHEN status <> 'unchanged' THEN 1 ELSE 0 END) OVER (PARTITION BY artifact ORDER BY artifact_seq) AS BIGINT) AS version FROM (
      SELECT doc_id % 500 AS artifact, doc_id AS artifact_seq, CASE WHEN row_number() OVER w = 1 THEN 'new' WHEN lag(sha256(text)) OVER w IS NOT DISTINCT FROM sha256(text) THEN 'unchanged' ELSE 'superseding' END AS status FROM documents WHERE doc_id IS NOT NULL WINDOW w AS (PARTITION BY doc_id % 500 ORDER BY doc_id))""",
    "s6_latest_filings": "SELECT o_custkey AS filer, CAST(o_orderdate AS DATE) AS filing_date, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS accession FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') DESC) = 1",
    "k7_peer_store": "SELECT o_custkey AS ppd_id, CAST(year(o_orderdate) AS INTEGER) AS fy, o_orderkey, o_totalprice AS value FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderkey DESC) = 1",
    "w1_funding_trend": sql("""SELECT plan_id, plan_period, round(funded_ratio, 6) AS funded_ratio, change AS funded_ratio_change,
      CASE WHEN coalesce(employer_contributions_usd, employee_contributions_usd, benefit_payments_usd) IS NOT NULL THEN round(coalesce(employer_contributions_usd, 0) + coalesce(employee_contributions_usd, 0) + coalesce(-benefit_payments_usd, 0), 6) END AS net_external_cash_flow_usd FROM funding_changes"""),
    "w6_trend_change": sql("SELECT plan_id, CASE WHEN count(*) >= 2 THEN round(max_by(funded_ratio, plan_period) - min_by(funded_ratio, plan_period), 6) END AS trend_change, count(*) AS n_points FROM plan_funding GROUP BY plan_id"),
    "w4_peer_statistics": sql(f"""SELECT *, percentile AS favorable_percentile, CASE WHEN percentile <= 25 THEN 1 WHEN percentile <= 50 THEN 2 WHEN percentile <= 75 THEN 3 WHEN percentile IS NOT NULL THEN 4 END AS quartile_rank FROM ({peers(PANEL, ["plan_period"])})"""),
    "w2_benchmark_panel": sql(f"""SELECT b.plan_id, b.plan_period, b.metric_name, b.metric_value, b.percentile AS peer_percentile, CASE WHEN b.percentile <= 25 THEN 1 WHEN b.percentile <= 50 THEN 2 WHEN b.percentile <= 75 THEN 3 WHEN b.percentile IS NOT NULL THEN 4 END AS peer_quartile_rank,
      b.peer_median, round(round(b.metric_value, 6) - b.peer_median, 6) AS delta_vs_peer_median, t.percentile AS tight_peer_percentile, t.n_peers AS n_tight_peers
      FROM ({peers(PANEL, ['plan_period'])}) b JOIN ({peers(PANEL, ['plan_period', 'peer_group'])}) t ON b.plan_id = t.plan_id AND b.plan_period = t.plan_period AND b.metric_name = t.metric_name"""),
    "j3_allocation_peers": sql(f"""SELECT plan_id, plan_period, peer_group, metric_name AS asset_class, round(metric_value, 6) AS plan_allocation_pct, peer_mean AS peer_mean_pct, peer_median AS peer_median_pct, delta_vs_mean AS delta_vs_peer_mean_pct
      FROM ({peers('SELECT plan_id, plan_period, peer_group, asset_class AS metric_name, allocation_pct AS metric_value FROM plan_allocation', ['plan_period', 'peer_group'])})"""),
    "w5_plan_health": sql(f"""SELECT * FROM (WITH rated AS (SELECT plan_id, plan_period, dimension, rating, value FROM (SELECT plan_id, plan_period, unnest([
      {{'dimension': 'funded_ratio_mva', 'rating': CASE WHEN funded BETWEEN 0 AND 1 THEN CASE WHEN funded >= 0.9 THEN 'green' WHEN funded >= 0.7 THEN 'yellow' ELSE 'red' END ELSE 'unknown' END, 'value': CASE WHEN funded BETWEEN 0 AND 1 THEN round(funded, 6) END}},
      {{'dimension': 'funded_ratio_trend', 'rating': CASE WHEN trend BETWEEN -1 AND 1 THEN CASE WHEN trend > 0.01 THEN 'green' WHEN trend >= -0.01 THEN 'yellow' ELSE 'red' END ELSE 'unknown' END, 'value': CASE WHEN trend BETWEEN -1 AND 1 THEN round(trend, 6) END}},
      {{'dimension': 'assumed_return', 'rating': CASE WHEN rate - realistic > 0.01 OR rate - peer > 0.005 THEN 'red' WHEN rate - realistic > 0 THEN 'yellow' ELSE 'green' END, 'value': round(rate, 6)}},
      {{'dimension': 'contribution_sufficiency', 'rating': CASE WHEN adc > 0 AND paid >= 0 THEN CASE WHEN paid / adc >= 1 THEN 'green' WHEN paid / adc >= 0.9 THEN 'yellow' ELSE 'red' END ELSE 'unknown' END, 'value': CASE WHEN adc > 0 AND paid >= 0 THEN round(paid / adc, 4) END}},
      {{'dimension': 'tread_water', 'rating': CASE WHEN paid >= 0 AND cost >= 0 AND uaal >= 0 THEN CASE WHEN round(paid - (cost + rate * uaal), 6) >= 0 THEN 'green' WHEN round(paid - (cost + rate * uaal), 6) >= -abs(cost + rate * uaal) * 0.1 THEN 'yellow' ELSE 'red' END ELSE 'unknown' END, 'value': CASE WHEN paid >= 0 AND cost >= 0 AND uaal >= 0 THEN round(paid - (cost + rate * uaal), 6) END}},
      {{'dimension': 'amortization', 'rating': CASE WHEN payment < rate * uaal THEN 'red' WHEN closed IS NULL OR closed THEN 'green' ELSE 'yellow' END, 'value': CASE WHEN NOT payment < rate * uaal AND NOT closed AND years > 25 THEN round(years, 1) END}},
      {{'dimension': 'cash_flow_maturity', 'rating': CASE WHEN cash BETWEEN -100 AND 100 THEN CASE WHEN cash >= -3 THEN 'green' WHEN cash >= -5 THEN 'yellow' ELSE 'red' END ELSE 'unknown' END, 'value': CASE WHEN cash BETWEEN -100 AND 100 THEN round(cash, 4) END}},
      {{'dimension': 'gasb_crossover', 'rating': CASE WHEN gasb < rate THEN 'red' ELSE 'green' END, 'value': round(gasb, 6)}},
      {{'dimension': 'mortality_currency', 'rating': CASE WHEN mortality >= 2010 THEN 'green' WHEN mortality >= 2000 THEN 'yellow' ELSE 'red' END, 'value': CAST(mortality AS DOUBLE)}}], recursive := true) FROM ({HEALTH_INPUTS}))) SELECT * FROM rated UNION ALL
      SELECT plan_id, plan_period, 'overall', CASE WHEN bool_or(rating = 'red') THEN 'red' WHEN bool_or(rating = 'yellow') THEN 'yellow' WHEN bool_or(rating = 'green') THEN 'green' ELSE 'unknown' END, NULL FROM rated GROUP BY plan_id, plan_period)"""),
    "j4_holdings_overlap": sql("""SELECT 'NATION_0' AS subject_plan_id, k.plan_id AS counterparty_plan_id, 'FY1998' AS plan_period, k.manager_name, k.fund_name,
      CASE WHEN coalesce(m.disclosure_state, 'not_disclosed') = 'disclosed' AND coalesce(t.disclosure_state, 'not_disclosed') = 'disclosed' THEN CASE WHEN m.exposure_usd IS NOT NULL AND t.exposure_usd IS NOT NULL THEN 'overlap' ELSE 'unknown_due_to_non_disclosure' END
        WHEN coalesce(m.disclosure_state, 'not_disclosed') <> 'not_disclosed' AND coalesce(t.disclosure_state, 'not_disclosed') <> 'not_disclosed' THEN 'known_not_invested' ELSE 'unknown_due_to_non_disclosure' END AS overlap_status,
      CASE WHEN m.disclosure_state = 'disclosed' AND t.disclosure_state = 'disclosed' AND m.exposure_usd IS NOT NULL AND t.exposure_usd IS NOT NULL THEN round(least(m.exposure_usd, t.exposure_usd), 6) END AS overlap_usd,
      coalesce(m.disclosure_state, 'not_disclosed') AS subject_disclosure_state, coalesce(t.disclosure_state, 'not_disclosed') AS counterparty_disclosure_state
      FROM (SELECT p.plan_id, s.manager_name, s.fund_name FROM (SELECT DISTINCT plan_id FROM manager_fund_positions WHERE plan_period = 'FY1998' AND plan_id <> 'NATION_0') p, (SELECT manager_name, fund_name FROM manager_fund_positions WHERE plan_period = 'FY1998' AND plan_id = 'NATION_0') s
        UNION SELECT plan_id, manager_name, fund_name FROM manager_fund_positions WHERE plan_period = 'FY1998' AND plan_id <> 'NATION_0') k
      LEFT JOIN (SELECT * FROM manager_fund_positions WHERE plan_period = 'FY1998' AND plan_id = 'NATION_0') m ON m.manager_name = k.manager_name AND m.fund_name = k.fund_name
      LEFT JOIN (SELECT * FROM manager_fund_positions WHERE plan_period = 'FY1998' AND plan_id <> 'NATION_0') t ON t.plan_id = k.plan_id AND t.manager_name = k.manager_name AND t.fund_name = k.fund_name"""),
    "a1_position_weights": sql("SELECT plan_id, plan_period, security_id, round(weight, 9) AS weight FROM weights"),
    "a3_concentration": sql("""SELECT plan_id, plan_period, round(sum(weight * weight), 6) AS hhi, round(1 / sum(weight * weight), 4) AS effective_names, round(sum(weight) FILTER (WHERE n <= 10), 6) AS top_weight, count(*) AS n_securities
      FROM (SELECT *, row_number() OVER (PARTITION BY plan_id, plan_period ORDER BY weight DESC, security_id) AS n FROM weights) GROUP BY plan_id, plan_period"""),
    "a23_allocation_drift": sql("""SELECT plan_id, plan_period, CAST(round(sum(CAST(abs(active) * 0.5 AS DECIMAL(18,7))), 6) AS DOUBLE) AS drift, round(coalesce(sum(active) FILTER (WHERE asset_class IN ('PROMO', 'ECONOMY')), 0), 6) AS alternatives_active_weight, count(*) AS n_classes FROM (
      SELECT coalesce(a.plan_id, t.plan_id) AS plan_id, coalesce(a.plan_period, t.plan_period) AS plan_period, coalesce(a.asset_class, t.asset_class) AS asset_class, round(coalesce(a.allocation_pct, 0) - coalesce(t.allocation_pct, 0), 6) AS active
      FROM plan_allocation a FULL JOIN (SELECT plan_id, 'FY' || CAST(CAST(substr(plan_period, 3) AS INTEGER) + 1 AS VARCHAR) AS plan_period, asset_class, allocation_pct FROM plan_allocation) t ON a.plan_id = t.plan_id AND a.plan_period = t.plan_period AND a.asset_class = t.asset_class) GROUP BY plan_id, plan_period"""),
    "a24_active_share": sql("""SELECT plan_id, plan_period, active_share, round(active_share * 100, 4) AS active_share_pct,
      CASE WHEN round(active_share * 100, 4) < 20 THEN 'closet-indexer' WHEN round(active_share * 100, 4) <= 60 THEN 'moderately-active' WHEN round(active_share * 100, 4) <= 80 THEN 'highly-active' ELSE 'very-highly-active' END AS cremers_band FROM (
      SELECT p.plan_id, p.plan_period, round(0.5 * sum(abs(coalesce(w.weight, 0) - b.weight)), 6) AS active_share
      FROM (SELECT DISTINCT plan_id, plan_period FROM weights) p CROSS JOIN benchmark_weights b LEFT JOIN weights w ON w.plan_id = p.plan_id AND w.plan_period = p.plan_period AND w.security_id = b.security_id GROUP BY p.plan_id, p.plan_period)"""),
    "a25_factor_tilts": sql("""SELECT plan_id, plan_period, factor, round(sum(weight * z) / sum(weight), 6) AS z_score, round(sum(weight), 6) AS coverage FROM weights
      JOIN (SELECT 'cusip:' || CAST(vec_id AS VARCHAR) AS security_id, unnest(['value', 'quality', 'size', 'momentum']) AS factor, CAST(unnest(embedding[1:4]) AS DOUBLE) AS z FROM embeddings) USING (security_id) GROUP BY plan_id, plan_period, factor"""),
    "a26_brinson": sql("""SELECT plan_id, plan_period, round(sum(a), 6) + 0 AS allocation_effect, round(sum(s), 6) + 0 AS selection_effect, round(sum(i), 6) + 0 AS interaction_effect, round(sum(a) + sum(s) + sum(i), 6) + 0 AS total_active_return, round(sum(a) + sum(s) + sum(i) - 0.002, 6) + 0 AS total_active_return_net_of_fee FROM (
      SELECT plan_id, plan_period, (wp - wb) * (rb - sum(wb * rb) OVER (PARTITION BY plan_id, plan_period)) AS a, wb * (rp - rb) AS s, (wp - wb) * (rp - rb) AS i FROM (
      SELECT coalesce(p.plan_id, b.plan_id) AS plan_id, coalesce(p.plan_period, b.plan_period) AS plan_period, coalesce(p.allocation_pct, 0) AS wp, coalesce(p.allocation_pct / 10, 0) AS rp, coalesce(b.weight, 0) AS wb, coalesce(b.weight / 8, 0) AS rb
      FROM plan_allocation p FULL JOIN (SELECT plan_id, plan_period, asset_class, weight FROM (SELECT DISTINCT plan_id, plan_period FROM plan_allocation) CROSS JOIN (SELECT asset_class, 1.0::DOUBLE / count(*) OVER () AS weight FROM (SELECT DISTINCT p_type AS asset_class FROM part))) b
      ON p.plan_id = b.plan_id AND p.plan_period = b.plan_period AND p.asset_class = b.asset_class)) GROUP BY plan_id, plan_period"""),
    "a28_liquidity": sql("""SELECT plan_id, plan_period, round(il, 4) AS illiquid_market_value_usd, round(t, 4) AS total_market_value_usd, round(il / t, 6) AS illiquid_pct, CASE WHEN o > 0 THEN round((t - il) / o, 6) END AS outflow_coverage_ratio FROM (
      SELECT plan_id, plan_period, coalesce(CAST(sum(CAST(market_value_usd AS DECIMAL(28,4))) FILTER (WHERE asset_class IN ('PROMO', 'ECONOMY')) AS DOUBLE), 0) AS il, CAST(sum(CAST(market_value_usd AS DECIMAL(28,4))) AS DOUBLE) AS t FROM security_positions GROUP BY plan_id, plan_period)
      LEFT JOIN (SELECT plan_id, plan_period, benefit_payments_usd - employer_contributions_usd AS o FROM plan_funding) USING (plan_id, plan_period)"""),
    "j6_security_overlap": sql("""SELECT a.plan_period, a.plan_id AS subject_plan_id, b.plan_id AS counterparty_plan_id, round(sum(least(a.weight, b.weight)), 6) AS overlap_weight, count(*) AS n_shared
      FROM weights a JOIN weights b ON a.plan_period = b.plan_period AND a.security_id = b.security_id AND a.plan_id < b.plan_id GROUP BY ALL"""),
    "b1_as_of": sql("""SELECT plan_id, metric_name, value, valid_from, asserted_at, input_seq FROM core_facts WHERE valid_from <= TIMESTAMP '1998-06-15' AND TIMESTAMP '1998-06-15' < valid_to AND asserted_at <= TIMESTAMP '1998-06-20' AND (superseded_at IS NULL OR TIMESTAMP '1998-06-20' < superseded_at)"""),
    "b2_latest_known": sql("SELECT plan_id, metric_name, value, valid_from, asserted_at, input_seq FROM core_facts WHERE asserted_at <= TIMESTAMP '1999-01-01' QUALIFY row_number() OVER (PARTITION BY plan_id, metric_name, valid_from ORDER BY asserted_at DESC, input_seq) = 1"),
    "b3_active_overlaps": sql("""SELECT plan_id, metric_name, input_seq, valid_from, overlaps_until FROM (SELECT *, max(valid_to) OVER (PARTITION BY plan_id ORDER BY valid_from, input_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS overlaps_until FROM core_facts WHERE superseded_at IS NULL) WHERE valid_from < overlaps_until"""),
    "b4_supersede": sql("""SELECT plan_id, metric_name, input_seq, value, valid_from, CASE WHEN superseded_at IS NULL AND EXISTS (SELECT 1 FROM core_facts r WHERE r.superseded_at IS NULL AND r.input_seq % 10 = 0 AND r.plan_id = c.plan_id AND r.metric_name = c.metric_name AND r.valid_from = c.valid_from) THEN TIMESTAMP '2005-01-01' ELSE superseded_at END AS superseded_at, FALSE AS restated FROM core_facts c
      UNION ALL SELECT plan_id, metric_name, input_seq, value * 2, valid_from, superseded_at, TRUE FROM core_facts WHERE superseded_at IS NULL AND input_seq % 10 = 0"""),
    "b7_artifact_versions": """SELECT source, lang, artifact_seq, checksum, status, CAST(sum(CASE WHEN status <> 'unchanged' THEN 1 ELSE 0 END) OVER (PARTITION BY source, lang ORDER BY artifact_seq) AS BIGINT) AS version FROM (
      SELECT source, lang, doc_id AS artifact_seq, sha256(text) AS checksum, CASE WHEN lag(sha256(text)) OVER w IS NULL THEN 'new' WHEN lag(sha256(text)) OVER w = sha256(text) THEN 'unchanged' ELSE 'superseding' END AS status FROM documents WINDOW w AS (PARTITION BY source, lang ORDER BY doc_id))""",
    "b15_canonical_ids": """SELECT s_suppkey AS source, CASE WHEN s_suppkey // 5 % 4 = 3 AND s_suppkey % 5 <= 3 THEN NULL ELSE least((s_suppkey // 5) * 5 + 4, (SELECT max(s_suppkey) FROM supplier) + 1) END AS canonical_id,
      CASE WHEN s_suppkey // 5 % 4 = 3 THEN 'ambiguous' ELSE 'resolved' END AS status FROM supplier WHERE s_suppkey % 5 < 4""",
    "w3_anomalies": sql("SELECT * FROM anomalies"),
    "q1_review_queue": sql("""SELECT 'review:' || substr(sha256('"' || plan_id || '"|"' || period || '"|"' || metric || '"'), 1, 20) AS review_id, plan_id, period, metric, severity || ' shift in ' || metric AS reason, priority, 'pending' AS state FROM anomalies"""),
    "a7_coverage": sql("""SELECT peer_group AS cohort, plan_period AS period, count(*) AS n_total, round(count(*) FILTER (WHERE m.disclosure_state = 'disclosed') / count(*), 6) AS manager_disclosed_rate, round(count(*) FILTER (WHERE exposure_usd IS NOT NULL) / count(*), 6) AS exposure_known_rate
      FROM manager_fund_positions m JOIN plan_dim USING (plan_id) GROUP BY ROLLUP (peer_group, plan_period)"""),
    "a9_window_report": """SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type AS metric, count(*) AS n, min(value) AS min_value, max(value) AS max_value, round(CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE) / count(*), 6) AS avg_value,
      array_to_string(list_sort(list(DISTINCT user_id % 10)), ',') AS run_ids FROM events GROUP BY 1, 2""",
    "a11_sla_gate": """SELECT t.metric, t.op, t.limit_ AS "limit", t.critical, o.value AS observed, coalesce(CASE WHEN t.op = '>=' THEN o.value < t.limit_ ELSE o.value > t.limit_ END, TRUE) AS breach, coalesce(CASE WHEN t.op = '>=' THEN o.value < t.limit_ ELSE o.value > t.limit_ END, TRUE) AND t.critical AS fails
      FROM (VALUES ('click', '>=', 0.95::DOUBLE, TRUE), ('error', '<=', 12::DOUBLE, TRUE), ('purchase', '<=', 0.08::DOUBLE, FALSE), ('review_latency', '<=', 12::DOUBLE, TRUE)) t(metric, op, limit_, critical)
      LEFT JOIN (SELECT event_type AS metric, round(CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE) / count(*), 6) AS value FROM events GROUP BY 1) o USING (metric)""",
    "a30_operation_summary": sql("""SELECT role, count(*) AS total_requests, count(*) FILTER (WHERE status = 'error') AS failed_requests, round(sum(latency_ms) / count(*), 6) AS avg_latency_ms, CAST(max(latency_ms) FILTER (WHERE place = round_even((n - 1) * 0.95::DOUBLE, 0)) AS DOUBLE) AS p95_latency_ms
      FROM (SELECT *, count(*) OVER (PARTITION BY role) AS n, row_number() OVER (PARTITION BY role ORDER BY latency_ms) - 1 AS place FROM log) GROUP BY role"""),
    "a32_model_benchmark": """SELECT source, n, round(ok / n, 6) AS success_rate,
      round(greatest(0, (ok / n + z2 / (2 * n) - z * sqrt(ok / n * (1 - ok / n) / n + z2 / (4 * n * n))) / (1 + z2 / n)), 6) AS success_low, round(least(1, (ok / n + z2 / (2 * n) + z * sqrt(ok / n * (1 - ok / n) / n + z2 / (4 * n * n))) / (1 + z2 / n)), 6) AS success_high,
      round(fp / n, 6) AS false_pass_rate, round(fn / n, 6) AS false_fail_rate FROM (
      SELECT source, count(*) AS n, count(*) FILTER (WHERE quality = p) AS ok, count(*) FILTER (WHERE quality = 0 AND p = 1) AS fp, count(*) FILTER (WHERE quality = 1 AND p = 0) AS fn, 1.959963984540054::DOUBLE AS z, 1.959963984540054::DOUBLE * 1.959963984540054::DOUBLE AS z2
      FROM (SELECT source, quality, CASE WHEN length(text) > 300 THEN 1 ELSE 0 END AS p FROM documents JOIN labels USING (doc_id)) GROUP BY source)""",
    "a34_quantile_summary": """SELECT event_type, round(CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE) / count(*), 6) AS mean, max(value) FILTER (WHERE place = round_even((n - 1) * 0.05::DOUBLE, 0)) AS p05, max(value) FILTER (WHERE place = round_even((n - 1) * 0.95::DOUBLE, 0)) AS p95
      FROM (SELECT *, count(*) OVER (PARTITION BY event_type) AS n, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS place FROM events) GROUP BY event_type""",
    "j14_snapshot_diff": sql("""SELECT plan_id, asset_class, before, after, change FROM (SELECT coalesce(a.plan_id, b.plan_id) AS plan_id, coalesce(a.asset_class, b.asset_class) AS asset_class, a.v AS before, b.v AS after, CASE WHEN a.plan_id IS NULL THEN 'added' WHEN b.plan_id IS NULL THEN 'removed' WHEN a.v IS DISTINCT FROM b.v THEN 'changed' END AS change
      FROM (SELECT plan_id, asset_class, round(allocation_pct, 2) AS v FROM plan_allocation WHERE plan_period = 'FY1997') a FULL JOIN (SELECT plan_id, asset_class, round(allocation_pct, 2) AS v FROM plan_allocation WHERE plan_period = 'FY1998') b ON a.plan_id = b.plan_id AND a.asset_class = b.asset_class) WHERE change IS NOT NULL"""),
    "u5_preferred_aliases": sql("""SELECT norm, arg_min(name, {'u': name = upper(name), 'l': lower(name), 'n': name}) AS preferred, count(*) AS n_seen FROM (SELECT name, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS norm FROM names) WHERE norm <> '' GROUP BY norm"""),
    "j11_alias_candidates": """SELECT source_name, 'supplier:' || CAST(s_suppkey AS VARCHAR) AS stable_id, 1.0::DOUBLE AS confidence, 'exact' AS strategy FROM (SELECT upper(replace(s_name, '#', '  ')) AS source_name, s_suppkey FROM supplier)""",
    "j12_alias_routing": """SELECT upper(replace(s_name, '#', '  ')) AS source_name, 'supplier:' || CAST(s_suppkey AS VARCHAR) AS stable_id, 1.0::DOUBLE AS confidence, 'auto_link' AS decision, 'linked' AS reason FROM supplier""",
    "w7_publication_events": sql("SELECT system_id, source_id, published_at FROM publications"),
    "w9_cadence_profiles": sql("""SELECT system_id, source_id, round(coalesce(m, 365), 3) AS frequency_days, months, CASE WHEN m IS NULL THEN 0.25 WHEN n < 3 THEN round(0.2::DOUBLE + 0.2::DOUBLE * (n / 3), 3) WHEN mean <= 0 THEN 0 ELSE round(least(0.35::DOUBLE + 0.45::DOUBLE * greatest(0, 1 - least(sd / mean, 1)) + 0.2::DOUBLE * least(n / 8, 1), 0.99), 3) END AS confidence, n AS sample_size, n < 3 AS is_sparse FROM (
      SELECT system_id, source_id, median(gap) AS m, avg(gap) AS mean, stddev_pop(gap) AS sd, array_to_string(list_sort(list(DISTINCT month(published_at))), ',') AS months, count(*) AS n FROM (
      SELECT *, (epoch_us(published_at) - epoch_us(lag(published_at) OVER (PARTITION BY system_id, source_id ORDER BY published_at))) / 1e6::DOUBLE / 86400 AS gap FROM publications) GROUP BY system_id, source_id)"""),
    "w11_lifecycle": sql("""SELECT plan_id, year, manager, fund, state FROM (SELECT coalesce(h.plan_id, b.plan_id) AS plan_id, coalesce(h.year, b.year) AS year, coalesce(h.manager, b.manager) AS manager, coalesce(h.fund, b.fund) AS fund, CASE WHEN b.plan_id IS NULL THEN 'entered' WHEN h.plan_id IS NULL THEN 'exited' ELSE 'still_invested' END AS state
      FROM held h FULL JOIN (SELECT plan_id, year + 1 AS year, manager, fund FROM held) b ON h.plan_id = b.plan_id AND h.year = b.year AND h.manager = b.manager AND h.fund = b.fund) JOIN (SELECT plan_id, min(year) AS f, max(year) AS l FROM held GROUP BY plan_id) USING (plan_id) WHERE year > f AND year <= l"""),
    "e1_clean_lines": sql("SELECT doc_id, page, line_no, line FROM clean WHERE line <> '' AND NOT regexp_matches(lower(line), '^(page )?[0-9]+( of [0-9]+)?$')"),
    "x1_scenarios": sql("""SELECT plan_id, plan_period, metric_name, scenario, round(value, 6) AS baseline_value, round(value + shock, 6) AS scenario_value, round(value + shock - value, 6) AS delta_value FROM (
      SELECT plan_id, plan_period, 'funded_ratio' AS metric_name, funded_ratio AS value FROM plan_funding UNION ALL SELECT plan_id, plan_period, 'employer_share', employer_contributions_usd / total_usd FROM plan_funding) m
      CROSS JOIN (VALUES ('base', 0::DOUBLE, 0::DOUBLE), ('stress', -0.1::DOUBLE, 0.02::DOUBLE)) s(scenario, a, b) CROSS JOIN LATERAL (SELECT CASE metric_name WHEN 'funded_ratio' THEN a ELSE b END AS shock)"""),
    "p1_entity_tokens": "SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS token, replace(lower(p_type), ' ', '_') AS asset_class, CASE WHEN p_size > 1 THEN round(p_size / 100, 9) ELSE p_size END AS ratio FROM part",
    "p14_normal_urls": r"SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9_+.-]*://[^/?#]*)', 1)) || regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9_+.-]*://[^/?]*', ''), '/$', '') AS url FROM (SELECT page_id, regexp_replace(url, '^\s+|\s+$', '', 'g') AS url FROM pages)",
    "p38_redaction": r"SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(text, 'sk-[A-Za-z0-9_-]{8,}', '[REDACTED]', 'g'), 'ghp_[A-Za-z0-9]{12,}', '[REDACTED]', 'g'), '(?i)api[_-]?key\s*[:=]\s*[A-Za-z0-9._-]{8,}', '[REDACTED]', 'g')) AS redacted_sha256 FROM documents",
    "p24_confidence_routing": sql("SELECT plan_id, period, round(least(1, confidence), 6) AS confidence, CASE WHEN round(least(1, confidence), 6) >= 0.9 THEN 'auto_accept' WHEN round(least(1, confidence), 6) >= 0.75 THEN 'publish_with_warning' ELSE 'high_priority_review' END AS routing_outcome, CASE WHEN round(least(1, confidence), 6) >= 0.9 THEN 'none' WHEN round(least(1, confidence), 6) >= 0.75 THEN 'medium' ELSE 'high' END AS review_priority, FALSE AS publish_blocked FROM points"),
    "a17_registry_audit": sql("SELECT peer_group, c_mktsegment AS segment, count(*) AS n_members FROM customer JOIN plan_dim ON c_nationkey = n_nationkey GROUP BY GROUPING SETS ((peer_group), (c_mktsegment), ())"),
    "w14_ambiguous_names": sql("SELECT norm, count(DISTINCT name) AS n_spellings FROM (SELECT name, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS norm FROM names) WHERE norm <> '' GROUP BY norm HAVING count(DISTINCT name) > 1"),
}
