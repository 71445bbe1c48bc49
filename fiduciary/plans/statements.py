"""Registered queries of statements and record rules, each beside its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import cut
from ..operators import quality, records, statements
from . import domain as D
from .oracle import sql

Query = Callable[[SparkSession, str], DataFrame]


def tenths(c: Column) -> Column:
    """A share as percent with one digit, cut off, as text."""
    k = F.floor(c * 1000).cast("bigint")
    return F.concat(F.floor(k / 10).cast("string"), F.lit("."), F.pmod(k, F.lit(10)).cast("string"))


def statement_blocks(s: SparkSession, d: str) -> DataFrame:
    """Two paragraphs of every plan's yearly statement; every third one doesn't disclose its discount rate."""
    f = D.plan_funding(s, d)
    n = F.col("n_orders")
    first = F.concat(F.lit("In "), F.substring("plan_period", 3, 4), F.lit(" the Funded Ratio was 2,019 then and is now "), tenths(F.col("funded_ratio")), F.lit("% of liabilities. AAL was $"), n.cast("string"), F.lit(" million."))
    second = F.when(n % 3 == 0, "Discount rate not disclosed. Participant count: ").otherwise(F.concat(F.lit("The discount rate is "), (5 + n % 3).cast("string"), F.lit("."), (n % 10).cast("string"), F.lit(" percent; active participants ")))
    texts = F.array(F.struct(F.lit("text:0").alias("ref"), first.alias("text")), F.struct(F.lit("text:1").alias("ref"), F.concat(second, (n * 7).cast("string")).alias("text")))
    return f.select("plan_id", "plan_period", F.inline(texts)).withColumn("unit", F.lit("thousand_usd"))


def statement_rows(s: SparkSession, d: str) -> DataFrame:
    """Table rows of the statements: a ratio for every second one, which every fourth one gives differently, and AVA without unit."""
    f = D.plan_funding(s, d)
    n = F.col("n_orders")
    ratio = F.when(n % 2 == 0, F.concat(tenths(F.col("funded_ratio") + F.when(n % 4 == 0, 0.25).otherwise(0.0)), F.lit("%")))
    rows = F.array(F.struct(F.lit("table:1").alias("ref"), F.lit(" Funding Ratio (MVA)").alias("label"), ratio.alias("value")), F.struct(F.lit("table:2").alias("ref"), F.lit("Actuarial Value of Assets").alias("label"), n.cast("string").alias("value")))
    return f.select("plan_id", "plan_period", F.inline(rows)).withColumn("unit", F.lit("thousand_usd"))


def metrics(s: SparkSession, d: str) -> DataFrame:
    return statements.statement_metrics(statements.metric_candidates(statement_blocks(s, d), statement_rows(s, d)))


def diagnostics(s: SparkSession, d: str) -> DataFrame:
    return statements.metric_diagnostics(D.plan_funding(s, d), metrics(s, d))


def routed(s: SparkSession, d: str) -> DataFrame:
    m = cut(metrics(s, d))  # used three times
    found = m.where("metric_name IN ('funded_ratio', 'participant_count')")
    told = statements.metric_diagnostics(D.plan_funding(s, d), m).where("metric_name IN ('funded_ratio', 'aal_usd')")
    return statements.second_extractor(D.plan_funding(s, d).select("plan_id", "plan_period", (F.col("n_orders") % 5 == 0).alias("complex")), found, told, sure=0.8)


def label_lines(s: SparkSession, d: str) -> DataFrame:
    """The statements' table rows as lines of text, in columns or after a colon, with empty lines and page numbers between."""
    rows = statement_rows(s, d).where("value IS NOT NULL")
    line = F.when(F.col("ref") == "table:1", F.concat(F.trim("label"), F.lit(" |  2019 | "), F.col("value"))).otherwise(F.concat(F.col("label"), F.lit(":  "), F.col("value")))
    text = F.concat_ws("\n", F.lit("Page 3 of 9"), line, F.lit("  "), F.lit("closing words"))
    return quality.label_values(quality.clean_lines(rows.select(F.concat_ws("/", "plan_id", "plan_period", "ref").alias("doc_id"), text.alias("text"))))


def history_families(s: SparkSession, d: str) -> dict[str, DataFrame]:
    f, a, p = D.plan_funding(s, d), D.plan_allocation(s, d), D.manager_fund_positions(s, d)
    ref = lambda *c: F.array(F.concat_ws(":", *c))
    return {
        "funded": f.select("plan_id", "plan_period", F.lit("funded_ratio").alias("metric_name"), F.col("funded_ratio").alias("value"), F.lit("ratio").alias("unit"), F.lit(0.93).alias("confidence"), ref(F.lit("order"), F.col("n_orders").cast("string")).alias("evidence_refs")),
        "cash_flow": f.select("plan_id", "plan_period", F.lit("benefit_payments").alias("metric_name"), F.col("benefit_payments_usd").alias("value"), F.lit("usd").alias("unit")),
        "allocation": a.select("plan_id", "plan_period", F.col("asset_class").alias("metric_name"), F.col("allocation_pct").alias("value"), F.lit("ratio").alias("unit"), ref(F.lit("class"), F.col("asset_class")).alias("evidence_refs")),
        "holding": p.select("plan_id", "plan_period", F.lit("exposure").alias("metric_name"), F.col("exposure_usd").alias("value"), F.lit("usd").alias("unit"), "manager_name", "fund_name"),
        "fee": p.where("exposure_usd IS NOT NULL").select("plan_id", "plan_period", F.lit("fee").alias("metric_name"), (F.col("exposure_usd") / 50).alias("value"), F.lit("usd").alias("unit"), "manager_name", "fund_name"),
    }


def history(s: SparkSession, d: str) -> DataFrame:
    h = records.metric_history(history_families(s, d))
    return h.select("plan_id", "plan_period", "metric_family", "metric_name", "value", "unit", "manager_name", "fund_name", "confidence", F.array_join("evidence_refs", ",").alias("refs"))


def curated_history(s: SparkSession, d: str) -> DataFrame:
    """Counts by family of the facts that the curated view keeps, where the unit of holdings of some managers is blank."""
    h = records.metric_history(history_families(s, d)).withColumnsRenamed({"value": "normalized_value"})
    unit = F.when(F.col("manager_name").endswith("1"), "  ").when(F.col("manager_name").endswith("2"), None).otherwise(F.col("unit"))
    return records.curated_metrics(h.withColumn("normalized_unit", unit)).groupBy("metric_family").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("normalized_value").cast("decimal(28,6)")).cast("double"), 2).alias("total"))


def curated_flows(s: SparkSession, d: str) -> DataFrame:
    f = D.plan_funding(s, d)
    fields = ["total_usd", "employer_contributions_usd", "benefit_payments_usd"]
    units = {f"{x}_unit": F.when(F.col("n_orders") % (i + 5) == 0, " ").otherwise("usd") for i, x in enumerate(fields)}
    return records.curated_cash_flows(f.withColumns(units), fields).select("plan_id", "plan_period", *[F.round(x, 2).alias(x) for x in fields])


def cohorts(s: SparkSession, d: str) -> DataFrame:
    c = D.table(s, d, "customer").select(F.col("c_custkey").alias("stable_id"), (F.col("c_nationkey") % 2 == 0).alias("in_state_employee_universe"), (F.col("c_mktsegment") == "BUILDING").alias("in_sampled_50"))
    kinds = {"state": {"state_only": True}, "sampled": {"sampled_only": True}, "both": {"state_only": True, "sampled_only": True}}
    first, *rest = [records.cohort(c, **how).select("stable_id", F.lit(name).alias("cohort")) for name, how in kinds.items()]
    for df in rest:
        first = first.union(df)
    return first


def plan_formulas(s: SparkSession, d: str) -> DataFrame:
    f, c = D.plan_funding(s, d), F.col
    rate = F.when(c("n_orders") % 4 == 0, float("nan")).otherwise(0.07)
    uaal = c("total_usd") - c("assets_usd")
    zero = F.when(c("n_orders") % 6 == 0, 0.0).otherwise(c("assets_usd"))
    return f.select(
        "plan_id", "plan_period", records.safe_ratio(c("benefit_payments_usd"), zero).alias("benefit_ratio"), records.safe_delta(c("funded_ratio"), rate).alias("delta"),
        records.tread_water_gap(c("employer_contributions_usd"), c("employee_contributions_usd"), rate, uaal).alias("tread_water_gap"), records.negative_amortization(c("employer_contributions_usd"), rate, uaal).alias("negative_amortization"),
        records.net_cash_flow_pct(c("employer_contributions_usd"), c("benefit_payments_usd"), zero).alias("net_cash_flow_pct"),
        records.amortization_closed(F.element_at(F.array(*map(F.lit, ("Open level %", "CLOSED 20y", "layered bases", "none"))), (c("n_orders") % 4 + 1).cast("int"))).alias("closed"),
    )


def filing_urls(s: SparkSession, d: str) -> DataFrame:
    o = D.table(s, d, "orders")
    name = F.when(F.col("o_orderkey") % 3 == 0, " ").otherwise(F.concat(F.lit(" /table"), F.col("o_orderkey").cast("string"), F.lit(".xml")))
    accession = F.concat_ws("-", F.lpad(F.col("o_custkey").cast("string"), 10, "0"), F.lit("24"), F.lpad(F.col("o_orderkey").cast("string"), 6, "0"))
    subs, table = records.filing_urls(F.col("o_custkey"), accession, name, "https://data.example/submissions/", "https://www.example/data/")
    return o.select("o_orderkey", subs.alias("submissions_url"), table.alias("table_url"))


def citations(s: SparkSession, d: str) -> DataFrame:
    k = F.col("l_orderkey")
    text = lambda *c: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in c])
    proposed = F.array(text(" p:", (k % 7).cast("string"), " "), text("p:", (k % 5).cast("string")), text("p:", (k % 7).cast("string")))
    allowed = F.array(text("p:", (k % 3).cast("string")), F.lit(""), text("p:", (k % 5 + 1).cast("string")), text("p:", (k % 3).cast("string")))
    return D.table(s, d, "lineitem").where("l_linenumber = 1").select("l_orderkey", F.array_join(records.allowed_citations(proposed, allowed), ",").alias("citations"))


def failures(s: SparkSession, d: str) -> DataFrame:
    e = D.table(s, d, "events")
    stage = F.element_at(F.array(*map(F.lit, ("source_map", "discovery", "ingestion", "extraction"))), (F.col("event_id") % 4 + 1).cast("int"))
    message = F.element_at(F.array(*map(F.lit, ("HTTP 403", "Robots.txt", "Revised file", "Supersession", "timeout"))), (F.col("event_id") % 5 + 1).cast("int"))
    return e.select("event_id", records.failure_category(stage, message).alias("category"))


def incomplete_plans(s: SparkSession, d: str) -> DataFrame:
    c = D.table(s, d, "customer")
    name = F.when(F.col("c_custkey") % 4 == 0, "  ").otherwise(F.col("c_name"))
    return records.missing_fields(c.select("c_custkey", name.alias("legal_name"), F.when(F.col("c_custkey") % 6 != 0, F.col("c_mktsegment")).alias("system_type"), F.col("c_nationkey").alias("jurisdiction")), "c_custkey", ["legal_name", "system_type", "jurisdiction"])


def run_ids(s: SparkSession, d: str) -> DataFrame:
    f = D.plan_funding(s, d)
    return f.select("plan_id", "plan_period", records.run_id("scenario", F.lit("deterministic"), F.concat(F.lit(" "), "plan_id"), F.col("plan_period"), F.lit("stress "), F.col("n_orders").cast("string")).alias("run_id"))


def alias_cases(s: SparkSession, d: str) -> DataFrame:
    """A part's name against the names of parts of its brand and size, of which one is its own."""
    p = D.table(s, d, "part").select("p_partkey", "p_name", F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("shelf"))
    words = F.split("p_name", " ")
    cases = p.select(F.col("p_partkey").alias("case_id"), "shelf", F.array_join(F.slice(words, 1, 2), "-").alias("alias"))
    return records.alias_scores(cases, p.select("shelf", F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("candidate")), by="shelf")


def payloads(s: SparkSession, d: str) -> DataFrame:
    """Orders with the parts of their lines as evidence; returned lines have none."""
    lines = D.table(s, d, "lineitem").where("l_returnflag <> 'R'")
    links = lines.select(F.col("l_orderkey").alias("row_id"), F.col("l_linenumber").alias("link_id"), F.col("l_partkey").alias("evidence_id"))
    evidence = D.table(s, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("evidence_id"), F.concat(F.lit("p."), F.col("p_size").cast("string")).alias("ref"))
    return records.citation_payload(D.table(s, d, "orders").select(F.col("o_orderkey").alias("row_id")), links, evidence)


def findings(s: SparkSession, d: str) -> DataFrame:
    f = D.plan_funding(s, d).where("funded_ratio < 0.6")
    return f.select("plan_id", "plan_period", F.round("funded_ratio", 6).alias("funded_ratio"), F.when(F.col("n_orders") % 2 == 0, "pending").otherwise("resolved").alias("state"))


QUERIES: dict[str, Query] = {
    "e3_statement_metrics": metrics,
    "e3_metric_diagnostics": diagnostics,
    "e4_funded_status": lambda s, d: metrics(s, d).where("metric_name IN ('funded_ratio', 'aal_usd', 'ava_usd')").select("plan_id", "plan_period", "metric_name", "normalized_value"),
    "e13_second_extractor": routed,
    "e2_label_lines": label_lines,
    "b6_metric_history": history,
    "p27_curated_metrics": curated_history,
    "p28_curated_cash_flows": curated_flows,
    "p26_cohorts": cohorts,
    "p35_plan_formulas": plan_formulas,
    "p36_filing_urls": filing_urls,
    "p39_allowed_citations": citations,
    "p40_failure_categories": failures,
    "d1_incomplete_plans": incomplete_plans,
    "x2_run_ids": run_ids,
    "j13_alias_cases": alias_cases,
    "j15_citation_payloads": payloads,
    "t5_latest_log_rows": lambda s, d: records.latest_rows(D.table(s, d, "events").select("event_id", "ts", "event_type"), 500, "ts", "event_id").select("event_id", "event_type"),
    "t6_capped_findings": lambda s, d: records.capped(findings(s, d), 10, "plan_id", "plan_period"),
    "q4_pending": lambda s, d: records.pending(findings(s, d)).withColumn("list", F.lit("pending")).union(records.resolved(findings(s, d)).withColumn("list", F.lit("resolved"))),
}


def tenths_sql(x: str) -> str:
    k = f"CAST(floor({x} * 1000) AS BIGINT)"
    return f"({k} // 10 || '.' || {k} % 10)"


STATEMENTS = rf"""blocks AS (SELECT plan_id, plan_period, unnest([
      {{'ref': 'text:0', 'text': 'In ' || substr(plan_period, 3, 4) || ' the Funded Ratio was 2,019 then and is now ' || {tenths_sql('funded_ratio')} || '% of liabilities. AAL was $' || n_orders || ' million.'}},
      {{'ref': 'text:1', 'text': CASE WHEN n_orders % 3 = 0 THEN 'Discount rate not disclosed. Participant count: ' ELSE 'The discount rate is ' || (5 + n_orders % 3) || '.' || (n_orders % 10) || ' percent; active participants ' END || (n_orders * 7)}}], recursive := true) FROM plan_funding),
    table_rows AS (SELECT plan_id, plan_period, unnest([
      {{'ref': 'table:1', 'label': 'Funding Ratio (MVA)', 'value': CASE WHEN n_orders % 2 = 0 THEN {tenths_sql('(funded_ratio + CASE WHEN n_orders % 4 = 0 THEN 0.25::DOUBLE ELSE 0 END)')} || '%' END}},
      {{'ref': 'table:2', 'label': 'Actuarial Value of Assets', 'value': CAST(n_orders AS VARCHAR)}}], recursive := true) FROM plan_funding),
    names AS (SELECT unnest([{', '.join(f"{{'metric_name': '{m}', 'kind': '{k}', 'alias': '{a}'}}" for m, (k, aliases) in statements.METRICS.items() for a in aliases)}], recursive := true)),
    mentions AS (SELECT plan_id, plan_period, metric_name, kind, ref, text AS raw, 0.84::DOUBLE AS confidence, strpos(lower(text), alias) + length(alias) AS pos,
        regexp_extract(substr(text, strpos(lower(text), alias) + length(alias), 96), '(?s)^(.*?)([.;!?](\s|$)|$)', 1) AS near FROM blocks JOIN names ON contains(lower(text), alias)
      UNION ALL SELECT plan_id, plan_period, metric_name, kind, ref, value, 0.93::DOUBLE, 0, value FROM table_rows JOIN names ON contains(lower(label), alias) AND value IS NOT NULL),
    figures AS (SELECT *, CAST(list_filter(regexp_extract_all(near, '[-+]?\d[\d.,]*\d|[-+]?\d'), lambda x: NOT regexp_matches(replace(replace(x, ',', ''), '.', ''), '^(19|20)\d\d$'))[1] AS DOUBLE) AS v FROM mentions),
    candidates AS (SELECT *, CASE WHEN kind = 'money' THEN CASE WHEN contains(lower(raw), 'million') THEN 'million_usd' ELSE 'thousand_usd' END WHEN kind = 'count' THEN 'count'
        WHEN contains(raw, '%') OR contains(lower(raw), 'percent') THEN 'percent' WHEN v > 1 THEN 'percent_assumed' ELSE 'ratio' END AS unit FROM (SELECT * FROM figures WHERE v IS NOT NULL QUALIFY row_number() OVER (PARTITION BY plan_id, plan_period, metric_name, ref ORDER BY pos) = 1)),
    valued AS (SELECT *, CASE unit WHEN 'million_usd' THEN round(v * 1e6, 6) WHEN 'thousand_usd' THEN round(v * 1e3, 6) WHEN 'count' THEN round_even(v, 0) WHEN 'ratio' THEN v ELSE round(v / 100, 9) END AS nv FROM candidates),
    picked AS (SELECT plan_id, plan_period, metric_name, arg_max(v, {{'c': confidence, 'r': ref}}) AS as_reported_value, arg_max(nv, {{'c': confidence, 'r': ref}}) AS normalized_value, arg_max(unit, {{'c': confidence, 'r': ref}}) AS as_reported_unit,
        max(confidence) AS confidence, arg_max(ref, {{'c': confidence, 'r': ref}}) AS evidence_ref, max(round(nv, 9)) - min(round(nv, 9)) > 1e-9 AS ambiguous FROM valued GROUP BY plan_id, plan_period, metric_name),
    told AS (SELECT plan_id, plan_period, code, metric_name FROM (SELECT f.plan_id, f.plan_period, n.metric_name, CASE WHEN p.metric_name IS NULL THEN 'missing_metric' WHEN p.ambiguous THEN 'ambiguous_metric' END AS code
        FROM plan_funding f JOIN (SELECT DISTINCT metric_name FROM names) n ON TRUE LEFT JOIN picked p ON p.plan_id = f.plan_id AND p.plan_period = f.plan_period AND p.metric_name = n.metric_name) WHERE code IS NOT NULL)"""


def stated(select: str) -> str:
    views = sql("SELECT 1 FROM plan_funding")
    return views[: views.rindex("\nSELECT 1")] + ",\n" + STATEMENTS + "\n" + select


HISTORY = """SELECT plan_id, plan_period, 'funded' AS metric_family, 'funded_ratio' AS metric_name, funded_ratio AS value, 'ratio' AS unit, NULL AS manager_name, NULL AS fund_name, 0.93::DOUBLE AS confidence, 'order:' || n_orders AS refs FROM plan_funding
    UNION ALL SELECT plan_id, plan_period, 'cash_flow', 'benefit_payments', benefit_payments_usd, 'usd', NULL, NULL, NULL, NULL FROM plan_funding
    UNION ALL SELECT plan_id, plan_period, 'allocation', asset_class, allocation_pct, 'ratio', NULL, NULL, NULL, 'class:' || asset_class FROM plan_allocation
    UNION ALL SELECT plan_id, plan_period, 'holding', 'exposure', exposure_usd, 'usd', manager_name, fund_name, NULL, NULL FROM manager_fund_positions
    UNION ALL SELECT plan_id, plan_period, 'fee', 'fee', exposure_usd / 50, 'usd', manager_name, fund_name, NULL, NULL FROM manager_fund_positions WHERE exposure_usd IS NOT NULL"""

FINDINGS = "SELECT plan_id, plan_period, round(funded_ratio, 6) AS funded_ratio, CASE WHEN n_orders % 2 = 0 THEN 'pending' ELSE 'resolved' END AS state FROM plan_funding WHERE funded_ratio < 0.6"

ORACLES = {
    "e3_statement_metrics": stated("SELECT *, CASE WHEN confidence > 0.9 THEN 'table_lookup' ELSE 'text_pattern' END AS extraction_method FROM picked"),
    "e3_metric_diagnostics": stated("SELECT * FROM told"),
    "e4_funded_status": stated("SELECT plan_id, plan_period, metric_name, normalized_value FROM picked WHERE metric_name IN ('funded_ratio', 'aal_usd', 'ava_usd')"),
    "e13_second_extractor": stated("SELECT plan_id, plan_period, n_orders % 5 = 0 OR EXISTS (SELECT 1 FROM told t WHERE t.plan_id = f.plan_id AND t.plan_period = f.plan_period AND t.metric_name IN ('funded_ratio', 'aal_usd')) AS second_extractor FROM plan_funding f"),
    "e2_label_lines": stated("SELECT plan_id || '/' || plan_period || '/' || ref AS doc_id, 1 AS page, 1 AS line_no, label, value FROM table_rows WHERE value IS NOT NULL"),
    "b6_metric_history": sql(HISTORY),
    "p27_curated_metrics": sql(f"SELECT metric_family, count(*) AS n, round(CAST(sum(CAST(value AS DECIMAL(28,6))) AS DOUBLE), 2) AS total FROM ({HISTORY}) WHERE value IS NOT NULL AND (manager_name IS NULL OR right(manager_name, 1) NOT IN ('1', '2')) GROUP BY metric_family"),
    "p28_curated_cash_flows": sql("SELECT plan_id, plan_period, round(total_usd, 2) AS total_usd, round(employer_contributions_usd, 2) AS employer_contributions_usd, round(benefit_payments_usd, 2) AS benefit_payments_usd FROM plan_funding WHERE n_orders % 5 <> 0 AND n_orders % 6 <> 0 AND n_orders % 7 <> 0 AND employer_contributions_usd IS NOT NULL AND benefit_payments_usd IS NOT NULL"),
    "p26_cohorts": "SELECT c_custkey AS stable_id, 'state' AS cohort FROM customer WHERE c_nationkey % 2 = 0 UNION ALL SELECT c_custkey, 'sampled' FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT c_custkey, 'both' FROM customer WHERE c_nationkey % 2 = 0 AND c_mktsegment = 'BUILDING'",
    "p35_plan_formulas": sql("""SELECT plan_id, plan_period, round(benefit_payments_usd / nullif(z, 0), 6) AS benefit_ratio, round(funded_ratio - r, 6) AS delta, round(employer_contributions_usd - (employee_contributions_usd + r * (total_usd - assets_usd)), 6) AS tread_water_gap,
      employer_contributions_usd < r * (total_usd - assets_usd) AS negative_amortization, round(100 * (employer_contributions_usd - benefit_payments_usd) / nullif(z, 0), 4) AS net_cash_flow_pct, [FALSE, TRUE, TRUE, NULL][n_orders % 4 + 1] AS closed
      FROM (SELECT *, CASE WHEN n_orders % 4 <> 0 THEN 0.07::DOUBLE END AS r, CASE WHEN n_orders % 6 = 0 THEN 0 ELSE assets_usd END AS z FROM plan_funding)"""),
    "p36_filing_urls": "SELECT o_orderkey, 'https://data.example/submissions/CIK' || lpad(CAST(o_custkey AS VARCHAR), 10, '0') || '.json' AS submissions_url, CASE WHEN o_orderkey % 3 <> 0 THEN 'https://www.example/data/' || o_custkey || '/' || lpad(CAST(o_custkey AS VARCHAR), 10, '0') || '24' || CASE WHEN length(CAST(o_orderkey AS VARCHAR)) > 6 THEN substr(CAST(o_orderkey AS VARCHAR), 1, 6) ELSE lpad(CAST(o_orderkey AS VARCHAR), 6, '0') END || '/table' || o_orderkey || '.xml' END AS table_url FROM orders",
    "p39_allowed_citations": "SELECT l_orderkey, array_to_string(CASE WHEN len(k) > 0 THEN k ELSE CASE WHEN a = b THEN [a] ELSE [a, b] END END, ',') AS citations FROM (SELECT *, list_filter(CASE WHEN x = y THEN [x] ELSE [x, y] END, lambda t: t = a OR t = b) AS k FROM (SELECT l_orderkey, 'p:' || l_orderkey % 7 AS x, 'p:' || l_orderkey % 5 AS y, 'p:' || l_orderkey % 3 AS a, 'p:' || (l_orderkey % 5 + 1) AS b FROM lineitem WHERE l_linenumber = 1))",
    "p40_failure_categories": "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'source_map_breakage' WHEN event_id % 5 < 2 THEN 'robots_restriction' WHEN event_id % 5 < 4 THEN 'revised_file_anomaly' WHEN event_id % 4 = 1 THEN 'discovery_data_error' WHEN event_id % 4 = 2 THEN 'ingestion_data_error' ELSE 'unexpected_error' END AS category FROM events",
    "d1_incomplete_plans": "SELECT c_custkey, concat_ws(', ', CASE WHEN c_custkey % 4 = 0 THEN 'legal_name' END, CASE WHEN c_custkey % 6 = 0 THEN 'system_type' END) AS missing FROM customer WHERE c_custkey % 4 = 0 OR c_custkey % 6 = 0",
    "x2_run_ids": sql("SELECT plan_id, plan_period, 'scenario:deterministic:' || plan_id || ':' || plan_period || ':' || substr(sha256(plan_id || '|' || plan_period || '|deterministic|stress|' || n_orders), 1, 12) AS run_id FROM plan_funding"),
    "j13_alias_cases": """WITH p AS (SELECT p_partkey, p_name, p_brand || '/' || p_size AS shelf, list_distinct(string_split(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), ' ')) AS r, array_to_string(string_split(p_name, ' ')[1:2], ' ') AS al FROM part),
      c AS (SELECT *, list_distinct(string_split(trim(regexp_replace(lower(al), '[^a-z0-9]+', ' ', 'g')), ' ')) AS l FROM p),
      s AS (SELECT a.p_partkey AS case_id, b.p_partkey AS entity_id, CASE WHEN trim(regexp_replace(lower(a.al), '[^a-z0-9]+', ' ', 'g')) = trim(regexp_replace(lower(b.p_name), '[^a-z0-9]+', ' ', 'g')) THEN 1::DOUBLE ELSE least(0.99::DOUBLE, round(len(list_intersect(a.l, b.r))::DOUBLE / len(list_distinct(list_concat(a.l, b.r)))
          + CASE WHEN list_has_all(b.r, a.l) OR list_has_all(a.l, b.r) THEN 0.15::DOUBLE ELSE 0 END, 6)) END AS score FROM c a JOIN c b USING (shelf)),
      t AS (SELECT case_id, max(score) AS f, arg_max(entity_id, {'s': score, 'e': entity_id}) AS e, coalesce(list_sort(list(score), 'DESC')[2], 0) AS g FROM s GROUP BY case_id),
      d AS (SELECT *, CASE WHEN f < 0.65 THEN 'no_match' WHEN g >= 0.65 AND abs(f - g) <= 0.05 AND f < 0.999999 THEN 'ambiguous_review' WHEN f >= 0.82 THEN 'matched' ELSE 'ambiguous_review' END AS decision FROM t)
      SELECT case_id, decision, CASE WHEN decision = 'matched' THEN e END AS entity_id, round(f, 6) AS best_score, round(g, 6) AS second_best_score FROM d""",
    "j15_citation_payloads": "SELECT o_orderkey AS row_id, coalesce(string_agg('p.' || p_size, ',' ORDER BY l_linenumber, l_partkey) FILTER (WHERE p_size IS NOT NULL), '') AS citations, CAST(count(p_size) AS INTEGER) AS n_citations FROM orders LEFT JOIN (SELECT l_orderkey, l_linenumber, l_partkey, p_size FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'R' AND p_size > 10) ON l_orderkey = o_orderkey GROUP BY o_orderkey",
    "t5_latest_log_rows": "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 500",
    "t6_capped_findings": sql(f"SELECT *, (SELECT count(*) FROM ({FINDINGS})) > 10 AS truncated FROM ({FINDINGS}) ORDER BY plan_id, plan_period LIMIT 10"),
    "q4_pending": sql(f"SELECT *, state AS list FROM ({FINDINGS})"),
}
