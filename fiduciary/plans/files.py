"""Queries of scans and sinks: the tables are written as the files that plans, filers and agencies publish, and read back; each with its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import shared_folder
from ..operators import disclosures, integrity
from ..sources import publishing, scans
from . import curation
from . import domain as D
from . import registry as registry_plans
from .oracle import sql

Query = Callable[[SparkSession, str], DataFrame]

FILED = 100_000  # positions in one XML file at most: Spark reads such a file in one task


def folder(s: SparkSession) -> str:
    return f"{shared_folder(s)}/files-{uuid.uuid4()}"


def as_text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def csv(s: SparkSession, df: DataFrame, read: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    path = folder(s)
    df.write.csv(path, header=True)
    return read(s, path)


def documents(s: SparkSession, rows: DataFrame, bucket: Column, before: str, after: str) -> str:
    """A JSON file for each of a few hundred rows: the objects in column ``value`` between two texts."""
    path = folder(s)
    one = rows.groupBy(bucket.alias("bucket")).agg(as_text(before, F.array_join(F.collect_list("value"), ", "), after).alias("value"))
    one.write.partitionBy("bucket").text(path)
    return path


def registry(s: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = D.table(s, d, "customer").select(F.when(k % 9 > 0, as_text("p", k)).alias("plan_id"), as_text(F.col("c_name"), " Fund!").alias("plan_name"), F.lower("c_mktsegment").alias("system_type"), as_text("N-", F.col("c_nationkey")).alias("jurisdiction"), F.get(F.array(*map(F.lit, ["Yes", "0", "maybe", "TRUE "])), (k % 4).cast("int")).alias("in_peer_universe"))
    return csv(s, rows, scans.registry)


def source_map(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    cells = {"plan_id": as_text("p", k), "plan_name": F.lit("A, \"quoted\" name"), "expected_plan_identity": F.col("o_orderpriority"), "seed_url": as_text("https://a.example/", k), "allowed_domains": F.lit("a.example;b.example"), "doc_type_hints": F.lit("annual_report"), "pagination_hints": F.when(k % 2 == 0, "next_link"), "max_pages": k % 7, "max_depth": F.lit(1), "override_notes": F.col("o_orderstatus")}
    return csv(s, D.table(s, d, "orders").select(*[c.cast("string").alias(n) for n, c in cells.items()]), scans.source_map)


def holdings(s: SparkSession, d: str) -> DataFrame:
    part = D.table(s, d, "part")
    k = F.col("p_partkey")
    rows = part.select(F.when(k % 2 == 0, F.col("p_name")).alias("security_name"), as_text(" ", F.col("p_brand")).alias("name"), F.lower("p_type").alias("ticker"), as_text("a-", k, "/x").alias("cusip"), as_text(F.col("p_size"), ",000").alias("shares"), F.when(k % 5 > 0, F.col("p_retailprice").cast("string")).otherwise("n/a").alias("market_value"))
    return csv(s, rows, scans.own_holdings)


def information(s: SparkSession, d: str) -> DataFrame:
    path = folder(s)
    k = F.col("p_partkey")
    rows = D.table(s, d, "part").select(as_text(" ", F.col("p_name"), " & co").alias("nameOfIssuer"), as_text("c", k).alias("cusip"), F.floor("p_retailprice").alias("value"), F.struct(F.col("p_size").alias("sshPrnamt")).alias("shrsOrPrnAmt"))
    rows.write.format("xml").option("rowTag", "infoTable").option("rootTag", "informationTable").option("maxRecordsPerFile", FILED).save(path)
    return scans.information_table(s, path)


def filings(s: SparkSession, d: str) -> DataFrame:
    o = D.table(s, d, "orders")
    form = F.get(F.array(*map(F.lit, ["13F-HR", "10-K", "13F-HR/A"])), (F.col("o_orderkey") % 3).cast("int"))
    date = F.date_format("o_orderdate", "yyyy-MM-dd")
    one = F.struct(form.alias("form"), as_text("a-", F.col("o_orderkey")).alias("accessionNumber"), date.alias("filingDate"), date.alias("reportDate"), F.lower("o_orderpriority").alias("primaryDocument"))
    by = o.groupBy("o_custkey").agg(F.collect_list(one).alias("r"))
    recent = F.struct(*[F.col(f"r.{c}").alias(c) for c in ("form", "accessionNumber", "filingDate", "reportDate", "primaryDocument")])
    rows = by.select("o_custkey", F.to_json(F.struct(F.col("o_custkey").cast("string").alias("cik"), F.struct(recent.alias("recent")).alias("filings"))).alias("value"))
    return scans.filings(s, documents(s, rows, F.floor(F.col("o_custkey") / 50), "[", "]"))


def survey(s: SparkSession, d: str) -> DataFrame:
    c = D.table(s, d, "customer")
    rows = c.select("c_custkey", F.to_json(F.struct(F.col("c_custkey").alias("ppd_id"), F.col("c_name").alias("PlanName"), as_text(F.col("c_nationkey"), ".0").alias("fy"))).alias("value"))
    path = documents(s, rows, F.floor(F.col("c_custkey") / 100), '{"count": 1, "result": [', "]}")
    r = F.col("record")
    return scans.survey_records(s, path).select(r["ppd_id"].alias("ppd_id"), r["PlanName"].alias("plan_name"), r["fy"].alias("fy"), r["missing"].alias("missing"))


def codebook(s: SparkSession, d: str) -> DataFrame:
    rows = D.table(s, d, "part").select(F.when(F.col("p_size") > 5, as_text(" ", F.col("p_name"), " ")).alias(" VarName "), F.col("p_brand").alias("Label"))
    mapped = D.table(s, d, "part").select(F.col("p_name").alias("name")).union(D.table(s, d, "supplier").select("s_name"))
    return csv(s, rows, lambda s, p: scans.missing_variables(scans.codebook(s, p), mapped))


def schedules(s: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = D.table(s, d, "customer").select(F.get(F.array(*map(F.lit, ["sb", " MB", "H"])), (k % 3).cast("int")).alias("schedule"), F.when(k % 7 == 0, "20x").otherwise(as_text(k % 30 + 1990)).alias("plan_year"), as_text(F.lpad(k.cast("string"), 9, "1"), "-").alias("ein"), as_text("#", k % 1200).alias("plan_number"), F.col("c_name").alias("plan_name"))
    return csv(s, rows, scans.schedules)


def operation_log(s: SparkSession, d: str) -> DataFrame:
    path = folder(s)
    c = D.table(s, d, "conversations")
    good = F.to_json(F.struct(F.col("role").alias("operation"), F.when(F.col("turn") % 2 == 0, "Ok").otherwise("timeout").alias("status"), F.length("text").cast("double").alias("latency_ms")))
    c.select(F.when(F.col("turn") % 3 == 2, as_text("{broken ", F.col("conv_id"))).otherwise(good).alias("value")).where("value IS NOT NULL").write.text(path)
    return scans.operation_log(s, path).groupBy("operation", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("latency_ms").cast("long").alias("latency_ms"))


def artifacts(s: SparkSession, d: str) -> DataFrame:
    """Three result tables as JSON lines and CSV, twice; what the files hold then."""
    path = folder(s)
    trend = D.plan_funding(s, d).select("plan_id", "plan_period", F.round("funded_ratio", 6).alias("value"), F.array(F.lit("p,1"), F.lit('"q"')).alias("refs"))
    made = {"trend": trend, "gaps": trend.where("value < 0.3"), "none": trend.where("false")}
    for _ in range(2):
        scans.write_artifacts(made, path)
    kinds = "plan_id string, plan_period string, value double, refs string"
    back = [s.read.schema(kinds).csv(f"{path}/{n}.csv", header=True, escape='"').select(F.lit(f"{n}.csv").alias("artifact"), "*") for n in made]
    back += [s.read.schema(kinds).json(f"{path}/{n}.json").select(F.lit(f"{n}.json").alias("artifact"), "*") for n in made]
    out = back[0]
    for b in back[1:]:
        out = out.unionByName(b)
    return out


def telemetry(s: SparkSession, d: str) -> DataFrame:
    path = folder(s)
    e = D.table(s, d, "events")
    tags = F.map_from_entries(F.array_compact(F.array(F.struct(F.lit("run_id").alias("key"), (F.col("user_id") % 10).cast("string").alias("value")), F.when(F.col("value") > 50, F.struct(F.lit("stage").alias("key"), F.col("event_type").alias("value"))), F.struct(F.lit("other").alias("key"), F.lit("x").alias("value")))))
    scans.write_csv(scans.flat_tags(e.select(F.col("event_type").alias("metric"), "event_id", tags.alias("tags")), ["run_id", "stage"]), path)
    return s.read.schema("metric string, event_id long, run_id string, stage string").csv(path, header=True)


def curated_families(s: SparkSession, d: str) -> DataFrame:
    """The builds of four families of facts, each with its key, and why rows are rejected."""
    p = D.manager_fund_positions(s, d)
    plans = D.plan_dim(s, d).where("plan_id <> 'NATION_3'").select("plan_id")
    none = F.lit(None).cast("string")
    columns = lambda df, value, unit, manager=none, fund=none, completeness=none: df.select("*", value.cast("double").alias("normalized_value"), unit.alias("normalized_unit"), completeness.alias("completeness")).withColumns({"manager_name": manager, "fund_name": fund})
    usd = F.when(F.col("disclosure_state") == "not_disclosed", " ").otherwise("usd")
    state = F.when(F.col("disclosure_state") == "disclosed", "complete").otherwise("partial")
    fund = F.when(F.col("fund_name") != "Brand#7", F.col("fund_name"))
    o = D.plan_orders(s, d)
    families = {
        "allocation": (columns(D.plan_allocation(s, d).withColumn("metric_name", F.col("asset_class")), F.when(F.col("allocation_pct") > 0.14, F.col("allocation_pct")), F.lit("ratio")), ["plan_id", "plan_period", "asset_class"]),
        "holding": (columns(p.withColumn("metric_name", F.lit("exposure")), F.col("exposure_usd"), usd, F.col("manager_name"), fund, state), ["plan_id", "plan_period", "manager_name", "fund_name"]),
        "fee": (columns(o.withColumn("metric_name", F.col("o_orderpriority")), F.col("o_totalprice"), F.lit("usd")), ["plan_id", "plan_period", "o_orderpriority", "o_orderstatus"]),
        "cash_flow": (columns(D.plan_funding(s, d).withColumn("metric_name", F.lit("benefits")), F.col("benefit_payments_usd"), F.lit("usd")), ["plan_id", "plan_period"]),
    }
    out = None
    for name, (facts, key) in families.items():
        counts = integrity.curated(facts, plans, key).groupBy("plan_id", "plan_period", "metric_name", "reject_reason").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("normalized_value").cast("decimal(28,6)")).cast("double"), 6).alias("total")).select(F.lit(name).alias("family"), "*")
        out = counts if out is None else out.unionByName(counts)
    return out


def published(s: SparkSession, d: str) -> DataFrame:
    """A coverage run over orders as source records, as its files hold it."""
    path = folder(s)
    records = curation.source_records(s, d).withColumn("plan_period", as_text("FY", F.col("year")))
    publishing.publish(path, records, lambda: registry_plans.anomalies(s, d))
    kinds = {
        "readiness_rows": ("plan_id string, plan_period string, extraction_blocker_reason string, readiness_state string, is_extraction_ready string", ["plan_id", F.col("plan_period").alias("period"), F.col("extraction_blocker_reason").alias("what"), F.col("readiness_state").alias("state")]),
        "anomaly_rows": ("plan_id string, period string, metric string, severity string", ["plan_id", "period", F.col("metric").alias("what"), F.col("severity").alias("state")]),
        "review_queue_rows": ("plan_id string, period string, reason string, priority string", ["plan_id", "period", F.col("reason").alias("what"), F.col("priority").alias("state")]),
        "status": ("status string, error string", [F.lit(None).cast("string").alias("plan_id"), F.lit(None).cast("string").alias("period"), F.col("error").alias("what"), F.col("status").alias("state")]),
    }
    out = None
    for name, (kind, shown) in kinds.items():
        rows = s.read.schema(kind).json(f"{path}/{name}.json").select(F.lit(name).alias("artifact"), *shown)
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("artifact", "plan_id", "period", "what", "state").agg(F.count(F.lit(1)).alias("n"))


def run_rates(s: SparkSession, d: str) -> DataFrame:
    """Months of orders as runs."""
    o = D.table(s, d, "orders")
    n = lambda c: F.count_if(c)
    status, priority, price, month = F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_totalprice"), F.date_trunc("month", "o_orderdate")
    runs = o.groupBy(month.alias("m")).agg(
        F.max("o_orderdate").alias("t"), F.count(F.lit(1)).alias("records_total"), n(status == "F").alias("records_complete"), n(priority == "1-URGENT").alias("review_queue_items"), F.sum(F.when(price > 490000, float("nan")).otherwise(F.floor(price / 100000).cast("double"))).alias("review_queue_wait_hours_sum"),
        n(price < 20000).alias("parse_warning_count"), n(status == "P").alias("source_mismatch_count"), n(priority == "5-LOW").alias("unresolved_official_source_count"), n(price > 460000).alias("total_pages"), n(price > 200000).alias("cited_facts"),
        n(status == "O").alias("manager_disclosure_total"), n((status == "O") & (price > 100000)).alias("manager_disclosure_covered"), n(price > 480000).alias("consultant_disclosure_total"), n((price > 480000) & (status == "F")).alias("consultant_disclosure_covered"))
    runs = runs.select("*", F.date_format("m", "yyyy-MM").alias("run_id"), (F.col("m") + F.expr("INTERVAL 20 DAYS")).alias("source_published_at"), F.col("t").alias("run_started_at"))
    rates = disclosures.run_rates(runs)
    return rates.select("run_id", *[F.round(c, 6).alias(c) for c in rates.columns if c != "run_id"])


QUERIES: dict[str, Query] = {
    "a15_publication_set": published, "a8_run_rates": run_rates,
    "s1_registry": registry, "s2_source_map": source_map, "s3_own_holdings": holdings, "s4_information_table": information, "s5_filings": filings, "s7_survey_records": survey, "s8_missing_variables": codebook, "s9_schedules": schedules, "s10_operation_log": operation_log,
    "k1_artifacts": artifacts, "k4_telemetry": telemetry, "j2_curated_families": curated_families,
}

REASON = "CASE WHEN f.plan_id = 'NATION_3' THEN 'unknown_plan' WHEN v IS NULL THEN 'missing_value' WHEN trim(u) = '' THEN 'missing_unit' WHEN complete AND (coalesce(trim(m), '') = '' OR coalesce(trim(g), '') = '') THEN 'missing_names' WHEN count(*) OVER (PARTITION BY family, key) > 1 THEN 'duplicate_key' END"

ORACLES: dict[str, str] = {
    "a15_publication_set": sql(f"""SELECT artifact, plan_id, period, what, state, count(*) AS n FROM (
      SELECT 'readiness_rows' AS artifact, plan_id, 'FY' || year AS period, CASE WHEN m IS NOT NULL THEN m WHEN s = 1 THEN 'non_official_only' WHEN s = 0 THEN 'official_source_unresolved' ELSE '' END AS what, CASE WHEN s < 2 THEN 'blocked_source' WHEN m IS NOT NULL THEN 'blocked_quality' ELSE 'ready' END AS state FROM ({curation.RECORDS})
      UNION ALL SELECT 'anomaly_rows', plan_id, period, metric, severity FROM anomalies UNION ALL SELECT 'review_queue_rows', plan_id, period, severity || ' shift in ' || metric, priority FROM anomalies UNION ALL SELECT 'status', NULL, NULL, '', 'ok') GROUP BY ALL"""),
    "a8_run_rates": """SELECT strftime(m, '%Y-%m') AS run_id, round(greatest((epoch_us(t) - epoch_us(m + INTERVAL 20 DAY)) / 3.6e9::DOUBLE, 0), 6) AS freshness_lag_hours, round(complete / n, 6) AS completeness_rate, CASE WHEN items > 0 AND isfinite(waited) THEN round(waited / items, 6) ELSE 0 END AS review_queue_latency_hours, round(warned / n, 6) AS parse_warning_rate,
      CASE WHEN pages > 0 THEN round(cited * 10 / pages, 6) ELSE 0 END AS citation_density_per_10_pages, round(mismatched / n, 6) AS source_mismatch_rate, round(unresolved / n, 6) AS unresolved_official_source_rate, CASE WHEN mt > 0 THEN round(mc / mt, 6) ELSE 0 END AS manager_disclosure_coverage_rate, CASE WHEN ct > 0 THEN round(cc / ct, 6) ELSE 0 END AS consultant_disclosure_coverage_rate
      FROM (SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS m, max(o_orderdate) AS t, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS complete, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS items, sum(CASE WHEN o_totalprice > 490000 THEN 'NaN'::DOUBLE ELSE CAST(floor(o_totalprice / 100000) AS DOUBLE) END) AS waited, count(*) FILTER (WHERE o_totalprice < 20000) AS warned,
        count(*) FILTER (WHERE o_orderstatus = 'P') AS mismatched, count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS unresolved, count(*) FILTER (WHERE o_totalprice > 460000) AS pages, count(*) FILTER (WHERE o_totalprice > 200000) AS cited, count(*) FILTER (WHERE o_orderstatus = 'O') AS mt, count(*) FILTER (WHERE o_orderstatus = 'O' AND o_totalprice > 100000) AS mc,
        count(*) FILTER (WHERE o_totalprice > 480000) AS ct, count(*) FILTER (WHERE o_totalprice > 480000 AND o_orderstatus = 'F') AS cc FROM orders GROUP BY 1)""",
    "s1_registry": r"""SELECT plan_id, plan_name, system_type, jurisdiction, p AS in_peer_universe, trim(regexp_replace(lower(plan_name || '::' || jurisdiction), '[^a-z0-9]+', '-', 'g'), '-') AS identity_key, plan_id IS NOT NULL AND p IS NOT NULL AS is_valid FROM (
      SELECT CASE WHEN c_custkey % 9 > 0 THEN 'p' || c_custkey END AS plan_id, c_name || ' Fund!' AS plan_name, lower(c_mktsegment) AS system_type, 'N-' || c_nationkey AS jurisdiction, CASE c_custkey % 4 WHEN 0 THEN TRUE WHEN 1 THEN FALSE WHEN 3 THEN TRUE END AS p FROM customer)""",
    "s2_source_map": "SELECT 'p' || o_orderkey AS plan_id, 'A, \"quoted\" name' AS plan_name, o_orderpriority AS expected_plan_identity, 'https://a.example/' || o_orderkey AS seed_url, 'a.example;b.example' AS allowed_domains, 'annual_report' AS doc_type_hints, CASE WHEN o_orderkey % 2 = 0 THEN 'next_link' END AS pagination_hints, CAST(o_orderkey % 7 AS VARCHAR) AS max_pages, '1' AS max_depth, NULL AS source_authority_tier, NULL AS mismatch_reason, NULL AS override_requires_js, NULL AS override_force_render_wait_ms, NULL AS override_pagination_mode, o_orderstatus AS override_notes FROM orders",
    "s3_own_holdings": "SELECT CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_brand END AS security_name, p_type AS ticker, 'A' || p_partkey || 'X' AS cusip, CAST(p_size * 1000 AS DOUBLE) AS shares, CASE WHEN p_partkey % 5 > 0 THEN p_retailprice END AS market_value_usd FROM part",
    "s4_information_table": "SELECT p_name || ' & co' AS issuer, 'C' || p_partkey AS cusip, CAST(floor(p_retailprice) * 1000 AS DOUBLE) AS market_value_usd, CAST(p_size AS DOUBLE) AS shares FROM part",
    "s5_filings": "SELECT CAST(o_custkey AS VARCHAR) AS cik, CASE o_orderkey % 3 WHEN 0 THEN '13F-HR' ELSE '13F-HR/A' END AS form, 'a-' || o_orderkey AS accession, CAST(o_orderdate AS DATE) AS filing_date, CAST(o_orderdate AS DATE) AS report_date, lower(o_orderpriority) AS document FROM orders WHERE o_orderkey % 3 <> 1",
    "s7_survey_records": "SELECT CAST(c_custkey AS VARCHAR) AS ppd_id, c_name AS plan_name, c_nationkey || '.0' AS fy, CAST(NULL AS VARCHAR) AS missing FROM customer",
    "s8_missing_variables": "SELECT name FROM (SELECT DISTINCT p_name AS name FROM part UNION SELECT s_name FROM supplier) WHERE name NOT IN (SELECT p_name FROM part WHERE p_size > 5)",
    "s9_schedules": """SELECT upper(trim(s)) AS schedule, y AS plan_year, ein, lpad(n, 3, '0') AS plan_number, plan_name, upper(trim(s)) IN ('SB', 'MB') AND y IS NOT NULL AND length(ein) = 9 AND length(n) BETWEEN 1 AND 3 AS ok FROM (
      SELECT ['sb', ' MB', 'H'][c_custkey % 3 + 1] AS s, CASE WHEN c_custkey % 7 <> 0 THEN CAST(c_custkey % 30 + 1990 AS INTEGER) END AS y, lpad(CAST(c_custkey AS VARCHAR), 9, '1') AS ein, CAST(c_custkey % 1200 AS VARCHAR) AS n, c_name AS plan_name FROM customer)""",
    "s10_operation_log": "SELECT role AS operation, CASE WHEN turn % 2 = 0 THEN 'ok' ELSE 'error' END AS status, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS latency_ms FROM conversations WHERE turn % 3 <> 2 AND role IS NOT NULL GROUP BY 1, 2",
    "k1_artifacts": sql("""SELECT artifact, plan_id, plan_period, value, '["p,1","\\"q\\""]' AS refs FROM (SELECT unnest(['trend.csv', 'trend.json']) AS artifact, plan_id, plan_period, round(funded_ratio, 6) AS value FROM plan_funding
      UNION ALL SELECT unnest(['gaps.csv', 'gaps.json']), plan_id, plan_period, round(funded_ratio, 6) FROM plan_funding WHERE round(funded_ratio, 6) < 0.3)"""),
    "k4_telemetry": "SELECT event_type AS metric, event_id, CAST(user_id % 10 AS VARCHAR) AS run_id, CASE WHEN value > 50 THEN event_type END AS stage FROM events",
    "j2_curated_families": sql(f"""SELECT family, plan_id, plan_period, metric_name, reject_reason, count(*) AS n, round(CAST(sum(CAST(v AS DECIMAL(28,6))) AS DOUBLE), 6) AS total FROM (SELECT f.*, {REASON} AS reject_reason FROM (
      SELECT 'allocation' AS family, plan_id, plan_period, asset_class AS metric_name, CASE WHEN allocation_pct > 0.14 THEN allocation_pct END AS v, 'ratio' AS u, NULL AS m, NULL AS g, FALSE AS complete, plan_id || plan_period || asset_class AS key FROM plan_allocation
      UNION ALL SELECT 'holding', plan_id, plan_period, 'exposure', exposure_usd, CASE WHEN disclosure_state = 'not_disclosed' THEN ' ' ELSE 'usd' END, manager_name, nullif(fund_name, 'Brand#7'), disclosure_state = 'disclosed', plan_id || plan_period || manager_name || coalesce(nullif(fund_name, 'Brand#7'), '') FROM manager_fund_positions
      UNION ALL SELECT 'fee', plan_id, plan_period, o_orderpriority, o_totalprice, 'usd', NULL, NULL, FALSE, plan_id || plan_period || o_orderpriority || o_orderstatus FROM plan_orders
      UNION ALL SELECT 'cash_flow', plan_id, plan_period, 'benefits', benefit_payments_usd, 'usd', NULL, NULL, FALSE, plan_id || plan_period FROM plan_funding) f) GROUP BY ALL"""),
}
