"""Queries of component datasets, written by component and read back by manifest, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import shared_folder, written
from ..operators import components
from ..sources import manifests
from . import domain as D
from .oracle import sql

Query = Callable[[SparkSession, str], DataFrame]


def schema_rows(s: SparkSession, d: str) -> DataFrame:
    doc = F.concat_ws("/", "plan_id", "plan_period").alias("document_id")
    o, p = D.plan_orders(s, d), written(D.manager_fund_positions(s, d))  # three tables are made of p
    year = F.substring("plan_period", 3, 4)
    family = F.when(F.col("o_orderpriority") == "1-URGENT", "fee").when(F.col("o_orderpriority") == "2-HIGH", "allocation").otherwise("funded")
    refs = F.array(F.concat(F.lit(" p."), F.substring("o_orderpriority", 1, 1)), F.lit(""))
    pick = lambda status, priority: o.where((F.col("o_orderstatus") == status) & (F.col("o_orderpriority") == priority)).select(doc)
    context = o.groupBy("plan_id", "plan_period").agg(F.count_if(F.col("o_orderstatus") == "F").alias("n")).select(
        doc, "plan_id", "plan_period", F.concat(year, F.lit("-06-30")).alias("effective_date"), F.lit("2024-01-01").alias("ingestion_date"), F.when(F.col("n") > 0, F.concat(F.lit("doc:"), year)).alias("source_document_id"))
    tables = {
        "metrics": o.where("o_orderstatus = 'F'").select(doc, family.alias("metric_family"), F.when(F.col("o_totalprice") > 100000, F.concat(F.lit("v"), F.substring("o_orderpriority", 1, 1))).alias("benchmark_version"), refs.alias("evidence_refs")),
        "relations": p.where("disclosure_state = 'disclosed'").select(doc, F.when(F.col("fund_name") == "Brand#9", "v9").alias("benchmark_version")), "warnings": p.where("disclosure_state = 'not_disclosed'").select(doc, F.array(F.col("fund_name")).alias("evidence_refs")),
        "positions": p.where("exposure_usd IS NOT NULL").select(doc, "manager_name", F.when(F.col("fund_name") != "Brand#7", F.col("fund_name")).alias("fund_name")), "lifecycle": pick("O", "1-URGENT"), "risks": pick("O", "2-HIGH"), "consultants": pick("O", "3-MEDIUM"),
        "engagements": pick("P", "1-URGENT"), "recommendations": pick("P", "2-HIGH"), "attributions": pick("P", "3-MEDIUM"), "flows": pick("O", "5-LOW"),
    }
    return components.schema_components(context, tables)


ROW = "document_id string, component_name string, status string, row_count long, plan_id string, plan_period string, effective_date string, ingestion_date string, source_document_id string, confidence double, evidence_refs array<string>, notes string"


def shown(rows: DataFrame) -> DataFrame:
    return rows.withColumn("evidence_refs", F.array_join("evidence_refs", "|"))


def by_manifest(s: SparkSession, d: str) -> DataFrame:
    path = f"{shared_folder(s)}/components-{s.range(1).select(F.expr('uuid()')).first()[0]}"
    rows = manifests.component_datasets(s, manifests.write_components(schema_rows(s, d).drop("notes"), path), ROW)
    return shown(rows).select("component", "document_id", "status", "row_count", "confidence", "evidence_refs")


QUERIES: dict[str, Query] = {"a20_schema_components": lambda s, d: shown(schema_rows(s, d)), "s12_component_datasets": by_manifest}

PICKS = {"manager_lifecycle_event": ("O", "1-URGENT"), "risk_exposure_observation": ("O", "2-HIGH"), "consultant_entity": ("O", "3-MEDIUM"), "plan_consultant_engagement": ("P", "1-URGENT"), "consultant_recommendation": ("P", "2-HIGH"), "consultant_attribution_observation": ("P", "3-MEDIUM"), "plan_financial_flow": ("O", "5-LOW")}
COUNTS = {
    "pension_plan": "1", "source_document": "source", "document_version": "source", "plan_period": "1", "metric_observation": "metrics", "evidence_reference": "len(refs)", "investment_exposure": "allocation", "manager_entity": "managers", "fund_vehicle_entity": "funds",
    "plan_manager_fund_position": "positions", "benchmark_definition": "0", "benchmark_version": "benchmarks", "performance_observation": "0", "fee_observation": "fee", **{c: c for c in PICKS},
}
COMPONENTS = f"""o AS (SELECT plan_id, plan_period, count(*) FILTER (WHERE o_orderstatus = 'F') AS metrics, max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS source, count(*) FILTER (WHERE o_orderstatus = 'F' AND o_orderpriority = '2-HIGH') AS allocation, count(*) FILTER (WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') AS fee,
      {', '.join(f"count(*) FILTER (WHERE o_orderstatus = '{a}' AND o_orderpriority = '{b}') AS {c}" for c, (a, b) in PICKS.items())} FROM plan_orders GROUP BY plan_id, plan_period),
    p AS (SELECT plan_id, plan_period, count(*) FILTER (WHERE exposure_usd IS NOT NULL) AS positions, count(DISTINCT manager_name) FILTER (WHERE exposure_usd IS NOT NULL) AS managers, count(DISTINCT fund_name) FILTER (WHERE exposure_usd IS NOT NULL AND fund_name <> 'Brand#7') AS funds FROM manager_fund_positions GROUP BY plan_id, plan_period),
    told AS (SELECT plan_id, plan_period, 'p.' || left(o_orderpriority, 1) AS ref, CASE WHEN o_totalprice > 100000 THEN 'v' || left(o_orderpriority, 1) END AS v FROM plan_orders WHERE o_orderstatus = 'F' UNION ALL SELECT plan_id, plan_period, fund_name, NULL FROM manager_fund_positions WHERE disclosure_state = 'not_disclosed'
      UNION ALL SELECT plan_id, plan_period, NULL, 'v9' FROM manager_fund_positions WHERE disclosure_state = 'disclosed' AND fund_name = 'Brand#9'),
    t AS (SELECT plan_id, plan_period, count(DISTINCT v) AS benchmarks, list_sort(list_distinct(list(ref) FILTER (WHERE ref IS NOT NULL))) AS refs FROM told GROUP BY plan_id, plan_period),
    d AS (SELECT o.*, coalesce(positions, 0) AS positions, coalesce(managers, 0) AS managers, coalesce(funds, 0) AS funds, coalesce(benchmarks, 0) AS benchmarks, coalesce(refs, []) AS refs FROM o LEFT JOIN p USING (plan_id, plan_period) LEFT JOIN t USING (plan_id, plan_period)),
    c AS (SELECT plan_id, plan_period, source, metrics, refs, unnest([{', '.join(f"{{'component_name': '{c}', 'row_count': CAST({n} AS BIGINT)}}" for c, n in COUNTS.items())}], recursive := true) FROM d),
    s AS (SELECT *, CASE WHEN row_count > 0 THEN 'present' WHEN component_name IN ('benchmark_definition', 'performance_observation') AND metrics > 0 THEN 'partial' ELSE 'not_disclosed' END AS status FROM c),
    shown AS (SELECT plan_id || '/' || plan_period AS document_id, component_name, status, row_count, plan_id, plan_period, substr(plan_period, 3, 4) || '-06-30' AS effective_date, '2024-01-01' AS ingestion_date, CASE WHEN source > 0 THEN 'doc:' || substr(plan_period, 3, 4) END AS source_document_id,
      CASE status WHEN 'present' THEN 1.0::DOUBLE WHEN 'partial' THEN 0.5::DOUBLE END AS confidence, CASE WHEN status = 'not_disclosed' THEN '' ELSE array_to_string(refs, '|') END AS evidence_refs,
      CASE status WHEN 'present' THEN 'component rows emitted' WHEN 'partial' THEN 'context available but dedicated component extraction is pending' ELSE 'explicit non-disclosure marker' END AS notes FROM s)"""

ORACLES: dict[str, str] = {
    "a20_schema_components": sql(f"SELECT * FROM (WITH {COMPONENTS} SELECT * FROM shown)"),
    "s12_component_datasets": sql(f"SELECT * FROM (WITH {COMPONENTS} SELECT component_name AS component, document_id, status, row_count, confidence, evidence_refs FROM shown)"),
}
