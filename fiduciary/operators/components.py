"""What a run's documents disclose, by component of the schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mentions import filled

# The components in order; the tables of which each row counts; and those that metrics make partial.
SCHEMA = [
    "pension_plan", "source_document", "document_version", "plan_period", "metric_observation", "evidence_reference", "investment_exposure", "manager_entity", "fund_vehicle_entity", "plan_manager_fund_position",
    "manager_lifecycle_event", "benchmark_definition", "benchmark_version", "performance_observation", "fee_observation", "risk_exposure_observation", "consultant_entity", "plan_consultant_engagement",
    "consultant_recommendation", "consultant_attribution_observation", "plan_financial_flow",
]
COUNTED = {
    "plan_manager_fund_position": "positions", "manager_lifecycle_event": "lifecycle", "risk_exposure_observation": "risks", "consultant_entity": "consultants", "plan_consultant_engagement": "engagements",
    "consultant_recommendation": "recommendations", "consultant_attribution_observation": "attributions", "plan_financial_flow": "flows",
}
PENDING = ("benchmark_definition", "performance_observation")
CONTEXT = ["plan_id", "plan_period", "effective_date", "ingestion_date", "source_document_id"]
NOTES = {"present": "component rows emitted", "partial": "context available but dedicated component extraction is pending", "not_disclosed": "explicit non-disclosure marker"}


def schema_components(documents: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """A row for each of 21 components of every document: status, row_count, context, confidence, evidence_refs and notes.

    ``documents`` has document_id and the columns of CONTEXT, one row each.
    ``tables`` may have metrics (document_id, metric_family, benchmark_version,
    evidence_refs), relations (benchmark_version, evidence_refs), warnings
    (evidence_refs), positions (manager_name, fund_name) and the tables named in
    COUNTED. All are counted together in one aggregate by document before the
    join, so no grid of rows and components is made.
    """
    none, no_refs = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    fields = ["metric_family", "benchmark_version", "manager_name", "fund_name"]

    def one(kind: str, df: DataFrame) -> DataFrame:
        has = lambda c: F.col(c).cast("string") if c in df.columns else none
        return df.select("document_id", F.lit(kind).alias("_kind"), *[has(c).alias(c) for c in fields], (F.col("evidence_refs") if "evidence_refs" in df.columns else no_refs).alias("_refs"))

    rows = reduce(DataFrame.unionByName, [one(k, df) for k, df in tables.items()])
    kind = F.col("_kind")
    of = lambda name, when: F.count_if((kind == name) & when).alias(f"_{name}")
    names = lambda c, *kinds: F.size(F.collect_set(F.when(kind.isin(*kinds), filled(F.col(c)))))
    sums = rows.groupBy("document_id").agg(
        *[of(name, F.lit(True)) for name in {"metrics", *COUNTED.values()}], F.count_if((kind == "metrics") & (F.col("metric_family") == "allocation")).alias("_allocation"), F.count_if((kind == "metrics") & (F.col("metric_family") == "fee")).alias("_fee"),
        names("manager_name", "positions").alias("_managers"), names("fund_name", "positions").alias("_funds"), names("benchmark_version", "metrics", "relations").alias("_benchmarks"),
    )
    refs = rows.where(kind.isin("metrics", "relations", "warnings")).select("document_id", F.explode("_refs").alias("_r")).select("document_id", filled(F.col("_r")).alias("_r")).where("_r IS NOT NULL")
    refs = refs.groupBy("document_id").agg(F.array_sort(F.collect_set("_r")).alias("_all_refs"))
    all_refs = F.coalesce("_all_refs", F.array().cast("array<string>"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    known = lambda c: F.col(c).isNotNull().cast("long")
    zero = F.lit(0).cast("long")
    counts = {name: n(f"_{table}") for name, table in COUNTED.items()} | {
        "pension_plan": known("plan_id"), "source_document": known("source_document_id"), "document_version": known("source_document_id"), "plan_period": known("plan_period"), "metric_observation": n("_metrics"), "evidence_reference": F.size(all_refs).cast("long"),
        "investment_exposure": n("_allocation"), "manager_entity": n("_managers"), "fund_vehicle_entity": n("_funds"), "benchmark_definition": zero, "benchmark_version": n("_benchmarks"), "performance_observation": zero, "fee_observation": n("_fee"),
    }

    def status(name: str) -> Column:
        shown = F.when(counts[name] > 0, "present")
        return (shown.when(n("_metrics") > 0, "partial") if name in PENDING else shown).otherwise("not_disclosed")

    each = F.array(*[F.struct(F.lit(c).alias("component_name"), status(c).alias("status"), counts[c].alias("row_count")) for c in SCHEMA])
    out = documents.select("document_id", *CONTEXT).join(sums, "document_id", "left").join(refs, "document_id", "left").select("document_id", *CONTEXT, all_refs.alias("evidence_refs"), F.inline(each))
    state = F.col("status")
    return out.withColumns({
        "confidence": F.when(state == "present", 1.0).when(state == "partial", 0.5), "evidence_refs": F.when(state == "not_disclosed", F.array().cast("array<string>")).otherwise(F.col("evidence_refs")),
        "notes": F.coalesce(*[F.when(state == s, text) for s, text in NOTES.items()]),
    })
