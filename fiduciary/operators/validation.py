"""Rules that parsed rows must meet before a document may be published."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fields that must be filled, what references look like, and the range of each metric.
REQUIRED_FIELDS = ["plan_id", "plan_period", "metric_name", "source_document_id", "source_url", "effective_date", "ingestion_date", "parser_version", "extraction_method", "normalized_unit"]
VALID_REF = r"^(?:p\.\d+(?:#.+)?|text:(?:\d+|unknown)|table:.+)$"
RANGES = {
    "funded_ratio": (0.0, 2.0), "discount_rate": (0.0, 1.0), "employer_contribution_rate": (0.0, 1.0), "employee_contribution_rate": (0.0, 1.0),
    "aal_usd": (0.0, None), "ava_usd": (0.0, None), "participant_count": (0.0, None),
}


def outside(metric: Column, value: Column) -> Column:
    """Whether a value lies outside the range of its metric; NaN does, metrics without a range never do."""
    out = F.lit(False)
    for name, (low, high) in RANGES.items():
        bad = (value < low) | F.isnan(value)
        out = F.when(metric == name, bad if high is None else bad | (value > high)).otherwise(out)
    return out


def row_findings(rows: DataFrame) -> DataFrame:
    """One row for every broken rule of every parsed row: code, and the field for missing ones."""
    value, refs = F.col("normalized_value"), F.col("evidence_refs")
    case = lambda code, broken, detail="": F.when(broken, F.struct(F.lit(code).alias("code"), F.lit(detail).alias("detail")))
    rules = [case("schema_invalid", F.coalesce(F.btrim(F.col(c).cast("string")), F.lit("")) == "", c) for c in REQUIRED_FIELDS]
    rules += [
        case("confidence_out_of_range", ~F.coalesce(F.col("confidence").between(0.0, 1.0), F.lit(False))),
        case("normalized_value_missing", value.isNull()),
        case("numeric_out_of_range", F.coalesce(outside(F.col("metric_name"), value), F.lit(False))),
        case("provenance_missing", F.coalesce(F.size(refs), F.lit(0)) == 0),
        case("provenance_invalid", F.exists(refs, lambda x: ~F.coalesce(F.btrim(x).rlike(VALID_REF), F.lit(False)))),
    ]
    return rows.select("document_id", "plan_id", "plan_period", "metric_name", F.explode(F.array_compact(F.array(*rules))).alias("_f")).select("document_id", "plan_id", "plan_period", "metric_name", "_f.*")


def missing_metrics(rows: DataFrame, required: list[str]) -> DataFrame:
    """Required metrics that a document has no row of.

    Documents are grouped once with a flag for each metric, so neither
    a grid of documents and metrics nor an anti join is needed.
    """
    flags = [F.when(~F.bool_or(F.coalesce(F.col("metric_name") == m, F.lit(False))), F.lit(m)) for m in required]
    docs = rows.groupBy("document_id").agg(F.min(F.struct("plan_id", "plan_period")).alias("_p"), F.array_compact(F.array(*flags)).alias("_missing"))
    return docs.select("document_id", "_p.plan_id", "_p.plan_period", F.explode("_missing").alias("metric_name"), F.lit("required_metric_missing").alias("code"), F.lit("").alias("detail"))


def findings(rows: DataFrame, required: list[str]) -> DataFrame:
    """Broken rules of rows and missing metrics of documents, each once."""
    return row_findings(rows).unionByName(missing_metrics(rows, required)).distinct()


def promotable(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of documents without any finding: one finding blocks its document."""
    return rows.join(found.select("document_id").distinct(), "document_id", "left_anti")


def system_types(plans: DataFrame, registry: DataFrame) -> DataFrame:
    """Type of a plan's system by its id in lower case, with or without the prefix ``ps-``; its cohort where the registry has none.

    Of several registry rows for one id the last (by seq) counts.
    """
    known = registry.select(F.lower(F.btrim("stable_id")).alias("_id"), F.btrim("system_type").alias("system_type"), "seq").where("_id <> '' AND system_type <> ''")
    names = F.array_compact(F.array(F.col("_id"), F.when(F.col("_id").startswith("ps-"), F.substring("_id", 4, 1000))))
    by_name = known.select(F.explode(names).alias("_id"), "system_type", "seq").groupBy("_id").agg(F.max_by("system_type", "seq").alias("system_type"))
    rows = plans.withColumn("_id", F.lower(F.btrim("plan_id"))).join(by_name, "_id", "left")
    return rows.select("plan_id", F.coalesce("system_type", "cohort").alias("system_type"))


def key_changes(before: DataFrame, after: DataFrame, key: list[str], status: str) -> DataFrame:
    """Keys that a manifest gained or lost, or whose status changed: sets by one grouping instead of two differences."""
    tagged = before.select(*key, F.col(status).alias("_b"), F.lit(None).cast("string").alias("_a"), F.lit(1).alias("_s")).unionByName(after.select(*key, F.lit(None).cast("string").alias("_b"), F.col(status).alias("_a"), F.lit(2).alias("_s")))
    both = tagged.groupBy(*key).agg(F.max("_b").alias("before"), F.max("_a").alias("after"), F.bit_or("_s").alias("_s"))
    change = F.when(F.col("_s") == 1, "removed").when(F.col("_s") == 2, "added").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    return both.withColumn("change", change).where("change IS NOT NULL").drop("_s")
