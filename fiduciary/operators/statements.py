"""Funded and actuarial figures from the text blocks and table rows of statements."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import UNITS, first_number, first_sentence, lookup, money_scale

PLAN = ["plan_id", "plan_period"]

# The required metrics, of what kind they are, and the names under which statements give them.
METRICS = {
    "funded_ratio": ("ratio", ("funded ratio", "funding ratio")),
    "aal_usd": ("money", ("aal", "actuarial accrued liability")),
    "ava_usd": ("money", ("ava", "actuarial value of assets")),
    "discount_rate": ("ratio", ("discount rate", "assumed return")),
    "employer_contribution_rate": ("ratio", ("employer contribution rate", "adc rate")),
    "employee_contribution_rate": ("ratio", ("employee contribution rate",)),
    "participant_count": ("count", ("participant count", "active participants")),
}
NEAR = 96  # characters after a name in which its figure has to be
TEXT, TABLE = 0.84, 0.93  # confidence of a figure from text and from a table


def figure_after(text: Column, names: tuple[str, ...]) -> Column:
    """The number that follows the first mention of a name that has one in its sentence, within NEAR characters."""
    low = F.lower(text)

    def mentions(name: str) -> Column:
        parts = F.split(low, rf"\Q{name}\E", -1)
        ends = F.transform(F.slice(F.sequence(F.lit(0), F.size(parts) - 1), F.lit(2), F.size(parts)), lambda i: F.length(F.array_join(F.slice(parts, F.lit(1), i), name)) + len(name))
        return F.transform(ends, lambda at: F.struct(at.alias("at"), first_number(first_sentence(F.substring(text, at + 1, F.lit(NEAR)))).alias("value")))

    return F.array_min(F.filter(F.concat(*map(mentions, names)), lambda x: x["value"].isNotNull()))["value"]


def normalised(kind: str, value: Column, raw: Column, unit: Column) -> tuple[Column, Column]:
    """The value in common units, and the unit in which the text gives it."""
    if kind == "money":
        scale = F.coalesce(money_scale(raw, ""), F.lit(""))
        scale = F.when(scale == "", unit).otherwise(scale)
        return F.round(value * lookup(scale, UNITS), 6), scale
    if kind == "ratio":
        percent = F.instr(raw, "%").__gt__(0) | F.lower(raw).contains("percent")
        return F.when(percent | (value > 1), F.round(value / 100, 9)).otherwise(value), F.when(percent, "percent").when(value > 1, "percent_assumed").otherwise("ratio")
    return F.bround(value, 0), F.lit("count")


def metric_candidates(blocks: DataFrame, rows: DataFrame) -> DataFrame:
    """Every figure that a text block (text, unit, ref) or a table row (label, value, unit, ref) gives for a metric."""

    def found(df: DataFrame, raw: str, confidence: float) -> DataFrame:
        """Candidates from rows that hold the figure of every metric in a column of its name."""
        out = []
        for name, (kind, _) in METRICS.items():
            value = F.col(name)
            common, unit = normalised(kind, value, F.col(raw), F.col("unit"))
            out.append(F.when(value.isNotNull(), F.struct(F.lit(name).alias("metric_name"), value.alias("as_reported_value"), common.alias("normalized_value"), unit.alias("as_reported_unit"), F.lit(confidence).alias("confidence"))))
        return df.select(*PLAN, F.col("ref").alias("evidence_ref"), F.explode(F.filter(F.array(*out), lambda x: x.isNotNull())).alias("_m"))

    label, number = F.lower(F.trim("label")), first_number(F.trim("value"))
    named = {m: reduce(or_, [label.contains(name) for name in names]) for m, (_, names) in METRICS.items()}
    in_text = blocks.select(*PLAN, "ref", "unit", "text", *[figure_after(F.col("text"), names).alias(m) for m, (_, names) in METRICS.items()])
    in_tables = rows.withColumn("_number", number).select(*PLAN, "ref", "unit", "value", *[F.when(named[m], F.col("_number")).alias(m) for m in METRICS])
    return found(in_text, "text", TEXT).union(found(in_tables, "value", TABLE)).select(*PLAN, "_m.*", "evidence_ref")


def statement_metrics(candidates: DataFrame) -> DataFrame:
    """The surest figure of every metric (tables before text, then the last reference), and whether figures differ."""
    order = F.struct("confidence", (F.col("confidence") == TABLE).alias("table"), "evidence_ref")
    best = F.max_by(F.struct("as_reported_value", "normalized_value", "as_reported_unit", "confidence", "evidence_ref"), order).alias("_best")
    spread = F.max(F.round("normalized_value", 9)) - F.min(F.round("normalized_value", 9))
    out = candidates.groupBy(*PLAN, "metric_name").agg(best, (spread > 1e-9).alias("ambiguous"))
    method = F.when(F.col("confidence") == TABLE, "table_lookup").otherwise("text_pattern")
    return out.select(*PLAN, "metric_name", "_best.*", "ambiguous").withColumn("extraction_method", method)


def metric_diagnostics(documents: DataFrame, metrics: DataFrame) -> DataFrame:
    """A row for every metric that a document lacks or gives in different values."""
    known = metrics.groupBy(*PLAN).agg(F.collect_list("metric_name").alias("_has"), F.collect_list(F.when(F.col("ambiguous"), F.col("metric_name"))).alias("_unsure"))
    joined = documents.select(*PLAN).distinct().join(known, PLAN, "left")
    none = F.array().cast("array<string>")
    missing = F.array_except(F.array(*map(F.lit, METRICS)), F.coalesce("_has", none))
    rows = F.concat(F.transform(missing, lambda m: F.struct(F.lit("missing_metric").alias("code"), m.alias("metric_name"))), F.transform(F.coalesce("_unsure", none), lambda m: F.struct(F.lit("ambiguous_metric").alias("code"), m.alias("metric_name"))))
    return joined.select(*PLAN, F.inline(rows))


def second_extractor(documents: DataFrame, metrics: DataFrame, diagnostics: DataFrame, sure: float = 0.9) -> DataFrame:
    """Documents for the second extractor: a metric is missing, unsure or has a diagnostic, or the tables are complex (flag of the document)."""
    low = metrics.groupBy(*PLAN).agg(F.bool_or(F.col("confidence") < sure).alias("_low"))
    told = diagnostics.groupBy(*PLAN).agg(F.lit(True).alias("_told"))
    rows = documents.join(low, PLAN, "left").join(told, PLAN, "left")
    return rows.select(*PLAN, (F.col("complex") | F.coalesce("_low", F.lit(False)) | F.coalesce("_told", F.lit(False))).alias("second_extractor"))
