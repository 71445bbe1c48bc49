"""Fees, risk limits and consultants that statements mention line by line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import UNITS, entity_token, finite, first_number, lookup, money_scale, money_to_usd, rate_to_ratio

PLAN = ["plan_id", "plan_period"]

# Fee types, board decisions, strengths of attributions, and names that disclose nobody.
FEE_TYPES = {"management_fee": "management_fee", "management fee": "management_fee", "performance_fee": "performance_fee", "performance fee": "performance_fee"}
DECISIONS = {
    "adopted": "adopted", "approved": "adopted", "partially adopted": "partially_adopted", "partially approved": "partially_adopted",
    "rejected": "rejected", "declined": "rejected", "not disclosed": "not_disclosed", "unknown": "not_disclosed",
}
STRENGTHS = {"explicit": "explicit", "direct": "explicit", "implied": "implied", "inferred": "implied", "speculative": "speculative", "uncertain": "speculative"}
NOBODY = ["n/a", "na", "none", "not disclosed", "not_disclosed", "undisclosed", "unknown"]
NOBODY_TOKENS = ["n a", "na", "none", "not disclosed", "undisclosed", "unknown"]
MENTIONS = {"consultant": 0.86, "recommendation": 0.8, "attribution": 0.76}  # confidence by kind
RISKS = ["derivatives", "securities_lending"]
RISK_CONFIDENCE = 0.84


def folded(c: Column) -> Column:
    """Lower case, white space as one space, none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(c), r"\s+", " "))


def filled(c: Column) -> Column:
    """Without white space at the ends; null if nothing is left."""
    return F.nullif(F.regexp_replace(c, r"^\s+|\s+$", ""), F.lit(""))


def label_parts(label: Column, at: int) -> Column:
    """A part of a label between colons, trimmed; null if there is none or it is blank."""
    return filled(F.get(F.split(label, ":", -1), F.lit(at)))


def fee_lines(labels: DataFrame) -> DataFrame:
    """Fees from rows ``fee:<manager>:<type>:<field>`` (label, value and ref as text, unit of amounts without one)."""
    field, number = folded(label_parts(F.col("label"), 3)), first_number(F.col("value"))
    scale = money_scale(F.col("value"), "")
    return labels.where(folded(F.col("label")).startswith("fee:")).select(
        *PLAN, label_parts(F.col("label"), 1).alias("manager_name"), F.coalesce(lookup(folded(label_parts(F.col("label"), 2)), FEE_TYPES), F.lit("other_fee")).alias("fee_type"),
        F.when(field.isin("rate", "rate_pct", "percent"), number).alias("rate_value"), F.when(field.isin("amount", "amount_usd", "usd"), number).alias("amount_value"),
        F.when(scale == "", F.col("unit")).otherwise(scale).alias("amount_unit"), F.contains(folded(F.col("value")), F.lit("not disclosed")).alias("undisclosed"), "ref",
    )


def fees(lines: DataFrame) -> DataFrame:
    """Fees in common units with how complete they are and their warnings, joined by commas.

    A manager whose name is spelled in several ways in a plan's period is
    ambiguous in all of its rows; rows without a manager never are.
    """
    has_rate, has_amount = F.col("rate_value").isNotNull(), F.col("amount_value").isNotNull()
    state = F.when(F.coalesce("undisclosed", F.lit(False)), "not_disclosed").when(has_rate & has_amount, "complete").when(has_rate | has_amount, "partial").otherwise("not_disclosed")
    rows = lines.withColumns({"manager_name": filled(F.col("manager_name")), "completeness": state}).withColumn("_key", folded(F.col("manager_name")))
    spelled = rows.where("_key IS NOT NULL").groupBy(*PLAN, "_key").agg((F.min("manager_name") != F.max("manager_name")).alias("_several")).where("_several")
    warnings = F.concat_ws(",", F.when(F.col("_several"), "ambiguous_manager_name"), F.when(state == "not_disclosed", "non_disclosure").when(state == "partial", "partial_fee_disclosure"))
    return rows.join(spelled, [*PLAN, "_key"], "left").select(
        *PLAN, "manager_name", "fee_type", rate_to_ratio(finite(F.col("rate_value"))).alias("normalized_rate"), money_to_usd(finite(F.col("amount_value")), F.col("amount_unit")).alias("amount_usd"),
        "completeness", warnings.alias("warnings"), F.col("ref").alias("evidence_ref"),
    )


def risk_topics(labels: DataFrame) -> DataFrame:
    """Risk disclosures from rows ``risk:<kind>:<topic>:<field>``, one for every topic.

    Rows count in the order of their refs: unit and text are those of a
    topic's first row, a figure that of its last row, unknown if that has no
    number.
    """
    label, scale = F.col("label"), money_scale(F.col("value"), "")
    rows = labels.where(folded(label).startswith("risk:")).select(
        *PLAN, F.replace(folded(label_parts(label, 1)), F.lit(" "), F.lit("_")).alias("disclosure_type"), F.coalesce(label_parts(label, 2), F.lit("not_specified")).alias("topic"),
        folded(label_parts(label, 3)).alias("_f"), first_number(F.col("value")).alias("_v"), F.when(scale == "", F.col("unit")).otherwise(scale).alias("unit"), F.col("value").alias("text"), "ref",
    ).where(F.col("disclosure_type").isin(RISKS))

    def figure(field: str) -> Column:
        here = F.col("_f") == field
        return F.max_by(F.when(here, F.col("_v")), F.when(here, F.col("ref"))).alias(field)

    return rows.groupBy(*PLAN, "disclosure_type", "topic").agg(
        figure("policy_limit"), figure("realized_exposure"), figure("collateral"), F.min_by("unit", "ref").alias("unit"), F.min_by("text", "ref").alias("text"), F.array_join(F.array_sort(F.collect_set("ref")), ",").alias("evidence_refs")
    )


def without_risks(documents: DataFrame, topics: DataFrame) -> DataFrame:
    """Kinds of risk that a document says nothing of."""
    both = documents.select(*PLAN).distinct().select(*PLAN, F.explode(F.array(*map(F.lit, RISKS))).alias("disclosure_type"))
    return both.join(topics, [*PLAN, "disclosure_type"], "left_anti").withColumn("metric_name", F.concat("disclosure_type", F.lit(":not_disclosed")))


def risk_metric() -> Column:
    slug = F.btrim(F.regexp_replace(F.lower("topic"), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.concat("disclosure_type", F.lit(":"), F.when(slug == "", "not_specified").otherwise(slug))


def risk_observations(documents: DataFrame, topics: DataFrame) -> DataFrame:
    """Limits, exposures and collateral (of lending only) in common units; one row for each kind that isn't disclosed."""
    kinds = {"policy_limit": "policy_limit", "realized_exposure": "realized_exposure", "collateral": "collateral_context"}
    cases = [F.when(F.col(f).isNotNull() & (F.lit(f != "collateral") | (F.col("disclosure_type") == "securities_lending")), F.struct(F.lit(f).alias("field"), F.lit(k).alias("kind"), F.col(f).alias("value"))) for f, k in kinds.items()]
    rows = topics.withColumn("_o", F.explode(F.array_compact(F.array(*cases)))).select(
        *PLAN, "disclosure_type", F.concat(risk_metric(), F.lit(":"), "_o.field").alias("metric_name"), F.col("_o.kind").alias("observation_kind"),
        F.round(finite(F.col("_o.value")) * lookup(F.col("unit"), UNITS), 6).alias("value_usd"), F.when(F.col("unit") == "ratio", F.round(finite(F.col("_o.value")), 6)).alias("value_ratio"),
        F.coalesce(filled(F.col("text")), F.lit("not_disclosed")).alias("as_reported_text"), F.lit(RISK_CONFIDENCE).alias("confidence"), "evidence_refs",
    )
    none = F.lit(None).cast("double")
    gone = without_risks(documents, topics).select(*PLAN, "disclosure_type", "metric_name", F.lit("not_disclosed").alias("observation_kind"), none.alias("value_usd"), none.alias("value_ratio"), F.lit("not_disclosed").alias("as_reported_text"), F.lit(0.0).alias("confidence"), F.lit("").alias("evidence_refs"))
    return rows.unionByName(gone)


def risk_diagnostics(documents: DataFrame, topics: DataFrame) -> DataFrame:
    """Topics that give only the limit, only the exposure or neither (nor collateral), and kinds that aren't disclosed."""
    limit, real = F.col("policy_limit").isNotNull(), F.col("realized_exposure").isNotNull()
    backed = F.col("collateral").isNotNull() & (F.col("disclosure_type") == "securities_lending")
    code = F.when(limit & ~real, "policy_only").when(real & ~limit, "realized_only").when(~limit & ~real & ~backed, "not_disclosed")
    rows = topics.select(*PLAN, "disclosure_type", risk_metric().alias("metric_name"), code.alias("code"), "evidence_refs").where("code IS NOT NULL")
    return rows.unionByName(without_risks(documents, topics).select(*PLAN, "disclosure_type", "metric_name", F.lit("not_disclosed").alias("code"), F.lit("").alias("evidence_refs")))


def board_decision(c: Column) -> Column:
    return F.coalesce(lookup(folded(c), DECISIONS), F.lit("not_disclosed"))


def attribution_strength(c: Column) -> Column:
    return F.coalesce(lookup(folded(c), STRENGTHS), F.lit("speculative"))


def disclosed_name(name: Column) -> Column:
    """Whether a name stands for someone."""
    return F.coalesce((folded(name) != "") & ~folded(name).isin(NOBODY) & ~entity_token(name).isin(NOBODY_TOKENS), F.lit(False))


def consultant_id(name: Column) -> Column:
    """By name; for those that aren't disclosed by plan and period."""
    scope = lambda c, unknown: F.coalesce(F.nullif(entity_token(F.col(c)), F.lit("")), F.lit(unknown))
    own = F.when(disclosed_name(name), F.nullif(entity_token(name), F.lit("")))
    return F.coalesce(F.concat(F.lit("consultant:"), own), F.concat_ws(":", F.lit("consultant:not_disclosed"), scope("plan_id", "unknown-plan"), scope("plan_period", "unknown-period")))


def consultant_mentions(blocks: DataFrame) -> DataFrame:
    """Blocks ``consultant:``, ``recommendation:`` and ``attribution:`` as rows: kind, name and up to three more parts between bars."""
    kind = F.regexp_extract(F.lower(F.btrim("text")), f"^({'|'.join(MENTIONS)}):", 1)
    parts = F.split(F.regexp_extract(F.col("text"), r"(?s)^[^:]*:(.*)$", 1), r"\|", -1)
    part = lambda at: filled(F.get(parts, F.lit(at)))
    rows = blocks.select(*PLAN, kind.alias("kind"), part(0).alias("consultant_name"), part(1).alias("first"), part(2).alias("second"), part(3).alias("third")).where("kind <> ''")
    return rows.withColumn("_key", F.coalesce(folded(F.col("consultant_name")), F.lit("")))


def consultant_entities(mentions: DataFrame) -> DataFrame:
    """The consultants of a plan's period by folded name; several spellings make one ambiguous."""
    named = mentions.where("kind = 'consultant' AND _key <> ''").groupBy(*PLAN, F.col("_key").alias("normalized_name")).agg(F.min("consultant_name").alias("consultant_name"), F.max("consultant_name").alias("_last"))
    known = disclosed_name(F.col("normalized_name"))
    status = F.when(~known, "not_disclosed").when(F.col("consultant_name") != F.col("_last"), "ambiguous").otherwise("resolved")
    return named.select(*PLAN, "normalized_name", "consultant_name", consultant_id(F.col("normalized_name")).alias("consultant_id"), status.alias("linkage_status"), F.lit(MENTIONS["consultant"]).alias("confidence"))


def consultant_rows(documents: DataFrame, mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """Engagements, recommendations and attributions, at least one of each for every document.

    ``topic`` is the role of an engagement; ``detail`` a recommendation's text
    or an outcome; ``rating`` the board's decision or the strength.
    """
    unknown = F.lit("not_disclosed")
    unsure = entities.where("linkage_status = 'ambiguous'").select(*PLAN, F.col("normalized_name").alias("_key"), F.lit(True).alias("_unsure"))
    is_ = {k: F.col("kind") == k for k in MENTIONS}
    rating = F.when(is_["recommendation"], board_decision(F.col("third"))).when(is_["attribution"], attribution_strength(F.col("third")))
    status = F.when(~disclosed_name(F.col("consultant_name")), "not_disclosed").when(F.col("_unsure"), "ambiguous").otherwise("resolved")
    every = documents.select(*PLAN).distinct().select(*PLAN, F.explode(F.array(*map(F.lit, MENTIONS))).alias("kind"))
    gone = every.join(mentions.select(*PLAN, "kind").distinct(), [*PLAN, "kind"], "left_anti").withColumn("_gone", F.lit(True))
    rows = mentions.join(unsure, [*PLAN, "_key"], "left").unionByName(gone, allowMissingColumns=True)
    confidence = F.when(F.col("_gone"), 0.0).otherwise(lookup(F.col("kind"), MENTIONS))
    return rows.select(
        *PLAN, "kind", F.coalesce("consultant_name", unknown).alias("consultant_name"), consultant_id(F.col("consultant_name")).alias("consultant_id"), status.alias("linkage_status"),
        F.coalesce("first", unknown).alias("topic"), F.when(~is_["consultant"], F.coalesce("second", unknown)).alias("detail"), rating.alias("rating"), confidence.alias("confidence"),
    )


def consultant_warnings(documents: DataFrame, mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """Ambiguous names, recommendations without a topic, and documents that name no consultant."""
    code = lambda name: F.lit(name).alias("code")
    unsure = entities.where(F.col("linkage_status") == "ambiguous").select(*PLAN, code("ambiguous_naming"))
    bare = mentions.where("kind = 'recommendation' AND coalesce(first, 'not_disclosed') = 'not_disclosed'").select(*PLAN, code("missing_topic"))
    gone = documents.select(*PLAN).distinct().join(mentions.where("kind = 'consultant'"), PLAN, "left_anti").select(*PLAN, code("non_disclosure"))
    return unsure.union(bare).union(gone).groupBy(*PLAN, "code").agg(F.count(F.lit(1)).alias("n"))
