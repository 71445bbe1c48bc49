"""Metrics derived from staged facts, their history, and the evidence that they rest on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clamp_confidence, finite, ordered_refs, stable_id

# Derived metrics with their formulas.
FORMULAS = {
    "funded_gap_usd": "aal_usd - ava_usd",
    "unfunded_ratio": "(aal_usd - ava_usd) / aal_usd",
    "net_cash_flow_usd": "employer_contributions_normalized + employee_contributions_normalized + benefit_payments_normalized + refunds_normalized",
    "contribution_to_benefit_ratio": "(employer_contributions_normalized + employee_contributions_normalized) / ABS(benefit_payments_normalized)",
}
FLOWS = ["employer_contributions_normalized", "employee_contributions_normalized", "benefit_payments_normalized", "refunds_normalized"]


def long_metrics(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
    """One row for every derived metric that has a value."""
    cases = F.array(*[F.struct(F.lit(n).alias("metric_name"), v.alias("value"), F.lit(FORMULAS[n]).alias("lineage_formula")) for n, v in values.items()])
    return rows.select("plan_id", "plan_period", "confidence", "source_fact_ids", "provenance_refs", F.inline(cases)).where("value IS NOT NULL")


def derived_metrics(facts: DataFrame, flows: DataFrame) -> DataFrame:
    """Funded gap and unfunded ratio of the last facts of a plan and period, and flow metrics of every cash-flow row.

    One partial aggregate picks the last fact (by fact_id) of both inputs.
    Blank keys and values that are not finite are left out; the confidence is
    the least of the inputs, and ids and references are their sorted union.
    """
    filled = lambda c: F.btrim(c) != ""
    good = facts.where(filled("plan_id") & filled("plan_period") & filled("fact_id") & finite(F.col("normalized_value")).isNotNull())
    good = good.select(F.btrim("plan_id").alias("plan_id"), F.btrim("plan_period").alias("plan_period"), F.btrim("metric_name").alias("m"), F.col("normalized_value").alias("v"), clamp_confidence(F.col("confidence")).alias("c"), "fact_id", ordered_refs(F.col("evidence_refs")).alias("refs"))

    def last(metric: str) -> Column:
        return F.max_by(F.struct("v", "c", "fact_id", "refs"), F.when(F.col("m") == metric, F.col("fact_id")))

    pair = good.where(F.col("m").isin("aal_usd", "ava_usd")).groupBy("plan_id", "plan_period").agg(last("aal_usd").alias("aal"), last("ava_usd").alias("ava")).where("aal IS NOT NULL AND ava IS NOT NULL")
    pair = pair.select(
        "plan_id", "plan_period", F.least("aal.c", "ava.c").alias("confidence"), F.array_sort(F.array("aal.fact_id", "ava.fact_id")).alias("source_fact_ids"),
        F.array_sort(F.array_union("aal.refs", "ava.refs")).alias("provenance_refs"), (F.col("aal.v") - F.col("ava.v")).alias("gap"), F.col("aal.v").alias("aal"),
    )
    cash = flows.where(filled("plan_id") & filled("plan_period") & filled("cash_flow_id"))
    employer, employee, benefit, refunds = (finite(F.col(c)) for c in FLOWS)
    cash = cash.withColumns({"confidence": clamp_confidence(F.col("confidence")), "source_fact_ids": F.array("cash_flow_id"), "provenance_refs": ordered_refs(F.col("evidence_refs"))})
    return long_metrics(pair, {"funded_gap_usd": F.col("gap"), "unfunded_ratio": F.try_divide("gap", "aal")}).unionByName(
        long_metrics(cash, {"net_cash_flow_usd": employer + employee + benefit + refunds, "contribution_to_benefit_ratio": F.try_divide(employer + employee, F.abs(benefit))})
    )


def weighted_means(metrics: DataFrame) -> DataFrame:
    """Mean of every metric with confidence (1 if unknown) as weight, the plain one where all weights are 0."""
    w = F.coalesce("confidence", F.lit(1.0))
    total = F.sum(w)
    mean = F.when(total <= 0, F.avg("value")).otherwise(F.try_divide(F.sum(F.col("value") * w), total))
    return metrics.groupBy("metric_name").agg(mean.alias("weighted_mean"), F.count(F.lit(1)).alias("sample_count"), F.greatest(total, F.lit(0.0)).alias("confidence_weight_sum"))


def series(metrics: DataFrame) -> DataFrame:
    """Points of a plan's metric in order of period; a group holds a plan's periods, so its list stays short."""
    points = F.array_sort(F.collect_list(F.struct("plan_period", "lineage_formula", "value")))
    return metrics.groupBy("plan_id", "metric_name").agg(points.alias("points"), F.max("value").alias("peak")).withColumn("title", F.initcap(F.replace("metric_name", F.lit("_"), F.lit(" "))))


def history_filter(rows: DataFrame, metrics: list[str], since: str | None = None, until: str | None = None) -> DataFrame:
    """Rows of the named metrics (any case) whose valid time begins in a window that includes both ends."""
    wanted = F.lower(F.btrim("metric_name")).isin(*[m.strip().lower() for m in metrics]) if metrics else F.lit(True)
    for limit, keep in ((since, F.col("valid_from") >= F.lit(since).cast("timestamp")), (until, F.col("valid_from") <= F.lit(until).cast("timestamp"))):
        wanted = wanted & keep if limit else wanted
    return rows.where(wanted)


def page(rows: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    """One page of rows with the number of all rows and whether more follow.

    The page is a top-k by ``order`` (no global sort) and the count a partial aggregate of one row.
    """
    total = rows.agg(F.count(F.lit(1)).alias("total_rows"))
    part = rows.orderBy(*order).offset(offset).limit(limit)
    return part.join(F.broadcast(total)).withColumn("has_more", F.col("total_rows") > offset + limit)


# Fixed value: what a reference to a page looks like.
PAGE_REF = r"(?i)^p(?:age)?[\s.:#-]*(\d+)(?:\s*[#:-]\s*(.+))?$"


def evidence_ref(raw: Column) -> Column:
    """A reference as ``text:<anchor>``, ``p.<page>#<section>`` or its words with single spaces; null is empty."""
    token = F.coalesce(F.regexp_replace(raw, r"^\s+|\s+$", ""), F.lit(""))
    words = lambda c: F.btrim(F.regexp_replace(c, r"\s+", " "))
    anchor = F.btrim(F.regexp_extract(F.lower(token), r"(?s)^text:(.*)$", 1))
    number, section = F.regexp_extract(token, PAGE_REF, 1), words(F.regexp_extract(token, PAGE_REF, 2))
    on_page = F.concat(F.lit("p."), F.coalesce(F.nullif(F.ltrim(number, F.lit("0")), F.lit("")), F.lit("0")), F.when(section != "", F.concat(F.lit("#"), section)).otherwise(""))
    return F.when(F.lower(token).startswith("text:"), F.concat(F.lit("text:"), F.when(anchor == "", "unknown").otherwise(anchor))).when(token.rlike(PAGE_REF), on_page).otherwise(words(token))


def evidence(rows: DataFrame) -> DataFrame:
    """References (report_id, source_document_id, evidence_ref) taken apart, with a stable id; empty ones go."""
    ref = F.col("raw_ref")
    anchored = ref.rlike("^(text|table):")
    on_page = ref.rlike(r"^p\.\d+(#.+)?$") & ~anchored
    rows = rows.withColumn("raw_ref", evidence_ref(F.col("evidence_ref"))).where("raw_ref <> ''").withColumns({
        "page_number": F.when(on_page, F.regexp_extract("raw_ref", r"^p\.(\d+)", 1).try_cast("int")),
        "section_hint": F.when(on_page, F.nullif(F.regexp_extract("raw_ref", r"^p\.\d+#(.+)$", 1), F.lit(""))).when(~anchored, ref),
        "snippet_anchor": F.when(anchored, ref),
    })
    tabular = F.lower("section_hint").rlike("^table( |$)")
    method = F.when(ref.startswith("table:") | tabular, "table").when(ref.startswith("text:") | F.col("page_number").isNotNull(), "text")
    parts = [F.col(c) for c in ("report_id", "source_document_id", "raw_ref", "page_number", "section_hint", "snippet_anchor")]
    return rows.withColumn("method", method).withColumn("evidence_ref_id", stable_id("evidence", *parts))


def evidence_links(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """References of facts as links and distinct evidence rows, and the facts without any."""
    refs = facts.withColumn("_refs", ordered_refs(F.transform("evidence_refs", evidence_ref)))
    links = evidence(refs.select("fact_id", "report_id", "source_document_id", F.explode("_refs").alias("evidence_ref"))).drop("evidence_ref")
    return links, refs.where(F.coalesce(F.size("_refs"), F.lit(0)) == 0).select("fact_id", F.lit("missing_evidence").alias("warning"))


def locator(rows: DataFrame) -> Column:
    """Document, and the page, anchor or section in it, quoted for a URL."""
    quoted = lambda c: F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    doc, page_no, anchor, section = (rows[c] for c in ("source_document_id", "page_number", "snippet_anchor", "section_hint"))
    where = F.when(page_no.isNotNull(), F.concat(F.lit("#page="), page_no.cast("string"))).when(anchor.isNotNull(), F.concat(F.lit("#anchor="), quoted(anchor))).when(section.isNotNull(), F.concat(F.lit("#section="), quoted(section))).otherwise("")
    return F.concat(doc, where)


def citation_rows(facts: DataFrame) -> DataFrame:
    """One row for every citation of a fact; facts without one keep a row of status ``missing``."""
    refs = F.array_distinct(F.filter(F.transform("evidence_refs", evidence_ref), lambda x: x != ""))
    rows = facts.select("fact_id", F.explode_outer(refs).alias("citation"))
    return rows.withColumn("status", F.when(F.col("citation").isNull(), "missing").otherwise("cited"))
