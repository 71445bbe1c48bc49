"""Rules on single records, filters, unions and capped lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import entity_token, finite


def cohort(plans: DataFrame, state_only: bool = False, sampled_only: bool = False) -> DataFrame:
    """Plans of the state-employee universe, of the sample, or of both."""
    if state_only:
        plans = plans.where("in_state_employee_universe")
    return plans.where("in_sampled_50") if sampled_only else plans


def curated_metrics(facts: DataFrame) -> DataFrame:
    """Facts with a value and a unit that isn't blank."""
    return facts.where(F.col("normalized_value").isNotNull() & (F.trim("normalized_unit") != ""))


def curated_cash_flows(flows: DataFrame, fields: list[str]) -> DataFrame:
    """Cash flows whose fields all have a value and a unit (``<field>_unit``) that isn't blank."""
    return flows.where(reduce(lambda a, b: a & b, [F.col(f).isNotNull() & (F.trim(f"{f}_unit") != "") for f in fields]))


def amortization_closed(method: Column) -> Column:
    """False for an open method, true for a closed or layered one, else unknown."""
    low = F.lower(method)
    return F.when(low.contains("open"), False).when(low.contains("closed") | low.contains("layer"), True)


def safe_ratio(a: Column, b: Column) -> Column:
    """Round 6; null where a value is unknown or not finite, or the denominator is 0."""
    return F.round(F.try_divide(finite(a), finite(b)), 6)


def safe_delta(a: Column, b: Column) -> Column:
    return F.round(finite(a) - finite(b), 6)


def tread_water_gap(paid: Column, normal_cost: Column, rate: Column, uaal: Column) -> Column:
    """What contributions have above normal cost and the interest on what is unfunded."""
    return F.round(finite(paid) - (finite(normal_cost) + finite(rate) * finite(uaal)), 6)


def negative_amortization(payment: Column, rate: Column, uaal: Column) -> Column:
    return finite(payment) < finite(rate) * finite(uaal)


def net_cash_flow_pct(contributions: Column, benefits: Column, assets: Column) -> Column:
    return F.round(F.try_divide(100.0 * (finite(contributions) - finite(benefits)), finite(assets)), 4)


def padded_cik(cik: Column) -> Column:
    """Ten digits, the missing ones zeros in front."""
    return F.lpad(F.regexp_replace(cik.cast("string"), "[^0-9]", ""), 10, "0")


def filing_urls(cik: Column, accession: Column, document: Column, submissions: str, archives: str) -> tuple[Column, Column]:
    """Where a filer's submissions and a filing's table are; no table without a document's name. Nothing is fetched."""
    name = F.regexp_replace(F.trim(document), "^/+", "")
    table = F.concat(F.lit(archives), padded_cik(cik).cast("bigint").cast("string"), F.lit("/"), F.replace(accession, F.lit("-"), F.lit("")), F.lit("/"), name)
    return F.concat(F.lit(f"{submissions}CIK"), padded_cik(cik), F.lit(".json")), F.when(name != "", table)


def allowed_citations(proposed: Column, allowed: Column) -> Column:
    """Proposed citations that are allowed, in their order; all that are allowed if none is left."""
    clean = lambda c: F.array_distinct(F.transform(c, lambda x: F.trim(x)))
    kept = F.array_intersect(clean(proposed), F.filter(allowed, lambda x: x != ""))
    return F.when(F.size(kept) > 0, kept).otherwise(F.filter(clean(allowed), lambda x: x != ""))


def failure_category(stage: Column, message: Column) -> Column:
    """What an operator has to look at; the stage of the source map comes before words of the message, other stages after them."""
    low = F.lower(message)
    has = lambda *words: reduce(lambda a, b: a | b, [low.contains(w) for w in words])
    return (
        F.when(stage == "source_map", "source_map_breakage").when(has("robot", "403"), "robots_restriction").when(has("revised", "supersession"), "revised_file_anomaly")
        .when(stage == "discovery", "discovery_data_error").when(stage == "ingestion", "ingestion_data_error").otherwise("unexpected_error")
    )


def missing_fields(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows that lack fields (null or blank), with their names."""
    gone = F.array_compact(F.array(*[F.when(F.coalesce(F.trim(F.col(f).cast("string")), F.lit("")) == "", f) for f in fields]))
    return rows.select(key, gone.alias("missing")).where(F.size("missing") > 0).withColumn("missing", F.array_join("missing", ", "))


def run_id(kind: str, mode: Column, plan: Column, period: Column, name: Column, snapshot: Column) -> Column:
    """Readable parts and twelve digits of the digest of all parts."""
    parts = [F.trim(plan), F.trim(period), mode, F.trim(name), F.trim(snapshot)]
    return F.concat_ws(":", F.lit(kind), mode, F.trim(plan), F.trim(period), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 12))


def latest_rows(log: DataFrame, n: int, at: str, key: str) -> DataFrame:
    """The last ``n`` rows: a top-k, no global sort."""
    return log.orderBy(F.desc(at), F.desc(key)).limit(n)


def capped(findings: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` findings, each with whether others were left out."""
    more = findings.select(F.lit(1).alias("x")).limit(n + 1).agg((F.count("x") > n).alias("truncated"))
    return findings.orderBy(*order).limit(n).join(F.broadcast(more))


def pending(queue: DataFrame) -> DataFrame:
    return queue.where("state = 'pending'")


def resolved(queue: DataFrame) -> DataFrame:
    return queue.where("state <> 'pending'")


def alias_scores(cases: DataFrame, candidates: DataFrame, ambiguous: float = 0.65, margin: float = 0.05, match: float = 0.82, by: str = "case_id") -> DataFrame:
    """Decision on every case's alias among the candidates with its ``by``: overlap of tokens, more if one holds the other.

    Names are compared once however many cases and entities have them, and meet
    on their tokens, as those that share none score 0. Of the entities with one
    name only the two with the greatest ids can be among a case's best two.
    """
    asked = cases.select("case_id", F.col(by).alias("_by"), entity_token(F.col("alias")).alias("_l")).where("_l <> ''").distinct()
    named = candidates.select(F.col(by).alias("_by"), "entity_id", entity_token(F.col("candidate")).alias("_r")).where("_r <> ''").distinct()

    def best_two(rows: DataFrame, key: list[str], *order: Column) -> DataFrame:
        return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n <= 2")

    def held(rows: DataFrame, name: str, size: str) -> DataFrame:
        tokens = F.array_distinct(F.split(name, " "))
        return rows.select("_by", name, F.size(tokens).alias(size), F.explode(tokens).alias("_t"))

    met = held(asked.select("_by", "_l").distinct(), "_l", "_a").join(held(named.select("_by", "_r").distinct(), "_r", "_b"), ["_by", "_t"])
    pairs = met.groupBy("_by", "_l", "_r").agg(F.count(F.lit(1)).alias("_both"), F.first("_a").alias("_a"), F.first("_b").alias("_b"))
    both = F.col("_both")
    overlap = both / (F.col("_a") + F.col("_b") - both) + F.when((both == F.col("_a")) | (both == F.col("_b")), 0.15).otherwise(0.0)
    score = F.when(F.col("_l") == F.col("_r"), 1.0).otherwise(F.least(F.lit(0.99), F.round(overlap, 6)))
    by_score = [F.desc("score"), F.desc("entity_id")]

    def per_entity(rows: DataFrame, key: list[str]) -> DataFrame:
        return best_two(rows.groupBy(*key, "entity_id").agg(F.max("score").alias("score")), key, *by_score)

    scored = pairs.select("_by", "_l", "_r", score.alias("score")).join(best_two(named, ["_by", "_r"], F.desc("entity_id")).drop("_n"), ["_by", "_r"])
    two = per_entity(asked.join(per_entity(scored, ["_by", "_l"]).drop("_n"), ["_by", "_l"]), ["case_id"])
    at = lambda n, c: F.max(F.when(F.col("_n") == n, F.col(c)))
    top = two.groupBy("case_id").agg(at(1, "entity_id").alias("_best"), at(1, "score").alias("best_score"), at(2, "score").alias("_second"))
    rows = cases.select("case_id").distinct().join(top, "case_id", "left")
    first, second = F.coalesce("best_score", F.lit(0.0)), F.coalesce("_second", F.lit(0.0))
    unsure = (second >= ambiguous) & (F.abs(first - second) <= margin) & (first < 0.999999)
    decision = F.when(first < ambiguous, "no_match").when(unsure, "ambiguous_review").when(first >= match, "matched").otherwise("ambiguous_review")
    return rows.select("case_id", decision.alias("decision"), F.when(decision == "matched", F.col("_best")).alias("entity_id"), F.round(first, 6).alias("best_score"), F.round(second, 6).alias("second_best_score"))


def metric_history(families: dict[str, DataFrame]) -> DataFrame:
    """Fact families in one schema: plan, period, family, name, value, unit, manager, fund, confidence and evidence."""
    kinds = {"plan_id": "string", "plan_period": "string", "metric_name": "string", "value": "double", "unit": "string", "manager_name": "string", "fund_name": "string", "confidence": "double", "evidence_refs": "array<string>"}

    def one(name: str, df: DataFrame) -> DataFrame:
        return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()]).withColumn("metric_family", F.lit(name))

    return reduce(DataFrame.unionByName, [one(name, df) for name, df in families.items()])


def citation_payload(rows: DataFrame, links: DataFrame, evidence: DataFrame) -> DataFrame:
    """Every row with the evidence it is linked to, in the order of the links; rows without any stay."""
    found = links.join(evidence, "evidence_id").groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("link_id", "evidence_id", "ref"))).alias("_e"))
    cited = F.transform("_e", lambda x: x["ref"])
    return rows.join(found, "row_id", "left").select("row_id", F.coalesce(F.array_join(cited, ","), F.lit("")).alias("citations"), F.coalesce(F.size("_e"), F.lit(0)).alias("n_citations"))
