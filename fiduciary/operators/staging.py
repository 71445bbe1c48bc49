"""Staged facts and warnings, entities with their source links, peer records, components and their checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import entity_token, finite, ordered_refs, stable_id
from ..functions.shared import cut
from .disclosures import funded_fraction
from .mentions import PLAN, filled

# The components of the schema, and what a run must tell to be repeated.
COMPONENTS = [
    "pension_plan", "source_document", "document_version", "plan_period", "metric_observation", "evidence_reference", "investment_exposure", "manager_entity",
    "fund_vehicle_entity", "plan_manager_fund_position", "manager_lifecycle_event", "benchmark_definition", "benchmark_version", "performance_observation",
    "fee_observation", "risk_exposure_observation", "consultant_entity", "plan_consultant_engagement", "consultant_recommendation",
]
ENVELOPE = ["run_id", "config_hash", "code_version", "input_snapshot_id", "generated_at"]


def staged_facts(families: dict[str, DataFrame], effective: str, version: str) -> DataFrame:
    """Facts of all families (plan, period, metric, value, confidence, evidence_refs; manager and fund where they have them) as staging rows.

    Values and confidences that are not finite become null. The id is a digest
    of what tells facts apart, so staging the same fact again gives its id again.
    """
    kinds = {"metric_name": "string", "value": "double", "unit": "string", "manager_name": "string", "fund_name": "string", "confidence": "double", "evidence_refs": "array<string>"}

    def one(family: str, df: DataFrame) -> DataFrame:
        return df.select(*PLAN, *[(F.col(c) if c in df.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()]).withColumn("metric_family", F.lit(family))

    rows = reduce(DataFrame.unionByName, [one(name, df) for name, df in families.items()])
    rows = rows.withColumns({"evidence_refs": F.array_sort(ordered_refs(F.coalesce("evidence_refs", F.array().cast("array<string>")))), "effective_date": F.lit(effective), "benchmark_version": F.lit(version)})
    key = [*PLAN, "metric_family", "metric_name", "manager_name", "fund_name", "effective_date", "benchmark_version"]
    fact = stable_id("fact", *map(F.col, key), F.array_join("evidence_refs", ","))
    return rows.withColumns({"fact_id": fact, "value": finite(F.col("value")), "confidence": finite(F.col("confidence"))})


def relationships(positions: DataFrame, effective: str) -> DataFrame:
    """Positions as relations of plan, manager and fund; a manager without a name is told as not disclosed or unknown."""
    name = F.coalesce(F.when(filled(F.col("manager_name")).isNotNull(), F.col("manager_name")), F.when(F.col("completeness") == "not_disclosed", "[not_disclosed]").otherwise("[unknown_manager]"))
    rows = positions.withColumn("manager_name", name)
    return rows.withColumn("relationship_id", stable_id("rel", *[F.col(c) for c in (*PLAN, "manager_name", "fund_name", "completeness")], F.lit(effective)))


def warnings_union(domains: dict[str, DataFrame]) -> DataFrame:
    """Warnings of all domains in one schema, each with an id by its content; equal ones stay once."""
    fields = ["code", "manager_name", "fund_name", "metric_name"]

    def one(domain: str, df: DataFrame) -> DataFrame:
        return df.select(F.lit(domain).alias("warning_domain"), *PLAN, *[(F.col(c) if c in df.columns else F.lit(None)).cast("string").alias(c) for c in fields])

    rows = reduce(DataFrame.unionByName, [one(name, df) for name, df in domains.items()]).distinct()
    return rows.withColumn("warning_id", stable_id("warn", *[F.col(c) for c in ("warning_domain", *PLAN, *fields)]))


def distinct_findings(findings: DataFrame) -> DataFrame:
    """Findings, of those that agree in code, plan, period, metric, message and refs the last (seq); unknown metrics are alike."""
    key = ["code", *PLAN, "metric_name", "message", "evidence_refs"]
    return findings.withColumn("metric_name", F.coalesce("metric_name", F.lit(""))).groupBy(*key).agg(F.max_by("severity", "seq").alias("severity"))


def parser_anomalies(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """Errors, which block publishing, and rows of high review priority that don't; one for each id."""
    errors = findings.where("severity = 'error'").select(*PLAN, "metric_name", F.lit("error").alias("severity"), F.col("code").alias("source"), F.lit(True).alias("publish_blocked"), stable_id("parser-anomaly", *[F.col(c) for c in (*PLAN, "metric_name", "code")]).alias("anomaly_id"))
    unsure = decisions.where("review_priority = 'high' AND NOT publish_blocked").select(*PLAN, "metric_name", F.lit("warning").alias("severity"), F.col("row_id").cast("string").alias("source"), F.lit(False).alias("publish_blocked"), stable_id("parser-anomaly", F.lit("low_confidence"), *[F.col(c) for c in (*PLAN, "metric_name", "row_id")]).alias("anomaly_id"))
    return errors.unionByName(unsure).dropDuplicates(["anomaly_id"])


def entity_ids(kind: Column, name: Column, keys: Column) -> Column:
    """Kind, folded name and folded keys (each once, in their order); null if nothing of the name is left."""
    tokens = F.array_distinct(F.filter(F.transform(keys, entity_token), lambda x: x != ""))
    head = F.concat(kind, F.lit(":"), F.nullif(entity_token(name), F.lit("")))
    return F.when(F.size(tokens) > 0, F.concat(head, F.lit(":"), F.array_join(tokens, ":"))).otherwise(head)


def upsert_entities(entities: DataFrame, updates: DataFrame) -> DataFrame:
    """Entities (stable_id, entity_type, display_name, metadata, merged_into) with new ones; known ones take the metadata of their update.

    Merged entities keep theirs. Of several updates of one id that with the greatest seq counts.
    """
    latest = updates.groupBy("stable_id").agg(F.max_by(F.struct("entity_type", "display_name", "metadata"), "seq").alias("_u"))
    both = entities.withColumn("_known", F.lit(True)).join(latest, "stable_id", "full_outer")
    known = F.col("_known").isNotNull()
    kept = lambda c: F.when(known, F.col(c)).otherwise(F.col(f"_u.{c}")).alias(c)
    metadata = F.when(known & (F.col("merged_into").isNotNull() | F.col("_u").isNull()), F.col("metadata")).otherwise(F.col("_u.metadata"))
    return both.select("stable_id", kept("entity_type"), kept("display_name"), metadata.alias("metadata"), "merged_into")


def valid_merges(entities: DataFrame, merges: DataFrame) -> DataFrame:
    """Merges (source, target) of two different active entities of one type.

    A batch is taken as a whole: a source may go to one target only and a
    target may not itself be merged in the batch.
    """
    active = entities.where("merged_into IS NULL").select("stable_id", "entity_type")
    once = merges.where("source <> target").groupBy("source").agg(F.min("target").alias("target"), F.max("target").alias("_last")).where("target = _last").drop("_last")
    typed = once.join(active.toDF("source", "_s"), "source").join(active.toDF("target", "_t"), "target").where("_s = _t").select("source", "target")
    return typed.join(merges.select(F.col("source").alias("target")).distinct(), "target", "left_anti").select("source", "target")


def merge_rejects(entities: DataFrame, merges: DataFrame) -> DataFrame:
    """Merges (source, target) that break a rule, with the first one they break.

    same_id, unknown_source, unknown_target, entity_type, source_merged,
    target_merged; and for merges that are good one by one, but not in one
    batch: several_targets of a source, target_in_batch for a target that is
    itself a source.
    """
    of = lambda side: entities.select(F.col("stable_id").alias(side), F.col("entity_type").alias(f"_{side}_type"), F.col("merged_into").alias(f"_{side}_into"), F.lit(True).alias(f"_{side}"))
    several = merges.groupBy("source").agg((F.min("target") < F.max("target")).alias("_several"))
    sources = merges.select(F.col("source").alias("target"), F.lit(True).alias("_again")).distinct()
    rows = merges.distinct().join(of("source"), "source", "left").join(of("target"), "target", "left").join(several, "source", "left").join(sources, "target", "left")
    reason = (
        F.when(F.col("source").eqNullSafe(F.col("target")), "same_id").when(F.col("_source").isNull(), "unknown_source").when(F.col("_target").isNull(), "unknown_target").when(~F.col("_source_type").eqNullSafe(F.col("_target_type")), "entity_type")
        .when(F.col("_source_into").isNotNull(), "source_merged").when(F.col("_target_into").isNotNull(), "target_merged").when(F.col("_several"), "several_targets").when(F.col("_again"), "target_in_batch")
    )
    return rows.select("source", "target", reason.alias("reason")).where("reason IS NOT NULL")


def merge_entities(entities: DataFrame, merges: DataFrame) -> DataFrame:
    """Entities after valid merges: sources name their target."""
    to = merges.select(F.col("source").alias("stable_id"), F.col("target").alias("_to"))
    return entities.join(to, "stable_id", "left").withColumn("merged_into", F.coalesce("merged_into", "_to")).drop("_to")


def active_entities(entities: DataFrame) -> DataFrame:
    return entities.where("merged_into IS NULL")


def entity_links(links: DataFrame, merges: DataFrame) -> DataFrame:
    """Source records (stable_id, source_table, source_record_id, ref) of every entity after merges, with their refs in order; blank tables and records go."""
    moved = links.join(merges.select(F.col("source").alias("stable_id"), F.col("target").alias("_to")), "stable_id", "left")
    rows = moved.select(F.coalesce("_to", "stable_id").alias("stable_id"), filled(F.col("source_table")).alias("source_table"), filled(F.col("source_record_id")).alias("source_record_id"), filled(F.col("ref")).alias("ref"))
    return rows.where("source_table IS NOT NULL AND source_record_id IS NOT NULL").groupBy("stable_id", "source_table", "source_record_id").agg(F.array_sort(F.collect_set("ref")).alias("refs"))


def artifact_chains(records: DataFrame) -> DataFrame:
    """The root of every artifact's chain of supersessions (artifact_id, supersedes) and its place in it, by pointer jumping.

    Each round doubles the way that is known. A parent that isn't among the
    records ends the chain; members of a cycle have neither root nor place.
    """
    ids = records.select("artifact_id").distinct()
    parents = records.join(ids.withColumnRenamed("artifact_id", "supersedes"), "supersedes", "left_semi").select("artifact_id", F.col("supersedes").alias("_up"))
    at = cut(ids.join(parents, "artifact_id", "left").select("artifact_id", F.coalesce("_up", "artifact_id").alias("root"), F.col("_up").isNotNull().cast("long").alias("place"), F.col("_up").isNull().alias("_done")))
    for _ in range(at.count().bit_length() + 1):
        if at.where("NOT _done").isEmpty():
            break
        ahead = at.select(F.col("artifact_id").alias("root"), F.col("root").alias("_root"), F.col("place").alias("_place"), F.col("_done").alias("_end"))
        jumped = at.where("NOT _done").join(ahead, "root").select("artifact_id", F.col("_root").alias("root"), (F.col("place") + F.col("_place")).alias("place"), F.col("_end").alias("_done"))
        at = cut(at.where("_done").unionByName(jumped))
    return at.select("artifact_id", F.when(F.col("_done"), F.col("root")).alias("root"), F.when(F.col("_done"), F.col("place")).alias("place"))


def peer_universe(records: DataFrame, classes: dict[str, str]) -> DataFrame:
    """Survey records by plan and year, of several with one key the last (seq): allocations as a map of percents.

    ``classes`` names the column of each asset class; unknown and negative
    weights go, those up to 1 are shares. Funded ratios above 3 are percents;
    without one at market value that is the assets (mkt_assets) over the
    liabilities (act_liabilities), where those columns exist.
    """
    known = lambda c: finite(F.col(c)) if c in records.columns else F.lit(None).cast("double")
    ratios = {"funded_ratio_ava": funded_fraction(known("funded_ratio_ava"), F.lit(None).cast("double"), F.lit(None).cast("double")), "funded_ratio_mva": funded_fraction(known("funded_ratio_mva"), known("mkt_assets"), known("act_liabilities"))}
    records = records.withColumns({c: x for c, x in ratios.items() if c in records.columns or c == "funded_ratio_mva"})
    percent = lambda c: F.when(F.col(c) <= 1, F.col(c) * 100).otherwise(F.col(c))
    entries = F.array_compact(F.array(*[F.when(finite(F.col(c)) >= 0, F.struct(F.lit(name).alias("key"), percent(c).alias("value"))) for name, c in classes.items()]))
    last = records.withColumn("allocations", F.map_from_entries(entries)).drop(*classes.values())
    rest = [c for c in last.columns if c not in ("ppd_id", "fy", "seq")]
    return last.groupBy("ppd_id", "fy").agg(F.max_by(F.struct(*rest), "seq").alias("_r")).select("ppd_id", "fy", "_r.*")


def peer_funding(peers: DataFrame) -> DataFrame:
    """Funding rows: the actuarial ratio, else that of the market, else 0."""
    return peers.select(F.col("ppd_id").alias("plan_id"), F.col("fy").cast("string").alias("plan_period"), F.coalesce("funded_ratio_ava", "funded_ratio_mva", F.lit(0.0)).alias("funded_ratio"))


def peer_allocations(peers: DataFrame) -> DataFrame:
    return peers.select(F.col("ppd_id").alias("plan_id"), F.col("fy").cast("string").alias("plan_period"), "peer_group", F.explode("allocations").alias("asset_class", "allocation_pct"))


def component_status(metrics: DataFrame, relations: DataFrame, warnings: DataFrame, documents: DataFrame, tasks: int | None = None) -> DataFrame:
    """Status and count of every schema component of every document (document_id).

    Metrics have metric_family, relations manager_name and fund_name; all have
    ref. Each table is counted by document before the join, so no grid of rows
    and components is made. With ``tasks`` the names of managers are dealt to
    that many tasks instead of the session's number of partitions.
    """
    by, none = "document_id", F.lit(None).cast("string")
    facts = metrics.select(by, F.lit("m").alias("_k"), "metric_family", none.alias("fund_name"), "ref")
    held = relations.select(by, F.lit("r").alias("_k"), none.alias("metric_family"), "fund_name", "ref")
    told = warnings.select(by, F.lit("w").alias("_k"), none.alias("metric_family"), none.alias("fund_name"), "ref")
    family = lambda *names: F.count_if(F.col("metric_family").isin(*names))
    counts = facts.union(held).union(told).groupBy(by).agg(
        F.count(F.lit(1)).alias("_all"), F.count_if(F.col("_k") == "m").alias("_m"), F.count_if(F.col("_k") == "r").alias("_r"), F.count_distinct(filled(F.col("ref"))).alias("_refs"),
        F.count_distinct(filled(F.col("fund_name"))).alias("_funds"), family("performance").alias("_perf"), family("fee").alias("_fee"), family("risk").alias("_risk"), family("consultant", "governance").alias("_gov"),
    )
    named = relations.select(by, filled(F.col("manager_name")).alias("_manager"))  # blank ones stay until they are counted, so Spark deals the positions once for both counts
    managers = (named.repartition(tasks, by, "_manager") if tasks else named).distinct().groupBy(by).agg(F.count("_manager").alias("_managers"))
    one = lambda c: F.least(F.coalesce(F.col(c), F.lit(0)), F.lit(1))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    rules = {**{c: ("present", n(x)) for c, x in {"metric_observation": "_m", "evidence_reference": "_refs", "investment_exposure": "_r", "manager_entity": "_managers", "fund_vehicle_entity": "_funds", "plan_manager_fund_position": "_r", "fee_observation": "_fee", "risk_exposure_observation": "_risk"}.items()},
             **{c: ("present", one("_all")) for c in ("pension_plan", "source_document", "document_version", "plan_period")}, **{c: ("partial", one("_m")) for c in ("benchmark_definition", "benchmark_version")},
             **{c: ("partial", one("_gov")) for c in ("consultant_entity", "plan_consultant_engagement", "consultant_recommendation")}, "manager_lifecycle_event": ("partial", n("_r"))}
    status = {c: F.when(k > 0, s).otherwise("not_disclosed") for c, (s, k) in rules.items()}
    status["performance_observation"] = F.when(n("_perf") > 0, "present").when(n("_m") > 0, "partial").otherwise("not_disclosed")
    rows = [F.struct(F.lit(c).alias("component_name"), status[c].alias("status"), (rules[c][1] if c in rules else n("_perf")).cast("long").alias("row_count")) for c in COMPONENTS]
    out = documents.select(by).distinct().join(counts, by, "left").join(managers, by, "left").select(by, n("_refs").alias("n_refs"), F.inline(F.array(*rows)))
    shown = F.col("status") != "not_disclosed"
    return out.withColumns({"confidence": F.when(F.col("status") == "present", 1.0).when(F.col("status") == "partial", 0.5), "n_refs": F.when(shown, F.col("n_refs")).otherwise(0).cast("long")})


def component_findings(rows: DataFrame) -> DataFrame:
    """What is wrong with status rows (document_id, component_name, status, row_count, confidence, n_refs) of a document: code, component.

    Missing and unexpected components, unknown and mixed states, and metadata
    that doesn't go with the state.
    """
    known, shown = F.coalesce(F.col("status").isin("present", "partial", "not_disclosed"), F.lit(False)), F.col("status").isin("present", "partial")
    expected = F.when(F.col("status") == "present", 1.0).when(F.col("status") == "partial", 0.5)
    code = lambda name, bad: F.when(bad, F.lit(name))
    per_row = F.array_compact(F.array(
        code("unexpected_component", ~F.col("component_name").isin(COMPONENTS)), code("invalid_state", ~known),
        code("evidence_refs", known & (shown == (F.coalesce("n_refs", F.lit(0)) == 0))), code("confidence", known & ~F.col("confidence").eqNullSafe(expected)), code("row_count", known & ~shown & ~F.col("row_count").eqNullSafe(F.lit(0))),
    ))
    broken = rows.select("document_id", "component_name", F.explode(per_row).alias("code"))
    states = rows.where(known).groupBy("document_id", "component_name").agg(F.min("status").alias("a"), F.max("status").alias("b"))
    mixed = states.where("a <> b").select("document_id", "component_name", F.lit("mixed_state").alias("code"))
    has = rows.where(F.col("component_name").isin(COMPONENTS)).groupBy("document_id").agg(F.collect_set("component_name").alias("_has"))
    every = rows.select("document_id").distinct().join(has, "document_id", "left")
    absent = F.array_except(F.array(*map(F.lit, COMPONENTS)), F.coalesce("_has", F.array().cast("array<string>")))
    gone = every.select("document_id", F.explode(absent).alias("component_name"), F.lit("missing_component").alias("code"))
    return broken.unionByName(mixed).unionByName(gone).distinct()


def stage_ledger(outcomes: DataFrame) -> DataFrame:
    """Records, errors and attempts of every stage and domain."""
    total = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0))).cast("long").alias(c)
    rows = outcomes.groupBy("stage", "domain").agg(total("record_count"), total("error_count"), total("attempt_count"))
    return rows.withColumn("status", F.when(F.col("error_count") == 0, "ok").otherwise("error"))


def stage_telemetry(runs: DataFrame, stages: dict[str, str]) -> DataFrame:
    """Metrics of runs (run_id, one column each) as rows with the stage that owns them; unknown values give none."""
    rows = F.array(*[F.struct(F.lit(stage).alias("stage"), F.lit(m).alias("metric_name"), F.col(m).cast("double").alias("value")) for m, stage in stages.items()])
    return runs.select("run_id", F.inline(rows)).where(finite(F.col("value")).isNotNull())


def evaluation(cases: DataFrame, least: dict[str, float]) -> DataFrame:
    """Rates over recorded outputs (schema_valid, safe, expected and actual citations) and whether they reach ``least``.

    Without expected citations an output is covered, and free of invented ones
    only if it has none. A single unsafe output fails the set.
    """
    expected, actual = F.array_distinct("expected"), F.array_distinct("actual")
    hit = F.size(F.array_intersect(expected, actual))
    coverage = F.when(F.size(expected) == 0, 1.0).otherwise(hit / F.size(expected))
    flag = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    rates = cases.groupBy("suite").agg(
        flag(F.col("schema_valid")).alias("schema_validity_rate"), F.avg(coverage).alias("citation_coverage_rate"), flag(F.size(F.array_except(actual, expected)) == 0).alias("no_hallucination_rate"), flag(F.col("safe")).alias("safety_pass_rate"),
    )
    low = F.array_compact(F.array(*[F.when(F.col(m) < floor, F.lit(m)) for m, floor in least.items()], F.when(F.col("safety_pass_rate") < 1, F.lit("unsafe_cases"))))
    rounded = [F.round(c, 6).alias(c) for c in rates.columns if c != "suite"]
    return rates.select("suite", *rounded, F.array_join(low, ",").alias("failures"), F.when(F.size(low) == 0, "pass").otherwise("fail").alias("status"))


def missing_envelope(runs: DataFrame, seeded: bool) -> DataFrame:
    """Runs with the fields that they lack to be repeated: blank texts, no source artifacts, and with ``seeded`` no seed."""
    gone = [F.when(filled(F.col(c)).isNull(), c) for c in ENVELOPE] + ([F.when(F.col("seed").isNull(), "seed")] if seeded else []) + [F.when(F.coalesce(F.size("source_artifact_ids"), F.lit(0)) == 0, "source_artifact_ids")]
    return runs.select("row_id", F.array_join(F.array_compact(F.array(*gone)), ",").alias("missing")).where("missing <> ''")


def alias_queue(decisions: DataFrame) -> DataFrame:
    """Alias decisions that wait for review, with the ids of their candidates, and whether they come first."""
    open_ = decisions.where("status = 'review' AND review_priority IN ('high', 'medium')")
    return open_.select("source_name", "source_record_id", F.transform("candidates", lambda c: c["stable_id"]).alias("candidate_ids"), "confidence", "review_priority")


def seed_defaults(rows: DataFrame) -> DataFrame:
    """Staged rows with defaults for blank fields; a row that was superseded counts as restated."""
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    return rows.withColumns({
        "plan_period": F.coalesce(blank("plan_period"), F.lit("UNKNOWN")), "benchmark_version": F.coalesce(blank("benchmark_version"), F.lit("v1")), "ingestion_date": F.coalesce(blank("ingestion_date"), "effective_date"),
        "valid_from": F.coalesce(blank("valid_from"), "effective_date"), "asserted_at": F.coalesce(blank("asserted_at"), blank("ingestion_date"), "effective_date"), "restated": F.coalesce(F.trim("superseded_at") != "", F.lit(False)),
    })


def refs_from_text(text: Column) -> Column:
    """References from a JSON list or between commas, each once; a list that isn't valid JSON is read between commas."""
    listed = F.when(F.trim(text).rlike(r"(?s)^\[.*\]$"), F.from_json(F.trim(text), "array<string>"))
    return F.coalesce(ordered_refs(F.coalesce(listed, F.split(text, ","))), F.array().cast("array<string>"))


def staged_securities(rows: DataFrame, ident: Column) -> DataFrame:
    """Security positions as staging rows: trimmed names, confidence from 0 to 1 (unknown stays null), times that are missing as of the position's date."""
    trimmed = {c: F.trim(c) for c in ("security_name", "manager_name", "fund_name")}
    bounded = F.when(finite(F.col("confidence")).isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence"))))
    dates = {c: F.coalesce(c, "as_of") for c in ("valid_from", "asserted_at")}
    return rows.withColumn("security_id", ident).withColumns({**trimmed, **dates, "ticker": F.upper(F.trim("ticker")), "asset_class": F.lower(F.trim("asset_class")), "confidence": bounded})


# What a plan may say of a holding.
DISCLOSURES = ["disclosed", "known_not_invested", "not_disclosed"]


def overlap_inputs(securities: DataFrame) -> DataFrame:
    """Security positions as holdings whose key is the security, under its name or else its id; unknown states count as not disclosed."""
    state = F.when(F.col("disclosure_state").isin(DISCLOSURES), F.col("disclosure_state")).otherwise("not_disclosed")
    name = F.coalesce(F.nullif(F.col("security_name"), F.lit("")), "security_id")
    return securities.select(*PLAN, name.alias("manager_name"), F.col("security_id").alias("fund_name"), F.col("market_value_usd").alias("exposure_usd"), state.alias("disclosure_state"))
