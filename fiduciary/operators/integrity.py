"""Checks that facts, registries and reviews pass before they are stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def curated(facts: DataFrame, plans: DataFrame, key: list[str]) -> DataFrame:
    """Facts with the reason for which they are rejected, null if they are good.

    Reasons in order: unknown_plan, missing_value, missing_unit,
    missing_names (a complete holding without manager or fund), duplicate_key.
    A null in the key counts as a value of its own.
    """
    known = plans.select("plan_id").distinct().withColumn("_known", F.lit(True))
    blank = lambda c: F.coalesce(F.btrim(c), F.lit("")) == ""
    again = F.count(F.lit(1)).over(Window.partitionBy(*key)) > 1
    reason = (
        F.when(F.col("_known").isNull(), "unknown_plan").when(F.col("normalized_value").isNull(), "missing_value").when(blank("normalized_unit"), "missing_unit")
        .when((F.col("completeness") == "complete") & (blank("manager_name") | blank("fund_name")), "missing_names").when(again, "duplicate_key")
    )
    return facts.join(known, "plan_id", "left").withColumn("reject_reason", reason).drop("_known")


def unpublished(facts: DataFrame, published: DataFrame, key: str = "fact_id") -> DataFrame:
    """Facts that were not published before, so that a second run publishes nothing."""
    return facts.join(published.select(key), key, "left_anti")


def upsert(store: DataFrame, batch: DataFrame, values: list[str]) -> DataFrame:
    """What becomes of every row of a batch (one a fact_id) against the active row of its fact.

    ``insert``: unknown fact; ``skip``: the same assertion; ``conflict``: same
    time and source, other values; ``supersede``: a new assertion, whose id is
    ``fact_id@asserted_at:digest`` and whose time closes the old one. A stored
    id counts up to its first "@".
    """
    said = ["asserted_at", "source_document_id", *values]
    base = F.substring_index("fact_id", "@", 1)
    active = store.where("superseded_at IS NULL").select(base.alias("fact_id"), F.col("fact_id").alias("stored_id"), F.struct(*said).alias("_old"))
    rows = batch.select("fact_id", *said).withColumn("_new", F.struct(*said)).join(active, "fact_id", "left")
    where_from = F.col("_old.asserted_at").eqNullSafe(F.col("asserted_at")) & F.col("_old.source_document_id").eqNullSafe(F.col("source_document_id"))
    decision = F.when(F.col("stored_id").isNull(), "insert").when(F.col("_old").eqNullSafe(F.col("_new")), "skip").when(where_from, "conflict").otherwise("supersede")
    digest = F.substring(F.sha1(F.to_json("_new", {"ignoreNullFields": "false"})), 1, 12)
    rows = rows.withColumn("decision", decision)
    new_id = F.when(F.col("decision") == "supersede", F.concat("fact_id", F.lit("@"), F.col("asserted_at").cast("string"), F.lit(":"), digest)).when(F.col("decision") == "insert", F.col("fact_id"))
    return rows.select("fact_id", "stored_id", *said, "decision", new_id.alias("new_id"), F.when(F.col("decision") == "supersede", F.col("asserted_at")).alias("closes_at"))


def registry_merge(base: DataFrame, updates: DataFrame, payload: list[str]) -> DataFrame:
    """Updates (one a stable_id) as unchanged, conflict, identity_taken or appended.

    An identity key belongs to the base row that has it, else to the
    update with the smallest stable_id.
    """
    old = base.select("stable_id", F.struct("identity_key", *payload).alias("_old"))
    rows = updates.select("stable_id", "identity_key", F.struct("identity_key", *payload).alias("_new")).join(old, "stable_id", "left")
    owners = base.groupBy("identity_key").agg(F.min("stable_id").alias("_owner"))
    fresh = F.when(F.col("_old").isNull(), F.col("stable_id"))
    first = F.min(fresh).over(Window.partitionBy("identity_key"))
    rows = rows.withColumn("_first", first).join(owners, "identity_key", "left")
    status = F.when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").when(F.col("_old").isNotNull(), "conflict").when(F.col("_owner").isNotNull() | (F.col("_first") < F.col("stable_id")), "identity_taken").otherwise("appended")
    return rows.select("stable_id", "identity_key", status.alias("status"))


def seed_findings(seeds: DataFrame) -> DataFrame:
    """Seed addresses that a plan names twice, or that another plan named before (by seq, the first owner keeps it).

    The owner comes from a partial aggregate, so one address that very many seeds
    share is no window of its own.
    """
    owners = seeds.groupBy("url").agg(F.min_by("plan_id", "seq").alias("_owner"))
    firsts = seeds.groupBy("plan_id", "url").agg(F.min("seq").alias("_first"))
    rows = seeds.join(owners, "url").join(firsts, ["plan_id", "url"])
    codes = F.array_compact(F.array(F.when(F.col("seq") > F.col("_first"), "duplicate_seed_url"), F.when(F.col("_owner") != F.col("plan_id"), "conflicting_seed_url")))
    return rows.select("plan_id", "url", "seq", F.explode(codes).alias("code"))


# States of a review, and those that may follow.
TRANSITIONS = {"new": ["in_review", "resolved", "deferred"], "in_review": ["resolved", "deferred"], "deferred": ["in_review", "resolved"], "resolved": []}
ACTIONS = ["approve_alias", "merge", "split", "reject"]


def transitions(queue: DataFrame, requests: DataFrame) -> DataFrame:
    """Audit rows of requested state changes (one a queue_id), with the reason where one is refused.

    Requests may carry an action and resolved_ids; only a resolution may
    have them, and what it needs depends on the action.
    """
    allowed = F.create_map(*[x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))])
    rows = requests.join(queue.select("queue_id", F.col("state").alias("previous_state")), "queue_id", "left")
    ids, action = F.coalesce(F.size("resolved_ids"), F.lit(0)), F.col("action")
    refused = (
        F.when(F.col("previous_state").isNull(), "unknown_row").when(~F.array_contains(F.try_element_at(allowed, F.col("previous_state")), F.col("next_state")), "illegal_transition")
        .when((F.col("next_state") != "resolved") & (action.isNotNull() | (ids > 0)), "unexpected_action")
        .when((F.col("next_state") == "resolved") & ~F.coalesce(action.isin(ACTIONS), F.lit(False)), "missing_action")
        .when((F.col("next_state") == "resolved") & ((action.isin("approve_alias", "merge") & (ids < 1)) | ((action == "split") & (ids < 2)) | ((action == "reject") & (ids > 0))), "wrong_number_of_ids")
    )
    return rows.select("queue_id", "previous_state", "next_state", "action", refused.alias("refused"))


def best_of(rows: DataFrame, key: list[str], rank, order: str) -> DataFrame:
    """One row a key: the greatest rank (null is least), of equals the first by ``order``. A partial aggregate, no window."""
    rest = [c for c in rows.columns if c not in key]
    best = F.max_by(F.struct(*rest), F.struct(rank.isNotNull(), rank, -F.col(order)))
    return rows.groupBy(*key).agg(best.alias("_best")).select(*key, "_best.*")


PRIORITIES = ["low", "medium", "high"]


def review_rows(rows: DataFrame) -> DataFrame:
    """The entry of highest priority for every row under review."""
    return best_of(rows, ["row_id"], F.array_position(F.array(*map(F.lit, PRIORITIES)), F.col("priority")), "seq")


# Accuracy of extraction against reviewed values.


def compared(golden: DataFrame, actual: DataFrame) -> DataFrame:
    """Fields (document_id, field, value) as exact, incorrect, missing, extra, or unscorable (golden value null)."""
    g = golden.select("document_id", "field", F.col("value").alias("expected"), F.lit(True).alias("_g"))
    a = actual.select("document_id", "field", F.col("value").alias("actual"), F.lit(True).alias("_a"))
    kind = F.when(F.col("_g").isNull(), "extra").when(F.col("expected").isNull(), "unscorable").when(F.col("_a").isNull(), "missing").when(F.col("actual").eqNullSafe(F.col("expected")), "exact").otherwise("incorrect")
    return g.join(a, ["document_id", "field"], "full_outer").select("document_id", "field", "expected", "actual", kind.alias("kind"))


def accuracy(fields: DataFrame) -> DataFrame:
    """Counts, precision, recall and the share of documents without a fault; 1 where nothing counts."""
    kinds = ["exact", "incorrect", "missing", "extra", "unscorable"]
    per_doc = fields.groupBy("document_id").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds])
    totals = per_doc.agg(*[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in kinds], F.count(F.lit(1)).alias("n_documents"), F.count_if(F.col("incorrect") + F.col("missing") + F.col("extra") == 0).alias("passed"))
    share = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(1.0)), 6)
    e = F.col("exact")
    return totals.select(*kinds, "n_documents", "passed", share(e, e + F.col("incorrect") + F.col("extra")).alias("field_precision"), share(e, e + F.col("incorrect") + F.col("missing")).alias("field_recall"), share(F.col("passed"), F.col("n_documents")).alias("document_pass_rate"))


def worst_fields(fields: DataFrame, n: int = 20) -> DataFrame:
    """The first ``n`` faults by document and field: a top-k, no global sort."""
    return fields.where(F.col("kind").isin("incorrect", "missing", "extra")).orderBy("document_id", "field").limit(n)


def promoted(golden: DataFrame, corrections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Golden values with resolved corrections in place, and the corrections that are refused with their reason.

    Corrections: correction_id, document_id, field, value, state, seq. Of
    those that repeat an id the first counts; of several for one field the last.
    """
    fields = golden.select("document_id", "field").withColumn("_known", F.lit(True))
    first = F.row_number().over(Window.partitionBy("correction_id").orderBy("seq"))
    reason = F.when(F.coalesce(F.btrim("correction_id"), F.lit("")) == "", "missing_id").when(F.col("state").isNull() | (F.col("state") != "resolved"), "not_resolved").when(F.col("_n") > 1, "already_promoted").when(F.col("_known").isNull(), "unknown_field")
    rows = corrections.withColumn("_n", first).join(fields, ["document_id", "field"], "left").withColumn("reason", reason)
    good = rows.where("reason IS NULL").groupBy("document_id", "field").agg(F.max_by(F.struct("value", "correction_id"), "seq").alias("_new"))
    out = golden.join(good, ["document_id", "field"], "left")
    return out.select("document_id", "field", F.when(F.col("_new").isNotNull(), F.col("_new.value")).otherwise(F.col("value")).alias("value"), F.col("_new.correction_id").alias("correction_id")), rows.where("reason IS NOT NULL").select("correction_id", "document_id", "field", "reason")


def primary_values(first: DataFrame, second: DataFrame, key: list[str], tolerance: float) -> DataFrame:
    """Values of two extractors: the first one's, else the second's, and whether they differ by more than ``tolerance``."""
    a = first.select(*key, F.struct("value", "confidence").alias("_a"))
    b = second.select(*key, F.struct("value", "confidence").alias("_b"))
    apart = F.coalesce(F.abs(F.col("_a.value") - F.col("_b.value")) > tolerance, F.lit(False))
    rows = a.join(b, key, "full_outer").withColumn("disagrees", apart)
    one = F.coalesce("_a", "_b")
    return rows.select(*key, one["value"].alias("value"), F.when(F.col("disagrees"), F.least("_a.confidence", "_b.confidence")).otherwise(one["confidence"]).alias("confidence"), "disagrees", F.when(F.col("disagrees"), "high").alias("review_priority"))
