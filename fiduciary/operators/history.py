"""Bitemporal facts, artifact versions and entity histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import stable_id
from .lineage import cut


def as_of(facts: DataFrame, valid: str, known: str) -> DataFrame:
    """Facts that hold at ``valid`` as they were known at ``known``; open ends are null, intervals half-open."""
    v, k = F.lit(valid).cast("timestamp"), F.lit(known).cast("timestamp")
    return facts.where((F.col("valid_from") <= v) & (F.col("valid_to").isNull() | (v < F.col("valid_to"))) & (F.col("asserted_at") <= k) & (F.col("superseded_at").isNull() | (k < F.col("superseded_at"))))


def latest_known(facts: DataFrame, known: str, key: list[str]) -> DataFrame:
    """The last assertion of every key made by ``known``; of equal times the first one read."""
    rows = facts.where(F.col("asserted_at") <= F.lit(known).cast("timestamp"))
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("asserted_at"), "input_seq"))).where("_n = 1").drop("_n")


def active_overlaps(facts: DataFrame, key: list[str]) -> DataFrame:
    """Active facts whose valid time begins before that of an earlier one of the same key has ended."""
    w = Window.partitionBy(*key).orderBy("valid_from", "input_seq")
    ends = F.max(F.coalesce("valid_to", F.lit("9999-12-31").cast("timestamp"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return facts.where("superseded_at IS NULL").withColumn("overlaps_until", ends).where(F.col("valid_from") < F.col("overlaps_until"))


def supersede(facts: DataFrame, replacements: DataFrame, key: list[str], at: str) -> DataFrame:
    """Close active facts whose key is replaced and append the replacements as restated."""
    keys = replacements.select(*key).distinct().withColumn("_hit", F.lit(True))
    closed = facts.join(keys, key, "left").withColumn("superseded_at", F.when(F.col("superseded_at").isNull() & F.col("_hit"), F.lit(at).cast("timestamp")).otherwise(F.col("superseded_at"))).drop("_hit")
    return closed.withColumn("restated", F.lit(False)).unionByName(replacements.withColumn("restated", F.lit(True)))


def artifact_versions(artifacts: DataFrame, key: list[str]) -> DataFrame:
    """Fetches of an artifact as new, unchanged or superseding, with the id of its version chain's members.

    Rows need fetched_at, artifact_seq (order of equal times) and content.
    """
    w = Window.partitionBy(*key).orderBy("fetched_at", "artifact_seq")
    rows = artifacts.withColumn("checksum", F.sha2(F.col("content"), 256)).withColumn("_before", F.lag("checksum").over(w))
    status = F.when(F.col("_before").isNull(), "new").when(F.col("_before") == F.col("checksum"), "unchanged").otherwise("superseding")
    rows = rows.withColumn("status", status).withColumn("version", F.sum((F.col("status") != "unchanged").cast("int")).over(w))
    return rows.withColumn("artifact_id", stable_id("artifact", *[F.col(k) for k in key], F.col("version"), F.col("checksum"))).drop("_before", "content")


def canonical_ids(edges: DataFrame) -> DataFrame:
    """Follow successors (source, target) to their end by pointer jumping.

    Every round doubles the length of the paths that are known, until all have
    ended or are longer than there are links: those are cycles or lead to one,
    and have no canonical id. Sources with several successors are ambiguous, and
    so is what leads to them. Rounds are checkpointed, so the plan doesn't grow.
    """
    out = edges.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("target").alias("target"))
    forks = out.where("n > 1").select(F.col("source").alias("node"))
    at = cut(out.where("n = 1").select("source", "target", F.lit(True).alias("_open")))
    for _ in range(at.count().bit_length() + 1):  # the last one sees that the longest path has ended
        ahead = at.select(F.col("source").alias("target"), F.col("target").alias("_next"), F.col("_open").alias("_more"))
        jumped = at.where("_open").join(ahead, "target", "left").select("source", F.coalesce("_next", "target").alias("target"), F.coalesce("_more", F.lit(False)).alias("_open"))
        at = cut(at.where("NOT _open").unionByName(jumped))
        if at.where("_open").isEmpty():
            break
    fork = forks.withColumn("_fork", F.lit(True))
    ends = at.join(fork, at["target"] == fork["node"], "left").select("source", F.when(F.col("_fork") | F.col("_open"), None).otherwise(F.col("target")).alias("canonical_id"), F.when(F.col("_open"), "cycle").when(F.col("_fork"), "ambiguous").otherwise("resolved").alias("status"))
    return ends.unionByName(forks.select(F.col("node").alias("source"), F.lit(None).cast(dict(edges.dtypes)["target"]).alias("canonical_id"), F.lit("ambiguous").alias("status")))


def publication_events(observations: DataFrame) -> DataFrame:
    """Publications by explicit time, else by a fingerprint that differs from the one seen before; a null one resets it."""
    w = Window.partitionBy("system_id", "source_id").orderBy("observed_at", "input_seq")
    before = F.lag("fingerprint").over(w)
    changed = F.col("fingerprint").isNotNull() & (before.isNull() | (before != F.col("fingerprint")))
    at = F.when(F.col("published_at").isNotNull(), F.col("published_at")).when(changed, F.col("observed_at"))
    return observations.select("system_id", "source_id", at.alias("published_at")).where("published_at IS NOT NULL").distinct()


def cadence_profiles(events: DataFrame, sparse: int = 3) -> DataFrame:
    """Median gap in days, months seen, and how regular the gaps are, for every system and source."""
    w = Window.partitionBy("system_id", "source_id").orderBy("published_at")
    micros = F.unix_micros(F.col("published_at").cast("timestamp"))
    seconds = (micros - F.lag(micros).over(w)) / 1e6
    rows = events.withColumn("gap", seconds / 86400)
    g = rows.groupBy("system_id", "source_id").agg(F.median("gap").alias("m"), F.avg("gap").alias("mean"), F.stddev_pop("gap").alias("sd"), F.array_sort(F.collect_set(F.month("published_at"))).alias("months"), F.count(F.lit(1)).alias("n"))
    stability = F.greatest(F.lit(0.0), 1 - F.least(F.col("sd") / F.col("mean"), F.lit(1.0)))
    regular = F.round(F.least(0.35 + 0.45 * stability + 0.2 * F.least(F.col("n") / 8, F.lit(1.0)), F.lit(0.99)), 3)
    confidence = F.when(F.col("m").isNull(), 0.25).when(F.col("n") < 3, F.round(0.2 + 0.2 * (F.col("n") / 3), 3)).when(F.col("mean") <= 0, 0.0).otherwise(regular)
    return g.select("system_id", "source_id", F.round(F.coalesce("m", F.lit(365.0)), 3).alias("frequency_days"), F.concat_ws(",", F.col("months").cast("array<string>")).alias("months"), confidence.alias("confidence"), F.col("n").alias("sample_size"), (F.col("n") < sparse).alias("is_sparse"))
