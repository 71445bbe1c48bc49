"""Queries of snapshots, written as files from the tables and scanned back, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import shared_folder
from ..sources import snapshots
from . import domain as D
from .oracle import sql

Query = Callable[[SparkSession, str], DataFrame]


def allocation_fields(s: SparkSession, d: str) -> DataFrame:
    """A snapshot a period: every plan's allocation to a class as a field, sure by how far the plan is funded."""
    rows = D.plan_allocation(s, d).join(D.plan_funding(s, d).select("plan_id", "plan_period", "funded_ratio"), ["plan_id", "plan_period"])
    pct = F.round("allocation_pct", 2)
    evidence = F.when(pct > 0.16, F.concat(F.lit('p. "'), F.round(10 * F.col("funded_ratio"), 0).cast("int"), F.lit('"')))
    return rows.where(pct > 0.13).select(F.col("plan_period").alias("snapshot"), F.col("plan_id").alias("document_id"), F.col("asset_class").alias("field"), pct.cast("string").alias("value"), F.round("funded_ratio", 1).alias("confidence"), evidence.alias("evidence"))


def scanned(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Snapshots as files, twice for one region's plans, which makes their second documents duplicates, and one file that is older."""
    path = f"{shared_folder(s)}/snapshots-{s.range(1).select(F.expr('uuid()')).first()[0]}"
    fields = allocation_fields(s, d)
    snapshots.write_snapshots(fields, path, "parser", "2024-01-01T00:00:00Z", 4)
    asia = D.plan_dim(s, d).where("peer_group = 'ASIA'").select(F.col("plan_id").alias("document_id"))
    snapshots.write_snapshots(fields.join(asia, "document_id", "left_semi"), path, "parser", "2024-01-01T00:00:00Z", 1)
    snapshots.write_snapshots(fields.where("snapshot = 'FY1996'"), path, "parser", "2024-01-01T00:00:00Z", 1, snapshots.Header(baseline_version="v0"))
    return snapshots.snapshot_scan(s, path)


def changes(s: SparkSession, d: str) -> DataFrame:
    """Every period against the one before; changes in one class are expected in one region's plans."""
    fields, _ = scanned(s, d)
    year = F.substring("snapshot", 3, 4).cast("int")
    steps = fields.select("snapshot", year.alias("y")).distinct()
    steps = steps.select(F.col("snapshot").alias("baseline"), (F.col("y") + 1).alias("y")).join(steps.select(F.col("snapshot").alias("current"), "y"), "y")
    expected = D.plan_dim(s, d).where("peer_group = 'EUROPE'").select(F.col("plan_id").alias("document_id"), F.lit("PROMO").alias("field"))
    return snapshots.snapshot_changes(fields, steps, expected)


QUERIES: dict[str, Query] = {
    "s11_snapshot_fields": lambda s, d: scanned(s, d)[0],
    "s11_snapshot_rejects": lambda s, d: scanned(s, d)[1].groupBy("snapshot", "document_id", "reason").agg(F.count(F.lit(1)).alias("n")),
    "j14_snapshot_changes": changes,
}

FIELDS = """fields AS (SELECT plan_period AS snapshot, plan_id AS document_id, asset_class AS field, round(allocation_pct, 2) AS pct, CAST(round(allocation_pct, 2) AS VARCHAR) AS value, round(funded_ratio, 1) AS confidence,
  CASE WHEN round(allocation_pct, 2) > 0.16 THEN 'p. "' || CAST(CAST(round(10 * funded_ratio) AS INTEGER) AS VARCHAR) || '"' END AS evidence FROM plan_allocation JOIN plan_funding USING (plan_id, plan_period) WHERE round(allocation_pct, 2) > 0.13)"""

ORACLES: dict[str, str] = {
    "s11_snapshot_fields": sql(f"SELECT * FROM (WITH {FIELDS} SELECT snapshot, document_id, field, value, confidence, evidence FROM fields)"),
    "s11_snapshot_rejects": sql(f"""SELECT * FROM (WITH {FIELDS} SELECT DISTINCT snapshot, document_id, 'duplicate_document_id' AS reason, CAST(1 AS BIGINT) AS n FROM fields JOIN plan_dim ON plan_id = document_id WHERE peer_group = 'ASIA'
      UNION ALL SELECT DISTINCT snapshot, NULL, 'baseline_version', CAST(1 AS BIGINT) FROM fields WHERE snapshot = 'FY1996')"""),
    "j14_snapshot_changes": sql(f"""SELECT * FROM (WITH {FIELDS},
      steps AS (SELECT DISTINCT a.snapshot AS baseline, b.snapshot AS current FROM fields a JOIN fields b ON CAST(substr(b.snapshot, 3) AS INTEGER) = CAST(substr(a.snapshot, 3) AS INTEGER) + 1),
      keys AS (SELECT baseline, current, document_id, field FROM steps JOIN fields ON snapshot = baseline UNION SELECT baseline, current, document_id, field FROM steps JOIN fields ON snapshot = current),
      pairs AS (SELECT k.*, a.value AS av, a.confidence AS ac, a.evidence AS ae, b.value AS bv, b.confidence AS bc, b.evidence AS be, a.snapshot IS NOT NULL AS ha, b.snapshot IS NOT NULL AS hb
        FROM keys k LEFT JOIN fields a ON a.snapshot = k.baseline AND a.document_id = k.document_id AND a.field = k.field LEFT JOIN fields b ON b.snapshot = k.current AND b.document_id = k.document_id AND b.field = k.field),
      told AS (SELECT *, 'field_presence' AS attribute, CASE WHEN ha THEN 'true' ELSE 'false' END AS x, CASE WHEN hb THEN 'true' ELSE 'false' END AS y FROM pairs WHERE NOT (ha AND hb)
        UNION ALL SELECT *, 'value', av, bv FROM pairs WHERE ha AND hb AND av IS DISTINCT FROM bv UNION ALL SELECT *, 'confidence', CAST(ac AS VARCHAR), CAST(bc AS VARCHAR) FROM pairs WHERE ha AND hb AND ac IS DISTINCT FROM bc
        UNION ALL SELECT *, 'evidence', ae, be FROM pairs WHERE ha AND hb AND ae IS DISTINCT FROM be)
      SELECT baseline AS baseline_snapshot, current AS current_snapshot, document_id, field, attribute, x AS baseline, y AS current,
        CASE WHEN field = 'PROMO' AND document_id IN (SELECT plan_id FROM plan_dim WHERE peer_group = 'EUROPE') THEN 'expected_change' ELSE 'unexpected_drift' END AS classification FROM told)"""),
}
