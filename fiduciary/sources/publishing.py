"""The set of tables that a coverage run publishes: readiness of sources, anomalies and what of them goes to review."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import written
from ..operators import quality, readiness
from .scans import write_artifacts


def readiness_rows(records: DataFrame) -> DataFrame:
    """Whether the source of every record (plan_id, plan_period, cohort, system_type, ...) can be extracted, and why not."""
    state, why = F.col("official_resolution_state"), F.col("mismatch_reason")
    ready = readiness.readiness(why, state)
    return records.select(
        "plan_id", "plan_period", "cohort", "system_type", state, "source_authority_tier", F.coalesce(why, F.lit("")).alias("mismatch_reason"), readiness.blocker(why, state).alias("extraction_blocker_reason"),
        (ready == "ready").alias("is_extraction_ready"), ready.alias("readiness_state"),
    )


def publish(path: str, records: DataFrame, anomalies: Callable[[], DataFrame]) -> DataFrame:
    """Write the set under ``path`` and return its state: artifact, status and error.

    Anomalies don't block: where they can't be found or written the rest is
    published, their tables are empty, and the state says degraded and why.
    """
    spark, records = records.sparkSession, written(records)  # goes into four files
    write_artifacts({"readiness_rows": readiness_rows(records), "readiness_summary": readiness.readiness_summary(records)}, path)
    try:
        found = written(anomalies())  # goes into four files
        write_artifacts({"anomaly_rows": found, "review_queue_rows": quality.review_queue(found)}, path)
        state = ("ok", "")
    except Exception as error:  # any fault of theirs degrades the set
        none = spark.createDataFrame([], "plan_id string, period string")
        write_artifacts({"anomaly_rows": none, "review_queue_rows": none}, path)
        state = ("degraded", f"{type(error).__name__}: {str(error).splitlines()[0] if str(error) else ''}")
    status = spark.createDataFrame([("anomaly_routing", *state)], "artifact string, status string, error string")
    write_artifacts({"status": status.coalesce(1)}, path)
    return status
