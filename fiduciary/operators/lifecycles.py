"""Managers and funds that plans enter, keep and leave, by presence and by what documents say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clamp_confidence, period_year

KEY = ["plan_id", "plan_period", "_m", "_f"]
EVENT = "manager_name", "fund_name", "event_type", "basis", "confidence", "evidence_refs"


def folded(name: Column) -> Column:
    """A name in lower case with single spaces; unknown ones are empty."""
    return F.lower(F.btrim(F.regexp_replace(F.coalesce(name, F.lit("")), r"\s+", " ")))


def merged_refs(*refs: Column) -> Column:
    """References in their order, trimmed, without blank and repeated ones."""
    every = F.flatten(F.array(*[F.coalesce(r, F.array().cast("array<string>")) for r in refs]))
    return F.array_distinct(F.filter(F.transform(every, lambda x: F.btrim(x)), lambda x: F.coalesce(x, F.lit("")) != ""))


def sure(confidence: Column) -> Column:
    return F.round(clamp_confidence(confidence), 6)


def inferred_events(positions: DataFrame) -> DataFrame:
    """Events by presence in a plan's period and the one before it, for all its periods but the first.

    ``positions`` has plan_id, plan_period, manager_name, fund_name,
    is_disclosed, known_not_invested, confidence and evidence_refs. Only
    disclosed positions with a name count; of several with one name the one
    with the greatest confidence does. Who is gone left in the plan's next period.
    """
    rows = positions.select("*", folded(F.col("manager_name")).alias("_m"), folded(F.col("fund_name")).alias("_f"))
    order = F.struct(period_year(F.col("plan_period")).alias("year"), F.upper(F.btrim("plan_period")).alias("text"))
    periods = rows.select("plan_id", "plan_period").distinct().withColumn("_n", F.dense_rank().over(Window.partitionBy("plan_id").orderBy(order)))
    last = F.max("_n").over(Window.partitionBy("plan_id"))
    periods = periods.withColumns({"_last": last, "_next_period": F.lead("plan_period").over(Window.partitionBy("plan_id").orderBy("_n"))})
    told = rows.where(F.col("is_disclosed") & ~F.coalesce("known_not_invested", F.lit(False)) & ((F.col("_m") != "") | (F.col("_f") != "")))
    rest = ["manager_name", "fund_name", "evidence_refs"]
    one = told.groupBy(*KEY).agg(F.max(F.struct("confidence", *rest)).alias("_p")).select(*KEY, "_p.*").join(periods, ["plan_id", "plan_period"])
    w = Window.partitionBy("plan_id", "_m", "_f").orderBy("_n")
    held = F.struct("_n", "confidence", *rest)
    one = one.withColumns({"_before": F.lag(held).over(w), "_after": F.lead("_n").over(w)})
    before = F.col("_before")
    stays = F.coalesce(before["_n"] == F.col("_n") - 1, F.lit(False))
    filled = lambda c: F.when(F.coalesce(c, F.lit("")) != "", c)
    nobody = F.lit("unknown-manager")

    def event(period: Column, manager: Column, fund: Column, kind: str, basis: str, confidence: Column, refs: Column) -> Column:
        return F.struct(period.alias("plan_period"), manager.alias("manager_name"), fund.alias("fund_name"), F.lit(kind).alias("event_type"), F.lit(basis).alias("basis"), sure(confidence).alias("confidence"), refs.alias("evidence_refs"))

    name, fund, mine = F.coalesce(filled(F.col("manager_name")), nobody), F.col("fund_name"), merged_refs(F.col("evidence_refs"))
    here = F.when(stays, event(F.col("plan_period"), F.coalesce(filled(F.col("manager_name")), filled(before["manager_name"]), nobody), F.coalesce(filled(fund), before["fund_name"]), "still_invested", "inferred", F.least("confidence", before["confidence"]), merged_refs(before["evidence_refs"], F.col("evidence_refs"))))
    here = here.when(F.col("_n") > 1, event(F.col("plan_period"), name, fund, "entered", "table_presence_change", F.col("confidence"), mine))
    left = F.when((F.col("_n") < F.col("_last")) & (F.coalesce("_after", F.lit(0)) != F.col("_n") + 1), event(F.col("_next_period"), name, fund, "exited", "table_presence_change", F.col("confidence"), mine))
    events = one.select("plan_id", "_m", "_f", F.explode(F.array_compact(F.array(here, left))).alias("_e"))
    return events.select("plan_id", "_e.plan_period", "_m", "_f", *[F.col(f"_e.{c}").alias(c) for c in EVENT])


def lifecycle_events(positions: DataFrame, signals: DataFrame) -> DataFrame:
    """Inferred events, each replaced by the explicit signal of its plan, period, manager and fund, and the other signals.

    ``signals`` has the columns of an event and seq. Of several signals of one
    key the last by event_type, then seq, counts.
    """
    said = signals.select(
        "plan_id", "plan_period", folded(F.col("manager_name")).alias("_m"), folded(F.col("fund_name")).alias("_f"), F.btrim("manager_name").alias("manager_name"), F.when(F.coalesce("fund_name", F.lit("")) != "", F.btrim("fund_name")).alias("fund_name"),
        "event_type", F.lit("explicit_text").alias("basis"), sure(F.col("confidence")).alias("confidence"), merged_refs(F.col("evidence_refs")).alias("evidence_refs"), F.struct("event_type", "seq").alias("_order"),
    )
    last = said.groupBy(*KEY).agg(F.max_by(F.struct(*EVENT), "_order").alias("_e"), F.lit(1).alias("_rank"))
    rows = inferred_events(positions).select(*KEY, F.struct(*EVENT).alias("_e"), F.lit(0).alias("_rank")).unionByName(last)
    return rows.groupBy(*KEY).agg(F.max_by("_e", "_rank").alias("_e")).select("plan_id", "plan_period", *[F.col(f"_e.{c}").alias(c) for c in EVENT])


def undisclosed(positions: DataFrame) -> DataFrame:
    """Positions whose presence says nothing since nothing is disclosed: warnings."""
    gone = positions.where((F.col("completeness") == "not_disclosed") & ~F.coalesce("known_not_invested", F.lit(False)))
    return gone.select(F.lit("non_disclosure").alias("code"), "plan_id", "plan_period", "manager_name", "fund_name", merged_refs(F.col("evidence_refs")).alias("evidence_refs"))
