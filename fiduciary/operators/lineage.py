"""Histories of entities, and the names and positions that lead to them."""

from __future__ import annotations


from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import entity_token
from ..functions.shared import cut


def event_faults(events: DataFrame) -> DataFrame:
    """Lineage events (event_id, event_type, sources, targets) that break a rule, with the first one they break."""
    s, t = F.size("sources"), F.size("targets")
    shape = F.when(F.col("event_type").isin("rename", "successor"), (s == 1) & (t == 1)).when(F.col("event_type") == "merge", (s >= 2) & (t == 1)).when(F.col("event_type") == "split", (s == 1) & (t >= 2))
    n = F.count(F.lit(1)).over(Window.partitionBy("event_id"))
    fault = (
        F.when(F.coalesce(F.btrim("event_id"), F.lit("")) == "", "missing_id").when(F.arrays_overlap("sources", "targets"), "overlap").when(shape.isNull(), "unknown_type").when(~shape, "wrong_shape").when(n > 1, "duplicate_id")
    )
    return events.withColumn("fault", fault).where("fault IS NOT NULL").select("event_id", "event_type", "fault")


def edges(events: DataFrame) -> DataFrame:
    return events.select(F.explode("sources").alias("source"), "targets").select("source", F.explode("targets").alias("target")).distinct()


def reachable(links: DataFrame) -> DataFrame:
    """Everything that a root leads to, with the least number of steps; a root that leads to itself lies on a cycle.

    Breadth first: every round joins the newest pairs with the links and
    keeps those not seen, so it ends on cycles too and takes as many rounds as
    the longest path. Rounds are checkpointed, so the plan doesn't grow.
    """
    links = cut(links.select("source", "target").distinct())
    newest = links.select(F.col("source").alias("root"), F.col("target").alias("node"))
    out, depth = newest.withColumn("depth", F.lit(1)), 1
    while True:
        depth += 1
        step = newest.join(links, newest["node"] == links["source"]).select("root", F.col("target").alias("node")).distinct()
        newest = cut(step.join(out.select("root", "node"), ["root", "node"], "left_anti"))
        if newest.isEmpty():
            return out
        out = out.unionByName(newest.withColumn("depth", F.lit(depth)))


def terminals(reached: DataFrame, links: DataFrame) -> DataFrame:
    """What a root leads to that has no successor of its own."""
    return reached.join(links.select(F.col("source").alias("node")).distinct(), "node", "left_anti").select("root", "node", "depth")


def unique_aliases(aliases: DataFrame) -> DataFrame:
    """Normalised names (alias, entity_id) that lead to one entity only."""
    rows = aliases.select(entity_token(F.col("alias")).alias("norm"), "entity_id").where("norm <> ''")
    return rows.groupBy("norm").agg(F.min("entity_id").alias("entity_id"), F.max("entity_id").alias("_last")).where("entity_id = _last").drop("_last")


def sponsor_matches(schedules: DataFrame, entities: DataFrame) -> DataFrame:
    """Schedules by employer and plan number: matched if one entity has the key, else left for review."""
    key = ["ein", "plan_number"]
    ids = entities.groupBy(*key).agg(F.min("entity_id").alias("_a"), F.max("entity_id").alias("_b"))
    one = F.col("_a") == F.col("_b")
    reason = F.when(one, "exact EIN-plan key").when(F.col("_a").isNotNull(), "ambiguous sponsor-plan key").otherwise("no sponsor-plan key match")
    return schedules.join(ids, key, "left").select("schedule_id", *key, F.when(one, F.col("_a")).alias("entity_id"), F.when(one, "matched").otherwise("review").alias("status"), reason.alias("reason"))


def exposures(positions: DataFrame, states: DataFrame) -> DataFrame:
    """A manager's and a fund's row for every position, with its weight in the plan's period and its lifecycle state."""
    total = positions.groupBy("plan_id", "plan_period").agg(F.sum(F.col("exposure_usd").cast("decimal(28,4)")).cast("double").alias("_total"))
    rows = positions.withColumns({"_m": entity_token(F.col("manager_name")), "_f": entity_token(F.col("fund_name"))}).join(total, ["plan_id", "plan_period"])
    rows = rows.join(states.select("plan_id", "plan_period", F.col("manager").alias("_m"), F.col("fund").alias("_f"), F.col("state").alias("lifecycle_state")), ["plan_id", "plan_period", "_m", "_f"], "left")
    manager = F.struct(F.concat(F.lit("manager:"), F.col("_m")).alias("entity_id"), F.lit("manager").alias("entity_type"), F.col("manager_name").alias("entity_name"))
    fund = F.struct(F.concat(F.lit("fund:"), F.col("_m"), F.lit(":"), F.col("_f")).alias("entity_id"), F.lit("fund").alias("entity_type"), F.col("fund_name").alias("entity_name"))
    named = F.filter(F.array(manager, fund), lambda x: F.btrim(x["entity_name"]) != "")
    return rows.select(F.inline(named), "plan_id", "plan_period", "exposure_usd", F.when(F.col("_total") > 0, F.round(F.col("exposure_usd") / F.col("_total"), 9)).alias("exposure_weight"), "lifecycle_state")


def lookup(queries: DataFrame, exposure: DataFrame, aliases: DataFrame) -> DataFrame:
    """Exposures that a name (an id, or an alias that is unique) leads to; names that lead nowhere keep a row."""
    names = queries.select("name", entity_token(F.col("name")).alias("norm"))
    ids = exposure.select(F.col("entity_id").alias("_id")).distinct()
    found = names.join(ids, F.lower(F.btrim("name")) == F.col("_id"), "left").join(aliases.withColumnRenamed("entity_id", "_alias"), "norm", "left")
    return found.select("name", F.coalesce("_id", "_alias").alias("entity_id")).join(exposure, "entity_id", "left")
