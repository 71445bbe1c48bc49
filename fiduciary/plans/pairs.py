"""Queries of overlaps of all plans, of cycles and of lifecycles, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.shared import written
from ..operators import cycles, lifecycles, overlaps
from . import domain as D
from . import registry
from .oracle import sql

Query = Callable[[SparkSession, str], DataFrame]


def user_links(s: SparkSession, d: str) -> DataFrame:
    """A user's large purchase leads to the user who makes the next one of its month's day."""
    e = D.table(s, d, "events").where("event_type = 'purchase'")
    w = Window.partitionBy(F.to_date("ts"), F.floor(F.col("value") / 40)).orderBy("ts", "event_id")
    return e.select(F.col("user_id").alias("source"), F.lead("user_id").over(w).alias("target")).where("target IS NOT NULL AND source < 2 * target")


def lifecycle_positions(s: SparkSession, d: str) -> DataFrame:
    p, usd = D.manager_fund_positions(s, d), F.col("exposure_usd")
    state = F.col("disclosure_state")
    return p.select(
        "plan_id", "plan_period", "manager_name", F.when(F.col("fund_name") != "Brand#7", F.col("fund_name")).alias("fund_name"), (state == "disclosed").alias("is_disclosed"), (state == "known_not_invested").alias("known_not_invested"),
        F.when(state == "not_disclosed", "not_disclosed").otherwise("complete").alias("completeness"), F.when(usd.isNull(), 1.2).otherwise(F.round(usd / 50000, 4)).alias("confidence"), F.array(F.concat(F.lit(" p."), F.substring("plan_period", 3, 4)), F.lit(""), F.col("fund_name")).alias("evidence_refs"),
    )


def signals(s: SparkSession, d: str) -> DataFrame:
    """Lines that were returned late in an order say what became of their supplier's brand."""
    lines = D.position_lines(s, d).where("l_returnflag = 'R' AND l_linenumber >= 6")
    kind = F.when(F.col("net") < 20000, "exited").when(F.col("net") < 60000, "entered").otherwise("still_invested")
    return lines.select("plan_id", "plan_period", F.concat(F.lit(" "), F.upper("s_name"), F.lit(" ")).alias("manager_name"), F.when(F.col("p_brand") != "Brand#7", F.col("p_brand")).alias("fund_name"), kind.alias("event_type"), (F.col("net").cast("double") / 40000).alias("confidence"), F.array(F.lit("s.1"), F.lit("s.1 ")).alias("evidence_refs"), F.struct("net", "l_orderkey").alias("seq"))


def lifecycle_rows(s: SparkSession, d: str) -> DataFrame:
    events = lifecycles.lifecycle_events(written(lifecycle_positions(s, d)), signals(s, d))  # periods and events are made of them
    return events.withColumn("evidence_refs", F.array_join("evidence_refs", "|"))


QUERIES: dict[str, Query] = {
    "w11_lifecycle_events": lifecycle_rows,
    "j4_disclosure_overlaps": lambda s, d: overlaps.disclosure_overlaps(D.manager_fund_positions(s, d)),
    "j6_all_overlaps": lambda s, d: overlaps.security_overlaps(registry.weights(s, d)),
    "b13_cycle_components": lambda s, d: cycles.cycle_components(user_links(s, d)),
}

ORACLES: dict[str, str] = {
    "w11_lifecycle_events": sql(r"""SELECT * FROM (WITH pos AS (SELECT plan_id, plan_period, manager_name, nullif(fund_name, 'Brand#7') AS fund_name, lower(manager_name) AS m, coalesce(lower(nullif(fund_name, 'Brand#7')), '') AS f, disclosure_state, CASE WHEN exposure_usd IS NULL THEN 1.2::DOUBLE ELSE round(exposure_usd / 50000, 4) END AS c, 'p.' || substr(plan_period, 3, 4) AS ref, fund_name AS brand FROM manager_fund_positions),
      per AS (SELECT plan_id, plan_period, row_number() OVER w AS n, lead(plan_period) OVER w AS after FROM (SELECT DISTINCT plan_id, plan_period FROM pos) WINDOW w AS (PARTITION BY plan_id ORDER BY plan_period)),
      told AS (SELECT pos.*, n, after FROM pos JOIN per USING (plan_id, plan_period) WHERE disclosure_state = 'disclosed'),
      both_ AS (SELECT a.*, b.plan_id IS NOT NULL AS stays, b.c AS bc, b.ref AS bref, b.brand AS bbrand, z.plan_id IS NULL AS leaves FROM told a LEFT JOIN told b ON b.plan_id = a.plan_id AND b.m = a.m AND b.f = a.f AND b.n = a.n - 1 LEFT JOIN told z ON z.plan_id = a.plan_id AND z.m = a.m AND z.f = a.f AND z.n = a.n + 1),
      ev AS (SELECT plan_id, plan_period, m, f, manager_name, fund_name, CASE WHEN stays THEN 'still_invested' ELSE 'entered' END AS event_type, CASE WHEN stays THEN 'inferred' ELSE 'table_presence_change' END AS basis, round(greatest(0, least(1, CASE WHEN stays THEN least(c, bc) ELSE c END)), 6) AS confidence,
          CASE WHEN stays THEN bref || '|' || bbrand || '|' || ref || CASE WHEN bbrand <> brand THEN '|' || brand ELSE '' END ELSE ref || '|' || brand END AS evidence_refs FROM both_ WHERE n > 1
        UNION ALL SELECT plan_id, after, m, f, manager_name, fund_name, 'exited', 'table_presence_change', round(greatest(0, least(1, c)), 6), ref || '|' || brand FROM both_ WHERE leaves AND after IS NOT NULL),
      sig AS (SELECT plan_id, plan_period, lower(s_name) AS m, coalesce(lower(nullif(p_brand, 'Brand#7')), '') AS f, upper(s_name) AS manager_name, nullif(p_brand, 'Brand#7') AS fund_name, CASE WHEN net < 20000 THEN 'exited' WHEN net < 60000 THEN 'entered' ELSE 'still_invested' END AS event_type, 'explicit_text' AS basis,
          round(greatest(0, least(1, CAST(net AS DOUBLE) / 40000)), 6) AS confidence, 's.1' AS evidence_refs, net, l_orderkey FROM position_lines WHERE l_returnflag = 'R' AND l_linenumber >= 6
        QUALIFY row_number() OVER (PARTITION BY plan_id, plan_period, lower(s_name), coalesce(lower(nullif(p_brand, 'Brand#7')), '') ORDER BY CASE WHEN net < 20000 THEN 'exited' WHEN net < 60000 THEN 'entered' ELSE 'still_invested' END DESC, net DESC, l_orderkey DESC) = 1)
      SELECT plan_id, plan_period, manager_name, fund_name, event_type, basis, confidence, evidence_refs FROM sig
      UNION ALL SELECT plan_id, plan_period, manager_name, fund_name, event_type, basis, confidence, evidence_refs FROM ev WHERE (plan_id, plan_period, m, f) NOT IN (SELECT (plan_id, plan_period, m, f) FROM sig))"""),
    "j4_disclosure_overlaps": sql("""SELECT * FROM (WITH p AS (SELECT plan_period, plan_id, count(*) AS n FROM manager_fund_positions GROUP BY plan_period, plan_id),
      m AS (SELECT a.plan_period, a.plan_id AS x, b.plan_id AS y, a.disclosure_state = 'disclosed' AND b.disclosure_state = 'disclosed' AS d, a.disclosure_state <> 'not_disclosed' AND b.disclosure_state <> 'not_disclosed' AS t, least(a.exposure_usd, b.exposure_usd) AS usd, a.exposure_usd IS NOT NULL AND b.exposure_usd IS NOT NULL AS k
        FROM manager_fund_positions a JOIN manager_fund_positions b ON a.plan_period = b.plan_period AND a.manager_name = b.manager_name AND a.fund_name = b.fund_name AND a.plan_id <> b.plan_id),
      g AS (SELECT plan_period, x, y, round(coalesce(sum(usd) FILTER (WHERE d AND k), 0), 4) AS usd, count(*) FILTER (WHERE d AND k) AS o, count(*) FILTER (WHERE t AND NOT d) AS ni, count(*) AS shared FROM m GROUP BY plan_period, x, y)
      SELECT a.plan_id AS subject_plan_id, b.plan_id AS counterparty_plan_id, a.plan_period, coalesce(usd, 0) AS overlap_usd, coalesce(o, 0) AS n_overlap, coalesce(ni, 0) AS n_known_not_invested, a.n + b.n - coalesce(shared, 0) - coalesce(o, 0) - coalesce(ni, 0) AS n_unknown
      FROM p a JOIN p b ON a.plan_period = b.plan_period AND a.plan_id <> b.plan_id LEFT JOIN g ON g.plan_period = a.plan_period AND g.x = a.plan_id AND g.y = b.plan_id)"""),
    "j6_all_overlaps": sql("""SELECT a.plan_period, a.plan_id AS subject_plan_id, b.plan_id AS counterparty_plan_id, round(sum(least(a.weight, b.weight)), 6) AS overlap_weight, count(*) AS n_shared
      FROM weights a JOIN weights b ON a.plan_period = b.plan_period AND a.security_id = b.security_id AND a.plan_id < b.plan_id GROUP BY ALL"""),
    "b13_cycle_components": """WITH RECURSIVE links AS (SELECT DISTINCT source, target FROM (SELECT user_id AS source, lead(user_id) OVER (PARTITION BY CAST(ts AS DATE), floor(value / 40) ORDER BY ts, event_id) AS target FROM events WHERE event_type = 'purchase') WHERE target IS NOT NULL AND source < 2 * target),
      reach AS (SELECT source, target FROM links UNION SELECT r.source, l.target FROM reach r JOIN links l ON l.source = r.target)
      SELECT a.source AS node, min(a.target) AS component FROM reach a JOIN reach b ON b.source = a.target AND b.target = a.source GROUP BY a.source""",
}
