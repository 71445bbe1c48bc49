"""Cycles of a directed graph: which nodes lie on one, and which share it.

The graph is made small first: links to dead ends go, and stretches of nodes
with one predecessor and one successor become one link each, by pointer
doubling; a stretch without ends is a ring. What is left, where links truly
branch, is taken apart by colours: the largest node that leads to a node colours
it, and what leads back to that node within the colour lies on its cycles. The
stretches then follow their ends. No set of all pairs is made, and rounds grow
with the logarithm of the longest stretch and the width of what branches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import written


def trimmed(links: DataFrame) -> DataFrame:
    """Links whose source has a predecessor and whose target has a successor."""
    begun, ended = links.select(F.col("target").alias("source")).distinct(), links.select(F.col("source").alias("target")).distinct()
    return links.join(begun, "source", "left_semi").join(ended, "target", "left_semi").select("source", "target")


def stretches(links: DataFrame) -> DataFrame:
    """Nodes with one predecessor and one successor: (node, bwd, fwd)."""
    into = links.groupBy(F.col("target").alias("node")).agg(F.count(F.lit(1)).alias("_in"), F.min("source").alias("bwd")).where("_in = 1")
    out = links.groupBy(F.col("source").alias("node")).agg(F.count(F.lit(1)).alias("_out"), F.min("target").alias("fwd")).where("_out = 1")
    return into.join(out, "node").select("node", "bwd", "fwd")


def ends_of(nodes: DataFrame) -> DataFrame:
    """Both ends of the stretch of every node by pointer doubling; _ring for nodes whose stretch has none, low the least node passed."""
    inner = nodes.select("node", F.lit(True).alias("_inner"))
    for side in ("fwd", "bwd"):
        nodes = nodes.join(inner.select(F.col("node").alias(side), F.col("_inner").alias(f"_{side}")), side, "left").withColumn(f"_{side}", F.coalesce(f"_{side}", F.lit(False)))
    at = written(nodes.withColumn("low", F.col("node")))
    for _ in range(at.count().bit_length() + 1):
        if at.where("_fwd OR _bwd").isEmpty():
            break
        ahead = at.select(F.col("node").alias("fwd"), F.col("fwd").alias("_f"), F.col("_fwd").alias("_fo"), F.col("low").alias("_l"))
        behind = at.select(F.col("node").alias("bwd"), F.col("bwd").alias("_b"), F.col("_bwd").alias("_bo"))
        both = at.join(ahead, "fwd", "left").join(behind, "bwd", "left")
        at = written(both.select("node", F.coalesce("_b", "bwd").alias("bwd"), F.coalesce("_f", "fwd").alias("fwd"), F.coalesce("_fo", F.lit(False)).alias("_fwd"), F.coalesce("_bo", F.lit(False)).alias("_bwd"), F.least("low", F.coalesce("_l", "low")).alias("low")))
    return at.select("node", "bwd", "fwd", "low", F.col("_fwd").alias("_ring"))


def settled(state: DataFrame, step) -> DataFrame:
    """Apply ``step`` until the number of rows it changes (column _new) is 0; every round is written."""
    while True:
        state = written(step(state))
        if state.where("_new").isEmpty():
            return state.drop("_new")


def coloured(links: DataFrame) -> DataFrame:
    """Nodes (node, component) on cycles of links that branch."""
    found = None
    while not links.isEmpty():
        nodes = links.select(F.col("source").alias("node")).union(links.select("target")).distinct()

        def spread(state: DataFrame, links: DataFrame = links) -> DataFrame:
            come = links.join(state, links["source"] == state["node"]).groupBy(F.col("target").alias("node")).agg(F.max("colour").alias("_c"))
            rows = state.drop("_new").join(come, "node", "left")
            return rows.select("node", F.greatest("colour", F.coalesce("_c", "colour")).alias("colour"), F.coalesce(F.col("_c") > F.col("colour"), F.lit(False)).alias("_new"))

        colours = settled(nodes.select("node", F.col("node").alias("colour")), spread)
        tinted = links.join(colours.select(F.col("node").alias("source"), F.col("colour").alias("_s")), "source").join(colours.select(F.col("node").alias("target"), F.col("colour").alias("_t")), "target")
        within = written(tinted.where("_s = _t").select("source", "target"))

        def back(state: DataFrame, within: DataFrame = within) -> DataFrame:
            lead = within.join(state.where("hit").select(F.col("node").alias("target")), "target").select(F.col("source").alias("node"), F.lit(True).alias("_h")).distinct()
            rows = state.drop("_new").join(lead, "node", "left")
            return rows.select("node", "colour", F.coalesce(F.col("hit") | F.col("_h"), F.col("hit")).alias("hit"), (F.coalesce("_h", F.lit(False)) & ~F.col("hit")).alias("_new"))

        hits = settled(colours.withColumn("hit", F.col("node") == F.col("colour")), back).where("hit")
        many = hits.groupBy("colour").count().where("count > 1").select("colour")
        here = hits.join(many, "colour", "left_semi").select("node", F.col("colour").alias("component"))
        found = here if found is None else found.unionByName(here)
        gone = hits.select("node")
        left = links.join(gone.select(F.col("node").alias("source")), "source", "left_anti").join(gone.select(F.col("node").alias("target")), "target", "left_anti")
        links = written(trimmed(left.select("source", "target")))
    return found


def cycle_components(links: DataFrame) -> DataFrame:
    """Rows (node, component) of the nodes of links (source, target) that lie on a cycle; the component is the least node that shares it.

    Nodes that lead to themselves lie on a cycle. Nulls link nothing, repeated
    links count once, and an empty table gives no rows.
    """
    links = written(links.where("source IS NOT NULL AND target IS NOT NULL").select("source", "target").distinct())
    found = links.where("source = target").select(F.col("source").alias("node"), F.col("source").alias("component"), F.lit(0).alias("rank"))
    records: list[DataFrame] = []
    size = -1
    while True:
        own = links.where("source = target")
        found = found.unionByName(own.select(F.col("source").alias("node"), F.col("source").alias("component"), F.lit(0).alias("rank")))
        links = written(trimmed(links.where("source <> target")))
        nodes = stretches(links)
        if (now := links.count()) == 0 or (now == size and nodes.isEmpty()):
            break
        size = now
        if nodes.isEmpty():
            continue
        ends = ends_of(written(nodes))
        found = found.unionByName(ends.where("_ring").select("node", F.col("low").alias("component"), F.lit(1).alias("rank")))
        records.append(ends.where("NOT _ring"))
        inner = ends.select("node")
        outer = links.join(inner.select(F.col("node").alias("source")), "source", "left_anti").join(inner.select(F.col("node").alias("target")), "target", "left_anti")
        links = written(outer.select("source", "target").unionByName(records[-1].select(F.col("bwd").alias("source"), F.col("fwd").alias("target"))).distinct())
    rest = coloured(links)
    if rest is not None:
        found = found.unionByName(rest.withColumn("rank", F.lit(1)))
    at = written(found.groupBy("node").agg(F.max_by("component", "rank").alias("component"), F.max("rank").alias("rank")))
    for record in reversed(records):
        ends = record.join(at.select(F.col("node").alias("bwd"), F.col("component").alias("_b")), "bwd").join(at.select(F.col("node").alias("fwd"), F.col("component").alias("_f")), "fwd")
        more = ends.where("_b = _f").select("node", F.col("_b").alias("component"), F.lit(1).alias("rank"))
        at = written(at.unionByName(more).groupBy("node").agg(F.max_by("component", "rank").alias("component"), F.max("rank").alias("rank")))
    least = at.groupBy("component").agg(F.min("node").alias("least"))
    return at.join(least, "component").select("node", F.col("least").alias("component"))
