"""Overlaps of the holdings of all plans, for every pair of plans of a period.

Plans of a period are numbered and dealt to blocks, positions to buckets by
their hash. A group is one bucket of two blocks, of bounded size however many
plans hold a position: it adds up what every two plans of its blocks share, so
no row a pair and position leaves it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import cut, written

BLOCK = 256  # plans of a block
ROWS = 200_000  # positions of a bucket, about
PAIRS = 1 << 20  # pairs that are added up at a time


def dealt(rows: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows (plan_period, plan_id, the columns ``key``, and others) by (plan_period, a, b, bucket), with the plan's number; and the plans."""
    place = F.row_number().over(Window.partitionBy("plan_period").orderBy("plan_id")) - 1
    rows = written(rows)  # used twice
    plans = cut(rows.groupBy("plan_period", "plan_id").agg(F.count(F.lit(1)).alias("n")).withColumn("number", place))
    blocks = plans.groupBy("plan_period").agg((F.max("number") / BLOCK).cast("int").alias("last"), (F.sum("n") / ROWS).cast("int").alias("buckets"))
    numbered = rows.join(plans.select("plan_period", "plan_id", "number"), ["plan_period", "plan_id"]).join(F.broadcast(blocks), "plan_period")  # a row a period
    block, other = (F.col("number") / BLOCK).cast("int"), F.col("other")
    sided = numbered.select("*", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("other"))
    return sided.withColumns({"a": F.least(block, other), "b": F.greatest(block, other), "bucket": F.pmod(F.xxhash64(*key), F.col("buckets") + 1), "position": F.xxhash64(*key)}).drop("other", "last", "buckets"), plans


def per_pair(rows: DataFrame, plans: DataFrame, measures: dict[str, Column], values) -> DataFrame:
    """Sums over shared positions of what ``values(left columns, right columns)`` gives for holders: arrays of the measures' names."""
    names = list(measures)
    inner = rows.select("plan_period", "a", "b", "bucket", "position", "number", *[c.cast("double").alias(n) for n, c in measures.items()])

    def meet(group: pa.Table) -> pa.Table:
        period, a, b = (group[c][0].as_py() for c in ("plan_period", "a", "b"))
        order = np.lexsort((group["number"].to_numpy(), group["position"].to_numpy()))
        position, number = group["position"].to_numpy()[order], group["number"].to_numpy()[order]
        data = {n: group[n].to_numpy(zero_copy_only=False)[order] for n in names}
        left, right = np.flatnonzero(number // BLOCK == a), np.flatnonzero(number // BLOCK == b)
        begin, end = (np.searchsorted(position[right], position[left], side) for side in ("left", "right"))
        if a == b:
            begin = np.arange(1, len(left) + 1)  # of two plans the first one is left
        n = end - begin
        total, cuts = None, np.searchsorted(np.cumsum(n), np.arange(PAIRS, max(n.sum(), 1) + PAIRS, PAIRS)) + 1
        for s, e in zip(np.r_[0, cuts[:-1]], cuts, strict=True):
            many = n[s:e]
            x = np.repeat(left[s:e], many)
            y = right[np.arange(len(x)) + np.repeat(begin[s:e] - (np.cumsum(many) - many), many)]
            got = values({k: v[x] for k, v in data.items()}, {k: v[y] for k, v in data.items()})
            at = (number[x] - a * BLOCK) * BLOCK + number[y] - b * BLOCK
            sums = {k: np.bincount(at, v, BLOCK * BLOCK).astype(float).reshape(BLOCK, BLOCK) for k, v in got.items()}
            total = sums if total is None else {k: total[k] + v for k, v in sums.items()}
        i, j = np.nonzero(np.any([x != 0 for x in total.values()], axis=0))
        keep = i + a * BLOCK < j + b * BLOCK
        i, j = i[keep], j[keep]
        out = {"plan_period": pa.array([period] * len(i), pa.string()), "left": pa.array(i + a * BLOCK, pa.int32()), "right": pa.array(j + b * BLOCK, pa.int32())}
        return pa.table({**out, **{n: pa.array(x[i, j]) for n, x in total.items()}})

    made = list(values({n: np.zeros((1, 1)) for n in names}, {n: np.zeros((1, 1)) for n in names}))
    sums = inner.groupBy("plan_period", "a", "b", "bucket").applyInArrow(meet, f"plan_period string, left int, right int, {', '.join(f'{n} double' for n in made)}")
    sums = sums.groupBy("plan_period", "left", "right").agg(*[F.sum(n).alias(n) for n in made])
    for side in ("left", "right"):
        sums = sums.join(plans.select("plan_period", F.col("number").alias(side), F.col("plan_id").alias(f"{side}_plan"), F.col("n").alias(f"{side}_n")), ["plan_period", side])
    return sums


def security_overlaps(weights: DataFrame) -> DataFrame:
    """Sum of the smaller weights over the securities that two plans of a period share, for all pairs that share one."""
    rows, plans = dealt(weights.select("plan_period", "plan_id", "security_id", "weight"), ["security_id"])
    sums = per_pair(rows, plans, {"w": F.col("weight")}, lambda x, y: {"overlap": np.minimum(x["w"], y["w"]), "shared": np.ones(np.broadcast_shapes(x["w"].shape, y["w"].shape))})
    return sums.select("plan_period", F.col("left_plan").alias("subject_plan_id"), F.col("right_plan").alias("counterparty_plan_id"), F.round("overlap", 6).alias("overlap_weight"), F.col("shared").cast("long").alias("n_shared"))


def disclosure_overlaps(positions: DataFrame) -> DataFrame:
    """How the positions (manager and fund) of any two plans of a period overlap, by disclosure: a row each way for every pair.

    Positions that both disclose with an exposure overlap by the smaller one;
    those that neither leaves undisclosed, but not both disclose, are known
    not to be invested; all others, also those that only one of them names, are
    unknown. Pairs that share no position have a row too. Of a plan's rows for
    one position the largest counts.
    """
    one = positions.groupBy("plan_period", "plan_id", "manager_name", "fund_name").agg(F.max(F.struct("exposure_usd", "disclosure_state")).alias("x"))
    rows = one.select("plan_period", "plan_id", "manager_name", "fund_name", F.col("x.exposure_usd").alias("exposure"), F.col("x.disclosure_state").alias("state"))
    rows, plans = dealt(rows, ["manager_name", "fund_name"])
    measures = {"usd": F.coalesce("exposure", F.lit(float("nan"))), "open": (F.col("state") == "disclosed"), "told": F.coalesce(F.col("state") != "not_disclosed", F.lit(False))}

    def values(x: dict, y: dict) -> dict:
        disclosed = (x["open"] > 0) & (y["open"] > 0)
        both = disclosed & ~np.isnan(x["usd"]) & ~np.isnan(y["usd"])
        return {"overlap_usd": np.where(both, np.minimum(x["usd"], y["usd"]), 0.0), "n_overlap": both * 1.0, "n_not_invested": ((x["told"] > 0) & (y["told"] > 0) & ~disclosed) * 1.0, "n_shared": np.ones(disclosed.shape)}

    sums = per_pair(rows, plans, measures, values).select("plan_period", "left", "right", "overlap_usd", "n_overlap", "n_not_invested", "n_shared")
    sums = sums.unionByName(sums.select("plan_period", F.col("left").alias("right"), F.col("right").alias("left"), "overlap_usd", "n_overlap", "n_not_invested", "n_shared"))
    side = lambda name: plans.select("plan_period", F.col("number").alias(name), F.col("plan_id").alias(f"{name}_plan"), F.col("n").alias(f"{name}_n"))
    pairs = side("left").join(side("right"), "plan_period").where("left <> right").join(sums, ["plan_period", "left", "right"], "left")  # a row a pair is the result
    n = lambda c: F.coalesce(F.col(c), F.lit(0.0)).cast("long")
    return pairs.select(
        F.col("left_plan").alias("subject_plan_id"), F.col("right_plan").alias("counterparty_plan_id"), "plan_period", F.round(F.coalesce("overlap_usd", F.lit(0.0)), 4).alias("overlap_usd"), n("n_overlap").alias("n_overlap"), n("n_not_invested").alias("n_known_not_invested"),
        (F.col("left_n") + F.col("right_n") - n("n_shared") - n("n_overlap") - n("n_not_invested")).alias("n_unknown"),
    )
