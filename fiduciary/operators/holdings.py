"""Holdings: weights, overlap, concentration, activity, attribution, liquidity."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import finite
from ..functions.shared import few

PLAN = ["plan_id", "plan_period"]


def exact_sum(c: Column) -> Column:
    """A sum that doesn't depend on the order of the rows."""
    return F.sum(c.cast("decimal(28,12)")).cast("double")


def position_weights(positions: DataFrame) -> DataFrame:
    """Share of every security in the disclosed, positive market value of its plan and period."""
    value = finite(F.col("market_value_usd"))
    held = positions.where((F.col("disclosure_state") == "disclosed") & (value > 0)).groupBy(*PLAN, "security_id").agg(F.sum(value.cast("decimal(28,4)")).alias("mv"))
    total = held.groupBy(*[F.col(c).alias(f"_{c}") for c in PLAN]).agg(F.sum("mv").cast("double").alias("_total"))  # a row for each plan and period, so no sort of all rows
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in PLAN])
    return held.join(F.broadcast(total), same).select(*PLAN, "security_id", (F.col("mv").cast("double") / F.col("_total")).alias("weight"))


def concentration(weights: DataFrame, top: int = 10) -> DataFrame:
    """Herfindahl index, effective number of names and weight of the largest ``top`` names."""
    place = F.row_number().over(Window.partitionBy(*PLAN).orderBy(F.desc("weight"), "security_id"))
    ranked = weights.withColumn("_place", place)
    hhi = exact_sum(F.col("weight") * F.col("weight"))
    return ranked.groupBy(*PLAN).agg(F.round(hhi, 6).alias("hhi"), F.round(1 / hhi, 4).alias("effective_names"), F.round(exact_sum(F.when(F.col("_place") <= top, F.col("weight"))), 6).alias("top_weight"), F.count(F.lit(1)).alias("n_securities"))


def holdings_overlap(positions: DataFrame, subject: str, period: str) -> DataFrame:
    """Positions of the subject plan against those of every other plan of the period, by disclosure."""
    rows = positions.where(F.col("plan_period") == period)
    mine = rows.where(F.col("plan_id") == subject).select("manager_name", "fund_name", F.col("exposure_usd").alias("_mine"), F.col("disclosure_state").alias("_my_state"))
    theirs = rows.where(F.col("plan_id") != subject).select(F.col("plan_id").alias("counterparty_plan_id"), "manager_name", "fund_name", F.col("exposure_usd").alias("_their"), F.col("disclosure_state").alias("_their_state"))
    others = theirs.select("counterparty_plan_id").distinct()
    keys = mine.select("manager_name", "fund_name").join(few(others)).select("counterparty_plan_id", "manager_name", "fund_name").union(theirs.select("counterparty_plan_id", "manager_name", "fund_name")).distinct()
    both = keys.join(mine, ["manager_name", "fund_name"], "left").join(theirs, ["counterparty_plan_id", "manager_name", "fund_name"], "left")
    my_state, their_state = F.coalesce("_my_state", F.lit("not_disclosed")), F.coalesce("_their_state", F.lit("not_disclosed"))
    disclosed = (my_state == "disclosed") & (their_state == "disclosed")
    known = F.col("_mine").isNotNull() & F.col("_their").isNotNull()
    status = F.when(disclosed & known, "overlap").when(~disclosed & (my_state != "not_disclosed") & (their_state != "not_disclosed"), "known_not_invested").otherwise("unknown_due_to_non_disclosure")
    return both.select(
        F.lit(subject).alias("subject_plan_id"), "counterparty_plan_id", F.lit(period).alias("plan_period"), "manager_name", "fund_name", status.alias("overlap_status"),
        F.when(disclosed & known, F.round(F.least("_mine", "_their"), 6)).alias("overlap_usd"), my_state.alias("subject_disclosure_state"), their_state.alias("counterparty_disclosure_state"),
    )


def security_overlap(weights: DataFrame) -> DataFrame:
    """Sum of the smaller weights over the securities that two plans of a period share, for all pairs that share one."""
    a = weights.select("plan_period", "security_id", F.col("plan_id").alias("subject_plan_id"), F.col("weight").alias("_a"))
    b = weights.select("plan_period", "security_id", F.col("plan_id").alias("counterparty_plan_id"), F.col("weight").alias("_b"))
    pairs = a.join(b, ["plan_period", "security_id"]).where("subject_plan_id < counterparty_plan_id")
    return pairs.groupBy("plan_period", "subject_plan_id", "counterparty_plan_id").agg(F.round(exact_sum(F.least("_a", "_b")), 6).alias("overlap_weight"), F.count(F.lit(1)).alias("n_shared"))


def active_share(weights: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Half the gross difference from the benchmark, with its band.

    The benchmark's names that a plan doesn't hold count with their weight: the
    sum over all of them less that over the held ones, so the benchmark isn't
    repeated for every plan.
    """
    joined = weights.join(benchmark.select("security_id", F.col("weight").alias("_b")), "security_id", "left")
    whole = benchmark.agg(exact_sum(F.col("weight")).alias("_all"))
    held = joined.groupBy(*PLAN).agg(exact_sum(F.abs(F.col("weight") - F.coalesce("_b", F.lit(0.0)))).alias("_gross"), exact_sum(F.coalesce("_b", F.lit(0.0))).alias("_met"))
    share = F.round(0.5 * (F.col("_gross") + F.col("_all") - F.col("_met")), 6)
    pct = F.round(share * 100, 4)
    band = F.when(pct < 20, "closet-indexer").when(pct <= 60, "moderately-active").when(pct <= 80, "highly-active").otherwise("very-highly-active")
    return held.join(F.broadcast(whole)).select(*PLAN, share.alias("active_share"), pct.alias("active_share_pct"), band.alias("cremers_band"))


def allocation_drift(actual: DataFrame, target: DataFrame, alternatives: list[str]) -> DataFrame:
    """Half the gross difference of actual and target weights by class, and the part in alternatives."""
    key = [*PLAN, "asset_class"]
    both = actual.select(*key, F.col("weight").alias("_a")).join(target.select(*key, F.col("weight").alias("_t")), key, "full_outer")
    active = F.round(F.coalesce("_a", F.lit(0.0)) - F.coalesce("_t", F.lit(0.0)), 6)
    rows = both.select(*key, active.alias("active_weight"), F.col("asset_class").isin(alternatives).alias("is_alternative"))
    return rows.groupBy(*PLAN).agg(F.round(0.5 * exact_sum(F.abs("active_weight")), 6).alias("drift"), F.round(F.coalesce(exact_sum(F.when(F.col("is_alternative"), F.col("active_weight"))), F.lit(0.0)), 6).alias("alternatives_active_weight"), F.count(F.lit(1)).alias("n_classes"))


def factor_tilts(weights: DataFrame, exposures: DataFrame) -> DataFrame:
    """Weighted mean exposure to every factor over the names that have it, and their weight."""
    joined = weights.join(exposures.where(finite(F.col("z")).isNotNull()), "security_id")
    covered = exact_sum(F.col("weight"))
    return joined.groupBy(*PLAN, "factor").agg(F.when(covered > 0, F.round(exact_sum(F.col("weight") * F.col("z")) / covered, 6)).alias("z_score"), F.round(covered, 6).alias("coverage"))


def brinson(portfolio: DataFrame, policy: DataFrame, fee_drag: float = 0.0) -> DataFrame:
    """Allocation, selection and interaction effects by plan and period; rows have bucket, weight and ret."""
    key = [*PLAN, "bucket"]
    both = portfolio.select(*key, F.col("weight").alias("_wp"), F.col("ret").alias("_rp")).join(policy.select(*key, F.col("weight").alias("_wb"), F.col("ret").alias("_rb")), key, "full_outer").fillna(0.0, ["_wp", "_rp", "_wb", "_rb"])
    whole = F.sum((F.col("_wb") * F.col("_rb")).cast("decimal(28,12)")).over(Window.partitionBy(*PLAN)).cast("double")
    w, r = F.col("_wp") - F.col("_wb"), F.col("_rp") - F.col("_rb")
    rows = both.select(*PLAN, (w * (F.col("_rb") - whole)).alias("a"), (F.col("_wb") * r).alias("s"), (w * r).alias("i"))
    sums = rows.groupBy(*PLAN).agg(*[exact_sum(F.col(x)).alias(x) for x in "asi"])
    total = F.col("a") + F.col("s") + F.col("i")
    effects = {"allocation_effect": F.col("a"), "selection_effect": F.col("s"), "interaction_effect": F.col("i"), "total_active_return": total, "total_active_return_net_of_fee": total - fee_drag}
    return sums.select(*PLAN, *[(F.round(c, 6) + 0.0).alias(name) for name, c in effects.items()])  # plus zero: no negative zeros


def liquidity(positions: DataFrame, illiquid: list[str], outflow: DataFrame) -> DataFrame:
    """Illiquid share of a plan's book and how often the rest covers its net outflow."""
    value = F.col("market_value_usd")
    books = positions.groupBy(*PLAN).agg(F.coalesce(F.sum(F.when(F.col("asset_class").isin(illiquid), value.cast("decimal(28,4)"))).cast("double"), F.lit(0.0)).alias("illiquid"), F.sum(value.cast("decimal(28,4)")).cast("double").alias("total")).where("total > 0")
    rest = F.col("total") - F.col("illiquid")
    return books.join(outflow, PLAN, "left").select(*PLAN, F.round("illiquid", 4).alias("illiquid_market_value_usd"), F.round("total", 4).alias("total_market_value_usd"), F.round(F.col("illiquid") / F.col("total"), 6).alias("illiquid_pct"), F.when(F.col("net_cash_outflow_usd") > 0, F.round(rest / F.col("net_cash_outflow_usd"), 6)).alias("outflow_coverage_ratio"))
