"""Shocks, fees, contributions and allocations of plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import finite
from ..functions.shared import few

PLAN = ["plan_id", "plan_period"]


def funded_shocks(plans: DataFrame, shocks: DataFrame) -> DataFrame:
    """Every plan under every shock (equity_shock_pct, discount_rate_shock or null); the table of shocks is one that people write.

    Plans need total_assets_usd, liabilities_usd, equity_usd, equity_scope and
    liability_duration_years. Plans and shocks without a finite positive
    liability before and after have no row.
    """
    liabilities, assets = finite(F.col("liabilities_usd")), finite(F.col("total_assets_usd"))
    rows = plans.join(few(shocks)).withColumns({
        "asset_delta_usd": F.col("equity_usd") * F.col("equity_shock_pct"),
        "liability_delta_usd": F.when(F.col("discount_rate_shock").isNull(), 0.0).otherwise(-F.col("liability_duration_years") * F.col("discount_rate_shock") * liabilities),
    })
    rows = rows.withColumns({"_a": assets + F.col("asset_delta_usd"), "_l": liabilities + F.col("liability_delta_usd")}).where((F.col("liabilities_usd") > 0) & (F.col("_l") > 0) & finite(F.col("_a")).isNotNull())
    before, after = assets / liabilities, F.col("_a") / F.col("_l")
    return rows.select(
        *PLAN, F.when(F.col("equity_scope") == "total-plan", "total-plan").otherwise("equity-sleeve").alias("scope_label"), "equity_shock_pct", "discount_rate_shock",
        F.round(before, 6).alias("baseline_funded_ratio"), F.round(after, 6).alias("shocked_funded_ratio"), F.round(after - before, 6).alias("funded_ratio_delta"),
        F.round("asset_delta_usd", 6).alias("asset_delta_usd"), F.round("liability_delta_usd", 6).alias("liability_delta_usd"), F.round(F.col("_l") - F.col("_a"), 6).alias("shocked_uaal_usd"),
    )


def alternatives_fees(rows: DataFrame) -> DataFrame:
    """Fees of alternative funds: the sum of what is finite, and whether the fund counts as disclosed."""
    value, fee, carry = (finite(F.col(c)) for c in ("reported_fair_value_usd", "management_fees_usd", "carried_interest_usd"))
    total = F.when(fee.isNotNull() | carry.isNotNull(), F.round(F.coalesce(fee, F.lit(0.0)) + F.coalesce(carry, F.lit(0.0)), 6))
    hidden = F.coalesce("explicit_not_disclosed", F.lit(False)) | value.isNull()
    return rows.select(
        *PLAN, F.btrim("fund_name").alias("fund_name"), F.lower(F.btrim("asset_class")).alias("asset_class"), value.alias("reported_fair_value_usd"), fee.alias("management_fees_usd"),
        carry.alias("carried_interest_usd"), total.alias("total_fees_usd"), F.when(hidden, "not_disclosed").otherwise("disclosed").alias("disclosure_state"),
    )


def fee_effectiveness(plans: DataFrame, fees: DataFrame, anchor_bps: float = 40.0) -> DataFrame:
    """Expense of a plan in basis points of assets against an anchor, sums of its alternatives' fees, and value added."""
    sums = fees.groupBy(*PLAN).agg(F.round(F.sum(finite(F.col("management_fees_usd"))), 6).alias("alts_management_fees_usd"), F.round(F.sum(finite(F.col("carried_interest_usd"))), 6).alias("alts_carried_interest_usd"))
    bps = F.round(F.col("investment_expense_usd") / F.col("total_assets_usd") * 10000, 4)
    rows = plans.where((F.col("total_assets_usd") > 0) & finite(F.col("investment_expense_usd")).isNotNull()).join(sums, PLAN, "left")
    return rows.select(*PLAN, bps.alias("expense_bps"), F.round(bps - anchor_bps, 4).alias("excess_bps"), "alts_management_fees_usd", "alts_carried_interest_usd", F.round(finite(F.col("net_return")) - finite(F.col("policy_benchmark_return")), 6).alias("net_value_added"))


def coverage_of_assets(positions: DataFrame, plans: DataFrame, allocations: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Market value collected for a plan against its reported assets, in all and by asset class.

    A class that only one side has keeps its row; the ratio is null where nothing positive is reported.
    """
    held = positions.where("disclosure_state = 'disclosed'").groupBy(*PLAN, "asset_class").agg(F.sum(finite(F.col("market_value_usd")).cast("decimal(28,4)")).alias("collected"))
    anchors = allocations.select(*PLAN, F.lower(F.btrim("asset_class")).alias("asset_class"), F.col("market_value_usd").alias("reported"))
    total = plans.where("total_assets_usd > 0").select(*PLAN, "total_assets_usd")
    w = Window.partitionBy(*PLAN)
    rows = held.withColumn("asset_class", F.lower(F.btrim("asset_class"))).join(anchors, [*PLAN, "asset_class"], "full_outer").join(total, PLAN)
    got = F.coalesce(F.col("collected").cast("double"), F.lit(0.0))
    ratio = F.round(F.coalesce(F.sum("collected").over(w).cast("double"), F.lit(0.0)) / F.col("total_assets_usd"), 6)
    return rows.select(*PLAN, "asset_class", F.when(F.col("reported") > 0, F.round(got / F.col("reported"), 6)).alias("class_ratio"), ratio.alias("coverage_ratio"), F.when(ratio >= threshold, "total-plan").otherwise("equity-sleeve").alias("scope_label"))


def contributions(weights: DataFrame, returns: DataFrame, totals: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Weight times return by plan, against the total that its source states; buckets without a return make it incomplete."""
    rows = weights.join(returns, [*PLAN, "bucket"], "left")
    sums = rows.groupBy(*PLAN).agg(F.sum(F.col("weight") * F.col("ret")).alias("computed_total"), F.count_if(F.col("ret").isNull()).alias("n_missing"))
    delta = F.col("computed_total") - F.col("source_aggregate")
    return sums.join(totals.select(*PLAN, "source_aggregate"), PLAN).select(*PLAN, F.round("computed_total", 9).alias("computed_total"), F.round(delta, 9).alias("delta"), "n_missing", ((F.abs(delta) <= tolerance) & (F.col("n_missing") == 0)).alias("within_tolerance"))


def best_allocations(buckets: DataFrame, n_buckets: int, units: int, penalty_weight: float) -> DataFrame:
    """Weights on a grid of 1/``units`` that add up to 1 and give the best return less ``penalty_weight`` times penalty.

    Rows: plan_id, bucket, expected_return, risk_penalty, min_units,
    max_units; at most ``n_buckets`` a plan. The objective adds up over buckets, so
    the best way to spend k units on the first buckets is all that has to be
    kept: at most ``units`` + 1 rows a plan and bucket, instead of every
    combination. Ties go to the smallest weights, first bucket first.
    """
    w = Window.partitionBy("plan_id")
    placed = buckets.withColumns({"_i": F.row_number().over(w.orderBy("bucket")), "_n": F.count(F.lit(1)).over(w)})
    share = F.col("_u") / units
    gain = share * F.col("expected_return") - penalty_weight * share * share * F.col("risk_penalty")
    steps = placed.withColumn("_u", F.explode(F.sequence("min_units", "max_units"))).select("plan_id", "_i", "_n", "_u", gain.alias("_gain"))
    best = buckets.select("plan_id").distinct().select("plan_id", F.lit(0).alias("used"), F.lit(0.0).alias("objective"), F.array().cast("array<int>").alias("spent"), F.lit(0).alias("_at"), F.lit(0).cast("long").alias("_n"))
    done = None
    for i in range(1, n_buckets + 1):
        step = steps.where(F.col("_i") == i).select("plan_id", "_u", "_gain", F.col("_n").alias("_of"))
        tried = best.join(step, "plan_id").where(F.col("used") + F.col("_u") <= units)
        tried = tried.select("plan_id", (F.col("used") + F.col("_u")).alias("used"), (F.col("objective") + F.col("_gain")).alias("objective"), F.concat("spent", F.array("_u")).alias("spent"), F.col("_of").alias("_n"))
        rank = F.struct(F.round("objective", 12), F.transform("spent", lambda x: -x))
        best = tried.groupBy("plan_id", "used", "_n").agg(F.max_by(F.struct("objective", "spent"), rank).alias("_b")).select("plan_id", "used", "_b.objective", "_b.spent", "_n")
        ended = best.where((F.col("_n") == i) & (F.col("used") == units)).select("plan_id", "objective", "spent")
        done = ended if done is None else done.unionByName(ended)
    return done.select("plan_id", F.round("objective", 9).alias("objective"), F.transform("spent", lambda x: x / units).alias("weights"))


def experiment_comparison(experiments: DataFrame, pairs: DataFrame) -> DataFrame:
    """What the right experiment of a pair reached above the left one; unknown values stay null."""
    side = lambda s: experiments.select(F.col("experiment_id").alias(f"{s}_id"), F.col("objective_value").alias(f"{s}_objective"), F.col("total_return").alias(f"{s}_return"))
    rows = pairs.join(side("left"), "left_id").join(side("right"), "right_id")
    return rows.select("left_id", "right_id", F.round(F.col("right_objective") - F.col("left_objective"), 9).alias("objective_delta"), F.round(F.col("right_return") - F.col("left_return"), 9).alias("total_return_delta"))
