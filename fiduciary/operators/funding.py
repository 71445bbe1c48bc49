"""Funding trends, peer statistics and plan health."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import finite, period_digits, quartile


def net_external_flow() -> Column:
    parts = [F.col("employer_contributions_usd"), F.col("employee_contributions_usd"), -F.col("benefit_payments_usd")]
    known = sum((F.coalesce(p, F.lit(0.0)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0.0)))
    return F.when(F.coalesce(*parts).isNotNull(), F.round(known, 6))


def funding_trend(funding: DataFrame) -> DataFrame:
    """Funded ratio of every plan and period with its change from the period before and the net external flow."""
    w = Window.partitionBy("plan_id").orderBy(period_digits(F.col("plan_period")), "plan_period")
    before = F.lag("funded_ratio").over(w)
    return funding.select("plan_id", "plan_period", F.round("funded_ratio", 6).alias("funded_ratio"), F.round(F.col("funded_ratio") - before, 6).alias("funded_ratio_change"), net_external_flow().alias("net_external_cash_flow_usd"))


def trend_change(funding: DataFrame) -> DataFrame:
    """Last finite funded ratio of a plan less its first; null with fewer than two."""
    rows = funding.select("plan_id", "plan_period", finite(F.col("funded_ratio")).alias("v"), F.struct(period_digits(F.col("plan_period")), F.col("plan_period")).alias("k")).where("v IS NOT NULL")
    change = F.when(F.count(F.lit(1)) >= 2, F.round(F.max_by("v", "k") - F.min_by("v", "k"), 6))
    return rows.groupBy("plan_id").agg(change.alias("trend_change"), F.count(F.lit(1)).alias("n_points"))


def peer_statistics(metrics: DataFrame, peers: list[str], higher_is_better: bool = True) -> DataFrame:
    """Every plan's metric against all other plans of the same ``peers`` columns.

    ``metrics`` has plan_id, metric_name, metric_value and the columns of
    ``peers``; one row for each plan. Counts, means and deviations of the others
    come from sums over the group less the plan's own part; the median of the
    others is among the few values in the middle of the group, which are all
    that a group gathers. Every plan keeps its row.
    """
    key = [*peers, "metric_name"]
    rows = metrics.withColumn("v", finite(F.col("metric_value")))
    group = Window.partitionBy(*key)
    n = F.count("v").over(group) - F.col("v").isNotNull().cast("int")
    exact = F.col("v").cast("decimal(28,12)")
    own = F.coalesce("v", F.lit(0.0))
    mean = (F.coalesce(F.sum(exact).over(group).cast("double"), F.lit(0.0)) - own) / n
    at_or_below = F.count("v").over(group.orderBy("v").rangeBetween(Window.unboundedPreceding, 0)) - 1
    squares = (F.sum((F.col("v") * F.col("v")).cast("decimal(34,12)")).over(group).cast("double") - own * own) / n
    spread = F.sqrt(F.greatest(squares - mean * mean, F.lit(0.0)))
    place = F.row_number().over(group.orderBy(F.col("v").asc_nulls_last(), "plan_id"))
    ranked = rows.where("v IS NOT NULL").select(*key, "v", place.alias("_at"), F.count("v").over(group).alias("_all"))
    middle = ranked.where(F.abs(F.col("_at") - F.col("_all") / 2) <= 2.5)
    values = middle.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("_at", "v"))).alias("_middle"))
    known = F.col("v").isNotNull()
    out = rows.select(
        *key, "plan_id", F.col("v").alias("metric_value"), n.alias("n_peers"), F.when(n > 0, mean).alias("_mean"),
        F.when(known & (n > 0), 100.0 * at_or_below / n).alias("_pct"), F.when(known & (n >= 2), spread).alias("_spread"), F.when(known, place).alias("_place"),
    ).join(values, key, "left")

    def other(i: Column) -> Column:  # the i-th value of the others, from 1
        return F.try_element_at("_middle", (i + F.when(i >= F.col("_place"), 1).otherwise(0)).cast("int"))

    half = F.floor((F.col("n_peers") + 1) / 2)
    median = F.when(F.col("n_peers") > 0, (other(half) + other(F.floor(F.col("n_peers") / 2) + 1)) / 2)
    pct = F.round("_pct", 4)
    return out.select(
        *key, "plan_id", "metric_value", "n_peers", F.round("_mean", 6).alias("peer_mean"), F.round(median, 6).alias("peer_median"), F.round(F.col("metric_value") - F.round("_mean", 6), 6).alias("delta_vs_mean"),
        pct.alias("percentile"), F.round(pct if higher_is_better else 100 - pct, 4).alias("favorable_percentile"), quartile(pct).alias("quartile_rank"),
        F.when(F.col("_spread") > 1e-9, F.round((F.col("metric_value") - F.col("_mean")) / F.col("_spread"), 4)).alias("z_score"),
    )


@dataclass(frozen=True)
class HealthBands:
    """Limits of the ratings."""

    funded_green: float = 0.90
    funded_yellow: float = 0.70
    return_red_over_peer: float = 0.005
    return_red_over_realistic: float = 0.010
    return_yellow_over_realistic: float = 0.0
    adc_green: float = 1.0
    adc_yellow: float = 0.9
    tread_water_yellow: float = 0.10
    cash_green: float = -3.0
    cash_yellow: float = -5.0
    trend_flat: float = 0.01
    amortization_long: float = 25.0
    mortality_green: int = 2010
    mortality_yellow: int = 2000


def plan_health(inputs: DataFrame, bands: HealthBands = HealthBands()) -> DataFrame:
    """A row for each of nine dimensions of a plan's health (rating, value) and one for the worst of them."""
    b, c = bands, lambda name: finite(F.col(name).cast("double"))

    def within(x: Column, low: float, high: float) -> Column:
        return x.isNotNull() & (x >= low) & (x <= high)

    def steps(x: Column, green: float, yellow: float) -> Column:
        return F.when(x >= green, "green").when(x >= yellow, "yellow").otherwise("red")

    funded, trend, rate, realistic, peer = c("funded_ratio_mva"), c("funded_ratio_trend"), c("assumed_return"), c("realistic_return"), c("peer_assumed_return_median")
    adc, paid, cost, uaal, payment, years = c("adc_usd"), c("actual_contribution_usd"), c("normal_cost_usd"), c("uaal_usd"), c("amortization_payment_usd"), c("amortization_period_years")
    closed, cash, gasb, mortality = F.col("amortization_is_closed"), c("net_cash_flow_pct"), c("gasb_discount_rate"), F.col("mortality_table_year")
    rate_ok = within(rate, 0, 1)
    bad_comparator = (F.col("realistic_return").isNotNull() & ~F.coalesce(within(realistic, 0, 1), F.lit(False))) | (F.col("peer_assumed_return_median").isNotNull() & ~F.coalesce(within(peer, 0, 1), F.lit(False)))
    over_real, over_peer = rate - realistic, rate - peer
    paid_ok = (adc > 0) & (paid >= 0)
    tread_ok = (paid >= 0) & (cost >= 0) & rate_ok & (uaal >= 0)
    required = cost + rate * uaal
    gap = F.round(paid - required, 6)
    shrinking = payment < rate * uaal
    bad_amortization = F.coalesce((payment < 0) | (rate < 0) | (rate > 1) | (uaal < 0) | (years < 0), F.lit(False))
    unknown = F.lit("unknown")
    dimensions = {
        "funded_ratio_mva": (F.when(within(funded, 0, 1), steps(funded, b.funded_green, b.funded_yellow)).otherwise(unknown), F.when(within(funded, 0, 1), F.round(funded, 6))),
        "funded_ratio_trend": (F.when(within(trend, -1, 1), F.when(trend > b.trend_flat, "green").when(trend >= -b.trend_flat, "yellow").otherwise("red")).otherwise(unknown), F.when(within(trend, -1, 1), F.round(trend, 6))),
        "assumed_return": (
            F.when(~F.coalesce(rate_ok, F.lit(False)) | bad_comparator | (realistic.isNull() & peer.isNull()), unknown)
            .when((over_real > b.return_red_over_realistic) | (over_peer > b.return_red_over_peer), "red").when(over_real > b.return_yellow_over_realistic, "yellow").otherwise("green"),
            F.when(rate_ok, F.round(rate, 6)),
        ),
        "contribution_sufficiency": (F.when(paid_ok, steps(paid / adc, b.adc_green, b.adc_yellow)).otherwise(unknown), F.when(paid_ok, F.round(paid / adc, 4))),
        "tread_water": (F.when(tread_ok, F.when(gap >= 0, "green").when(gap >= -F.abs(required) * b.tread_water_yellow, "yellow").otherwise("red")).otherwise(unknown), F.when(tread_ok, gap)),
        "amortization": (
            F.when(bad_amortization, unknown).when(shrinking, "red").when(closed.isNull() & shrinking.isNull(), unknown).when(closed.isNull() | closed, "green").otherwise("yellow"),
            F.when(~bad_amortization & ~F.coalesce(shrinking, F.lit(False)) & ~closed & (years > b.amortization_long), F.round(years, 1)),
        ),
        "cash_flow_maturity": (F.when(within(cash, -100, 100), steps(cash, b.cash_green, b.cash_yellow)).otherwise(unknown), F.when(within(cash, -100, 100), F.round(cash, 4))),
        "gasb_crossover": (F.when(within(gasb, 0, 1) & rate_ok, F.when(gasb < rate, "red").otherwise("green")).otherwise(unknown), F.when(within(gasb, 0, 1) & rate_ok, F.round(gasb, 6))),
        "mortality_currency": (F.when(mortality.isNull(), unknown).otherwise(steps(mortality, b.mortality_green, b.mortality_yellow)), mortality.cast("double")),
    }
    rows = F.array(*[F.struct(F.lit(name).alias("dimension"), rating.alias("rating"), value.alias("value")) for name, (rating, value) in dimensions.items()])
    has = lambda r: F.exists(rows, lambda x: x["rating"] == r)
    overall = F.when(has("red"), "red").when(has("yellow"), "yellow").when(has("green"), "green").otherwise("unknown")
    rows = F.concat(rows, F.array(F.struct(F.lit("overall").alias("dimension"), overall.alias("rating"), F.lit(None).cast("double").alias("value"))))
    return inputs.select("plan_id", "plan_period", F.inline(rows))


def allocation_peers(allocation: DataFrame) -> DataFrame:
    """Allocation of every plan to a class against the others of its peer group in the period."""
    rows = allocation.withColumnRenamed("asset_class", "metric_name").withColumnRenamed("allocation_pct", "metric_value")
    return peer_statistics(rows, ["plan_period", "peer_group"]).select(
        "plan_id", "plan_period", "peer_group", F.col("metric_name").alias("asset_class"), F.round("metric_value", 6).alias("plan_allocation_pct"), F.col("peer_mean").alias("peer_mean_pct"), F.col("peer_median").alias("peer_median_pct"), F.col("delta_vs_mean").alias("delta_vs_peer_mean_pct")
    )
