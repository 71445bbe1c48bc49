"""Plans against all other plans of a group, for several groupings at once, and the benchmark panel on top."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import finite, quartile
from ..functions.shared import FEW, cut
from .funding import HealthBands, plan_health
from .records import amortization_closed, safe_ratio


def cumulative(counts: DataFrame, by: list[str], value: str) -> DataFrame:
    """Distinct values of groups, counted in ``n``, with the ranks (_first, _last) that they take in their group and its size (_total).

    Values are range-partitioned by group and value, so that a large group fills
    many partitions; what lies before a partition is added from the partitions'
    sums, one for each group that a partition holds.
    """
    placed = cut(counts.repartitionByRange(*by, value).withColumn("_part", F.spark_partition_id()))
    group = Window.partitionBy(*by)
    sums = placed.groupBy(*by, "_part").agg(F.sum("n").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.withColumns({"_before": before, "_total": F.sum("_sum").over(group)}).drop("_sum")
    up_to = F.col("_before") + F.sum("n").over(Window.partitionBy(*by, "_part").orderBy(value))
    return placed.join(starts, [*by, "_part"]).withColumn("_last", up_to).withColumn("_first", F.col("_last") - F.col("n") + 1).drop("_part", "_before")


def beside_groups(rows: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` with the columns of their group, which is broadcast up to a checked number of groups and joined by a shuffle beyond."""
    small = len(groups.take(FEW + 1)) <= FEW
    return rows.join(F.broadcast(groups) if small else groups, by, "left")


def leave_one_out(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` (the columns ``by``, none null, and v, finite or null) with statistics of all other values of their group.

    Adds n_peers, peer_mean, peer_median, peer_spread (of the population) and
    at_or_below (peers up to the own value). Groups are never gathered: ranks
    come from cumulative counts of distinct values, the median from the few
    values in the middle of the group, the spread from deviations off its mean.
    """
    known = rows.where("v IS NOT NULL")
    ranked = cut(cumulative(known.groupBy(*by, "v").agg(F.count(F.lit(1)).alias("n")), by, "v"))
    totals = cut(ranked.groupBy(*by).agg(F.max("_total").alias("_total"), (F.sum(F.col("v").cast("decimal(28,12)") * F.col("n")).cast("double") / F.max("_total")).alias("_mean")))
    off = F.col("v") - F.col("_mean")
    squares = beside_groups(ranked.select(*by, "v", "n"), totals, by).groupBy(*by).agg(F.sum(off * off * F.col("n")).alias("_squares"))
    central = (F.col("_last") >= F.col("_total") / 2 - 1) & (F.col("_first") <= F.col("_total") / 2 + 2)
    middle = ranked.where(central).groupBy(*by).agg(F.collect_list(F.struct("_first", "_last", "v")).alias("_middle"))
    groups = cut(totals.join(squares, by).join(middle, by))
    out = beside_groups(rows, groups, by).join(ranked.select(*by, "v", "_first", "_last"), [*by, "v"], "left")
    own = F.col("v").isNotNull()
    n = F.coalesce("_total", F.lit(0)) - own.cast("int")
    own_off = F.coalesce(off, F.lit(0.0))
    shift = -own_off / n  # of the others' mean from the group's
    variance = (F.col("_squares") - own_off * own_off) / n - shift * shift
    spread = F.when(variance > 1e-12 * F.col("_squares") / n, F.sqrt(variance)).otherwise(0.0)  # less is what the differences leave of equal values

    def other(k: Column) -> Column:  # the k-th value of the others, from 1
        rank = k + F.when(own & (k >= F.col("_first")), 1).otherwise(0)
        return F.get(F.filter("_middle", lambda x: (x["_first"] <= rank) & (rank <= x["_last"])), F.lit(0))["v"]

    median = (other(F.floor((n + 1) / 2)) + other(F.floor(n / 2) + 1)) / 2
    stats = {"n_peers": n, "peer_mean": F.when(n > 0, F.col("_mean") + shift), "peer_median": F.when(n > 0, median), "peer_spread": F.when(n > 0, spread), "at_or_below": F.when(own, F.col("_last") - 1)}
    return out.select(*rows.columns, *[c.alias(name) for name, c in stats.items()])


def peer_axes(metrics: DataFrame, axes: dict[str, list[str]]) -> DataFrame:
    """Metrics against the other plans of every axis: a row an axis.

    ``metrics`` has plan_id, metric_name, metric_value and the columns that the
    axes group by. Percentiles count peers at or below the plan; z scores need
    two peers that differ.
    """
    groups = F.array(*[F.struct(F.lit(name).alias("axis"), F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("peers")) for name, columns in axes.items()])
    rows = metrics.select(*metrics.columns, F.inline(groups)).withColumn("v", finite(F.col("metric_value")))
    out = leave_one_out(rows, ["axis", "peers", "metric_name"])
    value, known = F.round("v", 6), F.col("v").isNotNull() & (F.col("n_peers") > 0)
    pct = F.when(known, F.round(100.0 * F.col("at_or_below") / F.col("n_peers"), 4))
    z = F.when(known & (F.col("n_peers") >= 2) & (F.col("peer_spread") > 1e-9 * F.greatest(F.abs("peer_mean"), F.lit(1.0))), F.round((value - F.col("peer_mean")) / F.col("peer_spread"), 4))
    return out.withColumns({"metric_value": value, "percentile": pct, "quartile_rank": quartile(pct), "z_score": z, "peer_mean": F.round("peer_mean", 6), "peer_median": decimals(F.col("peer_median"), 6).cast("double")}).drop("v", "peers", "at_or_below", "peer_spread")


# The panel's metrics in order, and the metrics that show a dimension of health.
METRICS = [
    "funded_ratio_ava", "funded_ratio_mva", "funded_ratio_trend", "aal_usd", "uaal_usd", "assumed_return", "discount_rate", "inflation_rate", "payroll_growth_rate", "amortization_period_years",
    "amortization_method_closed", "mortality_table_year", "adc_vs_actual_contribution_ratio", "contribution_pct_of_payroll", "net_return_1yr", "net_return_3yr", "net_return_5yr", "net_return_10yr",
    "net_external_cash_flow_pct", "support_ratio", "benefit_payments_pct", "assets_payroll_ratio",
]
HEALTH = {
    "funded_ratio_mva": "funded_ratio_mva", "funded_ratio_trend": "funded_ratio_trend", "assumed_return": "assumed_return",
    "adc_vs_actual_contribution_ratio": "contribution_sufficiency", "net_external_cash_flow_pct": "cash_flow_maturity",
}


def decimals(x: Column, places: int, signed: bool = False) -> Column:
    """Digits of a double rounded from its exact value, as Python prints it (Spark's ``round`` goes by the shortest digits)."""
    digits = F.replace(F.format_number(x, places), F.lit(","), F.lit(""))
    return F.concat(F.when(x >= 0, "+").otherwise(""), digits) if signed else digits


def percent(x: Column, places: int, signed: bool = False) -> Column:
    return F.concat(decimals(100 * x, places, signed), F.lit("%"))


def health_basis(inputs: DataFrame, bands: HealthBands = HealthBands()) -> DataFrame:
    """The nine dimensions of ``plan_health`` with the figures behind each rating in words."""
    b = bands
    rated = plan_health(inputs, bands).where("dimension <> 'overall'")
    rows = rated.join(inputs, ["plan_id", "plan_period"])
    c = {name: finite(F.col(name).cast("double")) for name in ("assumed_return", "realistic_return", "peer_assumed_return_median", "amortization_payment_usd", "uaal_usd", "amortization_period_years", "gasb_discount_rate")}
    value, rating, unknown = F.col("value"), F.col("rating"), F.col("rating") == "unknown"
    rate, real, peer, years, closed = c["assumed_return"], c["realistic_return"], c["peer_assumed_return_median"], c["amortization_period_years"], F.col("amortization_is_closed")

    def bad(name: str) -> Column:
        return F.col(name).isNotNull() & ~F.coalesce((c[name] >= 0) & (c[name] <= 1), F.lit(False))

    against = F.concat_ws("; ", F.when(real.isNotNull(), F.concat(F.lit("vs realistic "), percent(real, 2), F.lit(": "), percent(rate - real, 2, True))), F.when(peer.isNotNull(), F.concat(F.lit("vs peer median "), percent(peer, 2), F.lit(": "), percent(rate - peer, 2, True))))
    shrinking = c["amortization_payment_usd"] < rate * c["uaal_usd"]
    invalid = F.coalesce((c["amortization_payment_usd"] < 0) | (rate < 0) | (rate > 1) | (c["uaal_usd"] < 0) | (years < 0), F.lit(False))
    texts = {
        "funded_ratio_mva": F.when(unknown, "no valid funded ratio (MVA) in [0, 1]").otherwise(F.concat(F.lit("MVA funded ratio "), percent(value, 1), F.lit(f"; bands >={b.funded_green:.0%}/>={b.funded_yellow:.0%}"))),
        "funded_ratio_trend": F.when(unknown, "no valid trend in [-1, 1]").otherwise(F.concat(F.lit("funded-ratio change "), decimals(value, 3, True), F.lit(f"; flat band +/-{b.trend_flat}"))),
        "assumed_return": F.when(value.isNull(), "no valid assumed return in [0, 1]").when(bad("realistic_return"), "realistic return outside [0, 1]").when(bad("peer_assumed_return_median"), "peer assumed return outside [0, 1]")
        .otherwise(F.concat(F.lit("assumed "), percent(rate, 2), F.lit("; "), F.when(against == "", "no peer/realistic comparator supplied").otherwise(against))),
        "contribution_sufficiency": F.when(unknown, "no valid non-negative ADC/actual").otherwise(F.concat(F.lit("paid "), percent(value, 0), F.lit(f" of ADC; bands >={b.adc_green:.0%}/>={b.adc_yellow:.0%}"))),
        "tread_water": F.when(unknown, "insufficient valid inputs").otherwise(F.concat(F.lit("contribution minus (normal cost + i*UAAL) = "), F.format_number(value, 0))),
        "amortization": F.when(invalid, "invalid amortization inputs").when(shrinking, "negative amortization: payment < interest on UAAL").when(unknown, "no amortization inputs").when(closed.isNull(), "not negatively amortizing")
        .when(closed, "closed/layered amortization").when(years > b.amortization_long, F.concat(F.lit("open amortization over "), decimals(years, 0), F.lit("y"), F.lit(f" (> {b.amortization_long:.0f}y)"))).otherwise("open amortization"),
        "cash_flow_maturity": F.when(unknown, "no valid net cash flow % in [-100, 100]").otherwise(F.concat(F.lit("net external cash flow "), decimals(value, 1, True), F.lit("%"), F.lit(f" of assets; bands >={b.cash_green}/>={b.cash_yellow}"))),
        "gasb_crossover": F.when(unknown, "no valid GASB/assumed rate").otherwise(F.concat(F.lit("GASB discount "), percent(value, 2), F.when(rating == "red", " < assumed ").otherwise(" >= assumed "), percent(rate, 2), F.when(rating == "red", ": crossover/depletion (blended rate)").otherwise(": no crossover"))),
        "mortality_currency": F.when(unknown, "no mortality table year").otherwise(F.concat(F.lit("mortality base year "), decimals(value, 0), F.lit(f"; green >={b.mortality_green}"))),
    }
    basis = F.coalesce(*[F.when(F.col("dimension") == name, text) for name, text in texts.items()])
    return rows.select("plan_id", "plan_period", "dimension", "rating", "value", basis.alias("basis"))


def panel_metrics(inputs: DataFrame) -> DataFrame:
    """The panel's metrics of every plan and period, a row each; unknown and non-finite ones are null."""
    made = {
        "amortization_method_closed": amortization_closed(F.col("amortization_method")).cast("double"), "mortality_table_year": F.col("mortality_table_year").cast("double"),
        "adc_vs_actual_contribution_ratio": safe_ratio(F.col("actual_contribution_usd"), F.col("adc_usd")), "contribution_pct_of_payroll": safe_ratio(F.col("actual_contribution_usd"), F.col("payroll_usd")),
    }
    each = F.array(*[F.struct(F.lit(m).alias("metric_name"), finite(made.get(m, F.col(m)).cast("double")).alias("metric_value")) for m in METRICS])
    return inputs.select("plan_id", "plan_period", "peer_group", "assumed_return", "policy_benchmark_return", F.inline(each))


def benchmark_panel(inputs: DataFrame, bands: HealthBands = HealthBands()) -> DataFrame:
    """The panel of every plan and period: each metric against all peers and those of the same group, then the dimensions of health.

    ``inputs`` has one row a plan and period. The assumed return is judged
    against the median of the peers'.
    """
    keys = ["plan_id", "plan_period", "metric_name"]
    stats = cut(peer_axes(panel_metrics(inputs), {"broad": ["plan_period"], "tight": ["plan_period", "peer_group"]}))
    broad, tight = (stats.where(F.col("axis") == axis) for axis in ("broad", "tight"))
    median = broad.where("metric_name = 'assumed_return'").select("plan_id", "plan_period", F.col("peer_median").alias("peer_assumed_return_median"))
    closed = amortization_closed(F.col("amortization_method")).alias("amortization_is_closed")
    health = health_basis(inputs.join(median, ["plan_id", "plan_period"]).select("*", closed, F.col("discount_rate").alias("gasb_discount_rate"), F.col("net_external_cash_flow_pct").alias("net_cash_flow_pct")), bands)
    shown = {"rating": "health_rating", "basis": "health_basis", "dimension": "health_dimension_name", "value": "health_dimension_value"}
    scores = health.select("plan_id", "plan_period", *[F.col(a).alias(b) for a, b in shown.items()])
    less = lambda a, b: F.round(F.col(a) - finite(F.col(b)), 6)
    returns = F.col("metric_name").startswith("net_return_")
    rows = broad.join(tight.select(*keys, *[F.col(c).alias(f"tight_peer_{c}") for c in ("percentile", "quartile_rank", "z_score")]), keys).select(
        *keys, "metric_value", F.col("percentile").alias("peer_percentile"), F.col("quartile_rank").alias("peer_quartile_rank"), F.col("z_score").alias("peer_z_score"), "peer_median", less("metric_value", "peer_median").alias("delta_vs_peer_median"),
        F.when(returns, less("metric_value", "assumed_return")).alias("delta_vs_assumed_return"), F.when(returns, less("metric_value", "policy_benchmark_return")).alias("delta_vs_policy_benchmark"), "tight_peer_percentile", "tight_peer_quartile_rank", "tight_peer_z_score",
        F.coalesce(*[F.when(F.col("metric_name") == m, F.lit(dim)) for m, dim in HEALTH.items()]).alias("health_dimension_name"),
    )
    rows = rows.join(scores, ["plan_id", "plan_period", "health_dimension_name"], "left")
    dimensions = scores.select("plan_id", "plan_period", F.concat(F.lit("health_scorecard."), F.col("health_dimension_name")).alias("metric_name"), F.col("health_dimension_value").alias("metric_value"), *shown.values())
    return rows.unionByName(dimensions, allowMissingColumns=True)
