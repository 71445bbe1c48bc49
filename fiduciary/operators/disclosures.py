"""Rows that plans disclose, by label, as facts in common units; run quality and refresh plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import asset_class, entity_token, finite, flow_sign, money_to_usd, rate_to_ratio

PLAN = ["plan_id", "plan_period"]

# Cash-flow fields with their direction.
FLOWS = {"beginning_aum": "balance", "ending_aum": "balance", "employer_contributions": "inflow", "employee_contributions": "inflow", "benefit_payments": "outflow", "refunds": "outflow"}


def financial_flows(labels: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """Cash flows of a plan's period from label rows (plan_id, plan_period, label, value, unit), one aggregate for all fields.

    Sums take what is known and are null if nothing is. The gap is what the
    ending balance has above the beginning one and the net flow; warnings are joined by commas. Of several
    rows with one label the greatest amount counts.
    """
    usd = money_to_usd(finite(F.col("value")), F.col("unit"))
    name = F.replace(entity_token(F.col("label")), F.lit(" "), F.lit("_"))
    wide = labels.select(*PLAN, name.alias("_name"), usd.alias("_usd")).groupBy(*PLAN).agg(*[flow_sign(F.max(F.when(F.col("_name") == f, F.col("_usd"))), F.lit(d)).alias(f) for f, d in FLOWS.items()])
    flows = [f for f, d in FLOWS.items() if d != "balance"]
    known = F.coalesce(*map(F.col, flows))
    net = F.when(known.isNotNull(), F.round(sum((F.coalesce(F.col(f), F.lit(0.0)) for f in flows), F.lit(0.0)), 6))
    n = sum((F.col(f).isNotNull().cast("int") for f in FLOWS), F.lit(0))
    level = F.when(n == len(FLOWS), "complete").when(n == 0, "not_disclosed").otherwise("partial")
    rows = wide.withColumns({"net_external_cash_flow_usd": net, "disclosure_level": level})
    rows = rows.withColumn("consistency_gap_usd", F.round(F.col("ending_aum") - F.round(F.col("beginning_aum") + F.col("net_external_cash_flow_usd"), 6), 6))
    apart = F.when(F.abs("consistency_gap_usd") > tolerance, "consistency_gap")
    warnings = F.concat_ws(",", F.when(F.col("disclosure_level") == "partial", "partial_disclosure").when(F.col("disclosure_level") == "not_disclosed", "not_disclosed"), apart)
    return rows.withColumns({"net_external_cash_flow_rate_pct": F.round(F.try_divide("net_external_cash_flow_usd", "beginning_aum") * 100, 6), "warnings": warnings})


def allocations(labels: DataFrame) -> DataFrame:
    """Allocation rows (label ``allocation:<class>``, percent_value, amount_value, unit): weight by percent, else share of the plan's amounts."""
    rows = labels.where(F.lower("label").startswith("allocation:")).select(
        *PLAN, asset_class(F.regexp_extract("label", r"(?s)^[^:]*:(.*)$", 1)).alias("category"), finite(F.col("percent_value")).alias("percent_value"), money_to_usd(finite(F.col("amount_value")), F.col("unit")).alias("amount_usd"),
    )
    total = F.sum(F.col("amount_usd").cast("decimal(28,6)")).over(Window.partitionBy(*PLAN)).cast("double")
    by_amount = F.when(total > 0, F.round(F.col("amount_usd") / total, 9))
    return rows.withColumn("weight", F.coalesce(rate_to_ratio(F.col("percent_value")), by_amount))


def manager_positions(labels: DataFrame) -> DataFrame:
    """Positions from label rows ``position:<manager>:<fund>:<field>`` with how complete they are.

    Keys are spelled as reported; ``ambiguous`` marks spellings that share one normalised key in a plan's period.
    """
    part = F.split("label", ":")
    rows = labels.where(F.lower("label").startswith("position:") & (F.size(part) == 4)).select(*PLAN, F.btrim(part[1]).alias("manager_name"), F.btrim(part[2]).alias("fund_name"), F.lower(F.btrim(part[3])).alias("_f"), finite(F.col("value")).alias("_v"))
    fields = ["commitment", "unfunded", "market_value"]
    wide = rows.groupBy(*PLAN, "manager_name", "fund_name").agg(*[F.max(F.when(F.col("_f") == f, F.col("_v"))).alias(f) for f in fields])
    n = sum((F.col(f).isNotNull().cast("int") for f in fields), F.lit(0))
    manager, fund = F.col("manager_name") != "", F.col("fund_name") != ""
    state = F.when(manager & fund & (n == 3), "complete").when(manager | fund | (n > 0), "partial").otherwise("not_disclosed")
    key = [*PLAN, "_m", "_k"]
    wide = wide.withColumns({"completeness": state, "_m": entity_token(F.col("manager_name")), "_k": entity_token(F.col("fund_name"))})
    return wide.withColumn("ambiguous", F.count(F.lit(1)).over(Window.partitionBy(*key)) > 1).drop("_m", "_k")


def security_id(cusip: Column, ticker: Column, name: Column) -> Column:
    """Id by CUSIP, else ticker, else name; null if all are blank."""
    filled = lambda c: F.nullif(F.btrim(c), F.lit(""))
    c = filled(F.upper(F.regexp_replace(cusip, "[^A-Za-z0-9]", "")))
    return F.coalesce(F.concat(F.lit("cusip:"), c), F.concat(F.lit("ticker:"), F.upper(filled(ticker))), F.concat(F.lit("name:"), F.regexp_replace(F.lower(filled(name)), r"\s+", " ")))


# Cells that stand for no number.
NOT_AVAILABLE = ["", "na", "n/a", "nan", "null", "none", "."]


def cell_number(cell: Column) -> Column:
    """A number from a cell of a survey: commas go, tokens for no value and what is not finite are null."""
    text = F.btrim(F.replace(cell, F.lit(","), F.lit("")))
    return F.when(~F.lower(text).isin(NOT_AVAILABLE), finite(text.try_cast("double")))


def whole(cell: Column) -> Column:
    """An id or year that may be written as 123.0; null unless it is integral."""
    v = cell_number(cell)
    return F.when(v == F.floor(v), v.cast("bigint"))


def funded_fraction(direct: Column, assets: Column, liabilities: Column) -> Column:
    """Funded ratio as a fraction (over 3 counts as percent), else assets by liabilities."""
    return F.coalesce(F.when(direct > 3, direct / 100).otherwise(direct), F.when(liabilities != 0, assets / liabilities))


def run_sla(runs: DataFrame) -> DataFrame:
    """Rates and lags of a run; 0 where the denominator is not positive or a part is not finite."""
    def ratio(a: str, b: str, factor: int = 1) -> Column:
        top, base = finite(F.col(a).cast("double")), finite(F.col(b).cast("double"))
        return F.coalesce(F.when(base > 0, F.round(top * factor / base, 6)), F.lit(0.0))

    lag = (F.unix_micros(F.col("run_started_at").cast("timestamp")) - F.unix_micros(F.col("source_published_at").cast("timestamp"))) / 3.6e9
    return runs.select(
        "run_id", ratio("records_complete", "records_total").alias("completeness_rate"), F.round(F.greatest(lag, F.lit(0.0)), 6).alias("freshness_lag_hours"), ratio("review_wait_hours", "review_items").alias("review_queue_latency_hours"),
        ratio("parse_warnings", "records_total").alias("parse_warning_rate"), ratio("cited_facts", "total_pages", 10).alias("citation_density_per_10_pages"),
    )


RATES = {
    "completeness_rate": ("records_complete", "records_total", 1), "review_queue_latency_hours": ("review_queue_wait_hours_sum", "review_queue_items", 1), "parse_warning_rate": ("parse_warning_count", "records_total", 1),
    "citation_density_per_10_pages": ("cited_facts", "total_pages", 10), "source_mismatch_rate": ("source_mismatch_count", "records_total", 1), "unresolved_official_source_rate": ("unresolved_official_source_count", "records_total", 1),
    "manager_disclosure_coverage_rate": ("manager_disclosure_covered", "manager_disclosure_total", 1), "consultant_disclosure_coverage_rate": ("consultant_disclosure_covered", "consultant_disclosure_total", 1),
}


def run_rates(runs: DataFrame) -> DataFrame:
    """All nine figures of a run's quality (run_id, two times and thirteen counts): eight rates and the hours from publishing to the run.

    A rate is 0 where its parts are not finite or the denominator is not
    positive; a run before its source was published has no lag.
    """
    def rate(a: str, b: str, factor: int) -> Column:
        top, base = finite(F.col(a).cast("double")), finite(F.col(b).cast("double"))
        return F.coalesce(F.when(base > 0, finite(top * factor / base)), F.lit(0.0))

    lag = (F.unix_micros(F.col("run_started_at").cast("timestamp")) - F.unix_micros(F.col("source_published_at").cast("timestamp"))) / 3.6e9
    return runs.select("run_id", F.greatest(lag, F.lit(0.0)).alias("freshness_lag_hours"), *[rate(*parts).alias(name) for name, parts in RATES.items()])


def refresh_windows(profiles: DataFrame, last: DataFrame, as_of: str, shortest: float = 7.0, longest: float = 120.0) -> DataFrame:
    """When a source should be read next: its usual gap after the last publication, moved to a month in which it publishes.

    The window lies between ``shortest`` and ``longest`` days after the last
    publication and not before ``as_of``; the less regular the source, the
    wider it is. Months come as text joined by commas.
    """
    seconds = lambda days: F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.round(days * 86400, 0).cast("decimal(18,6)"))
    now = F.lit(as_of).cast("timestamp_ntz")
    months = F.filter(F.transform(F.split("months", ","), lambda m: m.try_cast("int")), lambda m: m.isNotNull())

    def anchored(target: Column) -> Column:
        base = F.greatest(target, now)
        starts = F.transform(F.col("_months"), lambda m: F.make_date(F.year(base) + (m < F.month(base)).cast("int"), m, F.lit(1)))
        return F.when((F.size("_months") == 0) | F.array_contains("_months", F.month(target)), target).otherwise(F.array_min(starts).cast("timestamp_ntz"))

    rows = profiles.join(last.select("system_id", "source_id", F.col("published_at").cast("timestamp_ntz").alias("_seen")), ["system_id", "source_id"])
    rows = rows.withColumns({"_months": months, "_days": F.greatest(F.lit(shortest), F.least(F.lit(longest), F.col("frequency_days")))})
    rows = rows.withColumn("_floor", F.greatest(now, F.col("_seen") + seconds(F.lit(shortest)))).withColumn("_ceiling", F.greatest("_floor", F.col("_seen") + seconds(F.lit(longest))))
    rows = rows.withColumn("_target", anchored(F.col("_seen") + seconds(F.col("_days"))))
    rows = rows.withColumn("_target", F.when((F.col("_target") < now) & (F.size("_months") > 0), anchored(now)).otherwise(F.col("_target")))
    rows = rows.withColumn("_target", F.greatest("_floor", F.least("_ceiling", "_target")))
    jitter = F.col("_days") * (0.05 + (1 - F.col("confidence")) * 0.30)
    rows = rows.withColumn("next_run_earliest", F.greatest("_floor", F.least(F.col("_ceiling"), F.col("_target") - seconds(jitter))))
    rows = rows.withColumn("next_run_latest", F.greatest("next_run_earliest", F.least(F.col("_ceiling"), F.col("_target") + seconds(jitter))))
    return rows.select("system_id", "source_id", F.round("_days", 3).alias("recommended_interval_days"), "next_run_earliest", "next_run_latest", F.col("confidence").alias("profile_confidence"))
