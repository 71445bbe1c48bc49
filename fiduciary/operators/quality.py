"""Anomalies, confidence, coverage, service levels and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clamp_confidence, entity_token, period_year
from ..functions.shared import cut, few


def shifts(points: DataFrame, key: list[str], value: str, metric: Column, warning: float, critical: float, medium: float = 0.75) -> DataFrame:
    """Points that moved by ``warning`` or more from the one before, with severity, score and review priority; an unknown confidence counts as 0."""
    w = Window.partitionBy("plan_id", *key).orderBy(period_year(F.col("period")).asc_nulls_last(), "period")
    shift = F.round(F.abs(F.col(value) - F.lag(value).over(w)), 6)
    span = max(critical - warning, 1e-9) if critical != warning else 1.0
    rows = points.withColumn("shift", shift).where(F.col("shift") >= warning)
    severe = F.col("shift") >= critical
    excess = F.when(severe, 1 + (F.col("shift") - critical) / span).otherwise((F.col("shift") - warning) / span)
    score = F.round(excess * (0.5 + 0.5 * F.coalesce(clamp_confidence(F.col("confidence")), F.lit(0.0))), 6)
    sure = F.coalesce(F.col("confidence") >= medium, F.lit(False))
    return rows.select(
        "plan_id", "period", metric.alias("metric"), "shift", score.alias("score"), F.when(severe, "critical").otherwise("warning").alias("severity"),
        F.when(severe & sure, "high").when(severe | sure, "medium").otherwise("low").alias("priority"),
    )


def review_queue(anomalies: DataFrame) -> DataFrame:
    """Anomalies as rows for review."""
    from ..functions.scalars import stable_id

    return anomalies.select(stable_id("review", F.col("plan_id"), F.col("period"), F.col("metric")).alias("review_id"), "plan_id", "period", "metric", F.concat(F.col("severity"), F.lit(" shift in "), F.col("metric")).alias("reason"), "priority", F.lit("pending").alias("state"))


def coverage_by_cohort(observations: DataFrame, flags: list[str]) -> DataFrame:
    """Share of rows with each flag by cohort and period, by cohort, and over all (null keys)."""
    return observations.rollup("cohort", "period").agg(F.count(F.lit(1)).alias("n_total"), *[F.round(F.count_if(F.col(x)) / F.count(F.lit(1)), 6).alias(f"{x}_rate") for x in flags])


def window_report(telemetry: DataFrame, window: Column) -> DataFrame:
    """Count, least, largest and mean value of every metric in every window, and the runs that sent it."""
    g = telemetry.groupBy(window.alias("window_start"), "metric")
    return g.agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.round(F.sum(F.col("value").cast("decimal(18,6)")).cast("double") / F.count(F.lit(1)), 6).alias("avg_value"), F.concat_ws(",", F.transform(F.array_sort(F.collect_set("run_id")), lambda x: x.cast("string"))).alias("run_ids"))


def sla_gate(observed: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Every threshold (metric, op, limit, critical) against what was observed; a missing metric is a breach."""
    ok = F.when(F.col("op") == ">=", F.col("observed") >= F.col("limit")).otherwise(F.col("observed") <= F.col("limit"))
    rows = thresholds.join(observed.select("metric", F.col("value").alias("observed")), "metric", "left").withColumn("breach", ~F.coalesce(ok, F.lit(False)))
    return rows.select("metric", "op", "limit", "critical", "observed", "breach", (F.col("breach") & F.col("critical")).alias("fails"))


def ranked_values(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """For every group the values at nearest rank: one column a share, nulls being the smallest.

    Equal values are counted first. The counts are range-partitioned by group
    and value, so that a large group fills many partitions; what lies before a
    partition is added from the partitions' sums, of which there is one for each
    group that a partition holds.
    """
    counts = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    placed = cut(counts.repartitionByRange(*by, value).withColumn("_part", F.spark_partition_id()))
    sums = placed.groupBy(*by, "_part").agg(F.sum("_n").alias("_sum"))
    group = Window.partitionBy(*by)
    earlier = F.coalesce(F.sum("_sum").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.withColumns({"_before": earlier, "_total": F.sum("_sum").over(group)}).drop("_sum")
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"s.{c}")) for c in [*by, "_part"]]
    joined = placed.alias("p").join(starts.alias("s"), same).select(*[F.col(f"p.{c}").alias(c) for c in [*by, value, "_n", "_part"]], "_before", "_total")
    within = Window.partitionBy(*by, "_part").orderBy(value)
    up_to = F.col("_before") + F.sum("_n").over(within)
    ranked = joined.withColumn("_last", up_to - 1).withColumn("_first", F.col("_last") - F.col("_n") + 1)
    picks = [F.max(F.when(F.bround((F.col("_total") - 1) * q, 0).between(F.col("_first"), F.col("_last")), F.col(value))).alias(name) for name, q in shares.items()]
    return ranked.groupBy(*by).agg(*picks)


def operation_summary(log: DataFrame, by: list[str]) -> DataFrame:
    """Requests, failures, mean latency and the nearest-rank 95th percentile."""
    sums = log.groupBy(*by).agg(F.count(F.lit(1)).alias("total_requests"), F.count_if(F.col("status") == "error").alias("failed_requests"), F.round(F.sum("latency_ms") / F.count(F.lit(1)), 6).alias("avg_latency_ms"))
    ranks = ranked_values(log, by, "latency_ms", {"p95_latency_ms": 0.95}).withColumn("p95_latency_ms", F.col("p95_latency_ms").cast("double"))
    return beside(sums, ranks, by)


def beside(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Two tables of one row a group side by side."""
    more = [c for c in right.columns if c not in by]
    return left.alias("l").join(right.alias("r"), [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by]).select("l.*", *[F.col(f"r.{c}").alias(c) for c in more])


def wilson(successes: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Bounds of a rate, round 6."""
    p = successes / n
    base, middle = 1 + z * z / n, p + z * z / (2 * n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.round(F.greatest(F.lit(0.0), (middle - half) / base), 6), F.round(F.least(F.lit(1.0), (middle + half) / base), 6)


def model_benchmark(cases: DataFrame, by: list[str]) -> DataFrame:
    """Success, false-pass and false-fail rates of predictions, with the bounds of the success rate."""
    right = F.count_if(F.col("expected") == F.col("predicted"))
    n = F.count(F.lit(1))
    low, high = wilson(right, n)
    return cases.groupBy(*by).agg(n.alias("n"), F.round(right / n, 6).alias("success_rate"), low.alias("success_low"), high.alias("success_high"), F.round(F.count_if((F.col("expected") == 0) & (F.col("predicted") == 1)) / n, 6).alias("false_pass_rate"), F.round(F.count_if((F.col("expected") == 1) & (F.col("predicted") == 0)) / n, 6).alias("false_fail_rate"))


def snapshot_diff(before: DataFrame, after: DataFrame, key: list[str], value: str) -> DataFrame:
    """Rows that were added, removed or changed between two snapshots."""
    a = before.select(*key, F.col(value).alias("before"), F.lit(True).alias("_a"))
    b = after.select(*key, F.col(value).alias("after"), F.lit(True).alias("_b"))
    both = a.join(b, key, "full_outer")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    return both.withColumn("change", change).where("change IS NOT NULL").select(*key, "before", "after", "change")


def quantile_summary(draws: DataFrame, by: list[str]) -> DataFrame:
    """Mean and nearest-rank 5th and 95th percentiles of value."""
    means = draws.groupBy(*by).agg(F.round(F.sum(F.col("value").cast("decimal(18,6)")).cast("double") / F.count(F.lit(1)), 6).alias("mean"))
    return beside(means, ranked_values(draws, by, "value", {"p05": 0.05, "p95": 0.95}), by)


def preferred_aliases(names: DataFrame) -> DataFrame:
    """One spelling for every normalised name: mixed case before capitals, then by lower case and spelling."""
    rows = names.withColumn("norm", entity_token(F.col("name"))).where("norm <> ''")
    order = F.struct((F.col("name") == F.upper("name")).alias("u"), F.lower("name").alias("l"), F.col("name").alias("n"))
    return rows.groupBy("norm").agg(F.min_by("name", order).alias("preferred"), F.count(F.lit(1)).alias("n_seen"))


def alias_candidates(sources: DataFrame, entities: DataFrame, least: float = 0.86, fuzzy: float | None = None) -> DataFrame:
    """Candidates by name: exact with confidence 1, by Jaccard overlap of tokens of ``least`` or more, else by similar spelling.

    Two token sets that overlap so far share one of the rarest tokens of each,
    as many as the overlap may leave out and one more; pairs meet on these
    only. With ``fuzzy``, spellings meet on the rarest two of the first three letters of a name's tokens and count by one less
    the edits per letter of the longer name, from ``fuzzy`` up. Names are
    compared once however many rows have them.
    """
    def tokens(c: Column) -> Column:
        return F.array_distinct(F.split(c, " "))

    s = sources.select("source_name", entity_token(F.col("source_name")).alias("_s")).where("_s <> ''").distinct()
    e = entities.select("stable_id", entity_token(F.col("alias")).alias("_e")).where("_e <> ''").distinct()
    names = s.select(F.col("_s").alias("n")).union(e.select(F.col("_e").alias("n"))).distinct()
    held = names.select("n", F.explode(tokens(F.col("n"))).alias("t"))
    often = held.groupBy("t").agg(F.count(F.lit(1)).alias("c"))
    rarest = held.join(often, "t").groupBy("n").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "t"))), lambda x: x["t"]).alias("ts"))
    n = F.size("ts")
    keys = rarest.select("n", F.explode(F.slice("ts", F.lit(1), n - F.ceil(n * F.lit(least) - 1e-9).cast("int") + 1)).alias("k"))
    a, b = s.join(keys, s["_s"] == keys["n"]).drop("n"), e.join(keys, e["_e"] == keys["n"]).drop("n")
    overlap = F.round(F.size(F.array_intersect(tokens(F.col("_s")), tokens(F.col("_e")))) / F.size(F.array_union(tokens(F.col("_s")), tokens(F.col("_e")))), 4)
    near = a.join(b, "k").select("source_name", "stable_id", F.when(F.col("_s") == F.col("_e"), 1.0).otherwise(overlap).alias("confidence"), F.when(F.col("_s") == F.col("_e"), "exact").otherwise("normalized").alias("strategy"))
    if fuzzy is None:
        return best_of(near.where(F.col("confidence") >= least))
    starts = held.select("n", F.substring("t", 1, 3).alias("k")).distinct()
    rare = starts.groupBy("k").agg(F.count(F.lit(1)).alias("c"))
    two = F.slice(F.array_sort(F.collect_list(F.struct("c", "k"))), 1, 2)  # one of them may be misspelt
    key = starts.join(rare, "k").groupBy("n").agg(two.alias("_two")).select("n", F.explode(F.transform("_two", lambda x: x["k"])).alias("k"))
    a, b = s.join(key, s["_s"] == key["n"]).drop("n"), e.join(starts, e["_e"] == starts["n"]).drop("n")
    alike = F.round(1 - F.levenshtein("_s", "_e") / F.greatest(F.length("_s"), F.length("_e")), 4)
    spelt = a.join(b, "k").where("_s <> _e").where(overlap < least).select("source_name", "stable_id", alike.alias("confidence"), F.lit("fuzzy").alias("strategy"))
    return best_of(near.where(F.col("confidence") >= least).union(spelt.where(F.col("confidence") >= fuzzy)))


def best_of(scored: DataFrame) -> DataFrame:
    """The surest candidate row of every name and entity."""
    return scored.groupBy("source_name", "stable_id").agg(F.max("confidence").alias("confidence"), F.max_by("strategy", F.struct("confidence", "strategy")).alias("strategy"))


def alias_routing(sources: DataFrame, candidates: DataFrame, link: float = 0.92, gap: float = 0.08) -> DataFrame:
    """Link a name to its best candidate if that is sure and clear of the next one, else leave it for review."""
    w = Window.partitionBy("source_name").orderBy(F.desc("confidence"), "stable_id")
    best = candidates.withColumn("_n", F.row_number().over(w)).withColumn("_next", F.lead("confidence").over(w)).where("_n = 1")
    rows = sources.select("source_name").distinct().join(best, "source_name", "left")
    clear = (F.col("confidence") >= link) & (F.col("confidence") - F.coalesce("_next", F.lit(0.0)) >= gap)
    decision = F.when(clear, "auto_link").otherwise("review")
    reason = F.when(F.col("confidence").isNull(), "no_candidate").when(clear, "linked").when(F.col("confidence") < link, "low_confidence").otherwise("ambiguous")
    return rows.select("source_name", F.when(clear, F.col("stable_id")).alias("stable_id"), F.col("confidence"), decision.alias("decision"), reason.alias("reason"))


def lifecycle(positions: DataFrame, tasks: int | None = None) -> DataFrame:
    """Managers and funds that a plan entered, kept or left, by presence in consecutive years.

    With ``tasks`` names are dealt to that many tasks, once for all steps, instead of the session's number of partitions.
    """
    year = period_year(F.col("plan_period"))
    named = positions.select("plan_id", year.alias("year"), entity_token(F.col("manager_name")).alias("manager"), entity_token(F.col("fund_name")).alias("fund"))
    held = (named.repartition(tasks, "plan_id", "manager", "fund") if tasks else named).distinct()
    in_order = Window.partitionBy("plan_id", "manager", "fund").orderBy("year")
    runs = held.withColumns({"_previous": F.lag("year").over(in_order), "_next": F.lead("year").over(in_order)})
    span = held.groupBy("plan_id").agg(F.min("year").alias("_first"), F.max("year").alias("_last"))
    here = F.when(F.col("_previous") == F.col("year") - 1, "still_invested").otherwise("entered")
    left = F.when((F.coalesce("_next", F.lit(-1)) != F.col("year") + 1) & (F.col("year") < F.col("_last")), F.col("year") + 1)
    states = F.array(F.struct(F.when(F.col("year") > F.col("_first"), F.col("year")).alias("year"), here.alias("state")), F.struct(left.alias("year"), F.lit("exited").alias("state")))
    rows = runs.join(F.broadcast(span), "plan_id").select("plan_id", "manager", "fund", F.explode(F.filter(states, lambda x: x["year"].isNotNull())).alias("_s"))
    return rows.select("plan_id", "_s.year", "manager", "fund", "_s.state")


def clean_lines(docs: DataFrame) -> DataFrame:
    """Lines of documents by page (form feeds), white space made single, without empty lines and page numbers."""
    pages = docs.select("doc_id", F.posexplode(F.split("text", "\f")).alias("page", "_page"))
    lines = pages.select("doc_id", (F.col("page") + 1).alias("page"), F.posexplode(F.split("_page", "\n")).alias("line_no", "_line"))
    text = F.trim(F.regexp_replace("_line", r"\s+", " "))
    return lines.select("doc_id", "page", "line_no", text.alias("line")).where((F.col("line") != "") & ~F.lower("line").rlike(r"^(page )?[0-9]+( of [0-9]+)?$"))


def label_values(lines: DataFrame) -> DataFrame:
    """Label and rightmost value of lines in columns (bars) or of the form "label: value"."""
    columns = F.filter(F.transform(F.split("line", r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    figures = F.filter(F.slice(columns, F.lit(2), F.greatest(F.size(columns) - 1, F.lit(0))), lambda x: x.rlike(r"^[-+$(]*[0-9][0-9,.]*[%)]*$") & ~x.rlike(r"^(19|20)[0-9]{2}$"))
    label = F.when(F.size(columns) > 1, F.get(columns, F.lit(0))).otherwise(F.regexp_extract("line", r"^([^:|]{1,80}): *\S", 1))
    value = F.when(F.size(columns) > 1, F.try_element_at(figures, F.lit(-1))).otherwise(F.regexp_extract("line", r"^[^:|]{1,80}: *([-+$(]*[0-9][0-9,.]*[%)]*)$", 1))
    return lines.select("doc_id", "page", "line_no", label.alias("label"), value.alias("value")).where("label <> '' AND value <> ''")


def scenarios(metrics: DataFrame, cases: DataFrame) -> DataFrame:
    """Every baseline metric under every scenario (name, shocks map, return_override); the scenario table, which people write, is broadcast up to a bound."""
    shocked = F.col("value") + F.coalesce(F.try_element_at("shocks", F.col("metric_name")), F.lit(0.0))
    value = F.when((F.col("metric_name") == "net_return") & F.col("return_override").isNotNull(), F.col("return_override")).otherwise(shocked)
    return metrics.join(few(cases)).select("plan_id", "plan_period", "metric_name", F.col("name").alias("scenario"), F.round("value", 6).alias("baseline_value"), F.round(value, 6).alias("scenario_value"), F.round(value - F.col("value"), 6).alias("delta_value"))
