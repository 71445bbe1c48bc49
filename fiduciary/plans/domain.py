"""Views of the pension domain over the tables of the data folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


LINES = 500_000  # rows, such as lines of holdings, that a task joins and adds up: its memory stays as it is when the table grows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(spark: SparkSession, lines: int) -> int | None:
    """How many tasks that many lines need; None if the session's number of partitions is enough."""
    n = -(-lines // LINES)
    return n if n > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def dealt(df: DataFrame, lines: int, *keys: str) -> DataFrame:
    """The rows dealt by keys to as many tasks as that many lines need; few lines are left to the session's number of partitions."""
    n = tasks(df.sparkSession, lines)
    return df.repartition(n, *keys) if n else df


def met(df: DataFrame, lines: int, key: str, other: DataFrame, by: str) -> DataFrame:
    """The rows, that many lines, joined with another table, both dealt by the key; few lines are joined as Spark likes."""
    if tasks(df.sparkSession, lines) is None:
        return df.join(other, df[key] == other[by])
    left, right = dealt(df, lines, key), dealt(other, lines, by)
    return left.join(right.hint("merge"), left[key] == right[by])


def looked_up(df: DataFrame, lines: int, key: str, known: DataFrame, by: str) -> DataFrame:
    """The rows, that many lines, with their row of a table of keys, which goes to all tasks while it has no more rows than a task may hold."""
    if tasks(df.sparkSession, lines) and known.count() <= LINES:  # from the footers of its files
        return df.join(F.broadcast(known), df[key] == known[by])
    return met(df, lines, key, known, by)


def plan_dim(spark: SparkSession, d: str) -> DataFrame:
    """Plans with their peer group: 25 rows by the schema of the nation table."""
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    return nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select("n_nationkey", F.col("n_name").alias("plan_id"), F.col("r_name").alias("peer_group"))


def plan_orders(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").withColumn("plan_period", F.concat(F.lit("FY"), F.year("o_orderdate").cast("string")))
    customer = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    plans = plan_dim(spark, d)
    held = looked_up(orders, table(spark, d, "orders").count(), "o_custkey", customer, "c_custkey")
    return held.join(plans, held["c_nationkey"] == plans["n_nationkey"]).drop("c_custkey", "c_nationkey", "n_nationkey", "o_custkey")


def plan_funding(spark: SparkSession, d: str) -> DataFrame:
    price = F.col("o_totalprice").cast("decimal(18,2)")

    def part(condition) -> Column:
        return F.sum(F.when(condition, price)).cast("double")

    out = plan_orders(spark, d).groupBy("plan_id", "peer_group", "plan_period").agg(
        F.sum(price).cast("double").alias("total_usd"),
        F.coalesce(part(F.col("o_orderstatus") == "F"), F.lit(0.0)).alias("assets_usd"),
        part(F.col("o_orderpriority") == "1-URGENT").alias("employer_contributions_usd"),
        part(F.col("o_orderpriority") == "2-HIGH").alias("employee_contributions_usd"),
        part(F.col("o_orderpriority") == "3-MEDIUM").alias("benefit_payments_usd"),
        F.count(F.lit(1)).alias("n_orders"),
    )
    return out.withColumn("funded_ratio", F.col("assets_usd") / F.col("total_usd"))


def net() -> Column:
    return (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")


def line_count(spark: SparkSession, d: str) -> int:
    return table(spark, d, "lineitem").count()  # from the footers of its files


def position_lines(spark: SparkSession, d: str, names: bool = True, n: int | None = None) -> DataFrame:
    """Lines of holdings, ``n`` of them, with their plan, period and part, and with ``names`` their supplier."""
    n = line_count(spark, d) if n is None else n
    lines = table(spark, d, "lineitem").withColumn("net", net()).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_shipdate", "net")
    orders = plan_orders(spark, d).select("o_orderkey", "plan_id", "peer_group", "plan_period")
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_type")
    planned = dealt(met(lines, n, "l_orderkey", orders, "o_orderkey"), n, "l_partkey")
    held = looked_up(planned, n, "l_partkey", part, "p_partkey")
    if not names:
        return held
    return looked_up(held, n, "l_suppkey", table(spark, d, "supplier").select("s_suppkey", "s_name"), "s_suppkey")


def plan_allocation(spark: SparkSession, d: str) -> DataFrame:
    """Share of every asset class in a plan's holdings of a period."""
    classes = position_lines(spark, d, names=False).groupBy("plan_id", "peer_group", "plan_period", F.col("p_type").alias("asset_class")).agg(F.sum("net").alias("net"))
    return classes.select("plan_id", "peer_group", "plan_period", "asset_class", class_share().alias("allocation_pct"))


def class_share() -> Column:
    """Share of a class's net in that of its plan and period, in one row for each class."""
    return F.col("net").cast("double") / F.sum("net").over(Window.partitionBy("plan_id", "plan_period")).cast("double")


def least_flag(*flags: str) -> Column:
    """Where the least flag of a group lies: twice the number (from 1) of the one of ``flags``, which are in order, that it is, else an odd number. A least text would make Spark sort all rows."""
    flag, place = F.col("l_returnflag"), F
    for i, f in enumerate(flags, 1):
        place = place.when(flag < f, 2 * i - 1).when(flag == f, 2 * i)
    return F.min(place.when(flag.isNotNull(), 2 * len(flags) + 1))


def manager_fund_positions(spark: SparkSession, d: str) -> DataFrame:
    flag = least_flag("A", "N")
    state = F.when(flag == 4, "disclosed").when(flag == 2, "known_not_invested").otherwise("not_disclosed")
    exposure = F.when((F.min("l_linenumber") == 1) & (F.max("l_linenumber") == 1), None).otherwise(F.sum("net").cast("double"))
    n = line_count(spark, d)
    lines = dealt(position_lines(spark, d, n=n), n, "plan_id", "plan_period", "s_name", "p_brand")
    return lines.groupBy("plan_id", "plan_period", F.col("s_name").alias("manager_name"), F.col("p_brand").alias("fund_name")).agg(exposure.alias("exposure_usd"), state.alias("disclosure_state"))


def security_positions(spark: SparkSession, d: str, n: int | None = None, exact: bool = False) -> DataFrame:
    """Positions in securities; with ``exact`` also ``net``, their value as a decimal."""
    state = F.when(least_flag("R") == 2, "not_disclosed").otherwise("disclosed")
    held = position_lines(spark, d, names=False, n=n).groupBy("plan_id", "plan_period", "l_partkey", F.col("p_type").alias("asset_class")).agg(  # where the lines of a part lie
        F.sum("net").alias("net"), F.max("l_shipdate").alias("as_of"), state.alias("disclosure_state")
    )
    return held.select("plan_id", "plan_period", F.concat(F.lit("cusip:"), F.col("l_partkey").cast("string")).alias("security_id"), "asset_class", F.col("net").cast("double").alias("market_value_usd"), "as_of", "disclosure_state", *(["net"] if exact else []))


def benchmark_weights(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select(F.concat(F.lit("cusip:"), F.col("p_partkey").cast("string")).alias("security_id"), F.col("p_retailprice").cast("decimal(18,2)").alias("price"))
    total = part.agg(F.sum("price").cast("double").alias("total"))
    return part.join(F.broadcast(total)).select("security_id", (F.col("price").cast("double") / F.col("total")).alias("weight"))


def core_facts(spark: SparkSession, d: str) -> DataFrame:
    """Bitemporal facts: an order states its plan's priority total of a month until the next one does."""
    month = F.date_trunc("month", "o_orderdate")
    rows = plan_orders(spark, d).select("plan_id", F.col("o_orderpriority").alias("metric_name"), F.col("o_totalprice").alias("value"), month.alias("valid_from"), F.add_months(month, 1).cast("timestamp").alias("valid_to"), F.col("o_orderdate").alias("asserted_at"), F.col("o_orderkey").alias("input_seq"))
    w = Window.partitionBy("plan_id", "metric_name", "valid_from").orderBy("asserted_at", "input_seq")
    return rows.withColumn("superseded_at", F.lead("asserted_at").over(w))


def quality_points(spark: SparkSession, d: str) -> DataFrame:
    return plan_funding(spark, d).select("plan_id", F.col("plan_period").alias("period"), "funded_ratio", (F.lit(0.3) + F.lit(0.1) * (F.col("n_orders") % 7)).alias("confidence"))
