"""Mixing sources to target weights, with DataFrame functions only.

Words are summed per source, each source gets a target by weight (a source
stops at ``cap`` times its size and what is over is shared again by weight),
and a document is emitted floor(rate) times plus once more if a coin seeded by
its id falls below the fraction of the rate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

WORD = r"[^\x20\x09-\x0D]+"
#: Rows of the table of sources up to which it is broadcast; a larger one is joined by a shuffle.
BROADCAST_SOURCES = 50_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def coin(key: Column, seed: str) -> Column:
    """A number in [0, 1) from 52 bits of a digest of the key: the same in every run and on every partitioning."""
    bits = F.conv(F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(seed))), 1, 13), 16, 10)
    return bits.cast("double") / F.lit(float(16**13))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Target of every source, from rows (source, size).

    The level at which weight x level meets the budget is found by one pass
    over the sources in the order in which they fill up. The windows run over
    one row a source, after the documents have been summed up.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(ordered) - 1) % len(weights) + 1).cast("int"))
    t = total.withColumn("weight", weight.cast("double")).withColumn("budget", F.sum("source_size").over(everything) * F.lit(share))
    t = t.withColumn("most", F.col("source_size") * F.lit(cap)).withColumn("full_at", F.col("most") / F.col("weight"))
    filling = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    spent = F.coalesce(F.sum("most").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing))
    t = t.withColumn("level", (F.col("budget") - spent) / rest)
    open_level = F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", F.col("source").isNull(), "source", "level"))
    t = t.withColumn("final", F.min(open_level).over(everything)["level"])
    target = F.when(F.col("final").isNull() | (F.col("full_at") < F.col("final")), F.col("most")).otherwise(F.col("weight") * F.col("final"))
    rate = F.when(F.col("source_size") > 0, F.least(target / F.col("source_size"), F.lit(cap))).otherwise(F.lit(0.0))
    return t.select("source", "source_size", target.alias("target"), rate.alias("rate"))


def mixing_plan(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: str = "mix") -> DataFrame:
    """``docs`` with _size, _source_size, _target and _copies.

    A null text has size 0, a null source is a source of its own that comes
    last, null ids share one coin (as rows with the same id do), an empty table
    gives an empty result, and columns of any other name pass through.
    """
    sized = docs.withColumn("_size", words(F.col("text")))
    sources = cut(source_targets(sized.select("source", F.col("_size").alias("size")), weights, share, cap))
    sources = sources.select(F.col("source").alias("_source"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), F.col("rate").alias("_rate"))
    if len(sources.take(BROADCAST_SOURCES + 1)) <= BROADCAST_SOURCES:
        sources = F.broadcast(sources)
    joined = sized.join(sources, sized["source"].eqNullSafe(sources["_source"]), "left")
    whole = F.floor("_rate")
    extra = (coin(F.col("doc_id"), seed) < F.col("_rate") - whole).cast("long")
    return joined.withColumn("_copies", whole + extra).drop("_source", "_rate")


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus: every row of ``docs`` as many times as the mix takes it, with the columns of ``docs``."""
    plan = mixing_plan(docs, **how)
    return plan.where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select(*docs.columns)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing_plan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return plan.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_copies") * F.col("_size")).alias("taken"))


OP9_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), total AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, CAST([3, 1, 2][CAST((row_number() OVER (ORDER BY encode(source) ASC NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS DOUBLE) AS weight,
    CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 AS budget, source_size * CAST(2 AS DOUBLE) AS most FROM total
), filling AS (
  SELECT *, most / weight AS full_at,
    (budget - coalesce(sum(most) OVER (ORDER BY most / weight, encode(source) ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY most / weight, encode(source) ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed
), leveled AS (
  SELECT *, (SELECT level FROM filling WHERE level <= full_at ORDER BY full_at, encode(source) ASC NULLS LAST LIMIT 1) AS final FROM filling
), targets AS (
  SELECT source, source_size, CASE WHEN final IS NULL OR full_at < final THEN most ELSE weight * final END AS target FROM leveled
), rated AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 2.0) ELSE 0 END AS rate FROM targets
)
SELECT doc_id, size, source_size, target,
  CAST((floor(rate) + CASE WHEN CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || 'mix'), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM sized JOIN rated ON sized.source IS NOT DISTINCT FROM rated.source
"""
