"""Queries of streams with keyed state and of the store of staged facts, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import shared_folder
from ..sources.store import FactStore, judged, upsert_into
from ..streaming import jobs, publications
from . import domain as D
from .oracle import sql

Query = Callable[[SparkSession, str], DataFrame]

BLOCK_ROWS = 20_000  # observations of a block of publication_stream, about
STAGED = "fact_id string, plan_id string, metric_name string, normalized_value double, asserted_at string, source_document_id string, superseded_at string, restated boolean"


def observations(s: SparkSession, d: str) -> DataFrame:
    e = D.table(s, d, "events")
    at = F.col("ts").cast("timestamp")
    return e.select(F.col("user_id").alias("system_id"), F.col("event_type").alias("source_id"), at.alias("observed_at"), F.col("event_id").alias("input_seq"), F.when(F.col("event_type") == "signup", at).alias("published_at"), F.col("props").alias("fingerprint"))


def arrivals(rows: DataFrame) -> list[DataFrame]:
    """Observations in three deliveries: by thirds of the month, some a delivery later than their time, some twice, and one row that ends the stream."""
    part = F.least(F.floor((F.dayofmonth("observed_at") - 1) / 10), F.lit(2)).cast("int")
    late = F.least(part + (F.col("input_seq") % 7 == 0).cast("int"), F.lit(2))
    again = F.when((F.col("input_seq") % 11 == 0) & (late < 2), F.array(late, late + 1)).otherwise(F.array(late))
    dealt = rows.withColumn("_part", F.explode(again))
    last = rows.agg((F.max("observed_at") + F.expr("INTERVAL 100 DAYS")).alias("observed_at")).where("observed_at IS NOT NULL")
    kinds = {f.name: f.dataType for f in rows.schema}
    last = last.select(*[F.col(c) if c == "observed_at" else F.lit(None).cast(k).alias(c) for c, k in kinds.items()])
    return [dealt.where(F.col("_part") == i).drop("_part") for i in range(2)] + [dealt.where("_part = 2").drop("_part").unionByName(last)]


def publication_stream(s: SparkSession, d: str) -> DataFrame:
    rows = observations(s, d)
    blocks = max(64, rows.count() // BLOCK_ROWS)

    def run(stream: DataFrame, folder: str):
        changes = publications.publication_changes(stream, late="30 days", blocks=blocks)
        return changes.writeStream.outputMode("append").foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/out/batch={n}"))

    with publications.rocks(s):
        folder = jobs.replay(arrivals(rows), run)
    rows = s.read.schema("system_id string, source_id string, published_at timestamp, batch int").parquet(f"{folder}/out")
    return rows.select(F.col("system_id").cast("long").alias("system_id"), "source_id", F.col("published_at").cast("timestamp_ntz").alias("published_at"))


def assertions(s: SparkSession, d: str) -> DataFrame:
    """Orders as assertions of what a plan's orders of a priority and year are worth, in hundred thousands, by month and status."""
    rows = D.plan_orders(s, d)
    none = F.lit(None).cast("string")
    return rows.select(
        F.concat_ws(":", "plan_id", "o_orderpriority", F.year("o_orderdate")).alias("fact_id"), "plan_id", F.col("o_orderpriority").alias("metric_name"), F.floor(F.col("o_totalprice") / 100000).cast("double").alias("normalized_value"),
        F.date_format("o_orderdate", "yyyy-MM-01").alias("asserted_at"), F.concat(F.lit("doc:"), "o_orderstatus").alias("source_document_id"), none.alias("superseded_at"), F.lit(False).alias("restated"), F.col("o_orderkey").alias("seq"),
    )


def ordered_upsert(s: SparkSession, d: str) -> DataFrame:
    rows = judged(s.createDataFrame([], STAGED), assertions(s, d), "seq", F.pmod(F.xxhash64("fact_id"), F.lit(64)).cast("int"))
    return rows.select("fact_id", "normalized_value", "asserted_at", "source_document_id", F.col("_decision").alias("decision"), "superseded_at", "restated")


def new_store(s: SparkSession) -> FactStore:
    return FactStore(s, f"{shared_folder(s)}/facts-{s.range(1).select(F.expr('uuid()')).first()[0]}", STAGED, 16)


def staging_store(s: SparkSession, d: str) -> DataFrame:
    """Three batches, one of them sent twice."""
    store, rows = new_store(s), assertions(s, d)
    for i in (0, 1, 1, 2):
        store.put(rows.where(F.col("seq") % 3 == i), f"batch-{i}", "seq")
    return store.facts()


def staging_stream(s: SparkSession, d: str) -> DataFrame:
    store, rows = new_store(s), assertions(s, d)
    jobs.replay([rows.where(F.col("seq") % 3 == i) for i in range(3)], lambda stream, _: stream.writeStream.foreachBatch(upsert_into(store, "seq")))
    return store.facts()


QUERIES: dict[str, Query] = {
    "r3_publication_changes": publication_stream,
    "b5_ordered_upsert": ordered_upsert,
    "k6_staging_store": staging_store,
    "r4_streamed_upsert": staging_stream,
}


def folded(order: str) -> str:
    """Every assertion judged against the last accepted one of its fact, by recursion along ``order``."""
    return f"""q AS (SELECT *, row_number() OVER (PARTITION BY fact_id ORDER BY {order}) AS n,
    fact_id || '@' || asserted_at || ':' || substr(sha1('{{"asserted_at": "' || asserted_at || '", "metric_name": "' || metric_name || '", "normalized_value": ' || CAST(normalized_value AS VARCHAR) || ', "plan_id": "' || plan_id
      || '", "restated": false, "source_document_id": "' || source_document_id || '", "superseded_at": null}}'), 1, 12) AS version
  FROM (SELECT plan_id || ':' || o_orderpriority || ':' || CAST(year(o_orderdate) AS VARCHAR) AS fact_id, plan_id, o_orderpriority AS metric_name, CAST(floor(o_totalprice / 100000) AS DOUBLE) AS normalized_value,
    strftime(o_orderdate, '%Y-%m-01') AS asserted_at, 'doc:' || o_orderstatus AS source_document_id, o_orderkey AS seq FROM plan_orders)),
fold AS (
  SELECT fact_id, n, 'insert' AS decision, fact_id AS new_id, n AS active, [fact_id] AS ids FROM q WHERE n = 1
  UNION ALL
  SELECT fact_id, n, decision, CASE WHEN decision = 'supersede' THEN version ELSE fact_id END, CASE WHEN decision = 'supersede' THEN n ELSE active END, CASE WHEN decision = 'supersede' THEN list_append(ids, version) ELSE ids END
  FROM (SELECT q.fact_id, q.n, q.version, f.active, f.ids, CASE WHEN q.asserted_at = a.asserted_at AND q.source_document_id = a.source_document_id THEN CASE WHEN q.normalized_value = a.normalized_value THEN 'skip' ELSE 'conflict' END
      WHEN list_contains(f.ids, q.version) THEN 'conflict' ELSE 'supersede' END AS decision
    FROM fold f JOIN q ON q.fact_id = f.fact_id AND q.n = f.n + 1 JOIN q a ON a.fact_id = f.fact_id AND a.n = f.active)
), judged AS (
  SELECT fold.new_id AS fact_id, q.plan_id, q.metric_name, q.normalized_value, q.asserted_at, q.source_document_id, fold.decision,
    CASE WHEN fold.decision IN ('insert', 'supersede') THEN lead(q.asserted_at) OVER (PARTITION BY q.fact_id, fold.decision IN ('insert', 'supersede') ORDER BY q.n) END AS superseded_at
  FROM fold JOIN q ON q.fact_id = fold.fact_id AND q.n = fold.n
), shown AS (SELECT *, decision = 'supersede' OR superseded_at IS NOT NULL AS restated FROM judged)"""


def recursive(query: str) -> str:
    """A query with the views that it needs and the folded assertions, as one recursive WITH."""
    base = sql("SELECT 1 FROM plan_orders")
    return base.replace("WITH ", "WITH RECURSIVE ", 1).rsplit("SELECT 1 FROM plan_orders", 1)[0].rstrip() + ",\n" + query


STORED = "SELECT fact_id, plan_id, metric_name, normalized_value, asserted_at, source_document_id, superseded_at, restated FROM shown WHERE decision IN ('insert', 'supersede')"

ORACLES: dict[str, str] = {
    "r3_publication_changes": sql("SELECT system_id, source_id, published_at FROM publications"),
    "b5_ordered_upsert": recursive(folded("seq") + "\nSELECT fact_id, normalized_value, asserted_at, source_document_id, decision, superseded_at, restated FROM shown"),
    "k6_staging_store": recursive(folded("seq % 3, seq") + "\n" + STORED),
    "r4_streamed_upsert": recursive(folded("seq % 3, seq") + "\n" + STORED),
}
