"""The store of staged facts: upserts by batch, versions that readers see whole.

A store is a folder of data and a manifest, both written by Spark, so any file
system does. Facts lie in buckets by the hash of their base id. A batch reads
and rewrites only the buckets of its facts, into a folder of its own version;
then one small file is added to the manifest, which moves into place at once
when its job commits. Until then readers see the version before, and a write
that was killed leaves files that no manifest names. One writer at a time.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from hashlib import sha1

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.shared import cut

KEPT = ("held", "closed", "insert", "supersede")


def base_id(fact_id: Column) -> Column:
    """The id of a fact without the assertion that its versions carry behind an @."""
    return F.substring_index(fact_id, "@", 1)


def judged(store: DataFrame, batch: DataFrame, order: str, bucket: Column) -> DataFrame:
    """What becomes of every row of a batch, one after the other, against the last accepted one of its fact.

    ``store`` and ``batch`` have the same columns, with fact_id, asserted_at,
    source_document_id, superseded_at (strings) and restated; ``batch`` has
    ``order`` too, ids without @. Returns those columns with _decision and
    _bucket: stored rows that stay (held) or are superseded now (closed), and
    batch rows as

    - insert: no assertion of the fact is active
    - skip: the active one says the same, or the id is taken and nothing is active
    - conflict: the active one has the same time and source and says something
      else, or the version's id was given before
    - supersede: a new version, whose id is base@asserted_at:digest

    Rows of one fact are sorted by Spark and read as a stream; what is held in
    memory is its active rows and the ids of its versions. An empty asserted_at
    or valid_from takes ingestion_date or effective_date, where those exist.
    """
    columns = store.columns
    said = [c for c in columns if c not in ("fact_id", "restated")]
    fallback = [(a, b) for a, b in (("valid_from", "effective_date"), ("asserted_at", "ingestion_date")) if a in columns and b in columns]
    kinds = StructType([store.schema[c] for c in columns]).add("_decision", "string").add("_bucket", "integer")
    schema = to_arrow_schema(kinds)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fact, active, ids, out = None, [], set(), []

        def done() -> list[dict]:
            return [{**r, "_decision": r.get("_decision") or "held"} for r in active]

        def judge(row: dict, base: str, bucket: int) -> None:
            nonlocal active
            digest = sha1(json.dumps({c: row[c] for c in columns if c != "fact_id"}, default=str, sort_keys=True).encode()).hexdigest()[:12]
            version = f"{base}@{row['asserted_at'] or row.get('ingestion_date') or ''}:{digest}"
            for a, b in fallback:
                row[a] = row[a] or row[b]
            row["restated"] = bool(row["restated"] or row["superseded_at"])
            values = [row[c] for c in said]
            now = max(active, key=lambda r: (r["fact_id"] == base, r["asserted_at"] or "", r["fact_id"]), default=None)
            if now is None:
                decision, new = ("skip", row) if base in ids else ("insert", row)
            else:
                new = {**row, "fact_id": version, "restated": True}
                same = [now[c] for c in said] == values and (now["fact_id"], now["restated"]) in ((base, row["restated"]), (version, True))
                source = all(now[c] == row[c] for c in ("asserted_at", "source_document_id"))
                decision = "skip" if same else "conflict" if source or version in ids else "supersede"
            if decision == "supersede":
                out.extend({**r, "superseded_at": row["asserted_at"], "restated": True, "_decision": r.get("_decision") or "closed"} for r in active)
                active = []
            if decision in ("skip", "conflict"):
                out.append({**row, "_decision": decision, "_bucket": bucket})
            else:
                ids.add(new["fact_id"])
                active.append({**new, "_decision": decision, "_bucket": bucket})
                if new["superseded_at"]:
                    out.append(active.pop())

        for batch in batches:
            for r in batch.to_pylist():
                base, stored, row = r["_base"], r["_stored"], {c: r[c] for c in columns}
                if base != fact:
                    out.extend(done())
                    fact, active, ids = base, [], set()
                if not stored:
                    judge(row, base, r["_bucket"])
                    continue
                ids.add(row["fact_id"])
                if (row["superseded_at"] or "").strip():
                    out.append({**row, "_decision": "held", "_bucket": r["_bucket"]})
                else:
                    active.append({**row, "_bucket": r["_bucket"]})
            yield pa.RecordBatch.from_pylist(out, schema)
            out.clear()
        yield pa.RecordBatch.from_pylist(out + done(), schema)

    old = store.select(*columns, F.lit(True).alias("_stored"), F.lit(0).cast("long").alias("_order"))
    new = batch.select(*columns, F.lit(False).alias("_stored"), F.col(order).cast("long").alias("_order"))
    rows = old.unionByName(new).withColumn("_base", base_id(F.col("fact_id"))).withColumn("_bucket", bucket)
    return rows.repartition("_bucket").sortWithinPartitions("_bucket", "_base", F.desc("_stored"), "_order", "fact_id").mapInArrow(fold, kinds)


class FactStore:
    """Facts of one schema under ``path``, in ``buckets`` buckets (size them to a task's memory)."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)

    def manifest(self) -> DataFrame:
        """Rows (version, batch, bucket, folder) of all versions; a version's rows tell the folders of the buckets that it wrote."""
        kinds = "version long, batch string, bucket int, folder string"
        try:
            return self.spark.read.schema(kinds).parquet(f"{self.path}/manifest")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], kinds)

    def version(self) -> int:
        return self.manifest().agg(F.max("version")).first()[0] or 0

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(base_id(F.col("fact_id"))), F.lit(self.buckets)).cast("int")

    def facts(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """All facts of a version (by default the last), or those of some buckets."""
        rows = self.manifest().where("bucket IS NOT NULL")
        if version is not None:
            rows = rows.where(F.col("version") <= version)
        if buckets is not None:
            rows = rows.where(F.col("bucket").isin(buckets))
        folders = [r["folder"] for r in rows.groupBy("bucket").agg(F.max_by("folder", "version").alias("folder")).collect()]  # a row a bucket
        paths = [f"{self.path}/{f}" for f in folders]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def conflicts(self, version: int) -> DataFrame:
        """Batch rows that a version's write refused."""
        try:
            return self.spark.read.schema(self.schema).parquet(f"{self.path}/refused/version={version}")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], self.schema)

    def put(self, batch: DataFrame, name: str, order: str, refuse: bool = False) -> int:
        """Upsert a batch and return how many assertions it added; a batch whose name the manifest has adds nothing.

        Rows that conflict are written beside the version, or with ``refuse``
        make the whole batch fail and change nothing. An empty batch is noted.
        """
        done = self.manifest()
        if not done.where(F.col("batch") == name).isEmpty():
            return 0
        version = self.version() + 1
        touched = [r[0] for r in batch.select(self.bucket()).distinct().collect()]  # at most a row a bucket
        if touched:
            rows = cut(judged(self.facts(version - 1, touched), batch, order, self.bucket()))
            counts = {r["_decision"]: r["count"] for r in rows.groupBy("_decision").count().collect()}
            if refuse and counts.get("conflict"):
                raise ValueError(f"batch {name}: {counts['conflict']} rows conflict with assertions of the same time and source")
            columns = [f.name for f in self.schema]
            kept = rows.where(F.col("_decision").isin(*KEPT)).select(*columns, F.col("_bucket").alias("bucket"))
            kept.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/version={version}")
            rows.where("_decision = 'conflict'").select(*columns).write.mode("overwrite").parquet(f"{self.path}/refused/version={version}")
        self.commit(version, name, touched)
        return counts.get("insert", 0) + counts.get("supersede", 0) if touched else 0

    def commit(self, version: int, name: str, touched: list[int]) -> None:
        """One file that names the version's folders: the version exists from when it is moved into place."""
        rows = [(version, name, k, f"data/version={version}/bucket={k}") for k in touched] or [(version, name, None, None)]
        self.spark.createDataFrame(rows, "version long, batch string, bucket int, folder string").coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")


def upsert_into(store: FactStore, order: str):
    """For ``foreachBatch``: a micro-batch that comes again after a failure adds nothing."""

    def put(batch: DataFrame, number: int) -> None:
        store.put(batch, f"stream-{number}", order)

    return put
