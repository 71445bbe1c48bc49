"""Snapshots of extracted fields: the scan of their files, with a channel of rejects, and what changed from one to the next."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Header:
    """What a snapshot's file has to say of itself."""

    artifact_type: str = "pension_replay_baseline"
    schema_version: int = 1
    baseline_version: str = "v1"


FIELD = "snapshot string, document_id string, field string, value string, confidence double, evidence string"


def kind(v: Column) -> Column:
    """object, array, string, number, boolean, null (a JSON null) or missing."""
    s = F.schema_of_variant(v)
    return (
        F.when(v.isNull(), "missing").when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array").when(s == "STRING", "string").when(s == "VOID", "null").when(s == "BOOLEAN", "boolean").otherwise("number")
    )


def part(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def snapshot_scan(spark: SparkSession, path: str, header: Header = Header()) -> tuple[DataFrame, DataFrame]:
    """Fields (FIELD) of the snapshots under ``path``, and the rejects (snapshot, file, document_id, field, reason).

    Folders ``snapshot=<name>`` hold the JSON files of a snapshot, each with the
    header and some of its documents; a file is one row. Values stay JSON
    text, so that 1 and "1" differ. A file without a good header goes as a
    whole, a document without id or fields or whose id came before (by file and
    place) too, and a field whose payload is no object, has no value, or whose
    confidence or evidence is of another type by itself.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("snapshot").cast("string").alias("snapshot"), F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), F.try_parse_json("value").alias("v"))
    v = F.col("v")
    text = lambda p: F.try_variant_get(v, p, "string")
    blank = lambda c: F.coalesce(F.btrim(c), F.lit("")) == ""
    reason = (
        F.when(kind(v) != "object", "not_an_object").when(~text("$.artifact_type").eqNullSafe(F.lit(header.artifact_type)), "artifact_type")
        .when(~((kind(part(v, "$.schema_version")) == "number") & F.try_variant_get(v, "$.schema_version", "double").eqNullSafe(F.lit(float(header.schema_version)))), "schema_version")
        .when(~text("$.baseline_version").eqNullSafe(F.lit(header.baseline_version)), "baseline_version").when((kind(part(v, "$.parser_id")) != "string") | blank(text("$.parser_id")), "parser_id")
        .when(kind(part(v, "$.generated_at")) != "string", "generated_at").when(kind(part(v, "$.documents")) != "array", "documents")
    )
    files = files.withColumn("reason", reason)
    docs = files.where("reason IS NULL").select("snapshot", "file", F.posexplode(F.try_variant_get(v, "$.documents", "array<variant>")).alias("place", "d"))
    d = F.col("d")
    named = (kind(part(d, "$.document_id")) == "string") & ~blank(F.try_variant_get(d, "$.document_id", "string"))
    docs = docs.select("snapshot", "file", "place", "d", kind(d).alias("kind"), F.when(named, F.try_variant_get(d, "$.document_id", "string")).alias("document_id"))
    again = F.row_number().over(Window.partitionBy("snapshot", "document_id").orderBy("file", "place")) > 1
    docs = docs.withColumn("reason", F.when(F.col("kind") != "object", "not_an_object").when(F.col("document_id").isNull(), "document_id").when(again, "duplicate_document_id").when(kind(part(d, "$.fields")) != "object", "fields"))
    fields = docs.where("reason IS NULL").select("snapshot", "file", "document_id", F.explode(F.try_variant_get(d, "$.fields", "map<string,variant>")).alias("field", "p"))
    p = F.col("p")
    fault = (
        F.when(kind(p) != "object", "not_an_object").when(kind(part(p, "$.value")) == "missing", "value").when(~kind(part(p, "$.confidence")).isin("missing", "null", "number", "boolean"), "confidence")
        .when(~kind(part(p, "$.evidence")).isin("missing", "null", "string"), "evidence")
    )
    fields = fields.withColumn("reason", fault)
    good = fields.where("reason IS NULL").select("snapshot", "document_id", "field", F.to_json(part(p, "$.value")).alias("value"), F.try_variant_get(p, "$.confidence", "double").alias("confidence"), F.try_variant_get(p, "$.evidence", "string").alias("evidence"))
    none = F.lit(None).cast("string")
    shown = [files.select("snapshot", "file", none.alias("document_id"), none.alias("field"), "reason"), docs.select("snapshot", "file", "document_id", none.alias("field"), "reason"), fields.select("snapshot", "file", "document_id", "field", "reason")]
    rejects = shown[0].unionByName(shown[1]).unionByName(shown[2]).where("reason IS NOT NULL")
    return good, rejects


def write_snapshots(fields: DataFrame, path: str, parser_id: str, generated_at: str, parts: int = 16, header: Header = Header()) -> None:
    """Fields (FIELD, values JSON text) as snapshot files; documents are dealt to ``parts`` files a snapshot, so size it to what a file may hold."""
    text = lambda c: F.when(F.col(c).isNull(), "null").otherwise(F.expr(f"substring(to_json(struct({c} AS x)), 6, length(to_json(struct({c} AS x))) - 6)"))
    one = F.concat(text("field"), F.lit(': {"value": '), F.coalesce("value", F.lit("null")), F.lit(', "confidence": '), F.coalesce(F.col("confidence").cast("string"), F.lit("null")), F.lit(', "evidence": '), text("evidence"), F.lit("}"))
    docs = fields.select("snapshot", "document_id", one.alias("one"), "field").groupBy("snapshot", "document_id").agg(F.array_sort(F.collect_list("one")).alias("all"))
    doc = F.concat(F.lit('{"document_id": '), text("document_id"), F.lit(', "fields": {'), F.array_join("all", ", "), F.lit("}}"))
    head = f'{{"artifact_type": "{header.artifact_type}", "schema_version": {header.schema_version}, "baseline_version": "{header.baseline_version}", "parser_id": "{parser_id}", "generated_at": "{generated_at}", "documents": ['
    dealt = docs.select("snapshot", F.pmod(F.xxhash64("document_id"), F.lit(parts)).alias("part"), doc.alias("doc"))
    files = dealt.groupBy("snapshot", "part").agg(F.concat(F.lit(head), F.array_join(F.array_sort(F.collect_list("doc")), ", "), F.lit("]}")).alias("value"))
    files.write.mode("append").partitionBy("snapshot", "part").text(path)


ATTRIBUTES = ("value", "confidence", "evidence")


def snapshot_changes(fields: DataFrame, steps: DataFrame, expected: DataFrame) -> DataFrame:
    """Changes from one snapshot to another: a row for every attribute of a field that differs.

    ``steps`` names the pairs (baseline, current) to compare, ``expected`` the
    (document_id, field) whose changes are no drift. A field that only one of
    them has is one change, of its presence. Values are compared as JSON text.
    """
    of = lambda side: fields.select(*[F.col(c) for c in ("document_id", "field")], F.struct(*ATTRIBUTES).alias(f"_{side}"), F.col("snapshot").alias(f"{side}_snapshot"))
    steps = steps.select(F.col("baseline").alias("baseline_snapshot"), F.col("current").alias("current_snapshot")).distinct()
    before, after = of("baseline").join(steps, "baseline_snapshot"), of("current").join(steps, "current_snapshot")
    both = before.join(after, ["baseline_snapshot", "current_snapshot", "document_id", "field"], "full_outer")
    a, b = F.col("_baseline"), F.col("_current")
    show = lambda c: c.cast("string")
    gone = a.isNull() | b.isNull()
    each = [F.when(gone, F.struct(F.lit("field_presence").alias("attribute"), show(a.isNotNull()).alias("baseline"), show(b.isNotNull()).alias("current")))]
    each += [F.when(~gone & ~a[x].eqNullSafe(b[x]), F.struct(F.lit(x).alias("attribute"), show(a[x]).alias("baseline"), show(b[x]).alias("current"))) for x in ATTRIBUTES]
    rows = both.select("baseline_snapshot", "current_snapshot", "document_id", "field", F.inline(F.array_compact(F.array(*each))))
    known = expected.select("document_id", "field").distinct().withColumn("_expected", F.lit(True))
    label = F.when(F.col("_expected"), "expected_change").otherwise("unexpected_drift")
    return rows.join(known, ["document_id", "field"], "left").select("baseline_snapshot", "current_snapshot", "document_id", "field", "attribute", "baseline", "current", label.alias("classification"))
