"""Readers of the files that plans, filers and agencies publish, and writers of tables for people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

REGISTRY = "plan_id string, plan_name string, system_type string, jurisdiction string, in_peer_universe string"
FILINGS = "struct<form: array<string>, accessionNumber: array<string>, filingDate: array<string>, reportDate: array<string>, primaryDocument: array<string>>"

# Columns of a source map, and the names that columns of a codebook go by.
MAP_REQUIRED = ["plan_id", "plan_name", "expected_plan_identity", "seed_url", "allowed_domains", "doc_type_hints", "pagination_hints", "max_pages", "max_depth"]
MAP_OPTIONAL = ["source_authority_tier", "mismatch_reason", "override_requires_js", "override_force_render_wait_ms", "override_pagination_mode", "override_notes"]
CODEBOOK_NAMES = ["variable", "variablename", "name", "field", "varname"]
CODEBOOK_TEXTS = ["description", "label", "definition", "desc"]


def slug(*parts: Column) -> Column:
    """Parts joined by "::", in lower case, everything but a-z and 0-9 as one hyphen, none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(F.concat_ws("::", *parts)), "[^a-z0-9]+", "-"), F.lit("-"))


def truth(text: Column) -> Column:
    """true/yes/y/1 and false/no/n/0 in any case; null for anything else."""
    t = F.lower(F.btrim(text))
    return F.when(t.isin("true", "yes", "y", "1"), True).when(t.isin("false", "no", "n", "0"), False)


def registry(spark: SparkSession, path: str) -> DataFrame:
    """Plan registry from CSV, with the key that tells two rows of one plan and whether the row is usable."""
    rows = spark.read.schema(REGISTRY).csv(path, header=True, enforceSchema=False)
    rows = rows.withColumn("in_peer_universe", truth(F.col("in_peer_universe"))).withColumn("identity_key", slug(F.col("plan_name"), F.col("jurisdiction")))
    return rows.withColumn("is_valid", (F.coalesce(F.btrim("plan_id"), F.lit("")) != "") & F.col("in_peer_universe").isNotNull())


def own_holdings(spark: SparkSession, path: str) -> DataFrame:
    """Holdings that a plan publishes as CSV: the name may be in either of two columns, numbers may have commas."""
    rows = spark.read.csv(path, header=True)
    has = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    blank = lambda c: F.nullif(F.btrim(c), F.lit(""))
    number = lambda c: F.replace(has(c), F.lit(","), F.lit("")).try_cast("double")
    return rows.select(
        F.coalesce(blank(has("security_name")), blank(has("name"))).alias("security_name"), blank(F.upper(has("ticker"))).alias("ticker"),
        blank(F.upper(F.regexp_replace(has("cusip"), "[^A-Za-z0-9]", ""))).alias("cusip"), number("shares").alias("shares"), number("market_value").alias("market_value_usd"),
    )


def information_table(spark: SparkSession, path: str) -> DataFrame:
    """Positions of quarterly manager filings in XML; values are stated in thousands."""
    rows = spark.read.format("xml").option("rowTag", "infoTable").option("ignoreNamespace", "true").schema("nameOfIssuer string, cusip string, value double, shrsOrPrnAmt struct<sshPrnamt: double>").load(path)
    return rows.select(F.btrim("nameOfIssuer").alias("issuer"), F.upper(F.btrim("cusip")).alias("cusip"), (F.col("value") * 1000).alias("market_value_usd"), F.col("shrsOrPrnAmt.sshPrnamt").alias("shares"))


def filings(spark: SparkSession, path: str) -> DataFrame:
    """Quarterly holdings filings from JSON documents with one array per field; rows without an accession number fail."""
    rows = spark.read.schema(f"cik string, filings struct<recent: {FILINGS}>").json(path, multiLine=True)
    recent = F.arrays_zip(*[F.col(f"filings.recent.{x}").alias(x) for x in ("form", "accessionNumber", "filingDate", "reportDate", "primaryDocument")])
    rows = rows.select("cik", F.inline(recent)).where(F.col("form").isin("13F-HR", "13F-HR/A"))
    accession = F.when(F.coalesce("accessionNumber", F.lit("")) == "", F.raise_error(F.lit("filing without accession number"))).otherwise(F.col("accessionNumber"))
    return rows.select("cik", "form", accession.alias("accession"), F.to_date("filingDate").alias("filing_date"), F.to_date("reportDate").alias("report_date"), F.col("primaryDocument").alias("document"))


def latest_filing(rows: DataFrame, key: list[str]) -> DataFrame:
    """The last filing of every filer by date, then accession number: one partial aggregate, no sort of a filer's rows."""
    rest = [c for c in rows.columns if c not in key]
    last = F.max_by(F.struct(*rest), F.struct("filing_date", "accession")).alias("_last")
    return rows.groupBy(*key).agg(last).select(*key, "_last.*")


def schedules(spark: SparkSession, path: str) -> DataFrame:
    """Actuarial schedules from CSV; ok is false where the schedule, year, employer or plan number can't be used."""
    rows = spark.read.schema("schedule string, plan_year string, ein string, plan_number string, plan_name string").csv(path, header=True, enforceSchema=False)
    digits = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\D", "")
    rows = rows.select(F.upper(F.btrim("schedule")).alias("schedule"), F.col("plan_year").try_cast("int").alias("plan_year"), digits("ein").alias("ein"), digits("plan_number").alias("n"), "plan_name")
    ok = F.coalesce(F.col("schedule").isin("SB", "MB") & F.col("plan_year").isNotNull() & (F.length("ein") == 9) & F.length("n").between(1, 3), F.lit(False))
    return rows.select("schedule", "plan_year", "ein", F.lpad("n", 3, "0").alias("plan_number"), "plan_name", ok.alias("ok"))


def operation_log(spark: SparkSession, path: str) -> DataFrame:
    """Operation log of one JSON object a line; lines that are none are left out, any status but ok is an error."""
    rows = spark.read.schema("operation string, status string, latency_ms double, observed_at timestamp").option("mode", "DROPMALFORMED").json(path)
    return rows.where("operation IS NOT NULL").withColumn("status", F.when(F.lower("status") == "ok", "ok").otherwise("error"))


def source_map(spark: SparkSession, path: str) -> DataFrame:
    """Cells of a source-map CSV as text; unknown columns and missing ones that are required fail, optional ones that are missing are null."""
    rows = spark.read.csv(path, header=True)
    rows = rows.toDF(*[c.strip() for c in rows.columns])
    unknown, missing = sorted(set(rows.columns) - {*MAP_REQUIRED, *MAP_OPTIONAL}), sorted(set(MAP_REQUIRED) - set(rows.columns))
    if unknown or missing:
        raise ValueError(f"source map with unknown columns {unknown}, without {missing}")
    return rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in (*MAP_REQUIRED, *MAP_OPTIONAL)])


def survey_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of survey responses, one JSON file each, as maps of texts: an array, or an object with one under data, result or records; anything else fails."""
    body, records = F.btrim(F.col("value"), F.lit(" \t\r\n")), "array<map<string,string>>"
    wrapped = F.from_json(body, f"struct<data: {records}, result: {records}, records: {records}>")
    found = F.when(F.startswith(body, F.lit("[")), F.from_json(body, records)).otherwise(F.coalesce(wrapped["data"], wrapped["result"], wrapped["records"]))
    found = F.coalesce(found, F.raise_error(F.lit("survey response without records")).cast(records))
    return spark.read.text(path, wholetext=True).select(F.explode(found).alias("record"))


def codebook(spark: SparkSession, path: str) -> DataFrame:
    """Variables with their descriptions from a CSV whose columns go by one of several names; rows without a name are left out."""
    rows = spark.read.csv(path, header=True)
    by = {c.strip().lower(): c for c in rows.columns}
    name, about = (next((by[x] for x in names if x in by), None) for names in (CODEBOOK_NAMES, CODEBOOK_TEXTS))
    if name is None:
        raise ValueError(f"codebook without a column of names: {rows.columns}")
    text = F.coalesce(F.btrim(F.col(f"`{about}`")), F.lit("")) if about else F.lit("")
    return rows.select(F.btrim(F.col(f"`{name}`")).alias("name"), text.alias("description")).where("name <> ''")


def missing_variables(book: DataFrame, mapped: DataFrame) -> DataFrame:
    """Names that are mapped but not in the codebook."""
    return mapped.select("name").distinct().join(book, "name", "left_anti")


def write_csv(df: DataFrame, path: str) -> None:
    """A CSV folder with header; nulls are empty, quotes are doubled and nested columns are JSON."""
    nested = ("array", "map", "struct")
    df.select(*[F.to_json(c).alias(c) if t.startswith(nested) else F.col(c) for c, t in df.dtypes]).write.csv(path, header=True, nullValue="", emptyValue="", escape='"', mode="overwrite")


def write_artifacts(tables: dict[str, DataFrame], path: str) -> None:
    """A set of result tables under one path, each as a folder of JSON lines and one of CSV; running it again replaces them."""
    for name, df in tables.items():
        df.write.json(f"{path}/{name}.json", mode="overwrite", ignoreNullFields=False)
        write_csv(df, f"{path}/{name}.csv")


def flat_tags(records: DataFrame, names: list[str]) -> DataFrame:
    """Telemetry records whose named tags become columns, null where a record lacks them; other tags go."""
    return records.withColumns({n: F.try_element_at("tags", F.lit(n)) for n in names}).drop("tags")


def last_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row a key: the last by ``order``, as a keyed store keeps it."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
