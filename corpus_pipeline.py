"""A training corpus from ``documents``, stage by stage.

Every stage is written as Parquet and read again by the next one. All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fiduciary.llm.common import shared_folder, table
from fiduciary.llm.lines import line_dedup
from fiduciary.llm.mixing import mix
from fiduciary.llm.sentencepieces import digest, sentencepieces
from fiduciary.llm.simhash import simhash_groups
from fiduciary.llm.toxicity import fitted, toxicity

TOXIC = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores below TOXIC. The model is fitted on the rows that came and the labels of the data folder."""
    model = fitted(docs, spark, sf_dir)
    return toxicity(docs, model, keep=docs.columns, name="_toxicity").where(F.col("_toxicity") < TOXIC).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that ten of them share."""
    kept = line_dedup(docs).withColumn("text", F.col("_kept"))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that with the smallest id, of equal ids that with the smallest hashes.

    Documents without words are alike and one of them stays; a row with a null
    id stays only if its whole group has none. A row is told by the hashes of
    its text and of all its columns, so an id that holds several texts can stay
    once in each of their groups.
    """
    whole = F.xxhash64(*docs.columns, *[F.col(c).isNull() for c in docs.columns])
    rows = docs.withColumns({"_text": F.xxhash64("text"), "_row": whole})
    groups = simhash_groups(rows, keep=("_text", "_row"))
    first = F.min(F.struct(F.col("_id").isNull().alias("unnamed"), "_id", "_text", "_row")).alias("first")
    kept = groups.groupBy("_root").agg(first).select("first._text", "first._row")
    return rows.join(kept, ["_text", "_row"], "left_semi").dropDuplicates(["_text", "_row"]).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as many times as the mix takes them."""
    return mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every row, with digests of the ids and the decoded text."""
    import public_tokenizers

    out = sentencepieces(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), digest(F.col("ids")).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "library_agrees")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: The toxicity model and the fingerprints have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each but the last returns is written to the shared checkpoint folder."""
    folder = f"{shared_folder(spark)}/pipeline-{spark.sparkContext.applicationId}-{spark.range(1).select(F.expr('uuid()')).first()[0]}"
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{i}-{name}")
            docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir).drop("ids")
