"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a new one if all of them are this machine."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset: a cluster needs a shared folder")
    return tempfile.mkdtemp(prefix="spark-")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the cluster's shared checkpoint folder and cut its lineage.

    The folder is the session's ``spark.checkpoint.dir`` (see ``shared_folder``).
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def spread_join(many: DataFrame, one: DataFrame, key: str) -> DataFrame:
    """Join the rows of ``many`` to the one row that their key has in ``one``.

    A key that has more than a thousandth of the rows (and more than 1000) is
    dealt out over several tasks; there can't be more than 1000 such keys, so
    their table is broadcast.
    """
    counts = cut(many.groupBy(key).count())
    most = max(1000, (counts.agg(F.sum("count")).first()[0] or 0) // 1000)
    large = F.broadcast(counts.where(F.col("count") > most).select(key, F.ceil(F.col("count") / most).alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1).cast("long"))
    left = many.join(large, key, "left").withColumn("_salt", F.pmod(F.monotonically_increasing_id(), parts)).drop("_parts")
    right = one.join(large, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("_parts")
    return left.join(right, [key, "_salt"]).drop("_salt")


def texts(column: pa.Array) -> list[str]:
    """Arrow strings as Python strings; null is the empty string."""
    return [x or "" for x in column.to_pylist()]


def portions(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows with about ``most`` bytes of text, so that few texts are Python strings at a time."""
    sizes = np.ones(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) or pa.types.is_binary(column.type):
            sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends, a = np.cumsum(sizes), 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield batch.slice(a, b - a)
        a = b


def per_batch(f: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow``: apply ``f`` to every batch that has rows, some megabytes at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch):
                yield f(part)

    return run
