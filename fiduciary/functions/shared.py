"""What operators need of the session: a shared folder, cut lineage, and proof that a table is small."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEW = 10_000  # rows of a table that people write, such as scenarios or plans


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a new one if all of them are this machine."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset: a cluster needs a shared folder")
    return tempfile.mkdtemp(prefix="spark-")


def cut(df: DataFrame) -> DataFrame:
    """The rows behind a checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """The rows behind a table in the shared folder.

    For rounds of joins: a checkpoint keeps the size that Spark estimated for
    the join, and the product of such sizes, round after round, becomes a number
    of millions of digits; a table has the size of its files.
    """
    folder = f"{shared_folder(df.sparkSession)}/rows-{uuid.uuid4()}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def few(df: DataFrame, most: int = FEW) -> DataFrame:
    """A table of at most ``most`` rows, to be broadcast; a larger one is an error."""
    if len(df.limit(most + 1).take(most + 1)) > most:
        raise ValueError(f"the table has more than {most} rows and is not broadcast")
    return F.broadcast(df)
