"""Incremental forms of the batch operators, for Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.shared import shared_folder


def sla_windows(stream: DataFrame, width: str, slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Count, least, largest and mean value by event-time window and metric; rows later than ``late`` are dropped."""
    rows = stream.withWatermark("observed_at", late)
    g = rows.groupBy(F.window("observed_at", width, slide).alias("w"), "metric")
    mean = F.sum(F.col("value").cast("decimal(18,6)")).cast("double") / F.count(F.lit(1))
    return g.agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.round(mean, 6).alias("avg_value")).select(F.col("w.start").alias("window_start"), "metric", "n", "min_value", "max_value", "avg_value")


def changes(stream: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Rows whose fingerprint differs from the last one of their key, remembered across batches.

    ``stream`` has the key columns, those of ``order`` and fingerprint; adds
    status (new, unchanged, superseding) and version. A micro-batch is sorted by
    ``order`` within its key; the state is one fingerprint and one number a key.
    """
    fields = stream.schema.simpleString().removeprefix("struct<").removesuffix(">")

    def step(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, version = state.get if state.exists else (None, 0)
        for frame in [pd.concat(list(frames)).sort_values(order, kind="stable")]:
            status, versions = [], []
            for x in frame["fingerprint"]:
                status.append("new" if version == 0 else "unchanged" if x == seen else "superseding")
                version += status[-1] != "unchanged"
                seen = x
                versions.append(version)
            state.update((seen, version))
            yield frame.assign(status=status, version=versions)

    return stream.groupBy(*key).applyInPandasWithState(step, f"{fields}, status string, version long".replace(":", " "), "seen string, version long", "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, mode: str, key: list[str] | None = None) -> DataFrame:
    """Run a stream over all that is there and return its rows; with ``key``, the last batch's row of each key.

    Every batch is written to a folder of its own, so that a batch which is
    run again after a failure replaces itself.
    """
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/stream-{spark.range(1).select(F.expr('uuid()')).first()[0]}"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema)}, batch int").parquet(f"{folder}/out")
    if key:
        w = Window.partitionBy(*key).orderBy(F.desc("batch"))
        rows = rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return rows.drop("batch")


def follow(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder as a stream of its files. The path is a pattern, as a plain one has to be a folder."""
    return spark.readStream.schema(spark.read.parquet(f"{sf_dir}/{name}.parquet").schema).parquet(f"{sf_dir}/{name}.parque[t]")


def replay(parts: list[DataFrame], run: Callable[[DataFrame, str], DataStreamWriter]) -> str:
    """Let parts of a table arrive as files one after the other, and run a stream to its end after each.

    ``run(stream, folder)`` gives the writer of the stream; every run goes on
    from the checkpoint of the one before. Returns the folder, for what the
    writer puts there.
    """
    spark = parts[0].sparkSession
    folder = f"{shared_folder(spark)}/stream-{spark.range(1).select(F.expr('uuid()')).first()[0]}"
    for part in parts:
        part.write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(parts[0].schema).parquet(f"{folder}/in")
        run(stream, folder).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return folder
