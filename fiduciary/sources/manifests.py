"""Component datasets by manifest: which files belong to which component."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import written

MOST = 1000  # components of a manifest


def manifest_entries(spark: SparkSession, path: str) -> dict[str, str]:
    """Component names and their paths from a manifest, one JSON object; blank names or paths and anything else fail."""
    rows = spark.read.text(path, wholetext=True).take(2)
    entries = json.loads(rows[0]["value"]) if len(rows) == 1 else None
    if not isinstance(entries, dict) or len(entries) > MOST:
        raise ValueError(f"{path} must hold one JSON object of at most {MOST} components")
    if wrong := [k for k, v in entries.items() if not k.strip() or not isinstance(v, str) or not v.strip()]:
        raise ValueError(f"components without a name or path: {wrong}")
    return entries


def component_datasets(spark: SparkSession, path: str, schema: str, lines: bool = True) -> DataFrame:
    """The rows of all files of a manifest (``path``), read as one table, with their ``component``.

    Paths are relative to the manifest's folder, or absolute, and name files or
    folders of JSON lines (with ``lines`` false, of one JSON array each). Which
    component a row belongs to comes from the path of its file, not from the
    row; of paths within each other the longest counts.
    """
    entries = manifest_entries(spark, path)
    root = path.rsplit("/", 1)[0]
    full = {name: p if re.match(r"^([a-z][a-z0-9+.-]*:/|/)", p) else f"{root}/{p}" for name, p in sorted(entries.items())}
    rows = spark.read.schema(schema).json(list(dict.fromkeys(full.values())), multiLine=not lines)
    plain = lambda p: re.sub(r"^[a-z][a-z0-9+.-]*:/+", "/", p).rstrip("/")
    found = F.regexp_replace(F.url_decode("_metadata.file_path"), r"^[a-z][a-z0-9+.-]*:/+", "/")
    owner = F.coalesce(*[F.when((found == plain(p)) | F.startswith(found, F.lit(f"{plain(p)}/")), F.lit(name)) for name, p in sorted(full.items(), key=lambda x: (-len(plain(x[1])), x[0]))])
    return rows.select(owner.alias("component"), "*")


def write_components(datasets: DataFrame, path: str, name: str = "component_name") -> str:
    """Datasets as folders of JSON lines, one a component, and a manifest beside them; returns the manifest's path."""
    spark, datasets = datasets.sparkSession, written(datasets)  # for the names and for the folders
    names = [r[0] for r in datasets.select(name).distinct().take(MOST + 1)]
    if len(names) > MOST:
        raise ValueError(f"more than {MOST} components")
    datasets.withColumn("_component", F.col(name)).write.partitionBy("_component").json(f"{path}/data", ignoreNullFields=False)
    manifest = json.dumps({n: f"data/_component={n}" for n in sorted(names)})
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.text(f"{path}/manifest")
    return f"{path}/manifest"
