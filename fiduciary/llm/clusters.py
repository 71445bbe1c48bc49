"""Centroid clustering of integer vectors on bit planes.

A vector of 64 integers is written as bit planes: plane b holds bit b of all 64
components in one uint64, in two's complement, so that the last plane weighs
-2^b. The dot product of two vectors is the sum over pairs of planes of their
weights times the number of ones that the planes share (AND, then popcount),
and distances follow from it without any rounding.

Vectors are packed once into blocks of planes, written to the shared folder.
A round reads the blocks, and a task returns only the count, the component
sums and the summed distance of its part of each cluster; no vector moves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

WIDTH = 64  # components of a vector: one uint64 a plane
#: Components are kept within 2^27 of zero, where a squared distance still fits a long.
MOST = 1 << 27
LONG = (1 << 63) - 1


def planes_of(whole: np.ndarray) -> np.ndarray:
    """Bit planes (rows x planes, uint64) of integer vectors (rows x 64), as many as the largest component needs."""
    top = int(max(whole.max(initial=0), -1 - whole.min(initial=0)))
    bits = top.bit_length() + 1
    ones = (whole[:, None, :] >> np.arange(bits)[None, :, None]) & 1
    return np.packbits(ones.astype(np.uint8), axis=2, bitorder="little").view(np.uint64).reshape(len(whole), bits)


def weights_of(bits: int) -> np.ndarray:
    """What a one in each plane counts."""
    weights = np.int64(1) << np.arange(bits, dtype=np.int64)
    weights[-1] = -weights[-1]
    return weights


def dots(planes: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Exact dot products of vectors, given as planes, with one vector, given as its planes."""
    weights, total = weights_of(planes.shape[1]), np.zeros(len(planes), np.int64)
    for plane, weight in zip(other, weights_of(len(other)).tolist(), strict=True):
        total += weight * (np.bitwise_count(planes & plane).astype(np.int64) @ weights)
    return total


def component_sums(planes: np.ndarray) -> np.ndarray:
    """Sums of the 64 components over all vectors, from the ones of each plane."""
    ones = np.unpackbits(np.ascontiguousarray(planes).view(np.uint8).reshape(*planes.shape, 8), axis=2, bitorder="little")
    return weights_of(planes.shape[1]) @ ones.sum(0, dtype=np.int64)


def squares(planes: np.ndarray) -> np.ndarray:
    """Squared lengths, from the planes alone."""
    weights, total = weights_of(planes.shape[1]), np.zeros(len(planes), np.int64)
    for b, weight in enumerate(weights.tolist()):
        total += weight * (np.bitwise_count(planes & planes[:, b : b + 1]).astype(np.int64) @ weights)
    return total


class Centroids:
    """Centroids as integer vectors and as bit planes."""

    def __init__(self, whole: list[list[int]]):
        self.whole = whole
        each = [planes_of(np.array([c], np.int64))[0] for c in whole]
        self.planes = each
        self.square = [sum(x * x for x in c) for c in whole]

    def nearest(self, planes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid (the smaller of equals) and the squared distance, for every vector."""
        far = np.stack([square - 2 * dots(planes, c) for c, square in zip(self.planes, self.square, strict=True)], axis=1)
        at = far.argmin(axis=1)
        return at, far[np.arange(len(at)), at] + squares(planes)

    def moved(self, sums: dict[int, tuple[int, list[int]]]) -> Centroids:
        """Centroids at the floor of the mean of their vectors; those without vectors stay."""
        return Centroids([[s // sums[k][0] for s in sums[k][1]] if k in sums else c for k, c in enumerate(self.whole)])

    def digest(self, k: int) -> str:
        return hashlib.sha256(",".join(map(str, self.whole[k])).encode()).hexdigest()


def usable(embedding: Column) -> Column:
    """Exactly 64 components, none null or non-finite."""
    value = embedding.cast("array<double>")
    return F.coalesce((F.size(embedding) == WIDTH) & F.forall(value, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))), F.lit(False))


def whole_numbers(column: pa.Array, scale: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, WIDTH)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * values), -MOST, MOST - 1).astype(np.int64)


def plane_blocks(vectors: DataFrame, scale: int) -> DataFrame:
    """Rows (ids, empty, width, planes): an Arrow batch of usable vectors each; empty marks null ids."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                planes = planes_of(whole_numbers(batch.column(1), scale))
                ids = batch.column(0)
                numbers = np.array([i or 0 for i in ids.to_pylist()], np.int64)
                empty = np.packbits(ids.is_null().to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_pydict({"ids": [numbers.tobytes()], "empty": [empty.tobytes()], "width": [planes.shape[1]], "planes": [planes.tobytes()]}, pa.schema([("ids", pa.binary()), ("empty", pa.binary()), ("width", pa.int32()), ("planes", pa.binary())]))

    return vectors.mapInArrow(pack, "ids binary, empty binary, width int, planes binary")


def blocks_in(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, marks of null ids and planes of every block, one at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            r = {c: batch.column(c)[i].as_py() for c in ("ids", "empty", "width", "planes")}
            ids = np.frombuffer(r["ids"], np.int64)
            empty = np.unpackbits(np.frombuffer(r["empty"], np.uint8), count=len(ids)).astype(bool)
            yield ids, empty, np.frombuffer(r["planes"], np.uint64).reshape(len(ids), r["width"])


def exact_sum(x: np.ndarray) -> int:
    """Sum of longs that aren't negative, beyond a long too."""
    return (int((x >> 32).sum()) << 32) + int((x & 0xFFFFFFFF).sum())


def cluster_sums(blocks: DataFrame, centroids: Centroids) -> dict[int, tuple[int, list[int], int]]:
    """Count, component sums and summed distance of every cluster that has vectors, added up by Spark.

    A task returns 66 numbers a cluster; they are added as decimals, which no table overflows.
    """
    n = len(centroids.whole)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, WIDTH + 2), object)
        for _, _, planes in blocks_in(batches):
            at, far = centroids.nearest(planes)
            for k in np.unique(at).tolist():
                mine = at == k
                total[k] += np.r_[component_sums(planes[mine]).astype(object), int(mine.sum()), exact_sum(far[mine])]
        k, item = np.nonzero(total[:, WIDTH : WIDTH + 1] > np.zeros((1, WIDTH + 2), int))
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(item, pa.int32()), pa.array([str(x) for x in total[k, item]], pa.string())], ["cluster", "item", "value"])

    parts = blocks.mapInArrow(add, "cluster int, item int, value string")
    sums: dict[int, list[int]] = {}
    for r in parts.groupBy("cluster", "item").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect():  # 66 rows a cluster
        sums.setdefault(r["cluster"], [0] * (WIDTH + 2))[r["item"]] = int(r["value"])
    return {k: (s[WIDTH], s[:WIDTH], s[WIDTH + 1]) for k, s in sums.items()}


def first_centroids(vectors: DataFrame, k: int, seed: int, scale: int) -> Centroids:
    """The k vectors with the smallest hashes of their ids; of equal ids the smaller vector comes first."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select("_id", "_vector", order.alias("order")).orderBy("order", "_vector").limit(k).toArrow()
    return Centroids(whole_numbers(rows.column("_vector").combine_chunks(), scale).tolist() if rows.num_rows else [])


def clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, scale: int = 1024, key: str = "vec_id", column: str = "embedding") -> tuple[DataFrame, Centroids]:
    """Cluster of every usable vector after ``rounds`` rounds, and the last centroids.

    Returns rows (_id, cluster, distance, cluster_inertia, inertia,
    centroid_sha256). Vectors that are null, have not exactly 64 components, or
    hold a null or non-finite one take no part. A null id stays null and hashes
    like an empty one; repeated rows count each time; a table with fewer
    vectors than ``k`` has as many centroids as vectors, an empty one gives no
    rows. Only ``key`` and ``column`` are read, so other columns can't clash.
    Components beyond 2^27 after scaling are that bound, and inertias beyond a
    long are its end.
    """
    taken = vectors.select(F.col(key).cast("long").alias("_id"), F.col(column).alias("_vector")).where(usable(F.col("_vector")))
    blocks = cut(plane_blocks(taken, scale))
    centroids = first_centroids(taken, k, seed, scale)
    if centroids.whole:
        for _ in range(rounds):
            centroids = centroids.moved({c: (n, sums) for c, (n, sums, _) in cluster_sums(blocks, centroids).items()})
    inertia = {c: i for c, (_, _, i) in cluster_sums(blocks, centroids).items()} if centroids.whole else {}
    whole = min(LONG, sum(inertia.values()))
    digests = [centroids.digest(c) for c in range(len(centroids.whole))]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, empty, planes in blocks_in(batches):
            at, far = centroids.nearest(planes)
            columns = [
                pa.array(ids, mask=empty), pa.array(at.astype(np.int32)), pa.array(far), pa.array([min(LONG, inertia[c]) for c in at.tolist()], pa.int64()),
                pa.array(np.full(len(at), whole)), pa.DictionaryArray.from_arrays(at.astype(np.int32), digests).cast(pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return blocks.mapInArrow(assign, "_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"), centroids


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = clusters(table(spark, sf_dir, "embeddings"))
    return found.withColumnRenamed("_id", "vec_id")


def cluster_sql(k: int = 8, rounds: int = 10, seed: int = 3, scale: int = 1024) -> str:
    """The same in DuckDB SQL, a pair of expressions a round."""
    distance = "CAST(list_sum(list_transform(list_zip(v.c, m.c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)"
    near = f"SELECT v.r, v.vec_id, v.c, arg_min(m.k, ({distance}, m.k)) AS cluster, min({distance}) AS distance FROM v CROSS JOIN m{{0}} m GROUP BY v.r, v.vec_id, v.c"
    parts = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS c FROM embeddings
  WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {WIDTH})""",
        f"m0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('{seed}:' || CAST(vec_id AS VARCHAR)), c) - 1 AS INTEGER) AS k, c FROM v ORDER BY sha256('{seed}:' || CAST(vec_id AS VARCHAR)), c LIMIT {k})",
    ]
    for i in range(rounds):
        parts.append(f"a{i} AS MATERIALIZED ({near.format(i)})")
        parts.append(f"u{i} AS (SELECT cluster AS k, list(s ORDER BY d) AS c FROM (SELECT cluster, d, CAST((sum(x) - (sum(x) % count(*) + count(*)) % count(*)) // count(*) AS BIGINT) AS s FROM (SELECT cluster, unnest(c) AS x, generate_subscripts(c, 1) AS d FROM a{i}) GROUP BY cluster, d) GROUP BY cluster)")
        parts.append(f"m{i + 1} AS MATERIALIZED (SELECT m.k, coalesce(u.c, m.c) AS c FROM m{i} m LEFT JOIN u{i} u ON u.k = m.k)")
    parts.append(f"z AS MATERIALIZED ({near.format(rounds)})")
    return "WITH " + ",\n".join(parts) + f"""
SELECT z.vec_id, z.cluster, z.distance, CAST(sum(z.distance) OVER (PARTITION BY z.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(z.distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(m.c, ',')) AS centroid_sha256
FROM z JOIN m{rounds} m ON m.k = z.cluster"""


OP13_SQL = cluster_sql()
