"""Blocks of vectors for searches of a query set against all rows.

Vectors are packed into blocks of bounded size in descending order of length,
so that a task holds one block of candidates and one of queries, however large
the table is. Every block of queries meets the block of the longest vectors
first, which gives each query a score that later blocks have to reach.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

CANDIDATES = 8192  # rows of a block
QUERIES = 2048
#: Bytes of all packed queries up to which they are broadcast; beyond it the blocks meet by a shuffle.
BROADCAST_BYTES = 32 << 20


def length_of(v: np.ndarray) -> float:
    """Length of a vector of any finite components (the largest double, where it is beyond that)."""
    top = float(np.abs(v).max(initial=0.0))
    return min(top * float(np.sqrt(((v / top) ** 2).sum())), np.finfo(float).max) if top > 0 else 0.0


def usable(vectors: DataFrame, prepare: Callable[[np.ndarray], np.ndarray], zero: bool, key: str, column: str) -> DataFrame:
    """Rows (_id, _dim, _norm, _data) of the vectors that take part; _data has float64 values after ``prepare``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims, norms, data = [], [], [], []
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if i is None or not x or any(v is None for v in x):
                    continue
                v = np.asarray(x, np.float64)
                if not np.isfinite(v).all() or not (zero or v.any()):
                    continue
                v = prepare(v)
                ids.append(i)
                dims.append(len(v))
                norms.append(length_of(v))
                data.append(v.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(norms, pa.float64()), pa.array(data, pa.binary())], ["_id", "_dim", "_norm", "_data"])

    return vectors.select(F.col(key).cast("long"), column).mapInArrow(run, "_id long, _dim int, _norm double, _data binary")


def findable(rows: DataFrame, k: int) -> DataFrame:
    """Rows without those copies of a vector that can be among no query's ``k`` best.

    Copies have equal scores and ties go to the smaller id, so the k + 1
    smallest ids (one may be the query's own) are enough, each k times at most.
    """
    by_id = Window.partitionBy("_data").orderBy("_id")
    few = rows.withColumn("_rank", F.dense_rank().over(by_id)).where(F.col("_rank") <= k + 1)
    again = Window.partitionBy("_data", "_id").orderBy("_dim")
    return few.withColumn("_again", F.row_number().over(again)).where(F.col("_again") <= k).drop("_rank", "_again")


def packed(rows: DataFrame, most: int, group: str) -> DataFrame:
    """Pack rows in the order in which they come into blocks of equal ``group`` and _dim, ``most`` rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def block() -> pa.RecordBatch:
            ids, norms = np.array([r[2] for r in held], np.int64), np.array([r[3] for r in held])
            return pa.RecordBatch.from_arrays(
                [pa.array([held[0][0]], pa.int32()), pa.array([held[0][1]], pa.int32()), pa.array([norms.max()]), pa.array([ids.tobytes()], pa.binary()), pa.array([b"".join([r[4] for r in held])], pa.binary())], ["group", "dim", "norm", "ids", "data"]
            )

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (len(held) >= most or row[:2] != held[0][:2]):
                    yield block()
                    held = []
                held.append(row)
        if held:
            yield block()

    return rows.select(group, "_dim", "_id", "_norm", "_data").mapInArrow(run, "group int, dim int, norm double, ids binary, data binary")


def candidate_blocks(rows: DataFrame) -> DataFrame:
    """All rows (of a table cut before) in blocks by descending length; a block is a row (dim, norm, ids, data, number)."""
    n = max(1, rows.count() // CANDIDATES)
    placed = rows.repartitionByRange(n, F.desc("_norm"), "_id").sortWithinPartitions("_dim", F.desc("_norm"), "_id").withColumn("_group", F.lit(0))
    return cut(packed(placed, CANDIDATES, "_group").drop("group").withColumn("number", F.monotonically_increasing_id()))


def query_blocks(rows: DataFrame) -> tuple[DataFrame, int, DataFrame]:
    """Blocks of queries, numbered in column qb, how many numbers there are, and the queries. A repeated id asks once."""
    rows = rows.groupBy("_id", "_dim", "_norm").agg(F.min("_data").alias("_data")).groupBy("_id").agg(F.min_by(F.struct("_dim", "_norm", "_data"), F.struct("_dim", "_norm", "_data")).alias("v")).select("_id", "v.*")
    rows = cut(rows)
    n = max(1, -(-rows.count() // QUERIES))
    placed = rows.withColumn("_group", F.pmod(F.xxhash64("_id"), F.lit(n)).cast("int")).repartition(n, "_group").sortWithinPartitions("_group", "_dim", "_id")
    blocks = packed(placed, 2 * QUERIES, "_group").select(F.col("group").alias("qb"), F.col("dim").alias("q_dim"), F.col("norm").alias("q_norm"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    return cut(blocks.withColumn("bound", F.lit(None).cast("binary"))), n, rows


Search = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def unpack(ids: bytes, data: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(data, np.float64).reshape(-1, dim)


def nearest(candidates: DataFrame, queries: DataFrame, numbers: int, k: int, search: Search, score_type: str) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k best of ``search`` for every query.

    ``search(query ids, queries, candidate ids, candidates, bounds)`` returns
    (row of the query, candidate id, score) of what a block has to offer;
    bounds are scores that k candidates of the query are known to reach.
    """
    # chosen once: of blocks of equal norm, every use has to take the same one
    best = cut(candidates.groupBy("dim").agg(F.max(F.struct("norm", "number")).alias("best")).select("dim", "best.number"))
    head = candidates.join(F.broadcast(best), ["dim", "number"], "left_semi")
    arrow = {"long": pa.int64(), "double": pa.float64()}[score_type]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                q_ids, q = unpack(r["q_ids"], r["q_data"], r["dim"])
                c_ids, c = unpack(r["ids"], r["data"], r["dim"])
                bound = np.frombuffer(r["bound"]) if r["bound"] else np.full(len(q_ids), -np.inf)
                at, found, score = search(q_ids, q, c_ids, c, bound)
                order = np.lexsort((found, -score, at))
                at, found, score = at[order], found[order], score[order]
                starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, int)
                place = np.arange(len(at)) - np.repeat(starts, np.diff(np.r_[starts, len(at)]))
                keep = place < k
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[at[keep]]), pa.array(found[keep]), pa.array(score[keep], arrow)], ["query_id", "vec_id", "score"])

    kinds = f"query_id long, vec_id long, score {score_type}"
    needed = ["dim", "q_ids", "q_data", "bound", "ids", "data"]
    every = F.explode(F.sequence(F.lit(0), F.lit(numbers - 1))).alias("qb")
    first = cut(head.select("dim", "ids", "data", every).join(queries.withColumn("dim", F.col("q_dim")), ["qb", "dim"]).select(*needed).mapInArrow(meet, kinds))

    # each block of queries gets the k-th score that its queries have from the longest vectors
    reached = first.groupBy("query_id").agg(F.min("score").cast("double").alias("low"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
    lows = reached.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(numbers)).cast("int")).groupBy("qb").agg(F.collect_list(F.struct("query_id", "low")).alias("lows"))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                ids = np.frombuffer(r["q_ids"], np.int64)
                low = {x["query_id"]: x["low"] for x in r.pop("lows") or []}
                r["bound"] = below(np.array([low.get(i, -np.finfo(float).max) for i in ids.tolist()])).tobytes()
                r["least"] = float(np.frombuffer(r["bound"]).min())
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("qb", pa.int32()), ("q_dim", pa.int32()), ("q_norm", pa.float64()), ("q_ids", pa.binary()), ("q_data", pa.binary()), ("bound", pa.binary()), ("least", pa.float64())]))

    asked = cut(queries.join(lows, "qb", "left").select("qb", "q_dim", "q_norm", "q_ids", "q_data", "lows").mapInArrow(bounded, "qb int, q_dim int, q_norm double, q_ids binary, q_data binary, bound binary, least double"))
    if (asked.agg(F.sum(F.length("q_data"))).first()[0] or 0) <= BROADCAST_BYTES:
        asked = F.broadcast(asked)
    # which blocks have to meet is settled on their lengths alone; then their vectors are fetched
    rest = candidates.select("dim", "norm", "number").join(F.broadcast(best), ["dim", "number"], "left_anti").select("dim", "norm", "number", every)
    asking = asked.select("qb", F.col("q_dim").alias("dim"), "q_norm", "least")
    pairs = rest.join(asking, ["qb", "dim"]).where(F.col("norm") * F.col("q_norm") * (1 + 1e-9) >= F.col("least")).select("number", "qb", "dim")
    pairs = pairs.join(candidates.select("number", "ids", "data"), "number").join(asked.withColumn("dim", F.col("q_dim")), ["qb", "dim"])
    found = first.unionByName(pairs.select(*needed).mapInArrow(meet, kinds))
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def per_query(at: np.ndarray, score: np.ndarray, bound: np.ndarray, k: int) -> np.ndarray:
    """The bounds, raised to the k-th best of the scores where a query has k of them."""
    order = np.lexsort((-score, at))
    at, score = at[order], score[order]
    starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, int)
    enough = starts[np.diff(np.r_[starts, len(at)]) >= k]
    bound = bound.copy()
    bound[at[enough]] = np.maximum(bound[at[enough]], below(score[enough + k - 1]))
    return bound


def below(score: np.ndarray) -> np.ndarray:
    """Scores as doubles that are no larger."""
    score = np.asarray(score, np.float64)
    return score - np.abs(score) * 1e-15
