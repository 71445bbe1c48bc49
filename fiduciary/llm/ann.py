"""Approximate nearest neighbours by randomly rotated one-bit codes.

A vector less the centre of a sample is turned by a random rotation (a short
one by several, until there are 256 components) and kept as one bit a
component, with two scalars: what turns the code's inner product with
a query into an unbiased estimate, and how far the estimate can be off. Codes
are made once a row and packed into blocks; only they meet the queries. A
query's components are rounded to whole numbers whose bits are masked with the
codes and counted. The vectors of the best estimates are fetched and scored
first; then those of all estimates that their errors could lift to the k-th
score found so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table
from .vectorblocks import BROADCAST_BYTES, below, candidate_blocks, findable, query_blocks, usable

SAMPLE = 2000  # vectors whose mean is the centre
WIDTH = 1.5  # error bound in standard deviations
BITS = 256  # of a code, at least
PLANES = 4  # bits of a query's rounded component
STRIPE = 1024  # codes that are weighed at once
MASKED = 1 << 17  # pairs that are masked at once: what fits a core's cache
FIRST = 3  # times k estimates a query has scored before the errors are weighed
LARGE = 1e100  # longer vectors have no code: they are always scored


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    """Random rotations side by side, scaled so that lengths stay."""
    rnd, out = np.random.default_rng(seed), []
    for _ in range(-(-BITS // dim)):
        q, r = np.linalg.qr(rnd.standard_normal((dim, dim)))
        out.append(q * np.sign(np.diag(r)))
    return np.hstack(out) / np.sqrt(len(out))


def centres(rows: DataFrame) -> dict[int, np.ndarray]:
    found: dict[int, list[np.ndarray]] = {}
    for r in rows.where(F.col("_norm") <= LARGE).select("_dim", "_data").orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE).collect():
        found.setdefault(r._dim, []).append(np.frombuffer(r._data))
    return {d: np.mean(x, 0) for d, x in found.items()}


def code_type(dim: int) -> np.dtype:
    """A row's number, its packed bits, the factor of the estimate and the error for a query of length 1."""
    return np.dtype([("row", "<i8"), ("bits", "<u8", (-(-dim * -(-BITS // dim) // 64),)), ("factor", "<f8"), ("error", "<f8")])


def packed_words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words, the last one filled up with zeros."""
    raw = np.packbits(bits, axis=1)
    return np.pad(raw, ((0, 0), (0, -raw.shape[1] % 8))).view("<u8")


def encode(rows: np.ndarray, c: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Codes of the vectors ``c``."""
    out = np.zeros(len(c), code_type(c.shape[1]))
    out["row"], out["error"] = rows, np.inf
    ordinary = np.flatnonzero(np.abs(c).max(1) <= LARGE)
    rest = c[ordinary] - centre
    length = np.sqrt((rest**2).sum(1))
    turned = rest @ turn
    overlap = np.abs(turned).sum(1) / (np.sqrt(turn.shape[1]) * np.maximum(length, 1e-300))  # of the vector and its code
    overlap = np.where(length > 0, overlap, 1)
    out["bits"][ordinary] = packed_words(turned > 0)
    out["factor"][ordinary] = length / overlap
    out["error"][ordinary] = length * np.sqrt(np.maximum(0, 1 - overlap**2)) / overlap * WIDTH / np.sqrt(max(1, turn.shape[1] - 1))
    return out


class Asked:
    """Queries of one dimension, made ready to be compared with codes."""

    def __init__(self, q: np.ndarray, centre: np.ndarray, turn: np.ndarray):
        self.bits = turn.shape[1]
        self.lengths = np.sqrt((q**2).sum(1))
        turned, self.fixed = q @ turn, q @ centre
        self.low = turned.min(1)
        self.step = np.maximum((turned.max(1) - self.low) / ((1 << PLANES) - 1), 1e-300)
        whole = np.rint((turned - self.low[:, None]) / self.step[:, None]).astype(np.uint8)
        self.total = self.bits * self.low + self.step * whole.sum(1, dtype=np.int64)
        self.planes = [packed_words(whole >> j & 1) for j in range(PLANES)]

    def estimates(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner product of every query with every code, and how far it can be off."""
        bits, n = codes["bits"], len(codes)
        counts = np.zeros((len(self.low), n), np.uint32)
        for a in range(0, n, width := max(1, MASKED // max(1, len(self.low)))):
            part = counts[:, a : a + width]
            for plane in reversed(self.planes):
                part <<= 1
                for w in range(bits.shape[1]):
                    part += np.bitwise_count(plane[:, w, None] & bits[None, a : a + width, w])
        ones = np.bitwise_count(bits).sum(1, dtype=np.int64)
        factor = codes["factor"] / np.sqrt(self.bits)
        guess = counts * (2 * self.step)[:, None]
        guess += np.outer(2 * self.low, ones)
        guess -= self.total[:, None]
        guess *= factor
        guess += self.fixed[:, None]
        with np.errstate(invalid="ignore"):
            off = np.outer(self.lengths, codes["error"])
        off[np.isnan(off)] = np.inf
        off += np.outer(WIDTH / np.sqrt(12) * self.step, codes["factor"])
        return guess, off


def compared(blocks: DataFrame, asked: DataFrame, numbers: int, middle: dict[int, np.ndarray], most: int | None) -> DataFrame:
    """Pairs (query_id, row, guess) from every block of codes for every block of queries.

    These are the ``most`` highest estimates of a query in a block (what has no
    estimate comes first); or, without ``most``, all that can reach its bound.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            for r in batch.to_pylist():
                dim = r["dim"]
                if dim not in turns:
                    turns[dim] = rotation(dim)
                ids, q = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["q_data"]).reshape(-1, dim)
                bound = np.frombuffer(r["bound"]) if r["bound"] else np.full(len(ids), -np.inf)
                codes = np.frombuffer(r["data"], code_type(dim))
                ready = Asked(q, middle.get(dim, np.zeros(dim)), turns[dim])
                best, best_rows = np.zeros((len(ids), 0)), np.zeros((len(ids), 0), np.int64)
                for a in range(0, len(codes), STRIPE):
                    part = codes[a : a + STRIPE]
                    guess, off = ready.estimates(part)
                    if most is None:
                        at, j = np.nonzero(guess + off >= bound[:, None])
                        yield batch_of(ids[at], part["row"][j], guess[at, j])
                        continue
                    guess[~np.isfinite(off)] = np.inf
                    best, best_rows = np.hstack([best, guess]), np.hstack([best_rows, np.tile(part["row"], (len(ids), 1))])
                    if best.shape[1] > most:
                        top = np.argpartition(-best, most - 1, axis=1)[:, :most]
                        best, best_rows = np.take_along_axis(best, top, 1), np.take_along_axis(best_rows, top, 1)
                if most is not None:
                    yield batch_of(np.repeat(ids, best.shape[1]), best_rows.ravel(), best.ravel())

    def batch_of(query: np.ndarray, row: np.ndarray, guess: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(query), pa.array(row), pa.array(guess)], ["query_id", "row", "guess"])

    every = F.explode(F.sequence(F.lit(0), F.lit(numbers - 1))).alias("qb")
    pairs = blocks.select("dim", "data", every).join(asked.withColumn("dim", F.col("q_dim")), ["qb", "dim"])
    return pairs.select("dim", "data", "q_ids", "q_data", "bound").mapInArrow(run, "query_id long, row long, guess double")


def scored(pairs: DataFrame, rows: DataFrame, queries: DataFrame) -> DataFrame:
    """Rows (query_id, vec_id, score) of pairs of different ids, scored on their vectors, which are fetched here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            score = np.zeros(len(left))
            sizes = np.array([len(x) for x in left])
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                a, b = (np.frombuffer(b"".join([x[i] for i in at.tolist()])).reshape(len(at), -1) for x in (left, right))
                with np.errstate(over="ignore", invalid="ignore"):
                    score[at] = np.einsum("ij,ij->i", a, b)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], ["query_id", "vec_id", "score"])

    found = pairs.select("query_id", "row").join(rows.select(F.col("_row").alias("row"), F.col("_id").alias("vec_id"), F.col("_data").alias("found")), "row")
    met = found.where("query_id <> vec_id").join(queries.select(F.col("_id").alias("query_id"), F.col("_data").alias("asked")), "query_id")
    return met.select("query_id", "vec_id", "asked", "found").mapInArrow(run, "query_id long, vec_id long, score double")


def nearest_neighbours(vectors: DataFrame, queries: Column, k: int, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The k nearest found by inner product for every row for which ``queries`` holds.

    Rows (query_id, rank, vec_id, score) with the score of the original
    vectors. Vectors that are null, empty, zero or hold null or non-finite
    components, and null ids, take no part; the rest as in the exact search.
    Every row (of equal vectors, all that can be among the k best) is coded and
    estimated for every query.
    """
    rows = cut(findable(usable(vectors, np.array, False, key, column), k).withColumn("_row", F.monotonically_increasing_id()))
    middle = centres(rows)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            dims, out = batch.column(1).to_numpy(), [b""] * batch.num_rows
            data, numbers = batch.column(3).to_pylist(), batch.column(4).to_numpy()
            for dim in np.unique(dims).tolist():
                if dim not in turns:
                    turns[dim] = rotation(dim)
                at = np.flatnonzero(dims == dim)
                c = np.frombuffer(b"".join([data[i] for i in at.tolist()])).reshape(-1, dim)
                for i, x in zip(at.tolist(), encode(numbers[at], c, middle.get(dim, np.zeros(dim)), turns[dim]), strict=True):
                    out[i] = x.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.binary())], ["_id", "_dim", "_norm", "_data"])

    blocks = candidate_blocks(cut(rows.select("_id", "_dim", "_norm", "_data", "_row").mapInArrow(code, "_id long, _dim int, _norm double, _data binary")))
    asked, numbers, asking = query_blocks(usable(vectors.where(queries), np.array, False, key, column))
    small = (asked.agg(F.sum(F.length("q_data"))).first()[0] or 0) <= BROADCAST_BYTES
    place = Window.partitionBy("query_id")
    # what the best estimates give is what all others have to reach
    share = min(FIRST * k + 1, FIRST * k // max(1, blocks.count()) + 4)  # of a block: the best may be spread unevenly
    guessed = compared(blocks, F.broadcast(asked) if small else asked, numbers, middle, share)
    guessed = guessed.withColumn("n", F.row_number().over(place.orderBy(F.desc("guess"), "row"))).where(F.col("n") <= FIRST * k + 1)
    first = scored(guessed, rows, asking).withColumn("n", F.row_number().over(place.orderBy(F.desc("score"), "vec_id"))).where(F.col("n") == k)
    lows = first.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(numbers)).cast("int")).groupBy("qb").agg(F.collect_list(F.struct("query_id", "score")).alias("lows"))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds = []
            for ids, lows in zip(batch.column(2).to_pylist(), batch.column(4).to_pylist(), strict=True):
                low = {x["query_id"]: x["score"] for x in lows or []}
                bounds.append(below(np.array([low.get(i, -np.finfo(float).max) for i in np.frombuffer(ids, np.int64).tolist()])).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(bounds, pa.binary())], ["qb", "q_dim", "q_ids", "q_data", "bound"])

    raised = cut(asked.join(lows, "qb", "left").select("qb", "q_dim", "q_ids", "q_data", "lows").mapInArrow(bounded, "qb int, q_dim int, q_ids binary, q_data binary, bound binary"))
    found = scored(compared(blocks, F.broadcast(raised) if small else raised, numbers, middle, None), rows, asking)
    found = found.withColumn("rank", F.row_number().over(place.orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)
