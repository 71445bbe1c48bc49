"""Exact top-k inner products over vectors of whole numbers.

Blocks come by descending length. Within one, vectors are rotated by the
singular vectors of a sample, so that the first coordinates carry most of an
inner product; the sum over these plus the product of the residual lengths
bounds it (Cauchy-Schwarz), and only pairs whose bound reaches the query's
k-th score are scored in full.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .vectorblocks import candidate_blocks, findable, nearest, per_query, query_blocks, usable

SAMPLE = 2000  # vectors that fix the rotation; results are exact with any
STRIPE = 512  # candidates that are bounded at once
PAIRS = 1 << 16  # pairs that are scored at once


FARTHEST = 2.0**100  # components beyond it are taken as it: their scores are beyond a long in any case


def quantised(v: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(256 * v), -FARTHEST, FARTHEST)


def whole_scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers as longs, exact; those beyond a long are its ends."""
    size = np.sqrt((q**2).sum(1) * (c**2).sum(1))
    score = np.zeros(len(q), np.int64)
    for rows, most in ((np.flatnonzero(size < 2.0**53), 0), (np.flatnonzero((size >= 2.0**53) & (size < 2.0**62)), 1), (np.flatnonzero(size >= 2.0**62), 2)):
        if not len(rows):
            continue
        if most == 0:  # doubles hold every partial sum
            score[rows] = np.einsum("ij,ij->i", q[rows], c[rows])
        elif most == 1 and np.abs(q[rows]).max() < 2.0**62 and np.abs(c[rows]).max() < 2.0**62:
            score[rows] = (q[rows].astype(np.int64) * c[rows].astype(np.int64)).sum(1)  # as the sum is below 2**63, it may wrap on the way
        else:
            high = (1 << 63) - 1
            low = -high
            score[rows] = [min(max(sum(int(a) * int(b) for a, b in zip(x, y, strict=True)), low), high) for x, y in zip(q[rows].tolist(), c[rows].tolist(), strict=True)]
    return score


def rotations(rows: DataFrame) -> dict[int, np.ndarray]:
    """Right singular vectors by dimension, from a bounded sample."""
    found: dict[int, list[np.ndarray]] = {}
    for r in rows.select("_dim", "_data").orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE).collect():
        found.setdefault(r._dim, []).append(np.frombuffer(r._data))
    return {d: np.linalg.svd(np.stack(x), full_matrices=True)[2].T for d, x in found.items()}


def exact_search(k: int, turns: dict[int, np.ndarray]):
    def search(q_ids, q, c_ids, c, bound):
        turn = turns.get(q.shape[1])
        turn = np.eye(q.shape[1]) if turn is None else turn
        parts = sorted({max(1, q.shape[1] // 8), max(1, q.shape[1] // 3)})
        turned, lengths = q @ turn, np.sqrt((q**2).sum(1))
        c_lengths = np.sqrt((c**2).sum(1))
        at_all, id_all, score_all = [], [], []
        order = np.argsort(-c_lengths, kind="stable")
        slack = 1e-9 * (1 + lengths * c_lengths.max())
        for a in range(0, len(order), STRIPE):
            rows = order[a : a + STRIPE]
            least = bound - slack
            live = np.flatnonzero(lengths * c_lengths[rows[0]] >= least)
            if not len(live):
                break
            x = c[rows] @ turn
            mask = np.ones((len(live), len(rows)), bool)
            for p in parts:
                rest_q = np.sqrt(np.maximum(0, (turned[live, p:] ** 2).sum(1)))
                rest_x = np.sqrt(np.maximum(0, (x[:, p:] ** 2).sum(1)))
                mask &= turned[live, :p] @ x[:, :p].T + np.outer(rest_q, rest_x) >= least[live, None]
            i, j = np.nonzero(mask)
            at, found = live[i], rows[j]
            own = q_ids[at] == c_ids[found]
            at, found = at[~own], found[~own]
            if len(at) > 0.2 * len(q) * len(rows) and lengths.max() * c_lengths[rows[0]] < 2.0**53:
                score = (q @ c[rows].T)[at, j[~own]].astype(np.int64)  # exact: doubles hold every partial sum
            else:
                score = np.concatenate([whole_scores(q[at[i : i + PAIRS]], c[found[i : i + PAIRS]]) for i in range(0, len(at), PAIRS)] or [np.zeros(0, np.int64)])
            good = score >= least[at]
            at, found, score = at[good], c_ids[found[good]], score[good]
            at_all.append(at)
            id_all.append(found)
            score_all.append(score)
            if a % (4 * STRIPE) == 0:
                at, found, score = (np.concatenate(v) for v in (at_all, id_all, score_all))
                bound = per_query(at, score, bound, k)
                good = score >= bound[at] - slack[at]
                at_all, id_all, score_all = [at[good]], [found[good]], [score[good]]
        if not at_all:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(at_all), np.concatenate(id_all), np.concatenate(score_all).astype(np.int64)

    return search


def top_inner_products(vectors: DataFrame, queries: Column, k: int, key: str = "vec_id", column: str = "embedding", prepare=quantised) -> DataFrame:
    """The k candidates of highest inner product for every row for which ``queries`` holds.

    Rows (query_id, rank, vec_id, score), ties to the smaller id. Vectors that
    are null, empty or hold null or non-finite components, and null ids, take
    no part; scores beyond a long are its ends; vectors meet those of their own
    dimension; rows with a query's id are no candidates of it; an id that is
    repeated asks once (with its shortest vector) and can be found as often as
    it is there, k times at most for one vector. Only the two columns are read. An empty table gives an empty result.
    """
    rows = usable(vectors, prepare, True, key, column)
    blocks = candidate_blocks(cut(findable(rows, k)))
    asked, numbers, _ = query_blocks(usable(vectors.where(queries), prepare, True, key, column))
    return nearest(blocks, asked, numbers, k, exact_search(k, rotations(rows)), "long")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""
