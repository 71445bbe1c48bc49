"""Queries of names that are spelt alike, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import spelling
from . import domain as D

Query = Callable[[SparkSession, str], DataFrame]


def title(text: Column) -> Column:
    """The first three words of a text."""
    return F.array_join(F.slice(F.split(text, " ", 4), 1, 3), " ")


def names(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Titles of documents as observed names, and other forms of parts' names; titles of the benchmark's items and parts' names as aliases of entities."""
    items = D.table(s, d, "benchmark").select(F.concat(F.lit("item:"), F.col("item_id").cast("string")).alias("stable_id"), title(F.col("text")).alias("alias"))
    parts = D.table(s, d, "part").select(F.concat(F.lit("part:"), F.col("p_name")).alias("stable_id"), F.col("p_name").alias("alias"))
    forms = F.array(F.upper("p_name"), F.array_join(F.reverse(F.split("p_name", " ")), "-"), F.replace("p_name", F.lit("i"), F.lit("")), F.get(F.split("p_name", " "), F.lit(1)))
    sources = D.table(s, d, "documents").select(title(F.col("text")).alias("source_name")).union(D.table(s, d, "part").select(F.explode(forms)))
    return sources, items.union(parts)


def candidates(s: SparkSession, d: str) -> DataFrame:
    return spelling.tiered_candidates(*names(s, d))


def decisions(s: SparkSession, d: str) -> DataFrame:
    sources, entities = names(s, d)
    return spelling.alias_decisions(sources, spelling.tiered_candidates(sources, entities))


QUERIES: dict[str, Query] = {"j11_tiered_candidates": candidates, "j12_alias_decisions": decisions}

# Every pair of names is compared in full: runs of equal letters on the diagonals, and the longest one of every open stretch, by recursion.
CANDIDATES = r"""WITH RECURSIVE src AS (SELECT DISTINCT source_name, trim(regexp_replace(lower(source_name), '[^a-z0-9]+', ' ', 'g')) AS a FROM (
    SELECT array_to_string(list_slice(string_split(text, ' '), 1, 3), ' ') AS source_name FROM documents WHERE text IS NOT NULL
    UNION ALL SELECT unnest([upper(p_name), array_to_string(list_reverse(string_split(p_name, ' ')), '-'), replace(p_name, 'i', ''), string_split(p_name, ' ')[2]]) FROM part)),
ent AS (SELECT DISTINCT stable_id, trim(regexp_replace(lower(alias), '[^a-z0-9]+', ' ', 'g')) AS b FROM (
    SELECT 'item:' || CAST(item_id AS VARCHAR) AS stable_id, array_to_string(list_slice(string_split(text, ' '), 1, 3), ' ') AS alias FROM benchmark UNION ALL SELECT 'part:' || p_name, p_name FROM part)),
pair AS (SELECT a, b, CAST(length(a) AS INTEGER) AS la, CAST(length(b) AS INTEGER) AS lb FROM (SELECT DISTINCT a FROM src WHERE a <> ''), (SELECT DISTINCT b FROM ent WHERE b <> '')
  WHERE 2.0 * least(length(a), length(b)) / (length(a) + length(b)) >= 0.72),
la AS (SELECT DISTINCT a, i, substr(a, i, 1) AS c FROM (SELECT a, unnest(range(1, length(a) + 1)) AS i FROM (SELECT DISTINCT a FROM src WHERE a <> ''))),
lb AS (SELECT DISTINCT b, j, substr(b, j, 1) AS c FROM (SELECT b, unnest(range(1, length(b) + 1)) AS j FROM (SELECT DISTINCT b FROM ent WHERE b <> ''))),
cells AS (SELECT pair.a, pair.b, la.i, lb.j, row_number() OVER (PARTITION BY pair.a, pair.b, la.i - lb.j ORDER BY la.i) AS n FROM pair JOIN la ON la.a = pair.a JOIN lb ON lb.b = pair.b AND lb.c = la.c),
runs AS MATERIALIZED (SELECT a, b, min(i) AS i, min(j) AS j, count(*) AS len FROM cells GROUP BY a, b, i - j, i - n),
cut AS (
  SELECT a, b, 1::BIGINT AS i0, la + 1::BIGINT AS i1, 1::BIGINT AS j0, lb + 1::BIGINT AS j1, 0::BIGINT AS found, 1 AS step FROM pair
  UNION ALL
  SELECT a, b, unnest([i0, i + len]), unnest([i, i1]), unnest([j0, j + len]), unnest([j, j1]), unnest([len, 0]), step + 1
  FROM (SELECT a, b, i0, i1, j0, j1, best.i AS i, best.j AS j, -best.len AS len, step FROM (
    SELECT a, b, i0, i1, j0, j1, step, min({'len': -(least(i + len, i1, i + j1 - j) - greatest(i, i0, i + j0 - j)), 'i': greatest(i, i0, i + j0 - j), 'j': greatest(j, j0, j + i0 - i)}) AS best
    FROM cut JOIN runs USING (a, b) WHERE least(i + len, i1, i + j1 - j) > greatest(i, i0, i + j0 - j) GROUP BY a, b, i0, i1, j0, j1, step))
), ratio AS (SELECT a, b, 2.0::DOUBLE * sum(found) / (length(a) + length(b)) AS r FROM cut GROUP BY a, b),
over AS (SELECT source_name, stable_id, a, b, len(list_intersect(ta, tb)) / CAST(len(ta) + len(tb) - len(list_intersect(ta, tb)) AS DOUBLE) AS o FROM (
    SELECT *, list_distinct(string_split(a, ' ')) AS ta, list_distinct(string_split(b, ' ')) AS tb FROM src, ent WHERE a <> '' AND b <> '')),
best AS (SELECT source_name, stable_id, max(CASE WHEN over.a = over.b THEN 1 ELSE 0 END) AS same, max(o) AS o, max(r) AS r FROM over LEFT JOIN ratio ON ratio.a = over.a AND ratio.b = over.b GROUP BY source_name, stable_id),
candidates AS (SELECT source_name, stable_id, CASE WHEN same = 1 THEN 'exact' WHEN round(o, 4) >= 0.86 THEN 'normalized' ELSE 'fuzzy' END AS strategy, CASE WHEN same = 1 THEN 1.0::DOUBLE WHEN round(o, 4) >= 0.86 THEN round(o, 4) ELSE round(r, 4) END AS confidence
  FROM best WHERE same = 1 OR round(o, 4) >= 0.86 OR r >= 0.72)
"""

ORACLES: dict[str, str] = {
    "j11_tiered_candidates": CANDIDATES + "SELECT source_name, stable_id, strategy, confidence FROM candidates",
    "j12_alias_decisions": CANDIDATES
    + """, ranked AS (SELECT *, row_number() OVER w AS n, lead(confidence) OVER w AS after FROM candidates WINDOW w AS (PARTITION BY source_name ORDER BY confidence DESC, stable_id)),
judged AS (SELECT s.source_name, r.stable_id, r.strategy, coalesce(r.confidence, 0) AS confidence, coalesce(r.after IS NOT NULL AND round(r.confidence - r.after, 4) < 0.08, FALSE) AS ambiguous FROM (SELECT DISTINCT source_name FROM src) s LEFT JOIN ranked r ON r.source_name = s.source_name AND r.n = 1),
linked AS (SELECT *, coalesce(confidence >= 0.92 AND strategy <> 'fuzzy' AND NOT ambiguous, FALSE) AS link FROM judged)
SELECT source_name, CASE WHEN link THEN 'auto_link' ELSE 'review' END AS status, CASE WHEN link THEN stable_id END AS stable_id, confidence,
  CASE WHEN link THEN 'none' WHEN confidence >= 0.78 THEN 'medium' ELSE 'high' END AS review_priority,
  CASE WHEN stable_id IS NULL THEN 'no viable candidates' WHEN link THEN 'high-confidence ' || strategy || ' match' WHEN ambiguous THEN 'ambiguous top candidates' ELSE 'confidence below auto-link threshold' END AS reason
FROM linked""",
}
