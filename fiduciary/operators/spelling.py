"""Names that are spelt alike: candidates of every tier, and what to do with them.

A ratio is twice the letters in common blocks over the letters of both names,
where the blocks are the longest common one, then the longest ones left and
right of it, and so on (``difflib``). Names are compared in blocks by length:
two products of small matrices give, for all pairs of two blocks at once, the
letters and the pairs of neighbouring letters they share, and with those a bound
on the ratio; only pairs that can reach the threshold are compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import entity_token
from .quality import alias_candidates

BLOCK = 512  # names of a block
STEP = 1.3  # ratio of the longest to the shortest name of a band
# Thresholds of candidates and of their routing.
NORMALIZED, FUZZY = 0.86, 0.72
LINK, REVIEW, MARGIN = 0.92, 0.78, 0.08


def counts_of(names: list[str], width: int, places: dict[tuple[str, int], int]) -> list[list[int]]:
    """Every string of ``width`` letters in a name, numbered by its occurrence, as a place of a vector."""
    out = []
    for name in names:
        seen: dict[str, int] = {}
        row = []
        for i in range(len(name) - width + 1):
            gram = name[i : i + width]
            seen[gram] = seen.get(gram, 0) + 1
            row.append(places.setdefault((gram, seen[gram]), len(places)))
        out.append(row)
    return out


def shared(a: list[str], b: list[str], width: int) -> np.ndarray:
    """How many strings of ``width`` letters every two names share, repeats included."""
    places: dict[tuple[str, int], int] = {}
    rows = [counts_of(names, width, places) for names in (a, b)]
    ones = [np.zeros((len(r), len(places)), np.float32) for r in rows]
    for one, grams in zip(ones, rows, strict=True):
        for i, row in enumerate(grams):
            one[i, row] = 1
    return (ones[0] @ ones[1].T).astype(np.int64)


def most_common(a: list[str], b: list[str]) -> np.ndarray:
    """No less than the letters in common blocks of every two names.

    M letters in k blocks share M - k neighbours at least, and every gap
    between blocks leaves a letter of one name out, so k <= 1 + letters - 2 M.
    """
    letters = np.array([len(x) for x in a])[:, None] + np.array([len(x) for x in b])[None, :]
    return np.minimum(shared(a, b, 1), (shared(a, b, 2) + letters + 1) // 3)


def alike(a: list[str], b: list[str], least: float) -> list[tuple[str, str, float]]:
    """Pairs of unequal names with their ratio, from ``least`` up."""
    letters = np.array([len(x) for x in a])[:, None] + np.array([len(x) for x in b])[None, :]
    found, matcher, last = [], SequenceMatcher(), None
    for j, i in np.argwhere((2 * most_common(a, b) >= (least - 1e-9) * letters).T).tolist():
        if a[i] == b[j]:
            continue
        if j != last:  # what the matcher knows of its second name is kept
            matcher.set_seq2(b[j])
            last = j
        matcher.set_seq1(a[i])
        if (ratio := matcher.ratio()) >= least:
            found.append((a[i], b[j], ratio))
    return found


def blocks(names: DataFrame) -> DataFrame:
    """Rows (band, block, names): distinct names of like length, about BLOCK at a time."""
    rows = names.withColumn("band", F.floor(F.log(F.length("name").cast("double")) / math.log(STEP)).cast("int"))
    sizes = rows.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))  # bands grow with the logarithm of the longest name
    dealt = rows.join(F.broadcast(sizes), "band").withColumn("block", F.pmod(F.xxhash64("name"), F.col("parts")))
    return dealt.groupBy("band", "block").agg(F.collect_list("name").alias("names"))


def spelling_pairs(left: DataFrame, right: DataFrame, least: float = FUZZY) -> DataFrame:
    """Rows (a, b, ratio) of unequal names (column name) of both sides whose ratio is ``least`` or more: all of them."""
    reach = math.ceil(math.log((2 - least) / least) / math.log(STEP))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = alike(batch.column("names")[i].as_py(), batch.column("others")[i].as_py(), least)
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.float64())], ["a", "b", "ratio"])

    asked = blocks(left.distinct()).withColumn("band", F.explode(F.sequence(F.col("band") - reach, F.col("band") + reach)))
    met = asked.select("band", "names").join(blocks(right.distinct()).select("band", F.col("names").alias("others")), "band")
    return met.select("names", "others").mapInArrow(compare, "a string, b string, ratio double")


def tiered_candidates(sources: DataFrame, entities: DataFrame, fuzzy: float = FUZZY) -> DataFrame:
    """The candidates (source_name, stable_id, strategy, confidence) of every name.

    An entity counts by the first tier that any of its names reaches: exact
    (the same normalised name, 1), normalized (Jaccard overlap of tokens of
    0.86 or more), fuzzy (ratio of spelling of ``fuzzy`` or more); within the
    tier the best name counts. Names without letters and digits have none.
    """
    s = sources.select("source_name", entity_token(F.col("source_name")).alias("a")).where("a <> ''").distinct()
    e = entities.select("stable_id", entity_token(F.col("alias")).alias("b")).where("b <> ''").distinct()
    pairs = spelling_pairs(s.select(F.col("a").alias("name")), e.select(F.col("b").alias("name")), fuzzy)
    spelt = pairs.join(s, "a").join(e, "b").select("source_name", "stable_id", F.round("ratio", 4).alias("confidence"), F.lit("fuzzy").alias("strategy"))
    rows = alias_candidates(sources, entities, NORMALIZED).select("source_name", "stable_id", "confidence", "strategy").unionByName(spelt)
    tier = F.array_position(F.array(F.lit("fuzzy"), F.lit("normalized"), F.lit("exact")), F.col("strategy"))
    best = F.max(F.struct(tier.alias("tier"), "confidence", "strategy")).alias("best")
    return rows.groupBy("source_name", "stable_id").agg(best).select("source_name", "stable_id", "best.strategy", "best.confidence")


def alias_decisions(sources: DataFrame, candidates: DataFrame) -> DataFrame:
    """Link or review (with priority and reason) for every distinct source_name.

    Linked are names whose best candidate is exact or normalized, sure, and
    clear of the next one; spelling alone never links. Of a name's candidates
    only two leave each task, so a name with very many isn't gathered.
    """
    def best_two(c: Column) -> Column:
        return F.slice(F.array_sort(F.collect_list(c)), 1, 2)

    order = F.struct((-F.col("confidence")).alias("c"), F.col("stable_id").alias("id"), F.col("strategy").alias("strategy"))
    ranked = candidates.withColumn("n", F.row_number().over(Window.partitionBy("source_name").orderBy(F.desc("confidence"), "stable_id"))).where("n <= 2")
    top = ranked.groupBy("source_name").agg(best_two(order).alias("two"))
    rows = sources.select("source_name").distinct().join(top, "source_name", "left")
    first, second = F.get("two", F.lit(0)), F.get("two", F.lit(1))
    confidence = F.coalesce(-first["c"], F.lit(0.0))
    ambiguous = second.isNotNull() & (F.round(confidence + second["c"], 4) < MARGIN)
    linked = (confidence >= LINK) & first["strategy"].isin("exact", "normalized") & ~ambiguous
    reason = F.when(first.isNull(), "no viable candidates").when(linked, F.concat(F.lit("high-confidence "), first["strategy"], F.lit(" match"))).when(ambiguous, "ambiguous top candidates").otherwise("confidence below auto-link threshold")
    priority = F.when(first.isNull(), "high").when(linked, "none").when(confidence >= REVIEW, "medium").otherwise("high")
    return rows.select("source_name", F.when(linked, "auto_link").otherwise("review").alias("status"), F.when(linked, first["id"]).alias("stable_id"), confidence.alias("confidence"), priority.alias("review_priority"), reason.alias("reason"))
