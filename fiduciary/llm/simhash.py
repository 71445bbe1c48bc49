"""Near-duplicate documents by SimHash fingerprints and generalised pigeonholes.

The 64 bits are cut into parts of correlated bits. If two fingerprints differ
in at most ``t`` bits, then in some part i they differ in at most ``t_i``, for
any thresholds with sum t - parts + 1. Dynamic programming picks the thresholds
(and the number of parts) of least estimated cost; every fingerprint is looked
up under its own value in a part and all values within the part's threshold,
and what meets is verified on all 64 bits. A bucket returns the links that span
it, not all its pairs; buckets too large for a task are dealt out as pairs of
blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, per_batch, spread_join, table, texts
from .components import components

BITS = 64
SAMPLE = 2000  # fingerprints on which costs are estimated; results don't depend on it
BUCKET = 16_384  # fingerprints that one task compares at once
BLOCK = BUCKET // 2
SMALL = 48  # buckets up to this size are compared many at a time


def fingerprint(text: str, size: int = 4, seed: int = 42) -> int:
    """Majority of the bits of the shingles' XXH64 hashes, ties to 0; 0 without words."""
    import xxhash

    words = text.encode().lower().split()  # of bytes: A-Z only, and white space \x20\x09-\x0D only
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_intdigest(line, seed)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], seed) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=False)], np.uint64)
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        part = hashes[i : i + (1 << 15)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, size: int = 4, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (_id, _print) with the columns ``keep``; null texts count as empty."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints = np.array([fingerprint(x, size) for x in texts(batch.column(1))], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64)), *batch.columns[2:]], ["_id", "_print", *keep])

    kinds = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(F.expr(f"try_cast(`{key}` AS BIGINT)"), text, *keep).mapInArrow(per_batch(run), "_id long, _print long" + kinds)


@dataclass
class Plan:
    """Masks of the parts that are looked up, with the threshold of each."""

    masks: list[int]
    thresholds: list[int]

    def flips(self, i: int) -> np.ndarray:
        """What a part's value is changed by to reach all values within the threshold."""
        bits = [1 << b for b in range(BITS) if self.masks[i] >> b & 1]
        return np.array([sum(c) for n in range(self.thresholds[i] + 1) for c in combinations(bits, n)], np.uint64)


def bit_sums(prints: DataFrame) -> tuple[np.ndarray, int]:
    """How many of all fingerprints have both bit i and bit j, and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS))
        for batch in batches:
            bits = np.unpackbits(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j].astype(np.int64))], ["i", "j", "n"])

    out = np.zeros((BITS, BITS))
    for r in prints.select("_print").mapInArrow(run, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        out[r.i, r.j] = r.n
    return out, prints.count()


def grouped_bits(both: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of nearly equal size, each grown by the bit most correlated with it."""
    share = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    tied = np.abs(both / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread)
    np.fill_diagonal(tied, 0)
    left, groups = list(range(BITS)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        group = [max(left, key=lambda b: (tied[b, left].sum(), -b))]
        left.remove(group[0])
        while len(group) < size:
            best = max(left, key=lambda b: (tied[b, group].sum(), -b))
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


def plan(prints: DataFrame, distance: int) -> Plan:
    """Parts and thresholds of least estimated cost: rows looked up plus pairs to verify."""
    both, n = bit_sums(prints)
    sample = np.array([r._print for r in prints.orderBy(F.xxhash64("_print"), "_print").limit(SAMPLE).collect()], np.int64).view(np.uint64)
    best: tuple[float, Plan] | None = None
    for parts in range(2, distance + 3):
        masks = [sum(1 << b for b in g) for g in grouped_bits(both, n, parts)]
        costs = []  # of part i under threshold -1, 0, 1, ...
        for mask in masks:
            apart = np.zeros(BITS + 1)
            for i in range(len(sample)):
                apart += np.bincount(np.bitwise_count((sample[i + 1 :] ^ sample[i]) & np.uint64(mask)), minlength=BITS + 1)
            near = (np.cumsum(apart) + 1) / max(1, len(sample) * (len(sample) - 1) / 2)
            looked = np.cumsum([comb(mask.bit_count(), t) for t in range(distance + 1)])
            costs.append([0.0] + [float(n * looked[t] + 0.01 * n * n * near[t] * looked[t]) for t in range(distance + 1)])
        table_: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for cost in costs:  # thresholds plus one have to sum up to distance + 1
            step: dict[int, tuple[float, list[int]]] = {}
            for used, (so_far, chosen) in table_.items():
                for t in range(-1, distance - used + 1):
                    total = so_far + cost[t + 1]
                    if used + t + 1 not in step or total < step[used + t + 1][0]:
                        step[used + t + 1] = total, [*chosen, t]
            table_ = step
        total, chosen = table_[distance + 1]
        if best is None or total < best[0]:
            best = total, Plan([m for m, t in zip(masks, chosen, strict=True) if t >= 0], [t for t in chosen if t >= 0])
    return best[1]


def find(parent: dict[int, int], x: int) -> int:
    while (up := parent.setdefault(x, x)) != x:
        parent[x] = x = parent[up]
    return x


def spanning(values: np.ndarray, ends: np.ndarray, distance: int) -> tuple[list[int], list[int]]:
    """Links that span every group of ``values`` (groups end at ``ends``) under the relation of at most ``distance`` bits."""
    a_out: list[int] = []
    b_out: list[int] = []
    starts = np.r_[0, ends[:-1]]
    sizes = ends - starts
    small = (sizes > 1) & (sizes <= SMALL)
    if small.any():
        group = np.repeat(np.arange(len(ends)), sizes)
        pick = small[group]
        v, g = values[pick], group[pick]
        parent: dict[int, int] = {}
        for shift in range(1, int(sizes[small].max())):
            hit = np.flatnonzero((g[shift:] == g[:-shift]) & (np.bitwise_count(v[shift:] ^ v[:-shift]) <= distance))
            for x, y in zip(v[hit].tolist(), v[hit + shift].tolist(), strict=True):
                p, q = find(parent, x), find(parent, y)
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    a_out.append(x)
                    b_out.append(y)
    for i in np.flatnonzero(sizes > SMALL):
        rest = np.unique(values[starts[i] : ends[i]])
        while len(rest):
            front, rest = [rest[0]], rest[1:]
            while front and len(rest):
                x = front.pop()
                near = np.bitwise_count(rest ^ x) <= distance
                if near.any():
                    new = rest[near]
                    rest = rest[~near]
                    front.extend(new)
                    a_out += [int(x)] * len(new)
                    b_out += new.tolist()
    return a_out, b_out


def links(prints: DataFrame, distance: int) -> DataFrame:
    """Links (a, b) between distinct fingerprints with the same components as all links of at most ``distance`` bits."""
    p = plan(prints, distance)
    flips = [p.flips(i) for i in range(len(p.masks))]

    def keys(batch: pa.RecordBatch) -> pa.RecordBatch:
        v = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        rows = [((v & np.uint64(m))[:, None] ^ f[None, :]).ravel() for m, f in zip(p.masks, flips, strict=True)]
        part = np.repeat(np.arange(len(rows)), [len(r) for r in rows]).astype(np.int32)
        held = np.concatenate([np.repeat(v, len(f)) for f in flips])
        return pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.concatenate(rows).view(np.int64)), pa.array(held.view(np.int64))], ["part", "key", "_print"])

    keyed = prints.select("_print").mapInArrow(per_batch(keys), "part int, key long, _print long")
    large = keyed.groupBy("part", "key").count().where(F.col("count") > BUCKET).select("part", "key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    large = cut(large)
    if large.isEmpty():
        dealt = keyed.withColumns({"x": F.lit(0), "y": F.lit(0)})
    else:
        own = F.pmod(F.xxhash64("_print"), F.col("blocks")).cast("int")
        joined = keyed.join(large, ["part", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", own)
        met = joined.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where((F.col("blocks") == 1) | (F.col("own") != F.col("other")))
        dealt = met.select("part", "key", "_print", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def done(whole: bool) -> Iterator[pa.RecordBatch]:
            group, value = (np.concatenate(x) for x in zip(*held, strict=True))
            change = np.flatnonzero((group[1:] != group[:-1]).any(1)) + 1
            if whole:
                change = np.r_[change, len(value)]
            held.clear()
            last = int(change[-1]) if len(change) else 0
            held.append((group[last:], value[last:]))
            if last:
                a, b = spanning(value[:last], change, distance)
                a, b = np.array(a, np.uint64), np.array(b, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            if batch.num_rows:
                held.append((np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1, 3, 4)], 1), batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)))
                yield from done(False)
        if held:
            yield from done(True)

    by = ["part", "key", "x", "y"]
    return dealt.select("part", "key", "_print", "x", "y").repartition(*by).sortWithinPartitions(*by, "_print").mapInArrow(compare, "a long, b long")


def simhash_groups(docs: DataFrame, distance: int = 4, size: int = 4, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (_id, _print, _root, _component) with the columns ``keep`` for every row of ``docs``.

    The component is the smallest id that can be reached over links of at most
    ``distance`` bits, itself included. Null texts and texts without words have
    fingerprint 0, linked like any other; a null id belongs to its fingerprint's
    component but can't name it; ids are read as long (what is no number counts
    as null); repeated rows stay; an empty table gives an
    empty result; only the two columns and ``keep`` are read. The root is a
    fingerprint that tells components apart, also those without any id.
    """
    marked = cut(fingerprints(docs, size, key, text, keep))
    distinct = cut(marked.groupBy("_print").agg(F.min("_id").alias("_least")))
    roots = components(links(distinct, distance))
    rooted = cut(distinct.join(roots, distinct["_print"] == roots["node"], "left").select("_print", "_least", F.coalesce("root", "_print").alias("_root")))
    names = rooted.groupBy("_root").agg(F.min("_least").alias("_component"))
    named = spread_join(rooted, names, "_root").select("_print", "_root", "_component")
    return spread_join(marked, named, "_print").select("_id", "_print", "_root", "_component", *keep)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_groups(table(spark, sf_dir, "documents"))
    return out.select(F.col("_id").alias("doc_id"), F.lower(F.lpad(F.hex("_print"), 16, "0")).alias("fingerprint"), F.col("_component").alias("component_id"))
