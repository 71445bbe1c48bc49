"""Sharding by a Feistel permutation of global row numbers.

Rows are numbered from 0 in the order of their keys, whatever partitions they
came in. A keyed Feistel network over the next even power of two permutes the
numbers; a number that leaves the range goes through again until it is back
(cycle walking), so that the whole is a permutation of the rows. A row's place
gives its shard (place modulo shards) and slot (place over shards): shards
differ by one row at most, every slot is filled, and which row lies at a shard
and slot is computed by walking back, without any table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

ROUNDS = 6
WORD = 31  # bits of a word of the round function: a product of two stays in a long
MIX = ((15, 0x2C1B3C6D), (12, 0x297A2D39))


def round_keys(seed: str) -> list[int]:
    return [int.from_bytes(hashlib.sha256(f"{seed}:{i}".encode()).digest()[:4], "big") >> 1 for i in range(ROUNDS)]


class Permutation:
    """A permutation of 0 to n - 1 that the seed decides, and its inverse."""

    def __init__(self, n: int, seed: str):
        self.n, self.keys = n, round_keys(seed)
        self.half = max(1, -(-max(0, n - 1).bit_length() // 2))
        self.mask = (1 << self.half) - 1

    def scramble(self, x: np.ndarray, key: int) -> np.ndarray:
        word = (1 << WORD) - 1
        x = (x + key) & word
        for shift, factor in MIX:
            x = ((x ^ (x >> shift)) * factor) & word
        return (x ^ (x >> 15)) & self.mask

    def once(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for key in self.keys:
            left, right = right, left ^ self.scramble(right, key)
        return (left << self.half) | right

    def back(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for key in reversed(self.keys):
            left, right = right ^ self.scramble(left, key), left
        return (left << self.half) | right

    def walk(self, x: np.ndarray, step) -> np.ndarray:
        x = step(np.asarray(x, np.int64))
        while (outside := x >= self.n).any():
            x[outside] = step(x[outside])
        return x

    def places(self, numbers: np.ndarray) -> np.ndarray:
        return self.walk(numbers, self.once)

    def numbers(self, places: np.ndarray) -> np.ndarray:
        return self.walk(places, self.back)

    def row_at(self, shard: int, slot: int, shards: int) -> int:
        """Number of the row that lies at a shard and slot."""
        return int(self.numbers(np.array([slot * shards + shard]))[0])


def numbered(rows: DataFrame, *order: str) -> tuple[DataFrame, list[int]]:
    """``rows`` sorted by ranges and cut, with _part and _at (place in the part), and the number of rows before each part.

    Rows that are alike in ``order`` are dealt over ranges too. Only a count a
    part comes to the driver.
    """
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    keys = [F.col(c).asc_nulls_last() for c in order]
    ranged = cut(tied.repartitionByRange(*keys, "_tie").sortWithinPartitions(*keys, "_tie").drop("_tie"))
    placed = ranged.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    counts = dict(placed.groupBy("_part").count().collect())
    before = [0]
    for part in range(max(counts, default=-1) + 1):
        before.append(before[-1] + counts.get(part, 0))
    return placed, before


def size_of(text: Column) -> Column:
    return (F.octet_length(F.coalesce(text, F.lit(""))) + 1).cast("long")


def sharded(docs: DataFrame, shards: int = 8, seed: str = "shard", keep: tuple[str, ...] = ("doc_id",)) -> tuple[DataFrame, Permutation]:
    """The columns ``keep`` of every row, with _size, _crc, _shard and _slot, and the permutation.

    Rows are numbered by doc_id (nulls last), checksum, size and a hash of all
    columns, so the result doesn't depend on files or partitions. A null text
    is an empty one of size 1; equal rows are rows of their own that take any
    of their places; an empty table gives no rows; columns of any other name
    pass through where ``keep`` names them.
    """
    made = ("_size", "_crc", "_shard", "_slot")
    text = F.coalesce("text", F.lit("")).cast("string")
    kept = [c for c in keep if c not in made]  # the columns made here take the place of those of these names
    narrow = docs.select(F.col("doc_id").alias("_id"), size_of(F.col("text")).alias("_size"), F.crc32(text).alias("_crc"), F.xxhash64(*docs.columns).alias("_hash"), F.struct(F.lit(0).alias("_none"), *kept).alias("_kept"))
    placed, before = numbered(narrow, "_id", "_crc", "_size", "_hash")
    permutation = Permutation(before[-1], seed)
    start = np.array(before[:-1], np.int64)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                part, at = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_part", "_at"))
                place = permutation.places(start[part] + at)
                columns = [batch.column("_kept"), batch.column("_size"), batch.column("_crc"), pa.array((place % shards).astype(np.int32)), pa.array(place // shards)]
                yield pa.RecordBatch.from_arrays(columns, ["_kept", *made])

    kinds = placed.select("_kept").schema["_kept"].dataType.simpleString()
    out = placed.select("_kept", "_size", "_crc", "_part", "_at").mapInArrow(put, f"_kept {kinds}, _size long, _crc long, _shard int, _slot long")
    return out.select(*[F.col("_kept")[c].alias(c) for c in kept], *made), permutation


def write_shards(docs: DataFrame, folder: str, shards: int = 8, seed: str = "shard", rows_a_file: int = 1 << 20) -> None:
    """Whole rows as Parquet under ``folder``/_shard=N, each file a run of slots in order."""
    rows, _ = sharded(docs, shards, seed, keep=tuple(docs.columns))
    runs = rows.withColumn("_run", F.floor(F.col("_slot") / rows_a_file))
    runs.repartition("_shard", "_run").sortWithinPartitions("_shard", "_slot").drop("_run").write.partitionBy("_shard").parquet(folder)


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = sharded(table(spark, sf_dir, "documents"))
    none = F.lit(None).cast("int")
    return rows.select("doc_id", F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.lit("rows").alias("law"), F.col("_shard").alias("shard"), F.col("_slot").alias("slot"), none.alias("grown_shard"))


#: The checksums of the numbers 0 to 15 as half bytes, by the polynomial of CRC-32.
HALF_BYTES = [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]


def shard_sql(shards: int = 8, seed: str = "shard") -> str:
    """The same in DuckDB SQL for tables of distinct ids: the network round by round, the walk as recursion."""
    word = (1 << WORD) - 1
    network = "SELECT rn, step, n, half, (1::BIGINT << half) - 1 AS mask, p >> half AS l, p & ((1::BIGINT << half) - 1) AS r FROM walk WHERE step = 0 OR p >= n"
    for key in round_keys(seed):
        network = f"SELECT *, (r + {key}) & {word} AS x FROM ({network})"
        for shift, factor in MIX:
            network = f"SELECT * EXCLUDE (x), (xor(x, x >> {shift}) * {factor}) & {word} AS x FROM ({network})"
        network = f"SELECT rn, step, n, half, mask, r AS l, xor(l, xor(x, x >> 15) & mask) AS r FROM ({network})"
    return rf"""
WITH RECURSIVE t(c) AS (SELECT {HALF_BYTES}),
d AS (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) + 1 AS size, row_number() OVER (ORDER BY doc_id) - 1 AS rn, count(*) OVER () AS n,
  list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda b: CAST('0x' || b AS BIGINT)) AS bytes FROM documents),
h AS (SELECT min(w) AS half FROM range(1, 32) r(w), (SELECT max(n) AS n FROM d) WHERE (1::BIGINT << CAST(2 * w AS INTEGER)) >= n),
walk AS (
  SELECT rn, 0 AS step, n, CAST(half AS INTEGER) AS half, rn AS p FROM d, h
  UNION ALL SELECT rn, step + 1, n, half, (l << half) | r AS p FROM ({network})
), place AS (SELECT rn, arg_max(p, step) AS p FROM walk GROUP BY rn),
crc AS (SELECT rn, list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda a, b: xor(xor(xor(a, b) >> 4, c[(xor(a, b) & 15) + 1]) >> 4, c[(xor(xor(a, b) >> 4, c[(xor(a, b) & 15) + 1]) & 15) + 1])) AS state FROM d, t)
SELECT doc_id, size, CAST(xor(state, 4294967295::BIGINT) AS BIGINT) AS text_crc32, 'rows' AS law, CAST(p % {shards} AS INTEGER) AS shard, p // {shards} AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM d JOIN place USING (rn) JOIN crc USING (rn)"""


OP11_SQL = shard_sql()
