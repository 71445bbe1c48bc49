"""Line dedup with DataFrame functions only.

Every line becomes a hash once. The hashes are range-partitioned and sorted by
hash, document and position, so that a stream over a partition meets a line's
first occurrence in a document before the others; ranges are cut within a hash
too, so a line that very many documents share fills several partitions. The
documents of a line are its first occurrences, counted per partition before
they meet. What comes back per document is a compressed bitmap of the lines it
keeps (64 lines a word, words of which all stay left out), not text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Parts into which a repeated line's occurrences are dealt where its table is joined by a shuffle.
SALTS = 16


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def hashed(docs: DataFrame, least_length: int) -> DataFrame:
    """A row for every line that has a key: row key (_id, _text), _pos and 96 bits of hash (_h, _g)."""

    def code(line: Column) -> Column:
        key = line_key(line)
        return F.when(F.char_length(key) >= least_length, F.struct(F.xxhash64(key).alias("_h"), F.hash(key).alias("_g")))

    lines = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_text"), F.posexplode(F.transform(lines_of(F.col("text")), code)).alias("_pos", "_line"))
    return lines.where("_line IS NOT NULL").select("_id", "_text", "_pos", "_line._h", "_line._g")


def line_stream(docs: DataFrame, least_length: int = 1) -> DataFrame:
    """Line hashes by range and, within a range, by hash, document and position; _first marks the first one in its document.

    Rows that are equal in id and text are documents of their own: each has its
    first occurrence.
    """
    document = ["_h", "_g", "_id", "_text"]
    ranged = cut(hashed(docs, least_length)).repartitionByRange(*document).sortWithinPartitions(*document, "_pos")
    return ranged.withColumn("_first", F.rank().over(Window.partitionBy(*document).orderBy("_pos")) == 1)


def repeated_hashes(stream: DataFrame, documents: int) -> DataFrame:
    """Line hashes with at least ``documents`` first occurrences, and the place of the very first one (_place)."""
    firsts = stream.where("_first")
    place = F.min(F.struct(F.col("_id").isNull().alias("unnamed"), "_id", "_text", "_pos")).alias("_place")
    return firsts.groupBy("_h", "_g").agg(F.count(F.lit(1)).alias("_n"), place).where(F.col("_n") >= documents)


def keep_bitmaps(docs: DataFrame, documents: int = 10, least_length: int = 1, keep_first: bool = False) -> DataFrame:
    """For every document that loses lines: _id, _text (hash of its text) and _keeps.

    _keeps maps numbers of words to 64 bits, one a line, set if it stays; a word
    that is not there keeps all its lines. The table of repeated hashes is
    broadcast if its size, known by then, is below the session's limit, and
    joined by a salted shuffle beyond it. With ``keep_first`` the very first occurrence
    of a repeated line stays.
    """
    stream = line_stream(docs, least_length)
    salted = stream.withColumn("_salt", F.pmod(F.xxhash64("_id", "_text"), F.lit(SALTS)).cast("int"))
    repeated = repeated_hashes(stream, documents).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    on = ["_h", "_g", "_salt"]
    if keep_first:
        place = F.struct(F.col("_id").isNull().alias("unnamed"), "_id", "_text", "_pos")
        gone = salted.join(repeated.select(*on, "_place"), on).where(~place.eqNullSafe(F.col("_place")))
    else:
        gone = salted.join(repeated.select(*on), on, "left_semi")
    bit = F.expr("shiftleft(1L, CAST(_pos % 64 AS INT))")
    words = gone.groupBy("_id", "_text", F.expr("CAST(_pos DIV 64 AS INT)").alias("_word")).agg(F.bitwise_not(F.bit_or(bit)).alias("_bits"))
    return words.groupBy("_id", "_text").agg(F.map_from_entries(F.collect_list(F.struct("_word", "_bits"))).alias("_keeps"))


def line_dedup(docs: DataFrame, documents: int = 10, least_length: int = 1, keep_first: bool = False) -> DataFrame:
    """``docs`` with _n_lines, _n_dropped and _kept, the text without lines whose key is in ``documents`` documents or more.

    The key of a line is the line without white space at both ends, A-Z in
    lower case; keys shorter than ``least_length`` code points never count. A
    null or empty text is one empty line and stays empty. Every row counts as a
    document, repeated ones too; null ids are allowed; an empty table gives an
    empty result; columns of any other name pass through.
    """
    bitmaps = keep_bitmaps(docs.select("doc_id", "text"), documents, least_length, keep_first)
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.xxhash64("text").alias("_hash"))
    joined = rows.join(bitmaps, F.col("_row.doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_text")), "left")
    lines = lines_of(F.col("_row.text"))

    def stays(i: Column) -> Column:
        word = F.coalesce(F.try_element_at("_keeps", F.floor(i / 64).cast("int")), F.lit(-1).cast("long"))
        return F.getbit(word, (i % 64).cast("int")) == 1

    kept = F.when(F.col("_keeps").isNull(), F.coalesce("_row.text", F.lit(""))).otherwise(F.array_join(F.filter(lines, lambda x, i: stays(i)), "\n"))
    count = F.coalesce(F.aggregate(F.map_values("_keeps"), F.lit(0).cast("long"), lambda a, x: a + 64 - F.bit_count(x)), F.lit(0).cast("long"))
    out = joined.select("_row", F.size(lines).cast("long").alias("_n_lines"), count.alias("_n_dropped"), kept.alias("_kept"))
    made = ("_n_lines", "_n_dropped", "_kept")  # take the place of columns of these names
    return out.select(*[F.col("_row")[c].alias(c) for c in docs.columns if c not in made], *made)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2("_kept", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10),
j AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY r, doc_id
"""
