"""Divergence of sources within a language, over the terms that enough documents use.

The terms are found by iceberg refinement of byte prefixes: a pass counts, per
language, the documents that hold each prefix of some length; a term that ends
before that length counts as itself. Prefixes in too few documents are
discarded with all terms that begin so, since no term is in more documents than
its beginning. The next pass extends those left to twice the length, until no
open prefix is left; a last pass counts the kept terms' occurrences by source.

What is left goes to the next pass as a bitmap of hashes of fixed size. Two
prefixes on one bit let a discarded one through to the next count, never the
other way, and terms are kept by their own count alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, portions, table

#: Bytes of a text: A-Z in lower case, other ASCII than letters as a space, all else as it is.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
PIECE = 4 << 20  # bytes of text whose words are looked at together
HELD = 500_000  # counts that a task holds before it adds up equal ones, and then passes them on
BITS = 1 << 26  # of the bitmap of prefixes: 8 MB
FIRST = 8  # bytes of the first prefixes; each level doubles them
#: Rows of the table of groups up to which it is broadcast; a larger one is joined by a shuffle.
BROADCAST_GROUPS = 20_000
TERMS, SOURCES = 256, 256  # of a bucket and of a block of sources where pairs are compared
UNIT = 1_000_000_000
SMOOTH = 5


class Words:
    """The words of some documents in one array: where each begins, its length and its document."""

    def __init__(self, text: bytes, a: int, b: int, ends: np.ndarray):
        self.bytes = np.frombuffer(text[a:b] + b" " * 8, np.uint8)
        inside = np.zeros(len(self.bytes) - 6, np.int8)
        inside[1:] = self.bytes[:-7] != 32
        edges = np.flatnonzero(np.diff(inside))
        self.start, self.length = edges[::2], edges[1::2] - edges[::2]
        self.doc = np.searchsorted(ends, self.start + a, "right")

    def only(self, mask: np.ndarray) -> Words:
        out = object.__new__(Words)
        out.bytes, out.start, out.length, out.doc = self.bytes, self.start[mask], self.length[mask], self.doc[mask]
        return out

    def keys(self, size: int) -> np.ndarray:
        """The first ``size`` bytes as numbers of eight bytes (a column each), zeros behind the word's end."""
        at = np.ndarray((len(self.bytes) - 7,), "<u8", self.bytes, strides=(1,))
        masks = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
        out = np.empty((len(self.start), size // 8), np.uint64)
        for j in range(size // 8):
            left = np.clip(self.length - 8 * j, 0, 8)
            out[:, j] = at[np.minimum(self.start + 8 * j, len(at) - 1)] & masks[left]
        return out


def pieces(texts: list[bytes]) -> Iterator[Words]:
    """The words of documents, some megabytes at a time; no word is cut."""
    joined = b" ".join(texts).translate(TERM_BYTES)
    ends = np.cumsum([len(t) + 1 for t in texts])
    a = 0
    while a < len(joined):
        b = len(joined) if len(joined) - a <= PIECE else joined.find(b" ", a + PIECE)
        b = len(joined) if b < 0 else b
        yield Words(joined, a, b, ends)
        a = b


def hashes(keys: np.ndarray, seed: np.ndarray | int = 0) -> np.ndarray:
    h = np.full(len(keys), seed, np.uint64) if np.isscalar(seed) else seed.copy()
    for j in range(keys.shape[1]):
        h ^= keys[:, j]
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        h ^= h >> np.uint64(31)
    return h


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different rows of ``keys`` and the number of each row's among them; told by hash, then compared."""
    _, first, code = np.unique(hashes(keys) if keys.shape[1] > 1 else keys[:, 0], return_index=True, return_inverse=True)
    if keys.shape[1] > 1 and not (keys[first][code] == keys).all():
        return np.unique(keys, axis=0, return_inverse=True)
    return keys[first], code


class Counts:
    """Counts by key and group: appended, and added up when there are many."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, keys: np.ndarray, group: np.ndarray, n: np.ndarray) -> None:
        self.parts.append((keys, group, n))
        self.size += len(keys)

    def merge(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All counts, sorted by key and group."""
        keys, group, n = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        rows, code = distinct(keys)
        many = int(group.max(initial=0)) + 1
        pair, at = np.unique(code * many + group, return_inverse=True)
        total = np.bincount(at, n, len(pair)).astype(np.int64)
        self.parts, self.size = [(rows[pair // many], pair % many, total)], len(pair)
        return self.parts[0]


def terms_of(keys: np.ndarray) -> pa.Array:
    """Keys as bytes, without the zeros behind the end."""
    return pa.array(np.ascontiguousarray(keys).view(f"S{8 * keys.shape[1]}").ravel().tolist(), pa.binary())


def seeds(langs: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    return np.array([known[x] if x in known else known.setdefault(x, xxhash.xxh64_intdigest(x)) for x in langs], np.uint64)


def bit_mask(words: Words, seed: np.ndarray, size: int, bitmap: np.ndarray) -> np.ndarray:
    """Whether the first ``size`` bytes of each word have a bit in the bitmap for the word's language."""
    place = hashes(words.keys(size), seed[words.doc]) & np.uint64(8 * len(bitmap) - 1)
    return (bitmap[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def columns_of(batch: pa.RecordBatch) -> Iterator[tuple[list[bytes], list[bytes], list[bytes]]]:
    for part in portions(batch, 2 << 20):
        yield tuple(pc.cast(part.column(c), pa.binary()).to_pylist() for c in ("text", "lang", "source"))


def document_counts(docs: DataFrame, size: int, bitmap) -> DataFrame:
    """Rows (lang, term, n): documents of a language that hold a prefix of ``size`` bytes, or a whole term if shorter.

    After the first level only words count that are as long as the prefixes of
    the level before and begin with one that has a bit in ``bitmap``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ones = np.frombuffer(bitmap.value, np.uint8) if bitmap else None
        counts, numbers = Counts(), {}

        def flush() -> Iterator[pa.RecordBatch]:
            if counts.size:
                keys, group, n = counts.merge()
                names = pa.array(list(numbers), pa.binary())
                for a in range(0, len(keys), 20_000):
                    here = slice(a, a + 20_000)
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(group[here])), terms_of(keys[here]), pa.array(n[here])], ["lang", "term", "n"])
                counts.parts, counts.size = [], 0

        for batch in batches:
            for texts, langs, _ in columns_of(batch):
                lang = np.array([numbers.setdefault(x, len(numbers)) for x in langs])
                seed = seeds(langs)
                held = Counts()  # documents are the groups: a word counts once in each
                for words in pieces(texts):
                    if bitmap:
                        words = words.only(words.length >= size // 2)
                        words = words.only(bit_mask(words, seed, size // 2, ones))
                    held.add(words.keys(size), words.doc, np.ones(len(words.doc)))
                if held.size:
                    keys, doc, _ = held.merge()
                    counts.add(keys, lang[doc], np.ones(len(doc)))
                if counts.size > HELD:
                    counts.merge()
                    if counts.size > HELD // 2:
                        yield from flush()
        yield from flush()

    parts = docs.mapInArrow(run, "lang binary, term binary, n long")
    return parts.groupBy("lang", "term").agg(F.sum("n").alias("n"))


def occurrences(docs: DataFrame, sizes: list[int], bitmap) -> DataFrame:
    """Rows (lang, term, source, n): occurrences of words that have a bit in ``bitmap``, by lengths up to each of ``sizes``.

    A task returns a row for each term, with its counts by source; they are
    taken apart where the term's rows have met.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ones = np.frombuffer(bitmap.value, np.uint8)
        counts, numbers = {size: Counts() for size in sizes}, {}

        def flush(found: Counts) -> Iterator[pa.RecordBatch]:
            if not found.size:
                return
            keys, group, n = found.merge()
            langs = sorted({x for x, _ in numbers})
            lang_of = np.array([langs.index(x) for x, _ in numbers])[group]
            order = np.argsort(lang_of, kind="stable")  # by language, then by key and group
            keys, group, n, lang_of = keys[order], group[order], n[order], lang_of[order]
            starts = np.flatnonzero(np.r_[True, (lang_of[1:] != lang_of[:-1]) | (keys[1:] != keys[:-1]).any(1)])
            names, sources = pa.array(langs, pa.binary()), pa.array([x for _, x in numbers], pa.binary())
            for a in range(0, len(starts), 20_000):
                first = np.append(starts[a : a + 20_000], starts[a + 20_000] if a + 20_000 < len(starts) else len(n))
                rows, offsets = slice(first[0], first[-1]), pa.array((first - first[0]).astype(np.int32))
                columns = [names.take(pa.array(lang_of[first[:-1]])), terms_of(keys[first[:-1]]), pa.ListArray.from_arrays(offsets, sources.take(pa.array(group[rows]))), pa.ListArray.from_arrays(offsets, pa.array(n[rows]))]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "term", "sources", "counts"])
            found.parts, found.size = [], 0

        for batch in batches:
            for texts, langs, origins in columns_of(batch):
                group = np.array([numbers.setdefault(x, len(numbers)) for x in zip(langs, origins, strict=True)])
                seed = seeds(langs)
                for words in pieces(texts):
                    for size, found in counts.items():
                        some = words.only((words.length < size) & (words.length >= (size // 2 if size > FIRST else 0)))
                        some = some.only(bit_mask(some, seed, size, ones))
                        found.add(some.keys(size), group[some.doc], np.ones(len(some.doc)))
                        if found.size > 2 * HELD:
                            found.merge()
                            if found.size > HELD:
                                yield from flush(found)
        for found in counts.values():
            yield from flush(found)

    parts = docs.mapInArrow(run, "lang binary, term binary, sources array<binary>, counts array<long>")
    each = parts.repartition("lang", "term").select("lang", "term", F.inline(F.arrays_zip(F.col("sources").alias("source"), F.col("counts").alias("n"))))
    return each.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"))


def bitmap_of(terms: DataFrame, sizes: list[int], bits: int) -> bytes:
    """A bit for every (lang, term), by the size of key of its level; put together in Spark: ``bits`` / 64 words at most come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seed = seeds(batch.column("lang").to_pylist())
            terms = batch.column("term").to_pylist()
            size = batch.column("size").to_numpy()
            for k in np.unique(size).tolist():
                rows = np.flatnonzero(size == k)
                keys = np.array([terms[i] for i in rows.tolist()], f"S{k}").view("<u8").reshape(len(rows), k // 8)
                yield pa.RecordBatch.from_arrays([pa.array((hashes(keys, seed[rows]) & np.uint64(bits - 1)).astype(np.int64))], ["place"])

    size = F.coalesce(*[F.when(F.length("term") < k, k) for k in sizes], F.lit(sizes[-1]))
    placed = terms.select("lang", "term", size.cast("int").alias("size")).mapInArrow(run, "place long")
    ones = F.bit_or(F.expr("shiftleft(1L, CAST(place % 64 AS INT))"))
    words = placed.groupBy(F.expr("place DIV 64").alias("word")).agg(ones.alias("ones")).toArrow()
    out = np.zeros(bits // 64, "<i8")
    out[words["word"].to_numpy()] = words["ones"].to_numpy()
    return out.tobytes()


def kept_terms(docs: DataFrame, least: int = 30, bits: int = BITS) -> DataFrame:
    """Rows (lang, source, term, n): occurrences of every term that at least ``least`` documents of its language hold.

    ``docs`` has text, lang and source, none null. Every row is a document.
    """
    share_out = docs.sparkSession.sparkContext.broadcast
    kept, sizes, bitmap = None, [FIRST], None
    while True:
        level = cut(document_counts(docs, sizes[-1], bitmap).where(F.col("n") >= least).select("lang", "term"))
        whole, left = level.where(F.length("term") < sizes[-1]), level.where(F.length("term") == sizes[-1])
        kept = whole if kept is None else kept.unionByName(whole)
        if left.isEmpty():
            break
        bitmap = share_out(bitmap_of(left, sizes[-1:], bits))
        sizes.append(2 * sizes[-1])
    found = occurrences(docs, sizes, share_out(bitmap_of(kept, sizes, bits)))
    rows = found.join(kept, ["lang", "term"], "left_semi")
    return cut(rows.select(F.col("lang").cast("string"), F.col("source").cast("string"), F.col("term").cast("string"), "n"))


def share(n: str, total: str, terms: str) -> Column:
    """1 + floor(UNIT (n + SMOOTH) / (total + SMOOTH terms)) of named columns, in whole numbers; null without terms."""
    whole = F.expr(f"{UNIT} * CAST({n} + {SMOOTH} AS DECIMAL(20, 0)) DIV CAST({total} + {SMOOTH} * {terms} AS DECIMAL(20, 0))")
    return F.when(F.col(terms) > 0, whole + 1)


def with_groups(rows: DataFrame, groups: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` with the columns of their group, by a broadcast up to a checked number of groups."""
    small = len(groups.take(BROADCAST_GROUPS + 1)) <= BROADCAST_GROUPS
    return rows.join(F.broadcast(groups) if small else groups, on)


def group_totals(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Every (lang, source) with its kept occurrences and those of its language, the language's terms, its number among the sources and its share of a term it lacks."""
    held = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    terms = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_distinct("term").alias("terms"))
    groups = docs.groupBy("lang", "source").count().drop("count").join(held, ["lang", "source"], "left").join(terms, "lang", "left")
    groups = groups.fillna(0, ["total", "lang_total", "terms"]).withColumn("none", F.lit(0).cast("long"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    return cut(groups.withColumns({"number": number, "p_none": F.coalesce(share("none", "total", "terms"), F.lit(0))}).drop("none"))


def pair_values(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows (lang, source, item, value) of both orders of every two sources: the summed differences of their shares.

    Terms are dealt to buckets of about TERMS and sources to blocks of SOURCES,
    so that a group is a bucket of terms of two blocks, of bounded size. A
    group adds up by how much its terms differ more than terms that both lack;
    what those differ by, times all terms, is added at the end.
    """
    blocks = groups.groupBy("lang").agg(((F.max("number") / SOURCES).cast("int")).alias("last"), (F.max("terms") / TERMS).cast("int").alias("buckets"))
    numbered = groups.withColumn("block", (F.col("number") / SOURCES).cast("int")).join(blocks, "lang")
    other = F.explode(F.sequence(F.lit(0), F.col("last"))).alias("other")
    sided = numbered.select("*", other).withColumns({"a": F.least("block", "other"), "b": F.greatest("block", "other")})
    columns = ["lang", "a", "b", "bucket", "number", "p_none", "term", "p"]
    heads = sided.withColumns({"bucket": F.explode(F.sequence(F.lit(0), F.col("buckets"))), "term": F.lit(None).cast("string"), "p": F.lit(None).cast("long")}).select(*columns)
    rows = with_groups(kept, sided.select("lang", "source", "total", "terms", "buckets", "number", "p_none", "a", "b"), ["lang", "source"])
    rows = rows.withColumns({"bucket": F.pmod(F.xxhash64("term"), F.col("buckets") + 1).cast("int"), "p": share("n", "total", "terms")}).select(*columns)

    def differ(group: pa.Table) -> pa.Table:
        lang, a, b = (group[c][0].as_py() for c in ("lang", "a", "b"))
        is_head = pc.is_null(group["term"]).to_numpy()
        number, none = (group[c].to_numpy()[is_head] for c in ("number", "p_none"))
        order = np.argsort(number)
        number, none = number[order], none[order].astype(np.int64)
        body = group.filter(pa.array(~is_head))
        codes = body["term"].combine_chunks().dictionary_encode()
        codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
        shares = np.tile(none, (len(codes.dictionary), 1))
        shares[codes.indices.to_numpy(zero_copy_only=False), np.searchsorted(number, body["number"].to_numpy())] = body["p"].to_numpy()
        found = []
        right = np.flatnonzero(number // SOURCES == b)
        for i in np.flatnonzero(number // SOURCES == a):
            js = right[number[right] > number[i]]
            more = np.abs(shares[:, js] - shares[:, i : i + 1]).sum(0) - len(shares) * np.abs(none[js] - none[i])
            found.append((np.full(len(js), number[i]), number[js], more))
        left, far, more = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 3
        return pa.table({"lang": pa.array([lang] * len(left), pa.string()), "left": pa.array(left, pa.int32()), "right": pa.array(far, pa.int32()), "more": pa.array(more, pa.int64())})

    sums = heads.unionByName(rows).groupBy("lang", "a", "b", "bucket").applyInArrow(differ, "lang string, left int, right int, more long")
    sums = sums.groupBy("lang", "left", "right").agg(F.sum("more").alias("more"))
    for side in ("left", "right"):
        sums = with_groups(sums, groups.select("lang", F.col("number").alias(side), F.col("source").alias(f"{side}_source"), F.col("p_none").alias(f"{side}_none"), *(["terms"] if side == "left" else [])), ["lang", side])
    value = F.col("more") + F.col("terms") * F.abs(F.col("left_none") - F.col("right_none"))
    both = F.explode(F.array(F.struct(F.col("left_source").alias("source"), F.col("right_source").alias("item")), F.struct(F.col("right_source").alias("source"), F.col("left_source").alias("item")))).alias("pair")
    return sums.select("lang", value.alias("value"), both).select("lang", "pair.source", "pair.item", "value")


def source_divergence(docs: DataFrame, least: int = 30, top: int = 50, bits: int = BITS) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): how far each source of a language is from the others and by which terms.

    Part ``pair`` has a row for every other source of the language, by
    descending difference; part ``term`` the ``top`` terms that the source uses
    more than its language does. Null text, lang and source are empty strings:
    an empty language or source is one like any other. Every row counts as a
    document, repeated ones too. A language without kept terms has differences
    of 0 and no terms, a source alone in its language no pairs, an empty table
    no rows. Ties go by the bytes of the item. Only the three columns are read,
    so others can't clash.
    """
    taken = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    kept = kept_terms(taken, least, bits)
    groups = group_totals(taken, kept)
    pairs = pair_values(kept, groups).withColumn("part", F.lit("pair"))
    here = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    everywhere = kept.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"))
    mine = with_groups(kept, groups.select("lang", "source", "total", "lang_total", "terms"), ["lang", "source"]).withColumn("p", share("n", "total", "terms"))
    theirs = with_groups(everywhere, groups.groupBy("lang").agg(F.max("lang_total").alias("lang_total"), F.max("terms").alias("terms")), ["lang"])
    theirs = theirs.select("lang", "term", share("lang_n", "lang_total", "terms").alias("q"))
    more = mine.select("lang", "source", "term", "p").join(theirs, ["lang", "term"]).where("p > q")
    terms = more.select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"), F.lit("term").alias("part"))
    first_terms = terms.withColumn("rank", F.row_number().over(here)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(here)).unionByName(first_terms).select("lang", "source", "part", "item", "value", "rank")


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k ON w.lang = k.lang AND w.term = k.term GROUP BY w.lang, w.source, w.term),
l AS (SELECT lang, term, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY lang, term),
v AS (SELECT lang, count(*) AS v, CAST(sum(n) AS BIGINT) AS total FROM l GROUP BY lang),
g AS (SELECT x.lang, x.source, coalesce(v.v, 0) AS v, coalesce(v.total, 0) AS lang_total, CAST(coalesce((SELECT sum(n) FROM c WHERE c.lang = x.lang AND c.source = x.source), 0) AS BIGINT) AS total
  FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN v ON v.lang = x.lang),
p AS (SELECT g.lang, g.source, l.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.total + 5 * g.v) AS p, 1 + (1000000000::HUGEINT * (l.n + 5)) // (g.lang_total + 5 * g.v) AS q
  FROM g JOIN l ON l.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = l.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
e AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q
), o AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM e)
SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= 50
"""
