"""Removal of byte strings that an earlier document has, by sorted suffixes.

Two equal strings of 50 bytes hold the same 16-grams, hence the same one of
smallest hash. A document is cut into segments, each the union of consecutive
50-byte windows with one such gram, and segments are dealt out by its hash:
windows that are equal meet in one bucket. There, of segments that are equal
byte by byte one goes on; the suffixes of the others are sorted in two stages:
those smaller than their successors directly, the rest induced by scans over
the buckets of first symbols. Neighbours with 50 or more symbols in common are
equal windows. Windows under a gram that very many segments share are dealt by
longer grams, and last by all their bytes, so that no bucket grows without end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

GRAM = 16
STRETCH = 1 << 16  # bytes that are hashed at once: what fits a core's cache
CHUNK = 5 << 20  # bytes of text whose segments are packed together
BUCKET_BYTES = 48 << 20  # bytes of segments that meet in a bucket
GROUP_BYTES = 12 << 20  # bytes of text that are put together again at once
SORT_BYTES = 1 << 19  # bytes whose suffixes are sorted at once
PROBED_BYTES = 128 << 20  # bytes of text in which frequent grams are looked for; results don't depend on it
FREQUENT = 64  # segments under one gram in a chunk that make it worth counting
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
SECOND = np.uint64(0xD1342543DE82EF95)
PLACE = np.uint64(1023)  # low bits of a gram's key, which hold its place; no window is longer
LAST_ID = np.iinfo(np.int64).max  # a null id comes after all others


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MULTIPLIER
    return x ^ (x >> np.uint64(29))


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one number."""
    return np.ndarray(max(0, len(data) - 7), np.dtype("<u8"), np.ascontiguousarray(data), strides=(1,))


def gram_hashes(data: np.ndarray, size: int = GRAM) -> np.ndarray:
    """Hash of the gram of ``size`` (16 or more) bytes at each position (as far as one fits)."""
    words, n = words_at(data), len(data) - size + 1
    code = np.zeros(n, np.uint64)
    for at in [*range(0, size - 8, 8), size - 8]:
        code = (code ^ words[at : at + n]) * (MULTIPLIER if at % 16 == 0 else SECOND)
        code ^= code >> np.uint64(32)
    return mixed(code)


def window_keys(data: np.ndarray, length: int, size: int = GRAM) -> np.ndarray:
    """For the window from each position: hash of its gram of smallest hash, in the low bits that gram's place modulo 1024."""
    n, out = len(data) - length + 1, []
    for a in range(0, n, STRETCH):
        part = data[a : min(len(data), a + STRETCH + length - 1)]
        code = gram_hashes(part, size) & ~PLACE | np.arange(a, a + len(part) - size + 1, dtype=np.uint64) & PLACE
        width, span = length - size + 1, 1
        while span * 2 <= width:
            code = np.minimum(code[:-span], code[span:])
            span *= 2
        out.append(np.minimum(code[: len(code) - (width - span)], code[width - span :]) if width > span else code)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def suffix_order(t: np.ndarray, depth: int) -> np.ndarray:
    """Positions of the bytes ``t`` in the order of their suffixes' first ``depth`` bytes at least.

    First stage: suffixes smaller than their successor are sorted directly, by
    eight bytes at a time. Second stage: going through the symbols in ascending
    order, every suffix whose position is left unplaced is put in its place
    when its successor is met.
    """
    n = len(t)
    if n == 0:
        return np.zeros(0, np.int32)
    step = np.zeros(n, np.int8)
    step[:-1] = (t[1:] > t[:-1]).astype(np.int8) - (t[1:] < t[:-1])
    step[-1] = -1
    turns = np.flatnonzero(step)  # where runs of equal symbols end
    smaller = np.repeat(step[turns] > 0, np.diff(np.r_[-1, turns]))
    words = words_at(np.concatenate([t, np.zeros(depth + 8, np.uint8)]))
    direct = np.flatnonzero(smaller).astype(np.int32)
    key = words[direct].byteswap()
    order = np.argsort(key)
    direct, key = direct[order], key[order]
    tie = np.r_[False, key[1:] == key[:-1]]
    for at in range(8, depth, 8):
        if not tie.any():
            break
        member = np.flatnonzero(tie | np.r_[tie[1:], False])
        group = np.cumsum(~tie[member])
        key = words[direct[member] + at].byteswap()
        order = np.argsort(key)
        order = order[np.argsort(group[order], kind="stable")]
        direct[member], key, group = direct[member[order]], key[order], group[order]
        tie = np.zeros(len(direct), bool)
        tie[member[1:]] = (key[1:] == key[:-1]) & (group[1:] == group[:-1])

    present = np.flatnonzero(np.bincount(t, minlength=256)).tolist()
    heads = np.searchsorted(t[direct], np.arange(257))
    waiting: dict[int, list[np.ndarray]] = {c: [] for c in present}
    waiting[int(t[-1])].append(np.array([n - 1], np.int32))
    out = []
    for c in present:
        wave = np.concatenate(waiting.pop(c) or [np.zeros(0, np.int32)])
        bucket = []
        while len(wave):
            bucket.append(wave)
            before = wave[wave > 0] - 1
            wave = before[(t[before] == c) & ~smaller[before]]
        full = np.concatenate([*bucket, direct[heads[c] : heads[c + 1]]])
        out.append(full)
        before = full[full > 0] - 1
        symbols = t[before]
        later = (symbols > c) & ~smaller[before]
        before, symbols = before[later], symbols[later]
        order = np.argsort(symbols, kind="stable")
        before, symbols = before[order], symbols[order]
        at = np.flatnonzero(np.r_[True, symbols[1:] != symbols[:-1]][: len(symbols)])
        for x, part in zip(symbols[at].tolist(), np.split(before, at[1:]), strict=len(at) > 0):
            waiting[x].append(part)
    return np.concatenate(out)


def common_prefixes(t: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Bytes that each suffix of ``order`` has in common with the one before it, ``most`` at most."""
    words = words_at(np.concatenate([t, np.zeros(most + 8, np.uint8)]))
    common = np.zeros(len(order), np.int32)
    live, a, b = np.arange(1, len(order)), order[1:], order[:-1]
    for depth in range(0, most, 8):
        unlike = words[a + depth] ^ words[b + depth]
        equal = unlike == 0
        common[live] += np.where(equal, 8, np.bitwise_count((unlike & (~unlike + np.uint64(1))) - np.uint64(1)) >> 3)
        live, a, b = live[equal], a[equal], b[equal]
        if not len(live):
            break
    return np.minimum(common, most)


def covered_windows(data: np.ndarray, starts: np.ndarray, windows: np.ndarray, ids: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment, window) of every window that another of the segments that lie in ``data``, with a smaller id, has too."""
    order = suffix_order(data, length)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] = 1
    inside[starts + windows] -= 1
    order = order[np.cumsum(inside)[order] > 0]  # windows, which end before their segment does
    run = np.flatnonzero(common_prefixes(data, order, length) < length)
    own = np.searchsorted(starts, order, "right") - 1
    sizes = np.diff(np.r_[run, len(order)])
    several = np.repeat(sizes > 1, sizes)
    order, own, run = order[several], own[several], np.cumsum(np.r_[0, sizes[sizes > 1]])[:-1]
    if not len(order):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = np.repeat(np.minimum.reduceat(ids[own], run), np.diff(np.r_[run, len(order)]))
    late = ids[own] > least
    return own[late], order[late] - starts[own[late]]


def compress(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=5).compress(raw)


def pack(*arrays: np.ndarray, tail: bytes = b"") -> bytes:
    """Arrays by planes of bytes, which compress better, and a tail."""
    head = np.array([len(a) for a in arrays], np.int64).tobytes()
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes() for a in arrays]
    return compress(head + b"".join(planes) + tail)


def unpack(blob: bytes, kinds: tuple) -> tuple[list[np.ndarray], bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    counts, at, out = np.frombuffer(raw, np.int64, len(kinds)), 8 * len(kinds), []
    for kind, n in zip(kinds, counts.tolist(), strict=True):
        width = np.dtype(kind).itemsize
        planes = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += n * width
    return out, raw[at:]


SPAN = (np.int64, np.int64, np.int32, np.int32)  # id, mark, first window, windows of what is covered
SEGMENT = (*SPAN, np.uint16)  # the same of a segment, and the place of its gram


def row_mark(i: int | None, text_hash: int) -> int:
    """Tells texts of one id apart: 32 bits of the hash, or all where the id is null and many rows may share it."""
    return text_hash if i is None else text_hash & 0xFFFFFFFF


def group_of(ids: np.ndarray, hashes: np.ndarray, groups: int) -> np.ndarray:
    """Group in which a document and what is covered of it meet again; copies under other ids go elsewhere."""
    return (mixed(mixed(ids.view(np.uint64)) ^ hashes.view(np.uint64)) % np.uint64(groups)).astype(np.int32)


def span_rows(ids, hashes, starts, windows, groups: int) -> Iterator[pa.RecordBatch]:
    """Covered windows, runs of them made one, packed by the group of their document."""
    if not len(ids):
        return
    order = np.lexsort((starts, hashes, ids))
    ids, hashes, starts, windows = ids[order], hashes[order], starts[order], windows[order]
    first = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (hashes[1:] != hashes[:-1]) | (starts[1:] != starts[:-1] + windows[:-1])])
    windows = np.add.reduceat(windows, first)
    ids, hashes, starts = ids[first], hashes[first], starts[first]
    group = group_of(ids, hashes, groups)
    order = np.argsort(group, kind="stable")
    at = np.r_[0, np.flatnonzero(np.diff(group[order])) + 1, len(order)]
    blobs, names = [], []
    for a, b in zip(at[:-1], at[1:], strict=True):
        rows = order[a:b]
        names.append(-1 - int(group[rows[0]]))
        blobs.append(pack(*(x[rows] for x in (ids, hashes, starts, windows))))
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])


def equal_segments(text: bytes, key: np.ndarray, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments under one key that different documents have: (rows by key, where each key's begin, kind, smallest id of the kind).

    Segments are of one kind if all their bytes are equal.
    """
    order = np.argsort(key, kind="stable")
    new = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]]) if len(order) else np.zeros(0, np.int64)
    several = np.minimum.reduceat(ids[order], new) < np.maximum.reduceat(ids[order], new) if len(order) else np.zeros(0, bool)
    sizes = np.diff(np.r_[new, len(order)])
    rows, sizes = order[np.repeat(several, sizes)], sizes[several]
    known: dict[bytes, int] = {}
    kind = np.array([known.setdefault(text[s:e], len(known)) for s, e in zip(starts[rows].tolist(), ends[rows].tolist(), strict=True)], np.int64)
    least = np.full(len(known), LAST_ID)
    np.minimum.at(least, kind, ids[rows])
    return rows, np.cumsum(np.r_[0, sizes])[:-1], kind, least[kind]


class Segments:
    """Segments of a chunk of documents (of ``length`` bytes or more)."""

    def __init__(self, ids: list[int], hashes: list[int], raw: list[bytes], length: int, frequent: list[np.ndarray]):
        self.text = b"".join(raw)
        data = np.frombuffer(self.text, np.uint8)
        ends = np.cumsum([len(x) for x in raw])
        keys = window_keys(data, length)
        for size, often in zip(LONGER, frequent, strict=False):
            under = np.isin(keys & ~PLACE, often)
            if under.any():
                keys = np.where(under, window_keys(data, length, min(size, length)), keys)
        change = np.ones(len(keys), bool)
        np.not_equal(keys[1:] & ~PLACE, keys[:-1] & ~PLACE, out=change[1:])
        inside = np.ones(len(keys), bool)
        for e in ends[:-1].tolist():  # windows that cross the end of a document are none
            inside[e - length + 1 : e] = False
            change[e - length + 1] = change[e] = True
        bounds = np.flatnonzero(change)
        windows = np.diff(np.r_[bounds, len(keys)])
        whole = inside[bounds]
        self.starts, self.windows = bounds[whole], windows[whole]
        self.ends = self.starts + self.windows + length - 1
        first = keys[self.starts]
        self.key = first & ~PLACE
        self.place = ((first - self.starts.astype(np.uint64)) & PLACE).astype(np.uint16)
        owner = np.searchsorted(ends, self.starts, "right")
        self.ids, self.hashes = np.array(ids, np.int64)[owner], np.array(hashes, np.int64)[owner]
        self.begin = (self.starts - np.r_[0, ends[:-1]][owner]).astype(np.int32)
        rows, _, _, least = equal_segments(self.text, self.key, self.ids, self.starts, self.ends)
        self.late = np.sort(rows[self.ids[rows] > least])  # covered by an equal one of this chunk
        stays = np.ones(len(self.key), bool)
        stays[self.late] = False
        self.stays = np.flatnonzero(stays)


#: Lengths of the grams by which the windows under a frequent gram are dealt; the last is the whole window.
LONGER = (32, 48, 1 << 20)


def chunks(length: int, batches: Iterator[pa.RecordBatch], frequent: list[np.ndarray]) -> Iterator[Segments]:
    ids, hashes, raw, size = [], [], [], 0
    for batch in batches:
        for i, h, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if x is not None and len(x) >= length:
                ids.append(LAST_ID if i is None else i)
                hashes.append(row_mark(i, h))
                raw.append(x)
                size += len(x)
                if size >= CHUNK:
                    yield Segments(ids, hashes, raw, length, frequent)
                    ids, hashes, raw, size = [], [], [], 0
    if raw:
        yield Segments(ids, hashes, raw, length, frequent)


def frequent_grams(docs: DataFrame, length: int, total: int, most: int) -> list[np.ndarray]:
    """Keys of grams under which more than ``most`` segments would meet, for each length of gram by which windows are dealt.

    They are counted in whole documents chosen by hash, PROBED_BYTES in
    expectation; they only decide how windows are dealt, not what is found.
    """
    share = min(1.0, PROBED_BYTES / max(total, 1))
    probe = docs.where(F.pmod(F.xxhash64("_hash", "doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    found: list[np.ndarray] = []
    for _ in LONGER:

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in chunks(length, batches, found):
                key, n = np.unique(part.key[part.stays], return_counts=True)
                often = n >= min(FREQUENT, most)
                yield pa.RecordBatch.from_arrays([pa.array(key[often].view(np.int64)), pa.array(n[often])], ["key", "n"])

        often = probe.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > most * share)
        keys = np.sort(np.array([r.key for r in often.select("key").collect()], np.int64).view(np.uint64))
        if not len(keys):
            break
        found.append(keys)
    return found


def segments(docs: DataFrame, length: int, buckets: int, groups: int, frequent: list[np.ndarray]) -> DataFrame:
    """Packed segments by bucket (0 and up), and windows found covered already by group (-1 and down)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(length, batches, frequent):
            windows = part.windows.astype(np.int32)
            yield from span_rows(*(x[part.late] for x in (part.ids, part.hashes, part.begin, windows)), groups)
            bucket = (mixed(part.key[part.stays]) % np.uint64(buckets)).astype(np.int32)
            by = np.argsort(bucket, kind="stable")  # in page order, so that ids and places compress
            keep, bucket = part.stays[by], bucket[by]
            cuts = np.r_[0, np.flatnonzero(np.diff(bucket)) + 1, len(bucket)] if len(bucket) else np.zeros(1, np.int64)
            names, blobs = [], []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                rows = keep[a:b]
                tail = b"".join([part.text[s:e] for s, e in zip(part.starts[rows].tolist(), part.ends[rows].tolist(), strict=True)])
                names.append(bucket[a])
                blobs.append(pack(*(x[rows] for x in (part.ids, part.hashes, part.begin, windows, part.place)), tail=tail))
                if len(blobs) == 64 or b == len(bucket):
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])
                    names, blobs = [], []

    return docs.mapInArrow(run, "bucket int, blob binary")


def settle(ids: np.ndarray, windows: np.ndarray, place: np.ndarray, text: bytes, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(segment, first window, windows) of what is covered among the segments of a bucket."""
    ends = np.cumsum(windows + length - 1)
    starts = ends - windows - length + 1
    words = words_at(np.frombuffer(text, np.uint8))
    gram = starts + place
    key = mixed(mixed(words[gram]) ^ words[gram + GRAM - 8])
    order, new, kind, least = equal_segments(text, key, ids, starts, ends)
    whole = order[ids[order] > least]
    yield whole, np.zeros(len(whole), np.int64), windows[whole]
    # one of each kind, and all of its smallest id, are compared with other kinds under the same key
    group = np.zeros(len(order), np.int64)
    group[new[1:]] = 1
    group = np.cumsum(group)
    stays = ids[order] == least
    order, group, kind = order[stays], group[stays], kind[stays]
    if not len(order):
        return
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    unlike = (np.minimum.reduceat(kind, first) < np.maximum.reduceat(kind, first)) & (np.minimum.reduceat(ids[order], first) < np.maximum.reduceat(ids[order], first))
    stays = np.repeat(unlike, np.diff(np.r_[first, len(order)]))
    order, k = order[stays], group[stays]
    if not len(order):
        return
    size = np.cumsum(ends[order] - starts[order])
    bounds = np.r_[np.flatnonzero(k[1:] != k[:-1]) + 1, len(k)]
    a = 0
    while a < len(order):
        base = size[a - 1] if a else 0
        fits = bounds[(bounds > a) & (size[bounds - 1] - base <= SORT_BYTES)]
        b = int(fits[-1]) if len(fits) else int(bounds[bounds > a][0])
        rows = order[a:b]
        data = np.frombuffer(b"".join([text[s:e] for s, e in zip(starts[rows].tolist(), ends[rows].tolist(), strict=True)]), np.uint8)
        own, window = covered_windows(data, np.cumsum(np.r_[0, ends[rows] - starts[rows]])[:-1], windows[rows], ids[rows], length)
        if len(own):
            by = np.lexsort((window, own))
            own, window = own[by], window[by]
            first = np.flatnonzero(np.r_[True, (np.diff(own) != 0) | (np.diff(window) != 1)])
            yield rows[own[first]], window[first], np.diff(np.r_[first, len(own)])
        a = b


def repeated_bytes(docs: DataFrame, length: int = 50, frequent: int = 200_000) -> DataFrame:
    """Bytes of every text that strings of ``length`` bytes starting in a document with a smaller id cover.

    Rows (_id, _bytes, _spans, _kept): bytes of the text, the maximal removed
    runs [from, to), and what is left. Null texts count as empty; a null id
    counts as larger than all others; rows with one id are one document to each
    other, none removes anything from another; ids are read as long (what is no
    number counts as null); an empty table gives an empty result; only the two
    columns are read. Windows of more than ``frequent`` segments that share a
    gram are dealt by longer grams. ``length`` is 16 to 1024.
    """
    if not GRAM <= length <= int(PLACE) + 1:
        raise ValueError(f"length {length} is not between {GRAM} and {int(PLACE) + 1}")
    docs = docs.select(F.expr("try_cast(doc_id AS BIGINT)").alias("doc_id"), F.xxhash64("text").alias("_hash"), F.col("text").cast("binary"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(24, -(-total * 4 // BUCKET_BYTES))
    groups = max(24, -(-total // GROUP_BYTES))
    dealt = segments(docs, length, buckets, groups, frequent_grams(docs, length, total, frequent))

    def meet(part: pa.Table) -> pa.Table:
        if part["bucket"][0].as_py() < 0:  # covered already
            return part
        found = [unpack(x, SEGMENT) for x in part["blob"].to_pylist()]
        ids, hashes, begin, windows, place = (np.concatenate([f[0][i] for f in found]) for i in range(5))
        text = b"".join([f[1] for f in found])
        del found
        out = []
        for rows, first, n in settle(ids, windows.astype(np.int64), place, text, length):
            out += span_rows(ids[rows], hashes[rows], (begin[rows] + first).astype(np.int32), n.astype(np.int32), groups)
        return pa.Table.from_batches(out, pa.schema([("bucket", pa.int32()), ("blob", pa.binary())]))

    settled = dealt.repartition(buckets + groups, "bucket").groupBy("bucket").applyInArrow(meet, "bucket int, blob binary")
    spans = settled.select((-1 - F.col("bucket")).alias("group"), "blob")

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = batch.column(2).to_pylist()
            hashes = np.array([row_mark(i, h) for i, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], np.int64)
            group = group_of(batch.column(0).fill_null(LAST_ID).to_numpy(), hashes, groups)
            short = np.array([x is None or len(x) < length for x in lines])  # nothing can be covered there: any group will do
            group[short] = np.arange(short.sum()) % groups
            blobs = [compress(x or b"") for x in lines]
            yield pa.RecordBatch.from_arrays([pa.array(group), batch.column(0), pa.array(hashes), pa.array(blobs, pa.binary())], ["group", "id", "hash", "text"])

    packed = docs.mapInArrow(squeeze, "group int, id long, hash long, text binary")

    def rejoin(texts: pa.Table, found: pa.Table) -> pa.Table:
        parts = [unpack(x, SPAN)[0] for x in found["blob"].to_pylist()]
        marks: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        if parts:
            ids, hashes, begin, windows = (np.concatenate([p[i] for p in parts]) for i in range(4))
            order = np.lexsort((hashes, ids))
            at = np.r_[0, np.flatnonzero((np.diff(ids[order]) != 0) | (np.diff(hashes[order]) != 0)) + 1, len(order)]
            for a, b in zip(at[:-1], at[1:], strict=True):
                rows = order[a:b]
                marks[int(ids[rows[0]]), int(hashes[rows[0]])] = begin[rows], windows[rows]
        out_bytes, out_spans, out_kept = [], [], []
        for i, h, blob in zip(texts["id"].to_pylist(), texts["hash"].to_pylist(), texts["text"].to_pylist(), strict=True):
            raw = zstandard.ZstdDecompressor().decompress(blob)
            runs, kept = [], raw
            if mark := marks.get((LAST_ID if i is None else i, h)):
                edge = np.zeros(len(raw) + 1, np.int32)
                np.add.at(edge, mark[0], 1)
                np.add.at(edge, mark[0] + mark[1] + length - 1, -1)
                gone = np.cumsum(edge) > 0
                turns = np.flatnonzero(np.diff(np.r_[False, gone[:-1], False]))
                runs = turns.reshape(-1, 2).tolist()
                kept = np.frombuffer(raw, np.uint8)[~gone[:-1]].tobytes()
            out_bytes.append(len(raw))
            out_spans.append([{"from": a, "to": b} for a, b in runs])
            out_kept.append(kept)
        kind = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
        return pa.table([texts["id"], pa.array(out_bytes, pa.int64()), pa.array(out_spans, kind), pa.array(out_kept, pa.binary())], names=["_id", "_bytes", "_spans", "_kept"])

    return packed.groupBy("group").cogroup(spans.groupBy("group")).applyInArrow(rejoin, "_id long, _bytes long, _spans array<struct<from: bigint, to: bigint>>, _kept binary")


def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_bytes(table(spark, sf_dir, "documents"))
    removed = F.aggregate("_spans", F.lit(0).cast("long"), lambda a, x: a + x["to"] - x["from"])
    return out.select(F.col("_id").alias("doc_id"), F.col("_bytes").alias("n_bytes"), removed.alias("n_removed"), F.size("_spans").cast("long").alias("n_spans"), F.sha2("_kept", 256).alias("kept_sha256"))
