"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

The encoder keeps an agenda of adjacent symbol pairs ordered by piece score
(then by position from the left) and merges the best pair until none is left.
A text is cut where no piece of the vocabulary holds the characters on both
sides, since no merge can cross there: before space marks, and before
punctuation that no piece holds after a letter. The units between are encoded
on their own, short ones many at a time with one agenda a row of an array; a
bounded per-worker table remembers those already seen. Every unit that the
agenda encodes is checked against the library in the same Arrow batch, and so
is the longest whole text (of at most 100,000 characters) of each batch. Where
they differ the row says so (library_agrees) and carries the library's ids; if
a whole text differs although its units don't, texts are no longer cut.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import portions, table, texts

MARK = "▁"  # what the vocabulary writes for a space
PUNCTUATION = "\n\t\r!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
WIDTHS = (8, 12, 20, 48)  # characters of units whose agendas are kept together
REMEMBERED_UNITS = 250_000
TOGETHER = 1_000_000  # bytes of texts that are split and looked up at once
WHOLE = 100_000  # characters of the longest whole text that is checked
REMEMBERED_LENGTH = 48
LAST = np.iinfo(np.int32).max  # the rank of no piece


class PieceModel:
    """Vocabulary of a BPE sentencepiece model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(size)]
        self.bytes = {i: int(self.pieces[i][3:-1], 16) for i in range(size) if sp.is_byte(i)}
        self.byte_id = {b: i for i, b in self.bytes.items()}
        special = {i for i in range(size) if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)}
        self.plain = set(range(size)) - special
        self.shown = [p.replace(MARK, " ") for p in self.pieces]
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in special}
        self.scores = {p: -sp.get_score(i) for p, i in self.ids.items()}
        self.unknown = sp.unk_id()
        inner = {pair for p in self.ids for pair in pairwise(p)}
        self.splits = not any(MARK in p.lstrip(MARK) or "\n" in p for p in self.ids)
        stops = set(PUNCTUATION)
        while bad := {c for x, c in inner if c in stops and x != MARK and x not in stops}:
            stops -= bad
        c = "".join(map(re.escape, sorted(stops)))  # no piece holds one of these after another character than these
        self.unit = re.compile(f"{MARK}+[{c}]*[^{MARK}{c}]*|[{c}]+[^{MARK}{c}]*|[^{MARK}{c}]+")
        self._known: dict[str, tuple[bytes, str]] = {}
        self._unlike: set[str] = set()  # units for which the library has other ids than the agenda
        self._tabulate()

    def _tabulate(self) -> None:
        """Symbols of characters, and a hash table of the pairs of symbols that make a piece."""
        symbols = dict(self.ids)
        for c in sorted({c for p in self.ids for c in p}):
            symbols.setdefault(c, len(self.pieces) + len(symbols))
        self.nothing = max(symbols.values()) + 1
        self.symbol_of = np.full(0x110000, self.nothing, np.int32)
        for x, i in symbols.items():
            if len(x) == 1:
                self.symbol_of[ord(x)] = i
        ranks = {score: rank for rank, score in enumerate(sorted(set(self.scores.values())))}
        pairs = [(symbols[p[:k]], symbols[p[k:]], i, ranks[self.scores[p]]) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols]
        left, right, merged, rank = np.array(pairs or [(0, 0, 0, LAST)], np.int64).T
        key = left * (self.nothing + 1) + right
        self.slots = 1 << int(4 * len(key)).bit_length()
        self.pair_key = np.full(self.slots, -1)
        self.pair_merged, self.pair_rank = np.zeros(self.slots, np.int32), np.full(self.slots, LAST, np.int32)
        at, left_over = self._slot(key), np.arange(len(key))
        while len(left_over):
            free = left_over[self.pair_key[at[left_over]] < 0]
            taken, which = np.unique(at[free], return_index=True)
            rows = free[which]
            self.pair_key[taken], self.pair_merged[taken], self.pair_rank[taken] = key[rows], merged[rows], rank[rows]
            left_over = np.setdiff1d(left_over, rows)
            at[left_over] = (at[left_over] + 1) % self.slots

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - self.slots.bit_length())).astype(np.int64)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (LAST if there is no such piece) and symbol of what two symbols make."""
        key = left.astype(np.int64) * (self.nothing + 1) + right
        at = self._slot(key)
        found = self.pair_key[at]
        astray = np.flatnonzero((found != key) & (found >= 0))
        while len(astray):
            at[astray] = (at[astray] + 1) % self.slots
            found = self.pair_key[at[astray]]
            astray = astray[(found != key[astray]) & (found >= 0)]
        return np.where(self.pair_key[at] == key, self.pair_rank[at], LAST), self.pair_merged[at]

    def merge(self, unit: str) -> list[str]:
        """Pieces of a unit by the agenda of adjacent pairs."""
        scores, symbols = self.scores, list(unit)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(s, i, i + 1, 2) for i in range(n - 1) if (s := scores.get(symbols[i] + symbols[i + 1])) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, left, right, length = heapq.heappop(agenda)
            a, b = symbols[left], symbols[right]
            if not a or not b or len(a) + len(b) != length:
                continue  # one side has been merged since
            symbols[left], symbols[right] = a + b, ""
            after[left] = follower = after[right]
            if follower < n:
                before[follower] = left
            for x, y in ((before[left], left), (left, follower)):
                if x >= 0 and y < n and (s := scores.get(pair := symbols[x] + symbols[y])) is not None:
                    heapq.heappush(agenda, (s, x, y, len(pair)))
        return [x for x in symbols if x]

    def merge_many(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for many units of nearly one length: symbols of all of them, and how many each has.

        A row holds a unit. Each round merges the best pair (the leftmost of
        equals) of every row that has one left.
        """
        n, width = len(units), max(map(len, units))
        points = np.frombuffer("".join([u.ljust(width, "\0") for u in units]).encode("utf-32-le"), np.uint32).reshape(n, width)
        length = np.fromiter(map(len, units), np.int64, n)
        alive = np.arange(width) < length[:, None]
        symbols = np.full((n, width + 1), self.nothing, np.int32)  # the last column is what comes before and after a unit
        symbols[:, :-1] = np.where(alive, self.symbol_of[points], self.nothing)
        after, before = np.tile(np.arange(1, width + 2, dtype=np.int16), (n, 1)), np.tile(np.arange(-1, width, dtype=np.int16), (n, 1))
        after[np.arange(n), length - 1] = width
        rank, merged = np.full((n, width + 1), LAST, np.int32), np.zeros((n, width + 1), np.int32)
        if width > 1:
            r, m = self._pairs(symbols[:, :-2].ravel(), symbols[:, 1:-1].ravel())
            rank[:, : width - 1], merged[:, : width - 1] = r.reshape(n, -1), m.reshape(n, -1)
        rows = np.arange(n)
        while len(rows):
            best = rank[rows].argmin(1)
            live = rank[rows, best] != LAST
            rows, i = rows[live], best[live]
            j, p = after[rows, i], before[rows, i]
            k = after[rows, j]
            symbols[rows, i] = merged[rows, i]
            alive[rows, j] = False
            after[rows, i], before[rows, k] = k, i
            rank[rows, j] = LAST
            made = symbols[rows, i]
            r, m = self._pairs(np.concatenate([made, symbols[rows, p]]), np.concatenate([symbols[rows, k], made]))
            rank[rows, i], merged[rows, i] = r[: len(rows)], m[: len(rows)]
            rank[rows, p], merged[rows, p] = r[len(rows) :], m[len(rows) :]
        return symbols[:, :-1][alive], alive.sum(1)

    def encode_many(self, units: list[str]) -> list[bytes]:
        """Ids (as 4-byte integers) of every unit by the agenda."""
        out = [b""] * len(units)
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        for low, high in pairwise((0, *WIDTHS)):
            rows = np.flatnonzero((sizes > low) & (sizes <= high))
            if not len(rows):
                continue
            ids, counts = self.merge_many([units[i] for i in rows.tolist()])
            ends = np.cumsum(counts)
            raw, whole = ids.astype(np.int32).tobytes(), np.logical_and.reduceat(ids < len(self.pieces), ends - counts)
            for i, a, b, known in zip(rows.tolist(), (4 * (ends - counts)).tolist(), (4 * ends).tolist(), whole.tolist(), strict=True):
                out[i] = raw[a:b] if known else array("i", self.encode_unit(units[i])).tobytes()
        for i in np.flatnonzero(sizes > WIDTHS[-1]).tolist():
            out[i] = array("i", self.encode_unit(units[i])).tobytes()
        return out

    def encode_unit(self, unit: str) -> list[int]:
        out: list[int] = []
        for piece in self.merge(unit):
            if (i := self.ids.get(piece)) is not None:
                out.append(i)
            elif self.byte_id:
                out += [self.byte_id[b] for b in piece.encode()]
            else:
                out.append(self.unknown)
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of ids: byte pieces are joined as UTF-8, marks become spaces, the first added space goes."""
        return self._join(ids).removeprefix(" ")

    def _join(self, ids: list[int]) -> str:
        if self.plain.issuperset(ids):
            return "".join([self.shown[i] for i in ids])
        out, raw = [], bytearray()
        for i in [*ids, -1]:
            if i in self.bytes:
                raw.append(self.bytes[i])
                continue
            if raw:
                out.append(raw.decode(errors="replace"))
                raw.clear()
            out.append(self.shown[i] if i in self.plain else " ⁇ " if i == self.unknown else "")
        return "".join(out)

    def learn(self, units: set[str]) -> None:
        """Encode units by the agenda and check them against the library.

        A unit that doesn't begin with a mark is handed to the library after a
        line break, which no piece holds.
        """
        listed = list(units)
        asked = [u[1:].replace(MARK, " ") if u[0] == MARK else f"\n{u}" for u in listed]
        theirs = self.library.encode(asked, num_threads=1)
        for i, u in enumerate(listed):
            if u[0] != MARK:
                theirs[i] = theirs[i][2:]
            elif u == MARK:  # of a lone mark the library gets nothing
                theirs[i] = [self.ids[MARK]] if MARK in self.ids else self.encode_unit(MARK)
        right = np.fromiter(chain.from_iterable(theirs), np.int32).tobytes()
        at = 0
        for unit, ids, others in zip(listed, self.encode_many(listed), theirs, strict=True):
            end = at + 4 * len(others)
            if ids == right[at:end]:
                self._known[unit] = ids, self._join(others)
            else:  # the library stands in, and the text is marked
                self._unlike.add(unit)
                self._known[unit] = right[at:end], self._join(others)
            at = end

    def encode(self, lines: list[str]) -> tuple[list[tuple[bytes, str]], list[bool]]:
        """Ids (as 4-byte integers) and decoded text of every text, and whether the library has the ids of the agenda."""
        marked = [MARK + x.replace(" ", MARK) if x else "" for x in lines]
        split = [self.unit.findall(x) for x in marked] if self.splits else [[x] if x else [] for x in marked]
        known = self._known
        if len(known) > REMEMBERED_UNITS:
            known.clear()
        new = set().union(*split).difference(known)
        self.learn(new)
        out = []
        for units in split:
            found = [known[u] for u in units]
            out.append((b"".join([x for x, _ in found]), "".join([x for _, x in found]).removeprefix(" ")))
        agrees = [not self._unlike or self._unlike.isdisjoint(units) for units in split]
        for unit in new:
            if len(unit) > REMEMBERED_LENGTH:
                del known[unit]
        return out, agrees


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    return PieceModel(path)


def sentencepieces(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encode a text column and decode it again.

    Returns ``key``, ``ids array<int>``, ``decoded string`` and ``library_agrees
    boolean``: whether the library gives all units of this text the ids that the
    agenda gives them; where not, the ids are the library's. Null and empty
    texts have no ids and decode to the empty string; repeated rows stay; an
    empty table gives an empty result; other columns are not read.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            probe = int(np.where(sizes <= WHOLE, sizes, 0).argmax())
            sample = texts(batch.column(1).slice(probe, 1))
            if np.frombuffer(m.encode(sample)[0][0][0], np.int32).tolist() != m.library.encode(sample[0], num_threads=1):
                m.splits = False  # this vocabulary has merges across the cuts
            for part in portions(batch, TOGETHER):
                found, agrees = m.encode(texts(part.column(1)))
                offsets = np.cumsum([0] + [len(x) // 4 for x, _ in found]).astype(np.int32)
                flat = pa.array(np.frombuffer(b"".join([x for x, _ in found]), np.int32))
                decoded = pa.array([x for _, x in found], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), flat), decoded, pa.array(agrees, pa.bool_())], ["key", "ids", "decoded", "library_agrees"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(encode, f"key {kind}, ids array<int>, decoded string, library_agrees boolean").withColumnRenamed("key", key)


def digest(ids: Column) -> Column:
    """SHA-256 of decimal ids joined by commas."""
    return F.sha2(F.array_join(ids.cast("array<string>"), ","), 256)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = sentencepieces(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(F.col("ids")).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "library_agrees")
