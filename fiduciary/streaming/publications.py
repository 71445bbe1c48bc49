"""Publication changes of a stream of observations, with state per system and source.

Observations come in any order within a watermark and more than once. They wait
in state until the watermark has passed them, then go in the order of their
times against the fingerprint that the key remembers, so that the stream gives
what ``history.publication_events`` gives for the whole table.

State is held by key, or by block of keys. A key's state costs some calls into
the JVM in every batch, which is too much for very many keys: a block costs as
many, and its rows travel as Arrow bytes and are settled as columns.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KEY = ["system_id", "source_id"]
SPAN = 1 << 41  # micros, 25 days: a state value holds the times of a key that lie in one span
HELD_ROWS, HELD_BYTES = 500_000, 64 << 20  # a task packs as many rows or bytes at a time
WAITING = pa.schema([("system_id", pa.string()), ("source_id", pa.string()), ("at", pa.int64()), ("input_seq", pa.int64()), ("published", pa.int64()), ("fingerprint", pa.string())])
KNOWN = pa.schema([("system_id", pa.string()), ("source_id", pa.string()), ("number", pa.int32()), ("fingerprint", pa.string()), ("seen_at", pa.int64())])
GIVEN = pa.schema([("number", pa.int32()), ("published", pa.int64())])
OUT = pa.schema([("system_id", pa.string()), ("source_id", pa.string()), ("published", pa.list_(pa.int64()))])
# The worker in which Spark sets a processor up does not search the folders of the driver's session.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def micros(at: datetime | None) -> int | None:
    return None if at is None else (at.astimezone(UTC) - EPOCH) // MICRO


class PublicationChanges(StatefulProcessor):
    """Waiting observations, the last fingerprint and the publication times given so far, of one key.

    Times are micros. Every call into the state is a round trip to the JVM, so
    a key's rows go in and out as arrays: a batch's rows are one element of the
    list that waits, under one timer, and a timer settles all rows that the watermark has passed,
    which can't be added to any more. Given times lie in spans of SPAN.
    """

    def __init__(self, forget_ms: int | None):
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "observed_at array<long>, input_seq array<long>, published_at array<long>, fingerprint array<string>")
        self.last = handle.getValueState("last", "fingerprint string, observed_at long")
        self.given = handle.getMapState("given", "span long", "published_at array<long>")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        came = [(row.at, row.input_seq, row.published, row.fingerprint) for row in rows]
        if came:
            self.waiting.appendValue(tuple(map(list, zip(*came, strict=True))))
            self.handle.registerTimer(-(-min(row[0] for row in came) // 1000))
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        expired, passed = expiredTimerInfo.getExpiryTimeInMs() * 1000, timerValues.getCurrentWatermarkInMs() * 1000
        waiting = {(row[0], row[1]): (row[2], row[3]) for chunk in self.waiting.get() for row in zip(*chunk, strict=True)}
        ready = sorted(k for k in waiting if k[0] <= max(expired, passed))
        last = self.last.get()
        before, seen_at = (None, None) if last is None else last
        if not ready:
            if last is not None and self.forget_ms is not None and expired >= seen_at + 1000 * self.forget_ms and not waiting:
                self.last.clear()
                self.given.clear()
            return iter([])
        spans: dict[int, set[int]] = {}
        changed_spans, out = set(), []
        for place in ready:
            published, fingerprint = waiting.pop(place)
            changed = fingerprint is not None and fingerprint != before
            event = published if published is not None else place[0] if changed else None
            if event is not None:
                span = event // SPAN
                if span not in spans:
                    known = self.given.getValue((span,))
                    spans[span] = set() if known is None else set(known[0])
                if event not in spans[span]:
                    spans[span].add(event)
                    changed_spans.add(span)
                    out.append(Row(system_id=key[0], source_id=key[1], published=event))
            before, seen_at = fingerprint, place[0]
        for span in changed_spans:
            self.given.updateValue((span,), (sorted(spans[span]),))
        self.last.update((before, seen_at))
        if waiting:
            self.waiting.put([tuple(map(list, zip(*((*k, *v) for k, v in waiting.items()), strict=True)))])
            self.handle.registerTimer(-(-min(waiting)[0] // 1000))
        else:
            self.waiting.clear()
        if self.forget_ms is not None:
            self.handle.registerTimer(-(-seen_at // 1000) + self.forget_ms)
        return iter(out)

    def close(self) -> None:
        pass


def to_bytes(rows: pa.Table | pa.RecordBatch) -> bytes:
    if isinstance(rows, pa.Table):
        rows = next(iter(rows.combine_chunks().to_batches()), None) or pa.RecordBatch.from_pylist([], rows.schema)
    return rows.serialize().to_pybytes()


def from_bytes(chunks: list[bytes], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_batches([pa.ipc.read_record_batch(pa.py_buffer(x), schema) for x in chunks], schema)


def edges(x: np.ndarray) -> np.ndarray:
    """Whether each of the ordered values begins a run of equal ones."""
    return np.append(True, x[1:] != x[:-1])[: len(x)]


def codes(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Numbers of the column's values, -1 for null, and the values by number."""
    encoded = pa.concat_arrays([pa.array([], column.type), *column.chunks]).dictionary_encode()
    return encoded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype("int64"), encoded.dictionary


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each block, in the order in which they came, as bytes: one chunk a block of what a task holds at a time."""

    def packed() -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        if table["at"].null_count:
            raise ValueError("an observation without observed_at has no place in the order")
        blocks = table["block"].to_numpy()
        order = np.argsort(blocks, kind="stable")
        blocks = blocks[order]
        rows = table.select(WAITING.names).cast(WAITING).combine_chunks().to_batches()[0].take(pa.array(order))
        at = np.flatnonzero(edges(blocks))
        chunks = [to_bytes(rows.slice(a, b - a)) for a, b in zip(at, [*at[1:], len(order)], strict=True)]
        return pa.record_batch([pa.array(blocks[at], pa.int32()), pa.array(chunks, pa.binary())], ["block", "rows"])

    held, rows, size = [], 0, 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= HELD_ROWS or size >= HELD_BYTES:
            yield packed()
            held, rows, size = [], 0, 0
    if held:
        yield packed()


def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for x in batch["rows"]:
            yield from from_bytes([x.as_py()], OUT).to_batches()


class PublicationBlocks(StatefulProcessor):
    """What PublicationChanges holds of one key, of a block of keys, as Arrow bytes.

    A block's rows are settled together once the watermark has passed them, and
    the time up to which they are is remembered. What comes again while the first
    one waits goes when they are settled; what is not after that time goes at once.
    Keys of a block have numbers, which stand for them in the given times.
    """

    def __init__(self, forget_ms: int | None):
        self.forget = None if forget_ms is None else 1000 * forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.last = handle.getValueState("last", "settled long, following int, keys binary")
        self.given = handle.getMapState("given", "span long", "rows binary")

    def wake(self, at: int) -> None:
        self.handle.registerTimer(-(-at // 1000))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        last, came = self.last.get(), from_bytes([row.rows for row in rows], WAITING)
        if last is not None:
            came = came.filter(pc.field("at") > last[0])
        if came.num_rows:
            self.waiting.appendValue((to_bytes(came),))
            self.wake(pc.min(came["at"]).as_py())
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        until, last = timerValues.getCurrentWatermarkInMs() * 1000, self.last.get()
        settled, following, keys = (None, 0, KNOWN.empty_table()) if last is None else (last[0], last[1], from_bytes([last[2]], KNOWN))
        silent = self.forget is not None and keys.num_rows and pc.min(keys["seen_at"]).as_py() + self.forget <= until
        if settled is not None and settled >= until and not silent:
            return iter([])
        waiting = from_bytes([chunk[0] for chunk in self.waiting.get()], WAITING)
        ready, rest = waiting.filter(pc.field("at") <= until), waiting.filter(pc.field("at") > until)
        out = []
        if ready.num_rows:
            keys, following, events = self.settle(ready, keys, following)
            out = [Row(rows=to_bytes(events))] if events.num_rows else []
            if rest.num_rows:
                self.waiting.put([(to_bytes(rest),)])
                self.wake(pc.min(rest["at"]).as_py())
            else:
                self.waiting.clear()
        if self.forget is not None and keys.num_rows:
            keys = self.forgotten(keys, rest, until)
            later = keys.filter(pc.field("seen_at") > until - self.forget)  # the others wake when their waiting rows are settled
            if later.num_rows:
                self.wake(pc.min(later["seen_at"]).as_py() + self.forget)
        self.last.update((until, following, to_bytes(keys)))
        return iter(out)

    def settle(self, ready: pa.Table, keys: pa.Table, following: int) -> tuple[pa.Table, int, pa.Table]:
        """The keys as they are after the rows, the number of the next new key, and the publications."""
        known = keys.num_rows
        systems, system_names = codes(pa.chunked_array([*keys["system_id"].chunks, *ready["system_id"].chunks], pa.string()))
        sources, source_names = codes(pa.chunked_array([*keys["source_id"].chunks, *ready["source_id"].chunks], pa.string()))
        places, pairs = pd.factorize(systems * len(source_names) + sources)  # the known keys come first, in their order
        prints, print_names = codes(pa.chunked_array([*keys["fingerprint"].chunks, *ready["fingerprint"].chunks], pa.string()))
        place, at, seq = places[known:], ready["at"].to_numpy(), ready["input_seq"].to_numpy()
        again = pd.DataFrame({"place": place, "at": at, "seq": seq}).duplicated().to_numpy()
        order = np.lexsort((seq, at, place))
        order = order[~again[order]]
        place, at, seen = place[order], at[order], prints[known:][order]
        explicit, published = ready["published"].is_valid().to_numpy()[order], ready["published"].fill_null(0).to_numpy()[order]

        remembered, seen_at = np.full(len(pairs), -1), np.zeros(len(pairs), "int64")
        remembered[:known], seen_at[:known] = prints[:known], keys["seen_at"].to_numpy()
        begins = edges(place)
        before = np.append(-1, seen[:-1])
        before[begins] = remembered[place[begins]]
        event = explicit | ((seen >= 0) & (seen != before))
        ends = np.append(begins[1:], True)
        remembered[place[ends]], seen_at[place[ends]] = seen[ends], at[ends]

        numbers = np.append(keys["number"].to_numpy(), np.arange(following, following + len(pairs) - known)).astype("int32")
        names = [system_names.take(pa.array(pairs // len(source_names))), source_names.take(pa.array(pairs % len(source_names)))]
        prints = pa.array(print_names.take(pa.array(remembered, mask=remembered < 0)), pa.string())
        keys = pa.table([*names, pa.array(numbers), prints, pa.array(seen_at)], KNOWN)

        place, published = place[event], np.where(explicit, published, at)[event]
        new = self.new(numbers[place], published)
        place, published = place[new], published[new]
        begins = np.flatnonzero(edges(place))
        lists = pa.ListArray.from_arrays(pa.array(np.append(begins, len(place)), pa.int32()), pa.array(published))
        return keys, following + len(pairs) - known, pa.table([*(x.take(pa.array(place[begins])) for x in names), lists], OUT)

    def new(self, numbers: np.ndarray, published: np.ndarray) -> np.ndarray:
        """Which of the publications were not given before; they are from now on."""
        spans, new = published // SPAN, np.zeros(len(published), bool)
        for span in np.unique(spans).tolist():
            here = np.flatnonzero(spans == span)
            value = self.given.getValue((span,))
            known = from_bytes([] if value is None else [value[0]], GIVEN)
            came = pa.table([pa.array(numbers[here]), pa.array(published[here])], GIVEN)
            first = ~pa.concat_tables([known, came]).to_pandas().duplicated().to_numpy()[known.num_rows :]
            new[here] = first
            if first.any():
                self.given.updateValue((span,), (to_bytes(pa.concat_tables([known, came.filter(pa.array(first))])),))
        return new

    def forgotten(self, keys: pa.Table, rest: pa.Table, until: int) -> pa.Table:
        """The keys but those that have been silent and have no rows that wait, whose given times go, too."""
        silent = keys["seen_at"].to_numpy() + self.forget <= until
        if not silent.any():
            return keys
        wait = set(zip(rest["system_id"].to_pylist(), rest["source_id"].to_pylist(), strict=True))
        names = zip(keys["system_id"].to_pylist(), keys["source_id"].to_pylist(), strict=True)
        gone = silent & np.array([x not in wait for x in names])
        numbers = keys["number"].to_numpy()[gone]
        for (span,), (rows,) in list(self.given.iterator()):
            times = from_bytes([rows], GIVEN)
            stay = ~np.isin(times["number"].to_numpy(), numbers)
            if not stay.any():
                self.given.removeKey((span,))
            elif not stay.all():
                self.given.updateValue((span,), (to_bytes(times.filter(pa.array(stay))),))
        return keys.filter(pa.array(~gone))

    def close(self) -> None:
        pass


def publication_changes(stream: DataFrame, late: str = "1 day", forget: timedelta | None = None, blocks: int | None = None) -> DataFrame:
    """Publications (system_id, source_id, published_at) of a stream of observations, each given once.

    Observations: the key, observed_at, input_seq (order of equal times),
    published_at, fingerprint. One that comes again within ``late`` is dropped
    before it reaches the state, one that comes later than ``late`` too. A
    publication has the explicit time, else the time of observation if the
    fingerprint differs from the last one; a null fingerprint resets it. State
    of a key that stays silent for ``forget`` is removed; by default none is.

    With ``blocks``, state is held by as many blocks of keys instead of by key.
    A task holds one block's state at a time, so blocks are to grow with the
    keys; a checkpoint keeps its number. A batch writes the remembered
    fingerprints of each block anew that it settles. One that comes again is
    dropped by the block; one later than ``late`` is only if its block is settled up
    to its time.
    """
    rows = stream.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in KEY], "observed_at", F.col("input_seq").cast("long").alias("input_seq"), F.unix_micros("observed_at").alias("at"), F.unix_micros("published_at").alias("published"), "fingerprint")
    forget_ms = None if forget is None else forget // timedelta(milliseconds=1)
    if blocks is None:
        once = rows.withWatermark("observed_at", late).dropDuplicatesWithinWatermark([*KEY, "observed_at", "input_seq"])
        events = once.groupBy(*KEY).transformWithState(PublicationChanges(forget_ms), "system_id string, source_id string, published long", "Append", "EventTime")
    else:
        block, seq = F.pmod(F.xxhash64(*KEY), F.lit(blocks)).cast("int").alias("block"), F.coalesce("input_seq", F.lit(-(1 << 63))).alias("input_seq")
        timed = rows.withWatermark("observed_at", late).select(block, *KEY, "at", seq, "published", "fingerprint")
        packed = timed.mapInArrow(pack, "block int, rows binary").groupBy("block").transformWithState(PublicationBlocks(forget_ms), "rows binary", "Append", "EventTime")
        events = packed.mapInArrow(unpack, "system_id string, source_id string, published array<long>").select(*KEY, F.explode("published").alias("published"))
    return events.select(*KEY, F.timestamp_micros("published").alias("published_at"))


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, which keyed state with timers needs."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)
