import datetime as dt
import random
from datetime import timedelta

import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from fiduciary.operators import history
from fiduciary.plans import stores
from fiduciary.sources.store import FactStore, judged
from fiduciary.streaming import jobs, publications

STAGED = "fact_id string, value double, asserted_at string, source_document_id string, superseded_at string, restated boolean"
SEEN = "system_id long, source_id string, observed_at timestamp, input_seq long, published_at timestamp, fingerprint string"


def day(x):
    return dt.datetime(2024, 1, 1) + timedelta(days=x)


def streamed(spark, parts, **how):
    def run(stream, folder):
        changes = publications.publication_changes(stream, "5 days", **how)
        return changes.writeStream.outputMode("append").foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/out/batch={n}"))

    with publications.rocks(spark):
        folder = jobs.replay([spark.createDataFrame(p, SEEN).coalesce(1) for p in parts], run)
    return sorted((r.system_id, r.source_id, r.published_at) for r in spark.read.parquet(f"{folder}/out").collect())


def test_streamed_publications_are_those_of_the_whole_table(spark):
    rows = [(1, "a", day(i * 0.9), i, day(i) if i % 5 == 3 else None, None if i % 7 == 6 else f"f{i // 2 % 3}") for i in range(18)]
    rows += [(2, "a", day(3), 100, day(1), None), (2, "a", day(4), 101, day(1), "x"), (2, "a", day(4), 102, None, "y")]
    late, again = rows[2], rows[10]
    parts = [[r for r in rows if r[2] < day(5) and r != late], [late, late, *[r for r in rows if r[2] >= day(5)]], [again, (9, "end", day(60), 999, None, None)]]
    whole = history.publication_events(spark.createDataFrame(rows, SEEN)).collect()
    expected = sorted((str(r.system_id), r.source_id, r.published_at) for r in whole)
    assert streamed(spark, parts) == expected
    assert spark.conf.get(publications.PROVIDER, None) != publications.ROCKS  # the session's own setting is back


def test_silent_keys_are_forgotten(spark):
    parts = [[(1, "a", day(0), 1, None, "x"), (7, "end", day(9), 2, None, None)], [(7, "end", day(50), 3, None, None)], [(1, "a", day(51), 4, None, "x"), (7, "end", day(99), 5, None, None)]]
    assert streamed(spark, parts) == [("1", "a", day(0))]
    assert streamed(spark, parts, forget=timedelta(days=20)) == [("1", "a", day(0)), ("1", "a", day(51))]


def row(fact, value, at, source, seq):
    return (fact, value, at, source, None, False, seq)


def batch(spark, *rows):
    return spark.createDataFrame(list(rows), f"{STAGED}, seq long")


def shown(df):
    return sorted((r.fact_id.split(":")[0], r.value, r.asserted_at, r.superseded_at, r.restated) for r in df.collect())


def test_rows_of_a_batch_are_judged_one_after_the_other(spark):
    rows = [row("f", 1.0, "t1", "d1", 1), row("f", 1.0, "t1", "d1", 2), row("f", 2.0, "t1", "d1", 3), row("f", 2.0, "t2", "d1", 4), row("f", 3.0, "t2", "d1", 5), row("f", 1.0, "t1", "d1", 6), row("f", 2.0, "t2", "d1", 7), row("g", None, None, None, 8)]
    found = judged(spark.createDataFrame([], STAGED), batch(spark, *rows).repartition(3), "seq", F.lit(0)).collect()
    assert [(r._decision, r.value, r.superseded_at) for r in sorted(found, key=lambda r: (r.fact_id[0], r.asserted_at or "", r.value or 0, r._decision))] == [
        ("insert", 1.0, "t2"), ("skip", 1.0, None), ("supersede", 1.0, None), ("conflict", 2.0, None), ("conflict", 2.0, None), ("supersede", 2.0, "t1"), ("conflict", 3.0, None), ("insert", None, None)]


def test_a_store_of_versions(spark, tmp_path):
    store = FactStore(spark, str(tmp_path / "store"), STAGED, 4)
    assert store.facts().collect() == [] and store.version() == 0
    first = batch(spark, row("a", 1.0, "t1", "d", 1), row("b", 1.0, "t1", "d", 2), row("c", 1.0, "t1", "d", 3))
    assert store.put(first, "one", "seq") == 3 and store.put(first, "one", "seq") == 0 and store.put(first, "again", "seq") == 0
    assert shown(store.facts()) == [(x, 1.0, "t1", None, False) for x in "abc"]
    folders = {r.bucket: r.folder for r in store.manifest().where("version = 1").collect()}
    second = batch(spark, row("a", 2.0, "t2", "d", 1), row("a", 3.0, "t2", "d", 2), row("a", 2.0, "t2", "d", 3))
    assert store.put(second, "two", "seq") == 1
    assert shown(store.facts()) == [("a", 1.0, "t1", "t2", True), ("a@t2", 2.0, "t2", None, True), ("b", 1.0, "t1", None, False), ("c", 1.0, "t1", None, False)]
    assert shown(store.facts(version=2)) == shown(store.facts(version=1)) == [(x, 1.0, "t1", None, False) for x in "abc"]
    assert [r.value for r in store.conflicts(3).collect()] == [3.0] and store.conflicts(9).collect() == []
    touched = {r.bucket for r in store.manifest().where("version = 3").collect()}
    assert len(touched) == 1 and touched <= set(folders)
    with pytest.raises(ValueError, match="1 rows conflict"):
        store.put(batch(spark, row("a", 9.0, "t2", "d", 1), row("new", 1.0, "t", "d", 2)), "bad", "seq", refuse=True)
    assert store.version() == 3 and "new" not in [r.fact_id for r in store.facts().collect()]
    assert store.put(first.limit(0), "none", "seq") == 0 and store.version() == 4


def test_a_killed_write_leaves_the_version_before(spark, tmp_path, monkeypatch):
    store = FactStore(spark, str(tmp_path / "store"), STAGED, 2)
    store.put(batch(spark, row("a", 1.0, "t1", "d", 1)), "one", "seq")
    monkeypatch.setattr(store, "commit", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        store.put(batch(spark, row("a", 2.0, "t2", "d", 1), row("z", 1.0, "t1", "d", 2)), "two", "seq")
    monkeypatch.undo()
    assert shown(store.facts()) == [("a", 1.0, "t1", None, False)] and store.version() == 1
    assert store.put(batch(spark, row("a", 5.0, "t3", "d", 1)), "two", "seq") == 1  # the name was not taken
    assert shown(store.facts()) == [("a", 1.0, "t1", "t3", True), ("a@t3", 5.0, "t3", None, True)]


class Counted:
    """A key's state in memory, which counts the calls into it."""

    def __init__(self):
        self.calls, self.rows, self.value, self.map, self.timers = 0, [], None, {}, []

    def __getattribute__(self, name):
        if name in ("getListState", "getValueState", "getMapState"):
            return lambda *_: self
        if name in ("appendValue", "get", "put", "clear", "update", "getValue", "updateValue", "registerTimer"):
            self.calls += 1
        return object.__getattribute__(self, name)

    appendValue = lambda self, x: self.rows.append(x)
    clear = lambda self: self.rows.clear()
    registerTimer = lambda self, at: self.timers.append(at)
    getValue = lambda self, k: self.map.get(k)
    updateValue = lambda self, k, v: self.map.update({k: v})

    def get(self):
        return list(self.rows) if self.rows else self.value

    def put(self, rows):
        self.rows[:] = rows

    def update(self, value):
        self.value = value


class Values(Counted):
    def get(self):
        return self.value


def test_waiting_rows_of_a_key_go_in_few_calls(spark):
    processor = publications.PublicationChanges(None)
    rows, last = Counted(), Values()
    processor.forget_ms, processor.handle, processor.waiting, processor.last, processor.given = None, rows, rows, last, last
    seen = [Row(at=1000 * i, input_seq=i, published=None, fingerprint=f"f{i // 2}") for i in range(2000)]
    clock = TimerValues(0, 1500)
    for part in (seen[::2], seen[1::2]):
        assert list(processor.handleInputRows(("k", "s"), iter(part), clock)) == []
    given = [x for at in sorted(rows.timers) for x in processor.handleExpiredTimer(("k", "s"), clock, ExpiredTimerInfo(at))]
    assert [x.published for x in given] == [1000 * i for i in range(0, 1501, 2)]
    assert rows.calls + last.calls < 20  # one call a row or more before
    given = list(processor.handleExpiredTimer(("k", "s"), TimerValues(0, 9000), ExpiredTimerInfo(rows.timers[-1])))
    assert [x.published for x in given] == [1000 * i for i in range(1502, 2000, 2)] and not rows.rows


def many(n, keys, seed):
    """Observations of several keys, some of equal time, with explicit times of other months, null fingerprints and nulls for keys."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = rng.randrange(keys)
        rows.append((key % 7 if key else None, f"s{key}", day(rng.randrange(120) / 4), i, day(rng.choice([-200, 1, 2, 40])) if rng.random() < 0.2 else None, None if rng.random() < 0.1 else f"f{rng.randrange(3)}"))
    return sorted(rows, key=lambda r: r[2])


def test_blocks_of_keys_give_what_the_whole_table_gives(spark):
    rows = many(600, 40, 1)
    parts = [[r for r in rows if at == min(2, int((r[2] - day(0)).days + r[3] % 5) // 10)] for at in range(3)]  # up to four days after their time
    assert any(r[2] < day(10) for r in parts[1]) and any(r[2] < day(20) for r in parts[2])
    parts = [parts[0] + parts[0][::3], parts[1] + parts[0][::2], [*parts[2], *parts[1][::2], *parts[0][:30], (9, "end", day(90), 9999, None, None)]]
    whole = history.publication_events(spark.createDataFrame(rows, SEEN)).collect()
    expected = sorted((r.system_id or 0, r.source_id, r.published_at) for r in whole)
    for blocks in (1, 6):
        found = streamed(spark, parts, blocks=blocks)
        assert sorted((int(s or 0), x, at) for s, x, at in found) == expected


def test_blocks_forget_silent_keys(spark):
    parts = [[(1, "a", day(0), 1, None, "x"), (1, "b", day(8), 2, None, "x"), (7, "end", day(9), 3, None, None)], [(7, "end", day(30), 4, None, None)], [(1, "a", day(31), 5, None, "x"), (1, "b", day(31), 6, None, "x"), (7, "end", day(99), 7, None, None)]]
    assert streamed(spark, parts, blocks=1) == [("1", "a", day(0)), ("1", "b", day(8))]
    assert streamed(spark, parts, blocks=1, forget=timedelta(days=20)) == [("1", "a", day(0)), ("1", "a", day(31)), ("1", "b", day(8))]


class Bytes(Counted):
    """The state of a block, of one kind each, with the calls counted."""

    def __init__(self, single=False):
        super().__init__()
        self.single = single

    def get(self):
        return self.value if self.single else list(self.rows)

    def iterator(self):
        return iter([(k, v) for k, v in self.map.items()])

    def removeKey(self, key):
        del self.map[key]


def test_a_block_of_many_keys_goes_in_few_calls():
    processor, waiting, last, given = publications.PublicationBlocks(None), Bytes(), Bytes(single=True), Bytes()
    processor.handle, processor.waiting, processor.last, processor.given = waiting, waiting, last, given
    seen = pa.table({"block": [3] * 8000, "system_id": [f"k{i % 2000}" for i in range(8000)], "source_id": ["s"] * 8000, "at": [1000 * i for i in range(8000)], "input_seq": range(8000), "published": pa.nulls(8000, pa.int64()), "fingerprint": [f"f{i // 4000}" for i in range(8000)]})
    given_out = []
    for part, passed in ((seen[:5000], 4000), (seen[5000:], 9000), (seen[:100], 9000)):  # the last ones come too late
        rows = [Row(rows=x.as_py()) for batch in publications.pack(iter(part.to_batches(max_chunksize=700))) for x in batch["rows"]]
        assert len(rows) == 1
        list(processor.handleInputRows((3,), iter(rows), TimerValues(0, passed)))
        due = [at for at in sorted(set(waiting.timers)) if at <= passed]
        waiting.timers[:] = [at for at in waiting.timers if at > passed]
        out = [x for at in due for x in processor.handleExpiredTimer((3,), TimerValues(0, passed), ExpiredTimerInfo(at))]
        lists = [r for batch in publications.unpack(iter([pa.record_batch({"rows": [x.rows for x in out]})])) for r in batch.to_pylist()] if out else []
        given_out += [(r["system_id"], at) for r in lists for at in r["published"]]
    assert sorted(given_out) == sorted((f"k{i % 2000}", 1000 * i) for i in [*range(2000), *range(4000, 6000)])
    assert waiting.calls + last.calls + given.calls < 25 and not waiting.rows


def test_a_silent_key_is_forgotten_while_another_of_its_block_waits():
    processor, waiting, last, given = publications.PublicationBlocks(10), Bytes(), Bytes(single=True), Bytes()
    processor.handle, processor.waiting, processor.last, processor.given = waiting, waiting, last, given
    seen = pa.table({"block": [0, 0, 0], "system_id": ["a", "b", "a"], "source_id": ["s"] * 3, "at": [0, 3000, 100_000], "input_seq": [1, 2, 3], "published": pa.nulls(3, pa.int64()), "fingerprint": ["x"] * 3})
    rows = [Row(rows=x.as_py()) for batch in publications.pack(iter(seen.to_batches())) for x in batch["rows"]]
    list(processor.handleInputRows((0,), iter(rows), TimerValues(0, 5)))
    for passed in (5, 10, 13):
        due = [at for at in sorted(set(waiting.timers)) if at <= passed]
        assert due
        for at in due:
            list(processor.handleExpiredTimer((0,), TimerValues(0, passed), ExpiredTimerInfo(at)))
            waiting.timers[:] = [x for x in waiting.timers if x != at]  # as Spark does after the call
    assert publications.from_bytes([last.value[2]], publications.KNOWN)["system_id"].to_pylist() == ["a"]
    assert 100 in waiting.timers and len(waiting.rows) == 1


def test_states_of_the_query_are_fewer_than_its_keys(spark, monkeypatch):
    queries, start = [], DataStreamWriter.start
    monkeypatch.setattr(DataStreamWriter, "start", lambda self, *args, **how: queries.append(start(self, *args, **how)) or queries[-1])
    data = "/root/testdata/sf0.01"
    found = stores.publication_stream(spark, data)
    keys = spark.read.parquet(f"{data}/events.parquet").select("user_id", "event_type").distinct().count()
    put = [op["numRowsUpdated"] for q in queries for p in q.recentProgress for op in p["stateOperators"] if op["operatorName"].startswith("transformWithState")]
    assert keys > 300 and put and max(put) < keys  # one of a key or more before
    whole = history.publication_events(stores.observations(spark, data))
    key = ["system_id", "source_id", "published_at"]
    assert sorted(map(tuple, found.select(*key).collect())) == sorted(map(tuple, whole.select("system_id", "source_id", F.col("published_at").cast("timestamp_ntz")).collect()))
