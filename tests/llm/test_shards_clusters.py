import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fiduciary.llm import clusters, shards

ODD = [(1, None), (2, ""), (2, ""), (3, "漢字 🙂"), (None, "no id"), (None, "no id"), (4, "word " * 5000), (5, "tie"), (5, "tie too")]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4096, 5001])
def test_a_permutation_and_its_inverse(n):
    p = shards.Permutation(n, "seed")
    places = p.places(np.arange(n))
    assert sorted(places.tolist()) == list(range(n)) and (p.numbers(places) == np.arange(n)).all()
    if n > 100:
        other = shards.Permutation(n, "other").places(np.arange(n))
        assert (places != np.arange(n)).mean() > 0.9 and (places != other).mean() > 0.9
        assert abs(np.corrcoef(np.arange(n), places)[0, 1]) < 0.15


def test_a_permutation_of_very_many_rows():
    n = (1 << 45) + 12345
    p, some = shards.Permutation(n, "s"), np.random.default_rng(1).integers(0, (1 << 45), 1000)
    places = p.places(some)
    assert ((places >= 0) & (places < n)).all() and (p.numbers(places) == some).all()


def test_sharding(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string").withColumns({c: F.lit(c) for c in ("_id", "_size", "_crc", "_hash", "_kept", "_part", "_at", "_tie", "_shard", "_slot")})
    rows, p = shards.sharded(docs, 4, "s", keep=tuple(docs.columns))
    found = rows.collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in found) == sorted((i or 0, x or "") for i, x in ODD) and {r._part for r in found} == {"_part"}
    for r in found:
        assert r._size == len((r.text or "").encode()) + 1 and r._crc == zlib.crc32((r.text or "").encode())
    for shard in range(4):
        assert sorted(r._slot for r in found if r._shard == shard) == list(range(len([0 for r in found if r._shard == shard])))
    assert sorted([r._shard for r in found].count(s) for s in range(4)) == [2, 2, 2, 3]
    ordered = sorted(found, key=lambda r: p.numbers(np.array([r._slot * 4 + r._shard]))[0])
    assert [r.doc_id for r in ordered] == [1, 2, 2, 3, 4, 5, 5, None, None] and p.row_at(ordered[3]._shard, ordered[3]._slot, 4) == 3
    key = lambda rs: sorted((r.doc_id or 0, r.text or "", r._shard, r._slot) for r in rs)
    assert key(shards.sharded(docs.repartition(7), 4, "s", keep=("doc_id", "text"))[0].collect()) == key(found)
    assert key(shards.sharded(docs, 4, "t", keep=("doc_id", "text"))[0].collect()) != key(found)
    assert shards.sharded(docs.limit(0))[0].collect() == []


def test_copies_of_one_row_are_numbered_by_many_tasks(spark):
    docs = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        _, before = shards.numbered(docs, "doc_id", "text")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert before[-1] == 4000 and max(b - a for a, b in zip(before, before[1:], strict=False)) < 2500
    rows = shards.sharded(docs, 8)[0].collect()
    assert sorted((r._shard, r._slot) for r in rows) == [(s, i) for s in range(8) for i in range(500)]


def test_written_shards(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string")
    shards.write_shards(docs, f"{tmp_path}/out", 3)
    back = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted((r.doc_id, r.text) for r in back) == [(i, f"text {i}") for i in sorted(range(50))] and {r._shard for r in back} == {0, 1, 2}


def test_planes_give_exact_products():
    rnd = np.random.default_rng(4)
    for most in (1, 2, 700, clusters.MOST):
        x, y = rnd.integers(-most, most, (300, 64)), rnd.integers(-most, most, 64)
        planes = clusters.planes_of(x)
        assert (clusters.dots(planes, clusters.planes_of(y[None])[0]) == x @ y).all()
        assert (clusters.squares(planes) == (x * x).sum(1)).all() and (clusters.component_sums(planes) == x.sum(0)).all()
    assert clusters.planes_of(np.zeros((2, 64), np.int64)).shape == (2, 1)
    assert clusters.exact_sum(np.full(1000, (1 << 62) - 1)) == 1000 * ((1 << 62) - 1)


def brute(rows, k, rounds, scale=1024):
    taken = [(i, np.clip(np.floor(scale * np.array(x, float)), -clusters.MOST, clusters.MOST - 1).astype(np.int64)) for i, x in rows if x is not None and len(x) == 64 and all(v is not None and np.isfinite(v) for v in x)]
    x = np.array([v for _, v in taken])
    order = sorted(range(len(taken)), key=lambda j: (hashlib.sha256(f"3:{'' if taken[j][0] is None else taken[j][0]}".encode()).hexdigest(), tuple(x[j])))
    c = x[order[:k]].copy()
    for turn in range(rounds + 1):
        far = ((x[:, None] - c[None]) ** 2).sum(2)
        at = far.argmin(1)
        if turn < rounds:
            for j in set(at.tolist()):
                c[j] = x[at == j].sum(0) // (at == j).sum()
    far = far[np.arange(len(x)), at]
    digest = [hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for v in c.tolist()]
    return sorted((-1 if i is None else i, int(a), int(d), int(far[at == a].sum()), int(far.sum()), digest[a]) for (i, _), a, d in zip(taken, at, far, strict=True))


def plain(found):
    return sorted((-1 if r._id is None else r._id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in found.collect())


def test_clusters(spark):
    rnd = np.random.default_rng(5)
    x = rnd.normal(size=(400, 64)) + 3 * rnd.integers(0, 3, (400, 1))
    x[100:230] = x[100]  # copies
    x[300] = 9000.0  # needs more planes than the others
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(7, x[8].tolist()), (7, x[8].tolist()), (None, x[3].tolist())]
    odd = [(501, None), (502, []), (503, [1.0] * 63), (504, [1.0] * 65), (505, [None] + [1.0] * 63), (506, [float("nan")] * 64), (507, [float("-inf")] + [0.0] * 63)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumns({c: F.lit(c) for c in ("_id", "_vector", "cluster", "distance", "planes", "order")})
    found, _ = clusters.clusters(df.repartition(5), 8, 4)
    assert plain(found) == brute(rows, 8, 4)


def test_clusters_of_few_and_of_huge_vectors(spark):
    few = [(i, [float(i % 2)] * 64) for i in range(5)]
    df = spark.createDataFrame(few, "vec_id long, embedding array<float>")
    assert plain(clusters.clusters(df, 8, 3)[0]) == brute(few, 8, 3)
    huge = spark.createDataFrame([(1, [1e300] * 64), (2, [-1e300] * 64), (3, [0.0] * 64)], "vec_id long, embedding array<double>")
    rows = clusters.clusters(huge, 1, 1)[0].collect()
    assert len(rows) == 3 and all(0 <= r.distance <= r.inertia <= clusters.LONG for r in rows)
    assert clusters.clusters(df.limit(0))[0].collect() == [] and clusters.clusters(df.where("size(embedding) = 3"))[0].collect() == []
