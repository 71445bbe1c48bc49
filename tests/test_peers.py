import json
import math
import random
import statistics

from pyspark.sql import functions as F

from fiduciary.operators import peers
from fiduciary.sources import snapshots


def finite(v):
    return v if v is not None and math.isfinite(v) else None


def test_statistics_of_all_others_equal_brute_force(spark):
    rnd = random.Random(7)
    rows = []
    for period in ("a", "b"):
        for i in range(60):
            rows.append((f"p{i}", period, rnd.choice("xyz"), "ties", float(rnd.randint(0, 2))))
            rows.append((f"p{i}", period, rnd.choice("xyz"), "large", 1e9 + rnd.random() * 1e6))
            rows.append((f"p{i}", period, rnd.choice("xyz"), "odd", rnd.choice([None, float("nan"), float("inf"), rnd.random()])))
    rows += [("lone", "c", "x", "ties", 1.0), ("q1", "d", None, "same", 0.1), ("q2", "d", None, "same", 0.1), ("q3", "d", "x", "same", 0.1), ("q4", "d", "x", "same", 5.0)]
    df = spark.createDataFrame(rows, "plan_id string, plan_period string, peer_group string, metric_name string, metric_value double")
    axes = {"broad": ["plan_period"], "tight": ["plan_period", "peer_group"]}
    found = {(r.axis, r.plan_id, r.plan_period, r.metric_name): r for r in peers.peer_axes(df.repartition(7), axes).collect()}
    assert len(found) == 2 * len(rows)
    for axis in axes:
        for plan, period, group, metric, value in rows:
            others = [v for p, t, g, m, x in rows if (v := finite(x)) is not None and p != plan and t == period and m == metric and (axis == "broad" or g == group)]
            r, value = found[axis, plan, period, metric], finite(value)
            assert r.n_peers == len(others) and (r.metric_value is None if value is None else math.isclose(r.metric_value, value, rel_tol=1e-12, abs_tol=1e-6))
            assert (r.peer_mean is None) == (not others) and (r.peer_median is None) == (not others)
            if others:
                assert math.isclose(r.peer_mean, statistics.fmean(others), rel_tol=1e-9, abs_tol=1e-6) and math.isclose(r.peer_median, statistics.median(others), rel_tol=1e-12, abs_tol=1.1e-6)
            assert r.percentile == (round(100 * sum(o <= value for o in others) / len(others), 4) if others and value is not None else None)
            sigma = statistics.pstdev(others) if len(others) > 1 else 0
            if value is None or sigma == 0:
                assert r.z_score is None
            else:
                assert math.isclose(r.z_score, (value - statistics.fmean(others)) / sigma, abs_tol=2e-3 if metric == "large" else 1e-4)


def test_text_behind_ratings(spark):
    fields = "plan_id string, plan_period string, funded_ratio_mva double, funded_ratio_trend double, assumed_return double, peer_assumed_return_median double, realistic_return double, gasb_discount_rate double, adc_usd double, actual_contribution_usd double, normal_cost_usd double, uaal_usd double, amortization_payment_usd double, amortization_is_closed boolean, amortization_period_years double, net_cash_flow_pct double, mortality_table_year int"
    rows = [
        ("a", "t", 0.8124, -0.0125, 0.07, 0.0675, 0.065, 0.05, 100.0, 95.0, 10.0, 1e6, 1e5, False, 30.0, -4.25, 2005),
        ("b", "t", 2.0, None, 0.07, None, 1.5, None, 0.0, 95.0, 10.0, -1.0, None, None, None, None, None),
        ("c", "t", 0.95, 0.02, 0.07, None, None, 0.07, 100.0, 120.0, 1e5, 1e6, 1.0, True, None, 1.0, 2012),
    ]
    found = {(r.plan_id, r.dimension): r.basis for r in peers.health_basis(spark.createDataFrame(rows, fields)).collect()}
    assert len(found) == 27
    assert found["a", "funded_ratio_mva"] == "MVA funded ratio 81.2%; bands >=90%/>=70%" and found["a", "funded_ratio_trend"] == "funded-ratio change -0.013; flat band +/-0.01"
    assert found["a", "assumed_return"] == "assumed 7.00%; vs realistic 6.50%: +0.50%; vs peer median 6.75%: +0.25%" and found["a", "contribution_sufficiency"] == "paid 95% of ADC; bands >=100%/>=90%"
    assert found["a", "tread_water"] == "contribution minus (normal cost + i*UAAL) = -69,915" and found["a", "amortization"] == "open amortization over 30y (> 25y)"
    assert found["a", "cash_flow_maturity"] == "net external cash flow -4.2% of assets; bands >=-3.0/>=-5.0" and found["a", "gasb_crossover"] == "GASB discount 5.00% < assumed 7.00%: crossover/depletion (blended rate)"
    assert found["a", "mortality_currency"] == "mortality base year 2005; green >=2010"
    assert [found["b", x] for x in ("funded_ratio_mva", "funded_ratio_trend", "assumed_return", "contribution_sufficiency", "tread_water", "amortization")] == [
        "no valid funded ratio (MVA) in [0, 1]", "no valid trend in [-1, 1]", "realistic return outside [0, 1]", "no valid non-negative ADC/actual", "insufficient valid inputs", "invalid amortization inputs"]
    assert found["c", "assumed_return"] == "assumed 7.00%; no peer/realistic comparator supplied" and found["c", "amortization"] == "negative amortization: payment < interest on UAAL" and found["c", "gasb_crossover"] == "GASB discount 7.00% >= assumed 7.00%: no crossover"


def snapshot_file(tmp_path, name, snapshot, documents, **head):
    folder = tmp_path / f"snapshot={snapshot}"
    folder.mkdir(exist_ok=True)
    header = {"artifact_type": "pension_replay_baseline", "schema_version": 1, "baseline_version": "v1", "parser_id": "p", "generated_at": "t", "documents": documents}
    (folder / name).write_text(json.dumps({**header, **head}, indent=1))


def test_snapshots_with_rejects(spark, tmp_path):
    good = {"value": 1, "confidence": 0.5, "evidence": "p. 1"}
    docs = [{"document_id": "d1", "fields": {"a": good, "b": {"value": None}, "c": {"value": {"x": [1]}}, "n": {}, "o": 3, "e": {"value": 1, "evidence": 2}, "f": {"value": "1", "confidence": "high"}}}, {"document_id": " ", "fields": {}}, {"document_id": "d2", "fields": []}, 7, {"document_id": "d1", "fields": {}}]
    snapshot_file(tmp_path, "a.json", "one", docs)
    snapshot_file(tmp_path, "b.json", "one", [{"document_id": "d1", "fields": {"a": good}}, {"document_id": "d3", "fields": {"a": {"value": "1"}}}])
    for name, head in {"c": {"schema_version": "1"}, "d": {"parser_id": " "}, "e": {"documents": {}}, "f": {"artifact_type": "x"}}.items():
        snapshot_file(tmp_path, f"{name}.json", "two", **{"documents": [], **head})
    (tmp_path / "snapshot=two" / "g.json").write_text("not json")
    rows, rejects = snapshots.snapshot_scan(spark, str(tmp_path))
    assert sorted((r.snapshot, r.document_id, r.field, r.value, r.confidence, r.evidence) for r in rows.collect()) == sorted([("one", "d1", "a", "1", 0.5, "p. 1"), ("one", "d1", "b", "null", None, None), ("one", "d1", "c", '{"x":[1]}', None, None), ("one", "d3", "a", '"1"', None, None)], key=str)
    assert sorted((r.file, r.document_id or "", r.field or "", r.reason) for r in rejects.collect()) == sorted([
        ("a.json", "d1", "n", "value"), ("a.json", "d1", "o", "not_an_object"), ("a.json", "d1", "e", "evidence"), ("a.json", "d1", "f", "confidence"), ("a.json", "", "", "document_id"), ("a.json", "d2", "", "fields"), ("a.json", "", "", "not_an_object"),
        ("a.json", "d1", "", "duplicate_document_id"), ("b.json", "d1", "", "duplicate_document_id"), ("c.json", "", "", "schema_version"), ("d.json", "", "", "parser_id"), ("e.json", "", "", "documents"), ("f.json", "", "", "artifact_type"), ("g.json", "", "", "not_an_object")])


def test_snapshots_written_and_compared(spark, tmp_path):
    rows = [("s1", "d", "a", "1", 0.5, "x"), ("s1", "d", "gone", '"t"', None, None), ("s2", "d", "a", "2", 0.5, None), ("s2", "d", "new\"", "null", 1.0, None), ("s3", "e", "a", "1", None, None)]
    df = spark.createDataFrame(rows, snapshots.FIELD)
    snapshots.write_snapshots(df, str(tmp_path / "out"), "p", "t", 2)
    back, rejects = snapshots.snapshot_scan(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str) and rejects.isEmpty()
    steps = spark.createDataFrame([("s1", "s2"), ("s1", "s2")], "baseline string, current string")
    expected = spark.createDataFrame([("d", "a")], "document_id string, field string")
    got = sorted((r.field, r.attribute, r.baseline, r.current, r.classification) for r in snapshots.snapshot_changes(back, steps, expected).collect())
    assert got == [("a", "evidence", "x", None, "expected_change"), ("a", "value", "1", "2", "expected_change"), ("gone", "field_presence", "true", "false", "unexpected_drift"), ('new"', "field_presence", "false", "true", "unexpected_drift")]
    assert snapshots.snapshot_changes(back.where(F.lit(False)), steps, expected).isEmpty()
