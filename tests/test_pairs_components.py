import json

import pytest

from fiduciary.operators import components, lifecycles, overlaps
from fiduciary.plans import pairs
from fiduciary.sources import manifests


def test_overlaps_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(overlaps, "BLOCK", 3)
    monkeypatch.setattr(overlaps, "ROWS", 10)
    rows = [(t, f"p{i}", f"s{(i * j) % 7}", 1.0 / (1 + i + j)) for t in ("a", "b") for i in range(8 if t == "a" else 2) for j in range(3) if (i * j) % 7 != 5]
    rows = list({r[:3]: r for r in rows}.values()) + [("c", "lone", "s", 1.0)]
    df = spark.createDataFrame(rows, "plan_period string, plan_id string, security_id string, weight double")
    expected = {}
    for t, p, s, w in rows:
        for t2, q, s2, v in rows:
            if t == t2 and s == s2 and p < q:
                x = expected.setdefault((t, p, q), [0.0, 0])
                x[0] += min(w, v)
                x[1] += 1
    found = {(r.plan_period, r.subject_plan_id, r.counterparty_plan_id): (r.overlap_weight, r.n_shared) for r in overlaps.security_overlaps(df).collect()}
    assert found == {k: (round(w, 6), n) for k, (w, n) in expected.items()} and overlaps.security_overlaps(df.limit(0)).isEmpty()


def test_overlaps_by_disclosure(spark):
    rows = [("t", "a", "m", "f", 5.0, "disclosed"), ("t", "b", "m", "f", 3.0, "disclosed"), ("t", "a", "m", None, None, "disclosed"), ("t", "b", "m", None, 2.0, "disclosed"), ("t", "a", "n", "f", 1.0, "known_not_invested"), ("t", "b", "n", "f", 1.0, "disclosed"), ("t", "a", "o", "f", 1.0, "not_disclosed"), ("t", "b", "o", "f", 1.0, "disclosed"), ("t", "a", "own", "f", 9.0, "disclosed"), ("t", "c", "x", "f", 1.0, "disclosed")]
    df = spark.createDataFrame(rows, "plan_period string, plan_id string, manager_name string, fund_name string, exposure_usd double, disclosure_state string")
    found = {(r.subject_plan_id, r.counterparty_plan_id): (r.overlap_usd, r.n_overlap, r.n_known_not_invested, r.n_unknown) for r in overlaps.disclosure_overlaps(df).collect()}
    assert found == {("a", "b"): (3.0, 1, 1, 3), ("b", "a"): (3.0, 1, 1, 3), ("a", "c"): (0.0, 0, 0, 6), ("c", "a"): (0.0, 0, 0, 6), ("b", "c"): (0.0, 0, 0, 5), ("c", "b"): (0.0, 0, 0, 5)}


def test_signals_take_precedence(spark):
    kinds = "plan_id string, plan_period string, manager_name string, fund_name string, is_disclosed boolean, known_not_invested boolean, completeness string, confidence double, evidence_refs array<string>"
    rows = [
        ("p", "FY2019", "Stays  Co", "F", True, False, "complete", 0.9, ["p.1", " p.2"]), ("p", "FY2021", "stays co", "F", True, False, "complete", 1.4, ["p.2", ""]), ("p", "FY2019", "Leaves", None, True, None, "complete", 0.5, None), ("p", "FY2021", "Comes", None, True, False, "complete", 0.5, ["c"]),
        ("p", "FY2021", "Hidden", None, False, False, "not_disclosed", 0.5, ["h "]), ("p", "FY2021", "Never", None, False, True, "not_disclosed", 0.5, None), ("p", "FY2021", " ", "", True, False, "complete", 0.5, None), ("q", "FY2021", "Alone", None, True, False, "complete", 0.5, None),
    ]
    positions = spark.createDataFrame(rows, kinds)
    signal = "plan_id string, plan_period string, manager_name string, fund_name string, event_type string, confidence double, evidence_refs array<string>, seq long"
    said = [("p", "FY2021", " COMES ", None, "still_invested", 2.0, ["s", "s"], 1), ("p", "FY2021", "comes", "", "entered", 0.3, [], 2), ("p", "FY2021", "Leaves", None, "exited", 0.7, ["s1"], 3), ("p", "FY2021", "leaves", None, "exited", 0.8, ["s2"], 4), ("z", "FY1999", "New", "Fund", "entered", 0.1, None, 5)]
    found = {(r.plan_id, r.plan_period, r.manager_name): (r.fund_name, r.event_type, r.basis, r.confidence, r.evidence_refs) for r in lifecycles.lifecycle_events(positions, spark.createDataFrame(said, signal)).collect()}
    assert found == {
        ("p", "FY2021", "stays co"): ("F", "still_invested", "inferred", 0.9, ["p.1", "p.2"]), ("p", "FY2021", "COMES"): (None, "still_invested", "explicit_text", 1.0, ["s"]),
        ("p", "FY2021", "leaves"): (None, "exited", "explicit_text", 0.8, ["s2"]), ("z", "FY1999", "New"): ("Fund", "entered", "explicit_text", 0.1, []),
    }
    plain = {(r.manager_name, r.event_type, r.basis) for r in lifecycles.inferred_events(positions).collect()}
    assert plain == {("stays co", "still_invested", "inferred"), ("Comes", "entered", "table_presence_change"), ("Leaves", "exited", "table_presence_change")}
    assert [(r.manager_name, r.evidence_refs) for r in lifecycles.undisclosed(positions).collect()] == [("Hidden", ["h"])]


def test_components_of_documents(spark):
    documents = spark.createDataFrame([("d", "p", "t", None, None, "s"), ("empty", None, None, None, None, None)], "document_id string, plan_id string, plan_period string, effective_date string, ingestion_date string, source_document_id string")
    metrics = spark.createDataFrame([("d", "fee", "v1", ["b", " a "]), ("d", "allocation", " ", None), ("d", None, "v1", ["a"])], "document_id string, metric_family string, benchmark_version string, evidence_refs array<string>")
    positions = spark.createDataFrame([("d", " m ", "f"), ("d", "m", None), ("d", None, "")], "document_id string, manager_name string, fund_name string")
    rows = {(r.document_id, r.component_name): r for r in components.schema_components(documents, {"metrics": metrics, "positions": positions}).collect()}
    assert len(rows) == 42
    got = {c: (rows["d", c].status, rows["d", c].row_count) for c in components.SCHEMA}
    assert got["metric_observation"] == ("present", 3) and got["benchmark_version"] == ("present", 1) and got["manager_entity"] == ("present", 1) and got["plan_manager_fund_position"] == ("present", 3) and got["evidence_reference"] == ("present", 2)
    assert got["performance_observation"] == got["benchmark_definition"] == ("partial", 0) and got["plan_financial_flow"] == ("not_disclosed", 0)
    assert rows["d", "pension_plan"].evidence_refs == ["a", "b"] and rows["d", "risk_exposure_observation"].evidence_refs == []
    assert {r.status for (d, _), r in rows.items() if d == "empty"} == {"not_disclosed"}


def test_manifests(spark, tmp_path):
    (tmp_path / "own").mkdir()
    (tmp_path / "a b.json").write_text('{"x": 1}\n{"x": 2}\n')
    (tmp_path / "own" / "part.json").write_text('{"x": 3}\n')
    (tmp_path / "own" / "deep.json").write_text('{"x": 4}\n')
    (tmp_path / "m.json").write_text(json.dumps({"one": "a b.json", "two": "own", "three": str(tmp_path / "own" / "deep.json")}))
    rows = manifests.component_datasets(spark, str(tmp_path / "m.json"), "x int")
    assert sorted({(r.component, r.x) for r in rows.collect()}) == [("one", 1), ("one", 2), ("three", 4), ("two", 3)]
    (tmp_path / "arrays.json").write_text('[{"x": 5},\n {"x": 6}]')
    (tmp_path / "m2.json").write_text(json.dumps({"one": "arrays.json"}))
    assert sorted(r.x for r in manifests.component_datasets(spark, str(tmp_path / "m2.json"), "x int", lines=False).collect()) == [5, 6]
    for wrong in ([], {"a": " "}, {" ": "x"}, {"a": 1}):
        (tmp_path / "w.json").write_text(json.dumps(wrong))
        with pytest.raises(ValueError):
            manifests.manifest_entries(spark, str(tmp_path / "w.json"))
    path = manifests.write_components(spark.createDataFrame([("c1", 1), ("c2", 2)], "component_name string, x int"), str(tmp_path / "out"))
    assert sorted((r.component, r.component_name, r.x) for r in manifests.component_datasets(spark, path, "component_name string, x int").collect()) == [("c1", "c1", 1), ("c2", "c2", 2)]


def test_overlaps_are_added_up_in_parts(spark, monkeypatch):
    weights = spark.sql("SELECT '2020' AS plan_period, concat('p', p.id) AS plan_id, concat('s', s.id) AS security_id, CAST((p.id * 7 + s.id * 3) % 11 AS double) AS weight FROM range(12) p, range(40) s WHERE (p.id + s.id) % 5 > 0")
    whole = sorted(map(tuple, overlaps.security_overlaps(weights).collect()))
    assert len(whole) == 66
    monkeypatch.setattr(overlaps, "PAIRS", 7)  # bounds the pairs that a task holds
    assert sorted(map(tuple, overlaps.security_overlaps(weights).collect())) == whole


def test_lifecycle_events_make_positions_once(spark):
    plan = pairs.lifecycle_rows(spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan parquet [l_") == 1  # that of the signals
