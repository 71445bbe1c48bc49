import json

import pytest

from fiduciary.operators import sourcemap
from fiduciary.plans import files
from fiduciary.sources import scans
from fiduciary.streaming import jobs


def test_registry_and_schedules(spark, tmp_path):
    (tmp_path / "r.csv").write_text("plan_id,plan_name,system_type,jurisdiction,in_peer_universe\np1,Big Plan!,state,CA,Yes\n,No Id,state,NY,maybe\n")
    rows = scans.registry(spark, str(tmp_path / "r.csv")).collect()
    assert [(r.identity_key, r.in_peer_universe, r.is_valid) for r in rows] == [("big-plan-ca", True, True), ("no-id-ny", None, False)]
    (tmp_path / "s.csv").write_text("schedule,plan_year,ein,plan_number,plan_name\nsb,2020,12-3456789,1,A\nXX,20x,1,,B\n")
    rows = scans.schedules(spark, str(tmp_path / "s.csv")).collect()
    assert [(r.plan_year, r.ein, r.plan_number, r.ok) for r in rows] == [(2020, "123456789", "001", True), (None, "1", "000", False)]


def test_holdings_xml_log_and_csv_sink(spark, tmp_path):
    (tmp_path / "h.csv").write_text('name,ticker,cusip,shares,market_value\n Acme ,ac,12-3,"1,000",x\n')
    assert tuple(scans.own_holdings(spark, str(tmp_path / "h.csv")).first()) == ("Acme", "AC", "123", 1000.0, None)
    (tmp_path / "f.xml").write_text('<n1:t xmlns:n1="u"><n1:infoTable><n1:nameOfIssuer>A</n1:nameOfIssuer><n1:cusip>x1</n1:cusip><n1:value>5</n1:value></n1:infoTable></n1:t>')
    assert tuple(scans.information_table(spark, str(tmp_path / "f.xml")).first())[:3] == ("A", "X1", 5000.0)
    (tmp_path / "l.json").write_text('{"operation": "q", "status": "OK", "latency_ms": 1}\nnot json\n\n{"operation": "q", "status": "slow"}\n')
    assert [r.status for r in scans.operation_log(spark, str(tmp_path / "l.json")).collect()] == ["ok", "error"]
    scans.write_csv(spark.createDataFrame([(1, None, [1, 2])], "a int, b string, c array<int>").coalesce(1), str(tmp_path / "out"))
    assert next((tmp_path / "out").glob("part*")).read_text().splitlines() == ["a,b,c", '1,,"[1,2]"']


def test_filings(spark, tmp_path):
    recent = {"form": ["13F-HR", "10-K"], "accessionNumber": ["a1", "a2"], "filingDate": ["2024-02-01"] * 2, "reportDate": ["2023-12-31"] * 2, "primaryDocument": ["d", "e"]}
    (tmp_path / "f.json").write_text(json.dumps({"cik": "1", "filings": {"recent": recent}}))
    assert [r.accession for r in scans.filings(spark, str(tmp_path / "f.json")).collect()] == ["a1"]
    recent["accessionNumber"][0] = ""
    (tmp_path / "g.json").write_text(json.dumps({"cik": "1", "filings": {"recent": recent}}))
    with pytest.raises(Exception, match="without accession number"):
        scans.filings(spark, str(tmp_path / "g.json")).collect()


def test_changes_are_remembered(spark, tmp_path):
    kind = "k string, seq long, fingerprint string"
    for i, rows in enumerate([[("a", 1, "x"), ("a", 2, "x")], [("a", 3, "y"), ("b", 4, "x")]]):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    out = jobs.drain(jobs.changes(stream, ["k"], ["seq"]), "append").orderBy("seq").collect()
    assert [(r.status, r.version) for r in out if r.k == "b"] == [("new", 1)]
    assert sorted(r.version for r in out if r.k == "a")[-1] == 2


def test_source_map_cells_feed_its_rules(spark, tmp_path):
    head = ",".join(scans.MAP_REQUIRED)
    (tmp_path / "m.csv").write_text(f"{head}, override_notes\np1,P,id,https://a.b/c,a.b,annual_report,next_link,5,x,n\n")
    found = sourcemap.entry_findings(sourcemap.entries(scans.source_map(spark, str(tmp_path / "m.csv"))))
    assert sorted(r.code for r in found.collect()) == ["invalid_crawl_constraints", "missing_authority_tier"]
    (tmp_path / "bad.csv").write_text("plan_id,colour\n1,2\n")
    with pytest.raises(ValueError, match="colour.*seed_url"):
        scans.source_map(spark, str(tmp_path / "bad.csv"))


def test_survey_records_and_codebook(spark, tmp_path):
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "a.json").write_text(' [{"ppd_id": 1, "fy": "2020"}, {"ppd_id": null}]')
    (tmp_path / "q" / "b.json").write_text('{"count": 1, "result": [{"ppd_id": 2.5}]}')
    assert sorted((str(r.record.get("ppd_id")), r.record.get("fy")) for r in scans.survey_records(spark, str(tmp_path / "q")).collect()) == [("1", "2020"), ("2.5", None), ("None", None)]
    (tmp_path / "c.json").write_text('{"count": 1}')
    with pytest.raises(Exception, match="without records"):
        scans.survey_records(spark, str(tmp_path / "c.json")).collect()
    (tmp_path / "b.csv").write_text(" VarName ,Label\n fy ,Year\n,x\n")
    book = scans.codebook(spark, str(tmp_path / "b.csv"))
    assert [tuple(r) for r in book.collect()] == [("fy", "Year")]
    mapped = spark.createDataFrame([("fy",), ("aal",)], "name string")
    assert [r.name for r in scans.missing_variables(book, mapped).collect()] == ["aal"]


def test_artifacts_and_tags(spark, tmp_path):
    records = spark.createDataFrame([("m", 1.0, {"run_id": "r", "x": "y"}), ("n", None, None)], "metric string, value double, tags map<string,string>")
    flat = scans.flat_tags(records, ["run_id", "stage"])
    assert sorted(map(tuple, flat.collect())) == [("m", 1.0, "r", None), ("n", None, None, None)]
    for _ in range(2):
        scans.write_artifacts({"telemetry": flat.coalesce(1), "none": flat.where("false")}, str(tmp_path / "out"))
    lines = next((tmp_path / "out" / "telemetry.json").glob("part*")).read_text().splitlines()
    assert [json.loads(x) for x in lines] == [{"metric": "m", "value": 1.0, "run_id": "r", "stage": None}, {"metric": "n", "value": None, "run_id": None, "stage": None}]
    assert spark.read.csv(str(tmp_path / "out" / "telemetry.csv"), header=True).count() == 2


def test_information_table_is_written_as_files_of_bounded_length(spark, monkeypatch):
    one = files.information(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(files, "FILED", 50, raising=False)
    many = files.information(spark, "/root/testdata/sf0.001")
    assert len(many.inputFiles()) == -(-one.count() // 50) > len(one.inputFiles())
    assert sorted(map(str, many.collect())) == sorted(map(str, one.collect()))
