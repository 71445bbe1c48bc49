import json

import pytest
from pyspark.sql import functions as F

from fiduciary.operators import disclosures, readiness, tables
from fiduciary.sources import publishing


def line_rows(spark, *lines):
    df = spark.createDataFrame([("d", 3, i, x) for i, x in enumerate(lines)], "doc_id string, page int, line_no int, line string")
    return {r.line_no: (r.label, r.value, r.complex_table, [tuple(p) for p in r.periods]) for r in tables.table_rows(df).collect()}


def test_rows_of_tables(spark):
    found = line_rows(
        spark, "Funded ratio | 2022 | 2023 | 70% | 72%", "Discount rate   7.0%\t\t6.75%", "Discount rate\t7.0%", "AAL: $1,200 (est.)", "Remarks: 5", "Employer contribution rate 12.5 % of pay", "The funded ratio was 80%", "Cash | 1 | 2",
        "Actuarial value of assets  2022  2023", "adc rate 5 and employer contribution rate 9", "ava " + "word " * 16 + "5", "participant count none", "Funded ratio of members: none", "", None, "Note: funded ratio 5%", "Assumed return | 2023 | 7% |", "AVA|  |",
    )
    assert found == {
        0: ("Funded ratio", "72%", True, [("2022", "70%"), ("2023", "72%")]), 1: ("Discount rate", "6.75%", False, []), 2: ("Discount rate", "7.0%", False, []), 3: ("AAL", "$1,200 (est.)", False, []), 5: ("Employer contribution rate", "12.5%", False, []),
        9: ("employer contribution rate", "9", False, []), 12: ("Funded ratio of members", "none", False, []), 16: ("Assumed return", "7%", True, [("2023", "7%")]),
    }


def test_report_coverage(spark):
    record = "plan_id string, plan_period string, cohort string, official_resolution_state string, source_authority_tier string, source_url string, seq long"
    records = spark.createDataFrame([("p", "FY2020", "late", "not_found", "official", "u1", 2), ("p", "FY2020", "first", "available_non_official_only", "private", "u2", 1), ("p", "no year", "none", "available_official", "official", "u3", 0)], record)
    documents = spark.createDataFrame([("p", "Annual report 2019-20", "x", "official"), ("p", "ACFR 2021", "a", "private"), ("p", "ACFR", "b/2021", "official"), ("q", "Holdings 2018", "y", "official"), ("q", "Annual Report", "no-year", "official"), ("q", None, None, None)], "plan_id string, title string, source_url string, source_authority_tier string")
    types = spark.createDataFrame([("P", "state")], "plan_id string, system_type string")
    rows = {(r.plan_id, r.plan_year): (r.cohort, r.system_type, r.official_resolution_state, r.annual_report_source_url, r.manager_disclosure_available) for r in readiness.report_coverage(records, documents, types).collect()}
    assert len(rows) == 10 and {y for _, y in rows} == set(range(2017, 2022))
    assert rows["p", 2020] == ("first", "state", "available_non_official_only", "u2", False) and rows["p", 2021] == ("first", "state", "available_official", "b/2021", False)
    assert rows["p", 2019] == ("first", "state", "not_found", "not_found", False) and rows["q", 2018] == ("unknown", "unknown", "not_found", "not_found", True)
    assert readiness.report_coverage(records.limit(0), documents.limit(0), types).isEmpty()
    undated = readiness.report_coverage(records.limit(0), documents.where("title = 'Annual Report'"), types)
    assert sorted(r.plan_year for r in undated.collect()) == [2021, 2022, 2023, 2024, 2025]


def test_publication_sets(spark, tmp_path):
    kinds = "plan_id string, plan_period string, cohort string, system_type string, official_resolution_state string, source_authority_tier string, mismatch_reason string"
    records = spark.createDataFrame([("p", "FY2020", "c", "s", "available_official", "official", None), ("q", "FY2020", "c", "s", "not_found", "private", None), ("r", "FY2020", "c", "s", "available_official", "official", "stale_period")], kinds)
    anomalies = spark.createDataFrame([("p", "FY2020", "m", "critical", "high")], "plan_id string, period string, metric string, severity string, priority string")
    assert [(r.status, r.error) for r in publishing.publish(str(tmp_path / "a"), records, lambda: anomalies).collect()] == [("ok", "")]
    read = lambda name: [json.loads(x) for f in sorted((tmp_path / name).glob("part*")) for x in f.read_text().splitlines()]
    assert sorted((r["plan_id"], r["readiness_state"], r["extraction_blocker_reason"], r["is_extraction_ready"]) for r in read("a/readiness_rows.json")) == [("p", "ready", "", True), ("q", "blocked_source", "official_source_unresolved", False), ("r", "blocked_quality", "stale_period", False)]
    assert [r["reason"] for r in read("a/review_queue_rows.json")] == ["critical shift in m"]
    broken = anomalies.withColumn("severity", F.raise_error(F.lit("no points")).cast("string"))
    state = publishing.publish(str(tmp_path / "b"), records, lambda: broken).first()
    assert state.status == "degraded" and state.error and len(read("b/readiness_rows.json")) == 3 and read("b/anomaly_rows.json") == []


@pytest.mark.parametrize("total, waited, expected", [(4, 2.0, 0.5), (0, 2.0, 0.0), (4, float("inf"), 0.0), (4, None, 0.0)])
def test_rates_of_runs(spark, total, waited, expected):
    names = sorted({c for a, b, _ in disclosures.RATES.values() for c in (a, b)} - {"review_queue_wait_hours_sum", "review_queue_items"})
    run = spark.createDataFrame([("r", total, waited)], "run_id string, review_queue_items int, review_queue_wait_hours_sum double").withColumns({c: F.lit(10 if c.endswith("total") or c == "total_pages" else 4) for c in names})
    run = run.withColumns({"run_started_at": F.lit("2024-01-02 00:00:00").cast("timestamp"), "source_published_at": F.lit("2024-01-01 12:00:00").cast("timestamp")})
    r = disclosures.run_rates(run).first()
    assert (r.review_queue_latency_hours, r.freshness_lag_hours, r.citation_density_per_10_pages, r.source_mismatch_rate, r.manager_disclosure_coverage_rate) == (expected, 12.0, 4.0, 0.4, 0.4)
