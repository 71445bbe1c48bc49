import pytest
from pyspark.sql import functions as F

from fiduciary.functions import scalars as S
from fiduciary.operators import disclosures, funding, history, holdings, integrity, lineage, metrics, quality, readiness, records, staging, statements, stress
from fiduciary.plans import domain as D
from fiduciary.plans import analysis, filings, registry
from fiduciary.plans import statements as plan_statements


def values(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_funding_trend_orders_by_period_and_keeps_unknown_flows_null(spark):
    rows = spark.createDataFrame([("P", "FY2024", 0.80, 10.0, None, 4.0), ("P", "FY2023", 0.75, None, None, None)], "plan_id string, plan_period string, funded_ratio double, employer_contributions_usd double, employee_contributions_usd double, benefit_payments_usd double")
    out = {r.plan_period: r for r in funding.funding_trend(rows).collect()}
    assert out["FY2023"].funded_ratio_change is None and out["FY2023"].net_external_cash_flow_usd is None
    assert out["FY2024"].funded_ratio_change == 0.05 and out["FY2024"].net_external_cash_flow_usd == 6.0


def test_peer_statistics_leave_the_plan_out(spark):
    rows = spark.createDataFrame([("A", 1.0), ("B", 2.0), ("C", 3.0), ("D", 10.0), ("E", None)], "plan_id string, metric_value double").withColumns({"metric_name": F.lit("m"), "plan_period": F.lit("FY1")})
    out = {r.plan_id: r for r in funding.peer_statistics(rows, ["plan_period"]).collect()}
    assert (out["A"].peer_median, out["B"].peer_median, out["D"].peer_median, out["E"].peer_median) == (3.0, 3.0, 2.0, 2.5)
    assert out["D"].percentile == 100.0 and out["A"].percentile == 0.0 and out["E"].percentile is None and out["E"].n_peers == 4


def test_weights_ignore_what_is_not_disclosed_or_not_finite(spark):
    rows = spark.createDataFrame([("P", "1", "a", "disclosed", 3.0), ("P", "1", "b", "disclosed", 1.0), ("P", "1", "c", "not_disclosed", 9.0), ("P", "1", "d", "disclosed", float("nan"))], "plan_id string, plan_period string, security_id string, disclosure_state string, market_value_usd double")
    weights = holdings.position_weights(rows)
    assert sorted(values(weights, "security_id", "weight")) == [("a", 0.75), ("b", 0.25)]
    assert values(holdings.concentration(weights, 1), "hhi", "top_weight", "n_securities") == [(0.625, 0.75, 2)]


def test_canonical_ids_follow_successors_and_mark_forks(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (5, 6), (6, 7), (6, 8)], "source long, target long")
    out = {r.source: (r.canonical_id, r.status) for r in history.canonical_ids(edges).collect()}
    assert out[1] == (4, "resolved") and out[3] == (4, "resolved") and out[5][1] == out[6][1] == "ambiguous"


def test_canonical_ids_of_long_chains_and_cycles(spark):
    links = [(i, i + 1) for i in range(100)] + [(i, i + 1) for i in range(200, 300)] + [(300, 301), (300, 302)]
    links += [(401, 402), (402, 403), (403, 401), (400, 401), (500, 501), (501, 500), (600, 600)]
    out = {r.source: (r.canonical_id, r.status) for r in history.canonical_ids(spark.createDataFrame(links, "source long, target long")).collect()}
    assert all(out[i] == (100, "resolved") for i in range(100)) and all(out[i] == (None, "ambiguous") for i in range(200, 301))
    assert all(out[i] == (None, "cycle") for i in (400, 401, 402, 403, 500, 501, 600)) and len(out) == 208
    one = spark.createDataFrame([(1, 1)], "source long, target long")
    assert history.canonical_ids(one).first().status == "cycle" and history.canonical_ids(one.limit(0)).count() == 0


def test_scalars(spark):
    row = spark.range(1).select(
        S.first_number(F.lit("in 2024 about 1.234,5 or 7")), S.first_number(F.lit("81,2 %")), S.first_number(F.lit("325.000")), S.report_year(F.lit("Report 2023-24")), S.report_year(F.lit("1999-00")),
        S.period_year(F.lit("FY24")), S.period_digits(F.lit("none")), S.entity_token(F.lit("A.B & Co")), S.normal_url(F.lit("HTTP://Ex.COM/a/#x")), S.redact(F.lit("key sk-abcdefgh12 end")),
    ).first()
    assert tuple(row) == (1234.5, 81.2, 325000.0, 2024, 2000, 2024, -1, "a b co", "http://ex.com/a", "key [REDACTED] end")


def test_scalars_on_abbreviated_scales_and_grouped_years(spark):
    scales = [S.money_scale(F.lit(x)) for x in ("$1bn", "USD 5 billions", "300mm", "250k", "a thousand", "the bank", "cabn")]
    row = spark.range(1).select(S.first_number(F.lit("was 2,024 and 7")), *scales, S.normal_url(F.lit(" HTTP://H/ ")), S.normal_url(F.lit("http://h/a/?q=1")), S.redact(F.lit("ghp_abcdefghijkl API-KEY: abcdefgh1"))).first()
    assert tuple(row) == (7.0, "billion_usd", "billion_usd", "million_usd", "thousand_usd", "thousand_usd", "usd", "usd", "http://h", "http://h/a/?q=1", "[REDACTED] [REDACTED]")


def test_ranks_of_large_groups_over_many_partitions(spark):
    rows = [("a", v % 7 * 1.0) for v in range(500)] + [("a", None)] * 3 + [("b", 2.0)] + [(None, float(v)) for v in range(11)]
    df = spark.createDataFrame(rows, "g string, value double").repartition(5)
    out = {r.g: (r.low, r.high) for r in quality.ranked_values(df, ["g"], "value", {"low": 0.05, "high": 0.95}).collect()}
    for g in ("a", "b", None):
        values = sorted((v for k, v in rows if k == g), key=lambda v: (v is not None, v))
        assert out[g] == tuple(values[round((len(values) - 1) * q)] for q in (0.05, 0.95))


def test_alias_candidates_meet_on_their_rarest_tokens(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    names = [" ".join(words[i : i + n]) + " fund" for i in range(4) for n in range(1, 8)] + ["Capital Patners fund"]
    entities = [(f"e{i}", n) for i, n in enumerate([" ".join(words[:7]), "beta gamma fund", "fund", "Capital Partners Fund", "theta eta zeta epsilon delta gamma fund"])]
    s, e = spark.createDataFrame([(n,) for n in names], "source_name string"), spark.createDataFrame(entities, "stable_id string, alias string")
    want = set()
    for n in names:
        for i, a in entities:
            x, y = set(n.lower().split()), set(a.lower().split())
            if n.lower() == a.lower() or len(x & y) / len(x | y) >= 0.86:
                want.add((n, i))
    got = {(r.source_name, r.stable_id) for r in quality.alias_candidates(s, e).collect()}
    assert got == want and got
    spelt = {(r.source_name, r.stable_id): (r.strategy, r.confidence) for r in quality.alias_candidates(s, e, fuzzy=0.72).collect()}
    assert spelt["Capital Patners fund", "e3"] == ("fuzzy", 0.9524) and want <= spelt.keys()


def test_supersede_closes_only_active_rows(spark):
    facts = spark.createDataFrame([("k", 1, None), ("k", 2, "2001-01-01"), ("x", 3, None)], "key string, v int, superseded_at string").withColumn("superseded_at", F.col("superseded_at").cast("timestamp"))
    out = history.supersede(facts, facts.where("v = 1").withColumn("v", F.lit(9)), ["key"], "2005-01-01")
    assert {r.v: (r.superseded_at and r.superseded_at.year, r.restated) for r in out.collect()} == {1: (2005, False), 2: (2001, False), 3: (None, False), 9: (None, True)}


def test_references_keep_their_digits(spark):
    row = spark.range(1).select(
        S.ordered_refs(F.array(F.lit(" p.10 "), F.lit("t 1"), F.lit(""), F.lit("p.10"))), *[metrics.evidence_ref(F.lit(x)) for x in ("Page 007 : Net  assets", "p.0", "TEXT: ", " Table  A ", None)]
    ).first()
    assert tuple(row) == (["p.10", "t 1"], "p.7#Net assets", "p.0", "text:unknown", "Table A", "")


def test_label_values_keep_their_digits(spark):
    lines = spark.createDataFrame([(1, 1, 0, "Total | 101 | 1,110 | 2024"), (1, 1, 1, "Ratio: 81.0%")], "doc_id long, page int, line_no int, line string")
    assert sorted(values(quality.label_values(lines), "label", "value")) == [("Ratio", "81.0%"), ("Total", "1,110")]


def test_derived_metrics_take_the_last_fact_and_skip_what_is_not_finite(spark):
    facts = spark.createDataFrame(
        [("P", "1", "aal_usd", 10.0, 0.9, "a", [" r "]), ("P", "1", "aal_usd", 20.0, None, "b", ["s"]), ("P", "1", "ava_usd", 15.0, 0.5, "c", None), ("P", "1", "ava_usd", float("inf"), 0.1, "d", []), (" ", "1", "ava_usd", 1.0, 0.1, "e", [])],
        "plan_id string, plan_period string, metric_name string, normalized_value double, confidence double, fact_id string, evidence_refs array<string>",
    )
    flows = spark.createDataFrame([("P", "1", "f", 3.0, 1.0, 0.0, None, None, None)], "plan_id string, plan_period string, cash_flow_id string, " + ", ".join(f"{c} double" for c in metrics.FLOWS) + ", confidence double, evidence_refs array<string>")
    out = {r.metric_name: r for r in metrics.derived_metrics(facts, flows).collect()}
    assert {k: (v.value, v.confidence, v.source_fact_ids) for k, v in out.items()} == {"funded_gap_usd": (5.0, 0.5, ["b", "c"]), "unfunded_ratio": (0.25, 0.5, ["b", "c"])}


def test_best_allocation_equals_a_full_search(spark):
    returns, penalties, low, high = [0.08, 0.05, 0.02], [0.2, 0.1, 0.01], [0, 1, 2], [6, 8, 10]
    rows = spark.createDataFrame([("P", f"b{i}", returns[i], penalties[i], low[i], high[i]) for i in range(3)] + [("Q", "b0", 0.1, 0.0, 0, 10)], "plan_id string, bucket string, expected_return double, risk_penalty double, min_units int, max_units int")
    full = max((sum(x / 10 * r - 0.5 * (x / 10) ** 2 * p for x, r, p in zip(w, returns, penalties)), w) for w in ((a, b, 10 - a - b) for a in range(7) for b in range(1, 9)) if 2 <= w[2] <= 10)
    out = {r.plan_id: r for r in stress.best_allocations(rows, 3, 10, 0.5).collect()}
    assert abs(out["P"].objective - full[0]) < 1e-9 and [round(x * 10) for x in out["P"].weights] == list(full[1])
    assert (out["Q"].objective, out["Q"].weights) == (0.1, [1.0])


def test_unknown_confidence_is_never_sure(spark):
    rows = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (1.7,), (-1.0,), (0.8,)], "c double")
    out = rows.select(S.clamp_confidence(F.col("c")).alias("clamped"), S.routing(F.col("c")).alias("r")).select("clamped", "r.*").collect()
    assert [r.clamped for r in out] == [None, None, None, 1.0, 0.0, 0.8]
    assert [(r.routing_outcome, r.publish_blocked) for r in out[:4]] == [("high_priority_review", True)] * 3 + [("auto_accept", False)]


def test_upsert_skips_conflicts_and_supersedes(spark):
    schema = "fact_id string, value double, source_document_id string, asserted_at string"
    store = spark.createDataFrame([("a@2000:x", 1.0, "d", "2001"), ("b", 1.0, "d", "2001"), ("c", None, "d", "2001")], schema).withColumn("superseded_at", F.lit(None).cast("string"))
    batch = spark.createDataFrame([("a", 2.0, "d", "2002"), ("b", 2.0, "d", "2001"), ("c", None, "d", "2001"), ("n", 1.0, "d", "2001")], schema)
    out = {r.fact_id: r for r in integrity.upsert(store, batch, ["value"]).collect()}
    assert {k: v.decision for k, v in out.items()} == {"a": "supersede", "b": "conflict", "c": "skip", "n": "insert"}
    assert out["a"].stored_id == "a@2000:x" and out["a"].new_id.startswith("a@2002:") and out["a"].closes_at == "2002" and out["n"].new_id == "n"


def test_reachable_ends_on_cycles_and_keeps_the_shortest_way(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4), (7, 8), (8, 7)], "source long, target long")
    got = sorted(values(lineage.reachable(e), "root", "node", "depth"))
    assert got == [(1, 2, 1), (1, 3, 1), (1, 4, 2), (2, 3, 1), (2, 4, 2), (3, 4, 1), (7, 7, 2), (7, 8, 1), (8, 7, 1), (8, 8, 2)]
    assert sorted(values(lineage.terminals(lineage.reachable(e), e), "root", "node")) == [(1, 4), (2, 4), (3, 4)]
    assert lineage.reachable(e.limit(0)).count() == 0


def test_accuracy_of_nothing_is_one(spark):
    none = spark.createDataFrame([], "document_id string, field string, value string")
    assert values(integrity.accuracy(integrity.compared(none, none)), "exact", "field_precision", "document_pass_rate") == [(0, 1.0, 1.0)]


def test_document_types_take_the_first_hint(spark):
    row = spark.range(1).select(*[readiness.document_type(F.lit(t), F.lit(u)) for t, u in (("Consultant annual report", "x"), ("Board meeting", "x"), (None, "http://h/ACFR.pdf"), ("News", "x"))]).first()
    assert tuple(row) == ("annual_report", "board_packet", "annual_report", "other")


def test_flows_say_what_is_missing(spark):
    rows = [("P", "1", "Beginning AUM", 100.0), ("P", "1", "ending_aum", 105.0), ("P", "1", "Benefit  Payments", 5.0), ("P", "1", "Refunds", float("nan")), ("Q", "1", "other", 1.0)]
    labels = spark.createDataFrame([(*r, "million_usd") for r in rows], "plan_id string, plan_period string, label string, value double, unit string")
    out = {r.plan_id: r for r in disclosures.financial_flows(labels).collect()}
    assert (out["P"].net_external_cash_flow_usd, out["P"].consistency_gap_usd, out["P"].net_external_cash_flow_rate_pct, out["P"].warnings) == (-5e6, 1e7, -5.0, "partial_disclosure,consistency_gap")
    assert (out["Q"].net_external_cash_flow_usd, out["Q"].disclosure_level, out["Q"].warnings) == (None, "not_disclosed", "not_disclosed")


def test_cells_and_ids(spark):
    row = spark.range(1).select(
        *[disclosures.cell_number(F.lit(x)) for x in (" 1,234.5 ", "n/a", "inf", ".", None)], disclosures.whole(F.lit("123.0")), disclosures.whole(F.lit("1.5")), disclosures.funded_fraction(F.lit(81.0), F.lit(None), F.lit(None)),
        disclosures.security_id(F.lit(" - "), F.lit(" ab "), F.lit("x")), disclosures.security_id(F.lit(None), F.lit(""), F.lit("Big  Co")),
    ).first()
    assert tuple(row) == (1234.5, None, None, None, None, 123, None, 0.81, "ticker:AB", "name:big co")


def test_figures_stay_in_their_sentence(spark):
    blocks = [
        ("a", "FY1", "text:0", "Funded ratio not disclosed. AAL was $410.5 million. The funding ratio, 2,019 aside, is 78,4 %"), ("a", "FY1", "text:1", "actuarial accrued liability of 3"), ("a", "FY1", "text:2", None),
        ("b", "FY1", "text:0", "Discount rate 7.25 and assumed return 0.07; active participants 12.5"), ("c", "FY1", "text:0", ""),
    ]
    rows = [("a", "FY1", "t:1", " Funding Ratio ", "0.79"), ("a", "FY1", "t:2", "AVA", None), (None, None, "t:1", "AVA", "5"), ("b", "FY1", "t:9", "ADC Rate", "1999 11.5 percent")]
    cols = "plan_id string, plan_period string, ref string, "
    b = spark.createDataFrame(blocks, cols + "text string").withColumn("unit", F.lit("usd"))
    r = spark.createDataFrame(rows, cols + "label string, value string").withColumn("unit", F.lit("thousand_usd"))
    metrics_ = statements.statement_metrics(statements.metric_candidates(b, r))
    out = {(x.plan_id, x.metric_name): (x.as_reported_value, x.normalized_value, x.as_reported_unit, x.evidence_ref, x.ambiguous) for x in metrics_.collect()}
    assert out == {
        ("a", "funded_ratio"): (0.79, 0.79, "ratio", "t:1", True), ("a", "aal_usd"): (3.0, 3.0, "usd", "text:1", True), (None, "ava_usd"): (5.0, 5000.0, "thousand_usd", "t:1", False),
        ("b", "discount_rate"): (7.25, 0.0725, "percent_assumed", "text:0", False), ("b", "participant_count"): (12.5, 12.0, "count", "text:0", False), ("b", "employer_contribution_rate"): (11.5, 0.115, "percent", "t:9", False),
    }
    told = {(x.plan_id, x.code, x.metric_name) for x in statements.metric_diagnostics(b, metrics_).collect()}
    assert ("c", "missing_metric", "ava_usd") in told and ("a", "ambiguous_metric", "aal_usd") in told and ("b", "missing_metric", "discount_rate") not in told
    assert statements.metric_candidates(b.limit(0), r.limit(0)).count() == 0


def test_record_rules(spark):
    row = spark.range(1).select(
        records.allowed_citations(F.array(F.lit(" b "), F.lit("x"), F.lit("b")), F.array(F.lit("a"), F.lit("b"))), records.allowed_citations(F.array(F.lit("x")), F.array(F.lit(" a"), F.lit(""), F.lit("a"))),
        records.safe_ratio(F.lit(1.0), F.lit(0.0)), records.safe_delta(F.lit(float("inf")), F.lit(1.0)), records.amortization_closed(F.lit("Open layered")), records.amortization_closed(F.lit("")), records.failure_category(F.lit("ingestion"), F.lit("403 Forbidden")),
        *records.filing_urls(F.lit("CIK 320"), F.lit("00-1-2"), F.lit(" /t.xml"), "s/", "a/"),
    ).first()
    assert tuple(row) == (["b"], ["a"], None, None, False, None, "robots_restriction", "s/CIK0000000320.json", "a/320/0012/t.xml")
    findings = spark.createDataFrame([(i,) for i in range(5)], "k long")
    assert [(r.k, r.truncated) for r in records.capped(findings, 3, "k").collect()] == [(0, True), (1, True), (2, True)] and not records.capped(findings, 5, "k").first().truncated


def test_alias_scores_compare_equal_names_once(spark):
    names = F.element_at(F.array(*map(F.lit, ("Blue  Ring", "blue-ring co", "hot bolt", "?"))), (F.col("id") % 4 + 1).cast("int"))
    cases = spark.range(30000).select(F.col("id").alias("case_id"), F.lit("s").alias("shelf"), names.alias("alias"))
    entities = spark.range(30000).select(F.col("id").alias("entity_id"), F.lit("s").alias("shelf"), names.alias("candidate"))  # 900 million pairs of rows
    rows = records.alias_scores(cases, entities, by="shelf").groupBy(F.col("case_id") % 4, "decision", "entity_id", "best_score", "second_best_score").count().collect()
    assert sorted(map(tuple, rows)) == [(0, "matched", 29996, 1.0, 1.0, 7500), (1, "matched", 29997, 1.0, 1.0, 7500), (2, "matched", 29998, 1.0, 1.0, 7500), (3, "no_match", None, 0.0, 0.0, 7500)]
    own = spark.createDataFrame([(1, 7, "blue ring"), (1, 7, "blue ring co"), (1, 8, "blue bolt"), (2, 9, "x")], "case_id long, entity_id long, candidate string")
    found = records.alias_scores(spark.createDataFrame([(1, "ring blue"), (2, None), (3, "y")], "case_id long, alias string"), own)
    assert sorted(map(tuple, found.collect())) == [(1, "matched", 7, 0.99, 0.333333), (2, "no_match", None, 0.0, 0.0), (3, "no_match", None, 0.0, 0.0)]


@pytest.mark.parametrize("view", [D.manager_fund_positions, D.security_positions])
def test_positions_are_hashed_not_sorted(spark, view):
    plan = view(spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


@pytest.mark.parametrize("view", [D.manager_fund_positions, D.security_positions, registry.weights])
def test_many_lines_of_holdings_go_to_more_tasks(spark, monkeypatch, view):
    few = view(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(D, "LINES", 300, raising=False)
    many = view(spark, "/root/testdata/sf0.001")
    assert many.rdd.getNumPartitions() > 4 >= few.rdd.getNumPartitions()
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))


def test_weights_of_unknown_plans_stay_and_no_plan_is_sorted(spark):
    rows = spark.createDataFrame([(None, "1", "a", 3.0), (None, "1", "b", 1.0), ("P", None, "a", 2.0), ("P", "1", "a", 5.0)], "plan_id string, plan_period string, security_id string, market_value_usd double").withColumn("disclosure_state", F.lit("disclosed"))
    weights = holdings.position_weights(rows)
    assert "Sort" not in weights._jdf.queryExecution().sparkPlan().toString()
    assert sorted(values(weights, "plan_id", "plan_period", "security_id", "weight"), key=str) == [("P", "1", "a", 1.0), ("P", None, "a", 1.0), (None, "1", "a", 0.75), (None, "1", "b", 0.25)]


def test_lifecycles_of_many_names_go_to_more_tasks(spark, monkeypatch):
    few = registry.QUERIES["w11_lifecycle"](spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(D, "LINES", 300)
    many = registry.QUERIES["w11_lifecycle"](spark, "/root/testdata/sf0.001")
    assert many.rdd.getNumPartitions() > 4
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))


@pytest.mark.parametrize(("lines", "join"), [(100, "SortMergeJoin"), (250, "BroadcastHashJoin")])
def test_many_orders_are_dealt_and_many_customers_not_broadcast(spark, monkeypatch, lines, join):
    few = D.plan_orders(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(D, "LINES", lines)
    many = D.plan_orders(spark, "/root/testdata/sf0.001")
    plan = many._jdf.queryExecution().sparkPlan().toString()
    assert join in [x for line in plan.splitlines() if "c_custkey" in line for x in ("SortMergeJoin", "BroadcastHashJoin") if x in line]
    assert (many.rdd.getNumPartitions() > 4) == (join == "SortMergeJoin")
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))


def test_coverage_of_assets_reads_the_lines_once(spark, monkeypatch):
    calls, lines = [], D.position_lines
    monkeypatch.setattr(D, "position_lines", lambda *a, **k: calls.append(a) or lines(*a, **k))
    assert analysis.asset_coverage(spark, "/root/testdata/sf0.001").count() > 0 and len(calls) == 1


def test_managers_of_many_lines_are_counted_in_more_tasks(spark, monkeypatch):
    few = filings.components(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(D, "LINES", 300)
    many = filings.components(spark, "/root/testdata/sf0.001")
    dealt = lambda df: [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "RepartitionByExpression" in line and "_manager#" in line]
    assert len(dealt(many)) == 1 and not dealt(few)
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))


def test_blank_managers_are_not_counted_and_equal_names_once(spark):
    none = spark.createDataFrame([], "document_id string, metric_family string, ref string")
    relations = spark.createDataFrame([("d", " m ", "f"), ("d", "m", "g"), ("d", "n", None), ("d", " ", "f"), ("d", None, "f"), (None, "x", "f"), ("b", "", "f")], "document_id string, manager_name string, fund_name string").withColumn("ref", F.lit("p.1"))
    documents = spark.createDataFrame([("d",), ("b",), ("empty",)], "document_id string")
    for tasks in (None, 3):
        rows = {(r.document_id, r.component_name): (r.status, r.row_count) for r in staging.component_status(none, relations, none.select("document_id", "ref"), documents, tasks).collect()}
        assert [rows[x, "manager_entity"] for x in ("d", "b", "empty")] == [("present", 2), ("not_disclosed", 0), ("not_disclosed", 0)]
        assert [rows[x, "investment_exposure"][1] for x in ("d", "b", "empty")] == [5, 1, 0] and rows["d", "fund_vehicle_entity"][1] == 2


@pytest.mark.parametrize("query", [lambda s, d: plan_statements.history(s, d), lambda s, d: analysis.fees(s, d), lambda s, d: filings.staged(s, d)], ids=["b6_metric_history", "a21_fee_effectiveness", "e11_staged_facts"])
def test_queries_over_dealt_positions_give_the_same_rows(spark, monkeypatch, query):
    few = query(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(D, "LINES", 300)
    many = query(spark, "/root/testdata/sf0.001")
    dealt = [line for line in many._jdf.queryExecution().optimizedPlan().toString().splitlines() if "RepartitionByExpression" in line and all(c in line for c in ("plan_id#", "plan_period#", "s_name#", "p_brand#"))]
    assert dealt and all(line.endswith(", 20") for line in dealt)  # 6,000 lines
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))
