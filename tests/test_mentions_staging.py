from pyspark.sql import functions as F

from fiduciary.operators import mentions, sourcemap, staging


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_fees_take_labels_apart_and_mark_spellings(spark):
    labels = spark.createDataFrame(
        [("p", "y", "FEE: Alpha : Management Fee: rate_pct", "1.5%", "usd", "a"), ("p", "y", "fee:alpha:custody:amount", "$2 million", "usd", "b"), ("p", "y", "fee", "5", "usd", "c"),
         ("p", "y", "fee:::rate", None, "usd", "d"), ("p", "z", "fee:alpha:x:rate", "Not  Disclosed", "usd", "e"), ("p", "z", None, "1", "usd", "f")],
        "plan_id string, plan_period string, label string, value string, unit string, ref string")
    out = mentions.fees(mentions.fee_lines(labels))
    assert rows(out, "evidence_ref", "manager_name", "fee_type", "normalized_rate", "amount_usd", "completeness", "warnings") == [
        ("a", "Alpha", "management_fee", 0.015, None, "partial", "ambiguous_manager_name,partial_fee_disclosure"), ("b", "alpha", "other_fee", None, 2e6, "partial", "ambiguous_manager_name,partial_fee_disclosure"),
        ("d", None, "other_fee", None, None, "not_disclosed", "non_disclosure"), ("e", "alpha", "other_fee", None, None, "not_disclosed", "non_disclosure")]


def test_last_row_of_a_risk_counts_and_silence_is_told(spark):
    labels = spark.createDataFrame(
        [("p", "y", "risk:derivatives:FX!:policy_limit", "$3 million", "usd", "1"), ("p", "y", "risk:derivatives:FX!:policy_limit", "none", "usd", "2"), ("p", "y", "risk:derivatives:FX!:collateral", "7", "usd", "3")],
        "plan_id string, plan_period string, label string, value string, unit string, ref string")
    docs = labels.select("plan_id", "plan_period").union(spark.createDataFrame([("q", "y")], "plan_id string, plan_period string"))
    topics = mentions.risk_topics(labels)
    assert rows(mentions.risk_observations(docs, topics), "plan_id", "metric_name", "observation_kind") == [("p", "securities_lending:not_disclosed", "not_disclosed"), ("q", "derivatives:not_disclosed", "not_disclosed"), ("q", "securities_lending:not_disclosed", "not_disclosed")]
    assert ("p", "derivatives:fx", "not_disclosed") in rows(mentions.risk_diagnostics(docs, topics), "plan_id", "metric_name", "code")


def test_names_that_stand_for_nobody_are_scoped_by_plan(spark):
    names = spark.createDataFrame([("P 1", "FY1", n) for n in ("N/A", " Not_Disclosed ", None, "", "Firm A")], "plan_id string, plan_period string, name string")
    ids = [r[0] for r in names.select(mentions.consultant_id(F.col("name"))).collect()]
    assert ids == ["consultant:not_disclosed:p 1:fy1"] * 4 + ["consultant:firm a"]
    both = names.select(mentions.board_decision(F.lit(" Partially  Approved ")), mentions.attribution_strength(F.lit(None).cast("string"))).first()
    assert tuple(both) == ("partially_adopted", "speculative")


def test_chains_of_any_length_end_and_cycles_have_no_root(spark):
    links = [(i, i - 1) for i in range(1, 70)] + [(0, None), (100, 101), (101, 100), (102, 100), (200, 999)]
    out = {r[0]: (r[1], r[2]) for r in staging.artifact_chains(spark.createDataFrame(links, "artifact_id long, supersedes long")).collect()}
    assert out[69] == (0, 69) and out[0] == (0, 0) and out[200] == (200, 0)
    assert {out[i] for i in (100, 101, 102)} == {(None, None)}
    assert staging.artifact_chains(spark.createDataFrame([], "artifact_id long, supersedes long")).count() == 0


def test_only_merges_that_leave_no_doubt_are_made(spark):
    entities = spark.createDataFrame([("a", "m", None), ("b", "m", None), ("c", "f", None), ("d", "m", "a"), ("e", "m", None), ("g", "m", None)], "stable_id string, entity_type string, merged_into string")
    wishes = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "b"), ("c", "a"), ("d", "b"), ("e", "a"), ("e", "b"), ("g", "a"), ("x", "b")], "source string, target string")
    valid = staging.valid_merges(entities, wishes)
    assert rows(valid, "source", "target") == []  # b is a source of itself: nothing may go there
    valid = staging.valid_merges(entities, wishes.where("source <> target"))
    assert rows(valid, "source", "target") == [("a", "b")]  # g would go to a, which goes to b
    assert rows(staging.active_entities(staging.merge_entities(entities, valid)), "stable_id") == [("b",), ("c",), ("e",), ("g",)]
    links = spark.createDataFrame([("a", "t", "1", "y"), ("b", " t ", "1", "x"), ("b", "t", "1", " "), ("b", " ", "1", "z"), ("b", "t", None, "z")], "stable_id string, source_table string, source_record_id string, ref string")
    assert [(r.stable_id, r.source_table, r.refs) for r in staging.entity_links(links, valid).collect()] == [("b", "t", ["x", "y"])]


def test_staged_ids_are_stable_and_bad_numbers_go(spark):
    facts = spark.createDataFrame([("p", "y", "m", float("nan"), 0.5, [" b", "a", "b"])], "plan_id string, plan_period string, metric_name string, value double, confidence double, evidence_refs array<string>")
    again = facts.withColumn("evidence_refs", F.array(F.lit("a"), F.lit("b ")))
    one, two = (staging.staged_facts({"funded": f}, "d", "v").first() for f in (facts, again))
    assert one.fact_id == two.fact_id and one.value is None and one.evidence_refs == ["a", "b"]


def test_map_entries_from_cells(spark):
    cells = spark.createDataFrame([("p", " http://x ", "a.b; ;c.d", "annual_report", None, "ten", "1", " ", None, " yes ", "")],
        "plan_id string, seed_url string, allowed_domains string, doc_type_hints string, pagination_hints string, max_pages string, max_depth string, source_authority_tier string, mismatch_reason string, override_requires_js string, override_notes string")
    entry = sourcemap.entries(cells)
    r = entry.first()
    assert (r.seed_url, r.allowed_domains, r.pagination_hints, r.max_pages, r.overrides) == ("http://x", ["a.b", "c.d"], [], -1, {"requires_js": "yes"})
    assert rows(sourcemap.entry_findings(entry), "code") == [("invalid_crawl_constraints",), ("invalid_override_value",), ("missing_authority_tier",)]


def test_rates_below_minus_one_are_no_percents(spark):
    from fiduciary.functions.scalars import rate_to_ratio

    found = spark.createDataFrame([(-5.0,), (-0.5,), (1.0,), (1.5,), (None,)], "r double").select(rate_to_ratio(F.col("r")).alias("x")).collect()
    assert [r.x for r in found] == [-5.0, -0.5, 1.0, 0.015, None]


def test_the_last_of_equal_findings_stays(spark):
    kinds = "code string, plan_id string, plan_period string, metric_name string, message string, evidence_refs string, severity string, seq long"
    found = spark.createDataFrame([("c", "p", "t", None, "m", "r", "error", 1), ("c", "p", "t", "", "m", "r", "warning", 2), ("c", "p", "t", "x", "m", "r", "error", 3)], kinds)
    assert sorted((r.metric_name, r.severity) for r in staging.distinct_findings(found).collect()) == [("", "warning"), ("x", "error")]


def test_every_wrong_override_is_a_finding(spark):
    cells = spark.createDataFrame([("p", "http://x.y", "a.b", "other", "", "1", "1", "scroll", "maybe", "-1")], "plan_id string, seed_url string, allowed_domains string, doc_type_hints string, pagination_hints string, max_pages string, max_depth string, override_pagination_mode string, override_requires_js string, override_force_render_wait_ms string")
    cells = cells.withColumns({c: F.lit(None).cast("string") for c in ("source_authority_tier", "mismatch_reason")})
    found = [r.code for r in sourcemap.entry_findings(sourcemap.entries(cells)).collect()]
    assert found.count("invalid_override_value") == 3


def test_merges_that_break_a_rule_come_back(spark):
    entities = spark.createDataFrame([("a", "m", None), ("b", "m", None), ("c", "f", None), ("d", "m", "a"), ("e", "m", None), ("g", "m", None)], "stable_id string, entity_type string, merged_into string")
    wishes = [("a", "a"), ("x", "a"), ("a", "y"), ("b", "c"), ("d", "b"), ("b", "d"), ("e", "a"), ("e", "b"), ("g", "e"), (None, None)]
    merges = spark.createDataFrame(wishes, "source string, target string")
    found = {(r.source, r.target): r.reason for r in staging.merge_rejects(entities, merges).collect()}
    assert found == {("a", "a"): "same_id", ("x", "a"): "unknown_source", ("a", "y"): "unknown_target", ("b", "c"): "entity_type", ("d", "b"): "source_merged", ("b", "d"): "target_merged", ("e", "a"): "several_targets", ("e", "b"): "several_targets", ("g", "e"): "target_in_batch", (None, None): "same_id"}


def test_funded_ratios_of_peer_records(spark):
    rows = [(1, 2020, 1, 85.0, None, 50.0, 100.0, 0.5), (2, 2020, 2, 2.5, 120.0, 1.0, 1.0, -1.0), (3, 2020, 3, None, None, 5.0, 0.0, 60.0)]
    found = {r.ppd_id: r for r in staging.peer_universe(spark.createDataFrame(rows, "ppd_id int, fy int, seq int, funded_ratio_ava double, funded_ratio_mva double, mkt_assets double, act_liabilities double, w double"), {"equity": "w"}).collect()}
    assert [(found[i].funded_ratio_ava, found[i].funded_ratio_mva, found[i].allocations) for i in (1, 2, 3)] == [(0.85, 0.5, {"equity": 50.0}), (2.5, 1.2, {}), (None, None, {"equity": 60.0})]
