"""Queries of what documents and source maps say: rows of tables and coverage by annual reports, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import readiness, tables
from . import domain as D
from .oracle import sql

Query = Callable[[SparkSession, str], DataFrame]


def lines(s: SparkSession, d: str) -> DataFrame:
    """Lines of every kind about a plan's funding in a year."""
    f = D.plan_funding(s, d)
    year = F.substring("plan_period", 3, 4)
    pct, aal = F.round(100 * F.col("funded_ratio"), 1).cast("string"), F.floor("total_usd").cast("string")
    before = (year.cast("int") - 1).cast("string")
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    kinds = F.array(
        text("Funded Ratio | ", before, " | ", year, " | 70.1% | ", pct, "%"), text("Discount  rate\t\t7.0%   6.", F.substring(year, 4, 1), "%  "), text("Discount rate\t\t7.0%   6.", F.substring(year, 4, 1), "%  "), text("Our AAL: $", aal, " (est.)"), text("Remarks: $", aal),
        text("the ADC rate rose to ", pct, " % in ", year), text("The funded ratio was ", pct, "%"), text("Members | 10 | ", pct), text("Participant count ", F.col("n_orders").cast("string"), ", employee contribution rate -", pct), text("Actuarial value of assets  ", before, "  ", year),
        text("AVA ", aal, " one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"),
    )
    return f.select(F.concat_ws("/", "plan_id", "plan_period").alias("doc_id"), F.lit(2).alias("page"), F.posexplode(kinds).alias("line_no", "line"))


def table_rows(s: SparkSession, d: str) -> DataFrame:
    shown = F.array_join(F.transform("periods", lambda x: F.concat(x["year"], F.lit("="), x["value"])), ";")
    return tables.table_rows(lines(s, d)).withColumn("periods", shown)


def report_coverage(s: SparkSession, d: str) -> DataFrame:
    rows = D.table(s, d, "orders").join(D.table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(D.plan_dim(s, d), F.col("c_nationkey") == F.col("n_nationkey"))
    plan, price, year, key = F.concat(F.lit("PS-"), F.col("o_custkey").cast("string")).alias("plan_id"), F.col("o_totalprice"), F.year("o_orderdate"), F.col("o_orderkey").cast("string")
    records = rows.where("o_orderstatus = 'F'").select(
        plan, F.concat(F.lit("FY"), year.cast("string"), F.when(price < 50000, F.concat(F.lit(" of "), (year - 1).cast("string"))).otherwise("")).alias("plan_period"), F.col("peer_group").alias("cohort"), readiness.resolution(price > 300000, price > 100000).alias("official_resolution_state"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "official").otherwise("high-confidence-third-party").alias("source_authority_tier"), F.concat(F.lit("http://x/"), key).alias("source_url"), F.col("o_orderkey").alias("seq"))
    name = {"1-URGENT": F.concat(F.lit("Annual Report "), year.cast("string"), F.lit("-"), F.substring((year + 1).cast("string"), 3, 2)), "2-HIGH": F.lit("ACFR"), "3-MEDIUM": F.lit("Board packet"), "4-NOT SPECIFIED": F.lit("Holdings by investment consultant")}
    title = F.coalesce(*[F.when(F.col("o_orderpriority") == p, t) for p, t in name.items()], F.lit("Notice"))
    documents = rows.where("o_orderstatus <> 'F'").select(plan, title.alias("title"), F.concat(F.lit("http://y/"), key, F.lit("/"), year.cast("string")).alias("source_url"), F.when(price > 150000, "official-mirror").otherwise("private").alias("source_authority_tier"))
    types = D.table(s, d, "customer").where("c_nationkey < 9").select(F.concat(F.lit("ps-"), F.col("c_custkey").cast("string")).alias("plan_id"), F.col("c_mktsegment").alias("system_type"))
    return readiness.report_coverage(records, documents, types)


QUERIES: dict[str, Query] = {"e2_table_rows": table_rows, "a16_report_coverage": report_coverage}

HINTS = ", ".join(f"'{h}'" for h in tables.HINTS)
ANY = f"len(list_filter([{HINTS}], lambda h: contains(lower({{0}}), h))) > 0"
FIGURE = r"[-+]?\$?\d[\d,]*(?:\.\d+)?%?"

ORACLES: dict[str, str] = {
    "e2_table_rows": sql(rf"""SELECT * FROM (WITH f AS (SELECT plan_id || '/' || plan_period AS doc_id, substr(plan_period, 3, 4) AS y, CAST(CAST(substr(plan_period, 3, 4) AS INTEGER) - 1 AS VARCHAR) AS b, CAST(round(100 * funded_ratio, 1) AS VARCHAR) AS pct, CAST(CAST(floor(total_usd) AS BIGINT) AS VARCHAR) AS aal, n_orders FROM plan_funding),
      k AS (SELECT doc_id, ['Funded Ratio | ' || b || ' | ' || y || ' | 70.1% | ' || pct || '%', 'Discount  rate' || chr(9) || chr(9) || '7.0%   6.' || substr(y, 4, 1) || '%  ', 'Discount rate' || chr(9) || chr(9) || '7.0%   6.' || substr(y, 4, 1) || '%  ', 'Our AAL: $' || aal || ' (est.)', 'Remarks: $' || aal,
        'the ADC rate rose to ' || pct || ' % in ' || y, 'The funded ratio was ' || pct || '%', 'Members | 10 | ' || pct, 'Participant count ' || n_orders || ', employee contribution rate -' || pct, 'Actuarial value of assets  ' || b || '  ' || y,
        'AVA ' || aal || ' one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen'] AS ls FROM f),
      l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_no FROM k),
      c AS (SELECT *, list_filter(list_transform(string_split_regex(line, '\s{{2,}}|\|'), lambda x: trim(x)), lambda x: x <> '') AS cols FROM l),
      p AS (SELECT *, list_filter(cols[2:], lambda x: regexp_full_match(x, '\d{{4}}')) AS years, list_filter(cols[2:], lambda x: NOT regexp_full_match(x, '\d{{4}}')) AS vals FROM c),
      h AS (SELECT doc_id, line_no, line, h, substr(line, strpos(lower(line), h) + length(h)) AS tail FROM (SELECT doc_id, line_no, line, unnest([{HINTS}]) AS h FROM l) WHERE contains(lower(line), h)),
      m AS (SELECT doc_id, line_no, arg_max({{'label': substr(line, strpos(lower(line), h), length(h)), 'value': v || CASE WHEN contains(substr(tail, strpos(tail, v), length(v) + 4), '%') AND NOT ends_with(v, '%') THEN '%' ELSE '' END}}, length(h)) AS best
        FROM (SELECT *, regexp_extract(tail, '{FIGURE}') AS v FROM h) WHERE v <> '' AND len(list_filter([' was ', ' were ', ' is ', ' are ', ' remained '], lambda x: contains(lower(line), x))) = 0 AND len(list_filter(string_split_regex(line, '\s+'), lambda x: x <> '')) <= 16 GROUP BY doc_id, line_no),
      r AS (SELECT p.*, CASE WHEN len(cols) >= 2 AND {ANY.format('cols[1]')} THEN {{'label': cols[1], 'value': coalesce(vals[-1], '')}}
        WHEN contains(line, ':') THEN CASE WHEN {ANY.format("split_part(line, ':', 1)")} THEN {{'label': trim(split_part(line, ':', 1)), 'value': trim(substr(line, strpos(line, ':') + 1))}} END ELSE best END AS got FROM p LEFT JOIN m ON m.doc_id = p.doc_id AND m.line_no = p.line_no)
      SELECT doc_id, 2 AS page, CAST(line_no AS INTEGER) AS line_no, got['label'] AS label, got['value'] AS value, 'p.2#table' AS evidence_ref, len(years) > 0 AS complex_table,
        coalesce(array_to_string(list_transform(list_filter(range(1, len(years) + 1), lambda i: cols[i + 1 + len(years)] IS NOT NULL), lambda i: years[i] || '=' || cols[i + 1 + len(years)]), ';'), '') AS periods FROM r WHERE got['label'] <> '' AND got['value'] <> '')"""),
    "a16_report_coverage": sql(r"""SELECT * FROM (WITH o AS (SELECT *, CAST(year(o_orderdate) AS INTEGER) AS y FROM orders JOIN customer ON o_custkey = c_custkey JOIN plan_dim ON c_nationkey = n_nationkey),
      rec AS (SELECT 'PS-' || o_custkey AS plan_id, list_max(list_transform(regexp_extract_all('FY' || y || CASE WHEN o_totalprice < 50000 THEN ' of ' || (y - 1) ELSE '' END, '(?:19|20)\d{2}'), lambda x: CAST(x AS INTEGER))) AS year, peer_group AS cohort, CASE WHEN o_totalprice > 300000 THEN 2 WHEN o_totalprice > 100000 THEN 1 ELSE 0 END AS s,
        CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS tier, 'http://x/' || o_orderkey AS url, o_orderkey FROM o WHERE o_orderstatus = 'F'),
      doc AS (SELECT 'PS-' || o_custkey AS plan_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'Annual Report ' || y || '-' || substr(CAST(y + 1 AS VARCHAR), 3, 2) WHEN '2-HIGH' THEN 'ACFR' WHEN '3-MEDIUM' THEN 'Board packet' WHEN '4-NOT SPECIFIED' THEN 'Holdings by investment consultant' ELSE 'Notice' END AS title,
        'http://y/' || o_orderkey || '/' || y AS url, CASE WHEN o_totalprice > 150000 THEN 1 ELSE 0 END AS official FROM o WHERE o_orderstatus <> 'F'),
      told AS (SELECT *, lower(title || ' ' || url) AS t, list_max(list_concat(list_transform(regexp_extract_all(title || ' ' || url, '(?:19|20)\d{2}'), lambda x: CAST(x AS INTEGER)), list_transform(regexp_extract_all(title || ' ' || url, '(?:19|20)\d{2}\s*[-/]\s*(?:19|20)?\d{2}'),
        lambda x: CASE WHEN length(regexp_extract(x, '\d+$')) = 4 THEN CAST(right(x, 4) AS INTEGER) ELSE CAST(substr(x, 1, 4) AS INTEGER) // 100 * 100 + CAST(right(x, 2) AS INTEGER) + CASE WHEN CAST(right(x, 2) AS INTEGER) < CAST(substr(x, 3, 2) AS INTEGER) THEN 100 ELSE 0 END END))) AS year FROM doc),
      last AS (SELECT max(year) AS l FROM (SELECT year FROM rec UNION ALL SELECT year FROM told)),
      plans AS (SELECT plan_id, coalesce(arg_min(cohort, o_orderkey) FILTER (WHERE cohort IS NOT NULL), 'unknown') AS cohort FROM (SELECT plan_id, cohort, o_orderkey FROM rec UNION ALL SELECT plan_id, NULL, NULL FROM told) GROUP BY plan_id),
      flags AS (SELECT plan_id, bool_or(contains(t, 'manager') OR contains(t, 'holding')) AS m, bool_or(contains(t, 'consultant report') OR contains(t, 'investment consultant')) AS c FROM told GROUP BY plan_id),
      best AS (SELECT * FROM rec QUALIFY row_number() OVER (PARTITION BY plan_id, year ORDER BY s DESC, tier DESC, url DESC) = 1),
      rep AS (SELECT * FROM told WHERE contains(t, 'annual report') OR contains(t, 'acfr') QUALIFY row_number() OVER (PARTITION BY plan_id, year ORDER BY official DESC, url DESC) = 1)
      SELECT p.plan_id, CAST(l - i AS INTEGER) AS plan_year, p.cohort, coalesce(ct.c_mktsegment, p.cohort) AS system_type, ['not_found', 'available_non_official_only', 'available_official'][coalesce(b.s, r.official + 1, 0) + 1] AS official_resolution_state, coalesce(b.url, r.url, 'not_found') AS annual_report_source_url,
        coalesce(m, FALSE) AS manager_disclosure_available, coalesce(f.c, FALSE) AS consultant_disclosure_available
      FROM plans p CROSS JOIN last CROSS JOIN range(0, 5) g(i) LEFT JOIN flags f ON f.plan_id = p.plan_id LEFT JOIN best b ON b.plan_id = p.plan_id AND b.year = l - i LEFT JOIN rep r ON r.plan_id = p.plan_id AND r.year = l - i LEFT JOIN customer ct ON 'PS-' || ct.c_custkey = p.plan_id AND ct.c_nationkey < 9)"""),
}
