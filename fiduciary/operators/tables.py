"""Rows of tables in the lines of documents: columns, "label: value", and prose that reads like a metric."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a label has to mention; words of running text; how columns part and what a figure looks like.
HINTS = [
    "funded ratio", "funding ratio", "aal", "actuarial accrued liability", "ava", "actuarial value of assets", "discount rate", "assumed return", "employer contribution rate", "adc rate",
    "employee contribution rate", "participant count", "active participants",
]
VERBS = [" was ", " were ", " is ", " are ", " remained "]
MOST_WORDS = 16
COLUMNS = r"\s{2,}|\|"
FIGURE = r"[-+]?\$?\d[\d,]*(?:\.\d+)?%?"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def mentions(label: Column) -> Column:
    low = F.lower(label)
    out = F.lit(False)
    for hint in HINTS:
        out = out | F.contains(low, F.lit(hint))
    return out


def metric_prose(line: Column) -> Column:
    """Label and first figure behind it of a short line that isn't running text: the longest hint that has a figure behind it."""
    low = F.lower(line)
    running = F.lit(False)
    for verb in VERBS:
        running = running | F.contains(low, F.lit(verb))
    found = []
    for hint in sorted(HINTS, key=len, reverse=True):
        at = F.locate(hint, low)
        tail = F.substring(line, at + len(hint), F.length(line))
        value = F.regexp_extract(tail, FIGURE, 0)
        near = F.substring(tail, F.regexp_instr(tail, F.lit(FIGURE)), F.length(value) + 4)
        shown = F.when(F.contains(near, F.lit("%")) & ~F.endswith(value, F.lit("%")), F.concat(value, F.lit("%"))).otherwise(value)
        found.append(F.when((at > 0) & (value != ""), F.struct(F.substring(line, at, F.lit(len(hint))).alias("label"), shown.alias("value"))))
    words = F.size(F.filter(F.split(line, r"\s+"), lambda x: x != ""))
    return F.when(~running & (words <= MOST_WORDS), F.coalesce(*found))


def table_rows(lines: DataFrame) -> DataFrame:
    """Label, value and periods of the lines (doc_id, page, line_no, line) that have them, with the place they come from.

    Lines part at bars, tabs and runs of two spaces. If the first column is a
    metric's label, the value is the last column that is no bare year: the
    latest period's. Year columns make the row a complex one, with the values
    that stand as far behind each year as there are years. Else the text behind
    a colon counts if what is before it is a label, and of lines without colon
    the figure behind a metric's name.
    """
    columns = F.filter(F.transform(F.split("line", COLUMNS), trimmed), lambda x: x != "")
    rows = lines.withColumn("_c", columns)
    rest = F.slice("_c", F.lit(2), F.greatest(F.size("_c") - 1, F.lit(0)))
    is_year = lambda x: x.rlike(r"^\d{4}$")
    years, values = F.filter(rest, is_year), F.filter(rest, lambda x: ~is_year(x))
    left = F.regexp_extract("line", r"^([^:]*):", 1)
    right = F.regexp_extract("line", r"^[^:]*:([\s\S]*)$", 1)
    in_columns = (F.size("_c") >= 2) & mentions(F.get("_c", F.lit(0)))
    pair = lambda label, value: F.struct(label.alias("label"), value.alias("value"))
    picked = F.when(in_columns, pair(F.get("_c", F.lit(0)), F.coalesce(F.try_element_at(values, F.lit(-1)), F.lit(""))))
    picked = picked.when(F.contains("line", F.lit(":")), F.when(mentions(left), pair(trimmed(left), trimmed(right)))).otherwise(metric_prose(F.col("line")))
    out = rows.withColumns({"_y": years, "_p": picked}).where("_p.label <> '' AND _p.value <> ''")
    periods = F.filter(F.transform("_y", lambda y, i: F.struct(y.alias("year"), F.get("_c", i + 1 + F.size("_y")).alias("value"))), lambda x: x["value"].isNotNull())
    return out.select("doc_id", "page", "line_no", "_p.label", "_p.value", F.concat(F.lit("p."), F.col("page").cast("string"), F.lit("#table")).alias("evidence_ref"), (F.size("_y") > 0).alias("complex_table"), periods.alias("periods"))
