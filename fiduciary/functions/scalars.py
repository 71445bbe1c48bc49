"""Column functions that the operators share. All are native Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """The value, or null if it is null, NaN or infinite."""
    return F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), c)


def clamp_confidence(c: Column) -> Column:
    """Between 0 and 1, round 6; null where the value is null or not finite (greatest and least skip nulls)."""
    known = finite(c.cast("double"))
    return F.when(known.isNotNull(), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), known)), 6))


def entity_token(c: Column) -> Column:
    """Lower case, anything but a-z and 0-9 as one space; null is empty."""
    return F.coalesce(F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")), F.lit(""))


def ordered_refs(refs: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(refs, lambda x: F.trim(x)), lambda x: x != ""))


def period_digits(c: Column) -> Column:
    """All digits of a period label as one number, -1 without any."""
    return F.coalesce(F.regexp_replace(c, "[^0-9]", "").try_cast("bigint"), F.lit(-1).cast("bigint"))


def period_year(c: Column) -> Column:
    """A calendar year, else a fiscal year (two digits count from 2000), else the first number; null sorts last."""
    c = F.upper(F.trim(c))
    fiscal = F.regexp_extract(c, r"\bFY\s*([0-9]{1,4})\b", 1)
    fiscal_year = F.when(F.length(fiscal) == 2, fiscal.try_cast("int") + 2000).otherwise(fiscal.try_cast("int"))
    return F.coalesce(F.regexp_extract(c, r"((?:19|20)\d{2})", 1).try_cast("int"), fiscal_year, F.regexp_extract(c, r"(\d+)", 1).try_cast("int"))


def report_year(c: Column) -> Column:
    """The latest year in a text; ranges such as 2023-24 count with their end, rolling over a century."""
    years = F.transform(F.regexp_extract_all(c, F.lit(r"((?:19|20)\d{2})"), 1), lambda x: x.cast("int"))
    spans = F.regexp_extract_all(c, F.lit(r"((?:19|20)\d{2}\s*[-/]\s*(?:19|20)?\d{2})"), 1)

    def end(span: Column) -> Column:
        start, last = F.substring(span, 1, 4).cast("int"), F.regexp_extract(span, r"[-/]\s*(\d+)$", 1)
        short = F.floor(start / 100).cast("int") * 100 + last.cast("int")
        return F.when(F.length(last) == 4, last.cast("int")).when(short < start, short + 100).otherwise(short)

    return F.array_max(F.concat(years, F.transform(spans, end)))


# Units of money and names of asset classes.
UNITS = {"usd": 1.0, "thousand_usd": 1e3, "million_usd": 1e6, "billion_usd": 1e9}
ASSET_CLASSES = {
    "public equity": "public_equity",
    "public equities": "public_equity",
    "equities": "public_equity",
    "fixed income": "fixed_income",
    "bonds": "fixed_income",
    "private equity": "private_equity",
    "real assets": "real_assets",
    "real estate": "real_assets",
    "cash": "cash",
}


def lookup(c: Column, values: dict) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), c)


def money_to_usd(amount: Column, unit: Column) -> Column:
    return F.round(amount * lookup(unit, UNITS), 6)


def flow_sign(amount: Column, direction: Column) -> Column:
    return F.when(direction == "inflow", F.abs(amount)).when(direction == "outflow", -F.abs(amount)).otherwise(amount)


def rate_to_ratio(c: Column) -> Column:
    """Rates above 1 are percents; those below -1 stay as they are."""
    return F.round(F.when(c > 1, c / 100).otherwise(c), 9)


def asset_class(label: Column) -> Column:
    clean = F.trim(F.regexp_replace(F.lower(label), r"\s+", " "))
    return F.coalesce(lookup(clean, ASSET_CLASSES), F.replace(clean, F.lit(" "), F.lit("_")))


def number_of(token: Column) -> Column:
    """A number token as double; the last of dot and comma is the decimal separator, single groups by their length."""
    body = F.regexp_replace(token, r"^[+-]+", "")
    dot, comma = F.instr(body, ".") > 0, F.instr(body, ",") > 0
    last_dot, last_comma = F.length(body) - F.instr(F.reverse(body), "."), F.length(body) - F.instr(F.reverse(body), ",")
    no_comma, no_dot = F.replace(body, F.lit(","), F.lit("")), F.replace(body, F.lit("."), F.lit(""))
    clean = (
        F.when(dot & comma, F.when(last_dot > last_comma, no_comma).otherwise(F.replace(no_dot, F.lit(","), F.lit("."))))
        .when(comma, F.when(body.rlike(r"^[^,]*,\d{1,2}$"), F.replace(body, F.lit(","), F.lit("."))).otherwise(no_comma))
        .when(dot, F.when(body.rlike(r"\..*\.|^[^.]*\.000$"), no_dot).otherwise(body))
        .otherwise(body)
    )
    return F.when(F.startswith(token, F.lit("-")), -clean.try_cast("double")).otherwise(clean.try_cast("double"))


def first_number(text: Column) -> Column:
    """The first number of a text that doesn't look like a year."""
    tokens = F.regexp_extract_all(text, F.lit(r"[-+]?\d[\d,.]*\d|[-+]?\d"), 0)
    return F.get(F.filter(F.transform(F.filter(tokens, lambda t: ~F.regexp_replace(t, "[.,]", "").rlike(r"^(19|20)\d{2}$")), number_of), lambda v: v.isNotNull()), F.lit(0))


def money_scale(text: Column, fallback: str = "usd") -> Column:
    low = F.lower(text)
    return F.when(low.rlike(r"billion|(?<![a-z])bn\b"), "billion_usd").when(low.rlike(r"million|(?<![a-z])mm\b"), "million_usd").when(low.rlike(r"thousand|(?<![a-z])k\b"), "thousand_usd").otherwise(fallback)


def first_sentence(text: Column) -> Column:
    return F.regexp_extract(text, r"(?s)^(.*?)(?:[.;!?](?:\s|$)|$)", 1)


def stable_id(prefix: str, *parts: Column) -> Column:
    """Prefix and 20 hexadecimal digits of the parts as JSON strings joined by bars (ASCII parts)."""
    text = [F.coalesce(F.concat(F.lit('"'), F.replace(p.cast("string"), F.lit('"'), F.lit('\\"')), F.lit('"')), F.lit("null")) for p in parts]
    return F.concat(F.lit(f"{prefix}:"), F.substring(F.sha2(F.concat_ws("|", *text), 256), 1, 20))


def normal_url(url: Column) -> Column:
    """Without white space around it, scheme and host in lower case, no fragment, no slash at the very end."""
    url = F.regexp_replace(url, r"^\s+|\s+$", "")
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(url, r"(?s)#.*$", ""), r"^[A-Za-z][\w+.-]*://[^/?]*", ""), r"/$", "")
    return F.concat(F.lower(F.regexp_extract(url, r"^([A-Za-z][\w+.-]*://[^/?#]*)", 1)), rest)


# What counts as a secret in free text.
SECRETS = (r"sk-[A-Za-z0-9_-]{8,}", r"ghp_[A-Za-z0-9]{12,}", r"(?i)api[_-]?key\s*[:=]\s*[A-Za-z0-9._-]{8,}")


def redact(text: Column) -> Column:
    for pattern in SECRETS:
        text = F.regexp_replace(text, pattern, "[REDACTED]")
    return text


def routing(confidence: Column) -> Column:
    """Where an extracted row goes: struct of outcome, priority and publish_blocked."""
    c = clamp_confidence(confidence)
    return F.struct(
        F.coalesce(c, F.lit(0.0)).alias("confidence"),
        F.when(c >= 0.9, "auto_accept").when(c >= 0.75, "publish_with_warning").otherwise("high_priority_review").alias("routing_outcome"),
        F.when(c >= 0.9, "none").when(c >= 0.75, "medium").otherwise("high").alias("review_priority"),
        c.isNull().alias("publish_blocked"),
    )


def quartile(percentile: Column) -> Column:
    return F.when(percentile <= 25, 1).when(percentile <= 50, 2).when(percentile <= 75, 3).when(percentile.isNotNull(), 4)
