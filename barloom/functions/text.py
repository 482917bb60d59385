"""Text, number and period parsing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names as they appear in English filings.
MONTHS = "January February March April May June July August September October November December"
MONTH_PATTERN = "(?i)(" + "|".join(MONTHS.split()) + r")\s+(\d{1,2}),?\s+(\d{4})"
DAY_FIRST_PATTERN = r"(?i)(\d{1,2})(?:st|nd|rd|th)?\s+(" + "|".join(MONTHS.split()) + r"),?\s+(\d{4})"


def parse_number(cell: Column) -> Column:
    """Finance number: commas and % removed, (x) negative, dashes and blanks NULL."""
    t = F.regexp_replace(F.trim(cell), "[,%]", "")
    negative = t.startswith("(") & t.endswith(")")
    body = F.regexp_replace(t, r"^\(+|\)+$", "")
    number = F.when(~t.isin("", "-", "--"), body.try_cast("double"))
    return F.when(negative, -number).otherwise(number)


def clean_label(label: Column) -> Column:
    """Statement row label: lower case, trailing plus and spacing removed."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(label, r"[+ ]", " "), r"\s+", " ")))


def period_end(label: Column, annual: bool) -> Column:
    """Month end (annual tables) or quarter end of a period label; TTM labels give NULL."""
    t = F.trim(label)
    d = F.coalesce(
        F.try_to_date(t, "yyyy-MM-dd"),
        F.try_to_date(F.concat(F.lit("01 "), t), "dd MMM yyyy"),
        F.try_to_date(F.concat(F.lit("01 "), t), "dd MMMM yyyy"),
    )
    d = F.when(~F.lower(t).startswith("ttm"), d)
    if annual:
        return F.last_day(d)
    return F.last_day(F.add_months(F.trunc(d, "quarter"), 2))


def financial_type(sector: Column) -> Column:
    s = F.upper(F.trim(sector))
    return (
        F.when(s.contains("BANK"), "BANK").when(s.contains("INSURANCE"), "INSURANCE")
        .when(s.contains("FINANCIAL") | s.contains("FINANCE") | s.contains("NBFC"), "NBFC")
        .otherwise("INDUSTRIAL")
    )


def normalize_symbol(symbol: Column, suffix: str = ".NS") -> Column:
    """Upper-case exchange symbol with its suffix; index symbols and suffixed ones stay."""
    s = F.upper(F.trim(symbol))
    return F.when(s.startswith("^") | s.contains("."), s).otherwise(F.concat(s, F.lit(suffix)))


def normalize_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), r"\s+", " "))


def normalize_number_text(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), ",", ""), r"\s+", " ")


def number_variants(value: Column, raw: Column) -> Column:
    """Ways a value may be printed: raw, integer, one and two decimals, percent below 100."""
    short = lambda s: F.regexp_replace(F.regexp_replace(s, "0+$", ""), r"\.$", "")
    whole = F.abs(value - F.round(value)) < 1e-9
    n = F.round(value).cast("bigint").cast("string")
    two = F.format_string("%.2f", value)
    small = F.abs(value) < 100
    return F.array_distinct(F.array_compact(F.array(
        F.lower(F.trim(F.regexp_replace(raw, ",", ""))),
        F.when(whole, n), F.when(whole, F.concat(n, F.lit(".0"))),
        short(two), short(F.format_string("%.1f", value)),
        F.when(small, F.concat(two, F.lit("%"))),
        F.when(small, F.concat(F.format_string("%.0f", value), F.lit("%"))),
    )))


def period_variants(period: Column) -> Column:
    """Date spellings searched in documents."""
    formats = (
        "d MMMM yyyy", "dd MMMM yyyy", "d MMM yyyy", "dd MMM yyyy", "d-MMM-yy", "dd-MMM-yy",
        "d.MM.yyyy", "dd.MM.yyyy", "d/MM/yyyy", "dd/MM/yyyy", "MMMM yyyy", "MMM yyyy",
    )
    return F.array_distinct(F.array(*[F.date_format(period, f) for f in formats]))


def period_in_text(text: Column) -> Column:
    """First period date named in a text, month-first or day-first.

    Only a match is parsed: a date parser fails by exceptions, which cost more than the search.
    """
    def named(pattern: str, order: tuple[int, ...]) -> Column:
        parts = F.concat_ws(" ", *[F.regexp_extract(text, pattern, i) for i in order])
        return F.when(F.regexp_extract(text, pattern, 0) != "", F.try_to_date(parts, "MMMM d yyyy"))

    return F.coalesce(named(MONTH_PATTERN, (1, 2, 3)), named(DAY_FIRST_PATTERN, (2, 1, 3)))


RESULT_PATTERN = r"(?i)(financial results?|quarterly results?|quarter ended|year ended)"


def announcement_score(description: Column, body: Column) -> Column:
    """70 when the headline names financial results, 45 when the text suggests them."""
    text = F.concat_ws(" ", description, body)
    return F.when(F.lower(description).contains("financial result"), 70).when(
        text.rlike(RESULT_PATTERN), 45).otherwise(0)


def is_result_announcement(description: Column, body: Column) -> Column:
    d, b = F.lower(description), F.lower(body)
    follow_up = F.lit(False)
    for term in ("newspaper", "transcript", "analyst", "investor presentation", "clarification"):
        follow_up = follow_up | d.contains(term) | b.contains(term)
    return (
        F.when(follow_up, False)
        .when(d.contains("financial result") | d.contains("outcome of board meeting"), True)
        .when(d.contains("board meeting") & b.contains("result"), False)
        .otherwise(body.rlike(RESULT_PATTERN))
    )


def coalesce_percent(percent: Column, ratio: Column) -> Column:
    """Decimal margin from a percent column where known, else from the ratio."""
    return F.coalesce(percent / 100.0, ratio)


def clamp(value: Column, low: float, high: float) -> Column:
    """Bounded value; NULL stays NULL (least and greatest alone would skip it)."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))
