"""Cell parsing, dates, buckets, verdict words and naming — native expressions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydromelt import config as C

DECIMAL = "decimal(18,6)"
_DIGITS = r"\d+(?:_\d+)*"
_FLOAT_TEXT = (rf"(?iU)^\s*[+-]?(?:nan|inf|infinity|(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})"
               rf"(?:e[+-]?{_DIGITS})?)\s*$")


# Every character Python and Unicode count as a blank.
_BLANKS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200b)))
           + "\u2028\u2029\u202f\u205f\u3000")


def strip(text: Column) -> Column:
    """Trim every Unicode blank, not only the ASCII space."""
    return F.btrim(text, F.lit(_BLANKS))


def _visible(text: Column) -> Column:
    """Whether a text begins with a visible ASCII character: two comparisons of bytes."""
    return (text >= F.lit("!")) & (text < F.lit("\x7f"))


def is_filled(text: Column) -> Column:
    """Whether a text has more than blanks; only odd ones are trimmed to see."""
    return _visible(text) | (strip(text) != "")


def blank_to_null(text: Column) -> Column:
    """A trimmed text, or null if nothing is left. Most texts have no blank at their ends, and trimming is dear."""
    plain = _visible(text) & _visible(F.right(text, F.lit(1)))
    return F.when(plain, text).otherwise(F.nullif(strip(text), F.lit("")))


def is_number_like(text: Column) -> Column:
    return F.regexp_replace(text, ",", "").rlike(_FLOAT_TEXT)


def number_text(text: Column) -> Column:
    """The numeric part of a trimmed cell, or null when the cell is no number."""
    wide = F.octet_length(text) > F.char_length(text)
    ascii_digits = F.when(wide, F.translate(text, "０１２３４５６７８９", "0123456789")).otherwise(text)
    return F.nullif(F.regexp_extract(F.replace(ascii_digits, F.lit(","), F.lit("")), C.NUMERIC_CELL, 1), F.lit(""))


def parse_number(text: Column) -> Column:
    """Value of a trimmed cell; markers and other texts give null.

    No marker matches the numeric pattern, so the pattern alone decides.
    """
    return number_text(text).try_cast(DECIMAL)


def parse_reason(text: Column) -> Column:
    return F.when(text.isNull(), "empty").when(number_text(text).isNull(), "non_numeric").otherwise("ok")


def is_censored(text: Column, number: Column) -> Column:
    """True for detection-limit notations such as ``<0.001``."""
    return F.coalesce(F.left(text, F.lit(1)).isin("<", ">", "≤", "≥") & number.isNotNull(), F.lit(False))


# One pass turns a date cell into y-m-d, or into a text no cast accepts.
_DATE_CELL = (r"(?s)^(?:(\d{4})([-/.])(\d{1,2})\2(\d{1,2})|(\d{4})(\d{2})(\d{2}))(?: .*)?$|^.*$")
_YEAR_CELL = r"^[<>≤≥]?\s*0*([1-9]\d{0,3})(?:\.\d+)?\s*$"
_MONTH_CELL = r"(?s)^[<>≤≥]?\s*0*(?:(1[01]|[1-9])(?:\.\d+)?|(12)(?:\.0+)?)\s*$|^.*$"


def parse_date(text: Column) -> Column:
    """Date before the first blank, as y-m-d, y/m/d, y.m.d or eight digits."""
    return F.regexp_replace(text, _DATE_CELL, "$1$5-$3$6-$4$7").try_cast("date")


def first_of_month(year_text: Column, month_text: Column) -> Column:
    """First day from separate year and month cells; an unusable month counts as January."""
    year = F.lpad(F.regexp_extract(F.replace(year_text, F.lit(","), F.lit("")), _YEAR_CELL, 1), 4, "0")
    month = F.coalesce(F.regexp_replace(month_text, _MONTH_CELL, "$1$2"), F.lit(""))
    return F.when(year != "0000", F.concat_ws(
        "-", year, F.when(month == "", "1").otherwise(month), F.lit("1"))).try_cast("date")


def resolve_dates(df: DataFrame, date_text: str, datetime_text: str, year_text: str, month_text: str,
                  label: str) -> DataFrame:
    """Adds ``measured_on`` and ``period_label`` from the date cells of a row.

    A full date wins over year and month; the label survives only without one.
    """
    full = F.coalesce(parse_date(F.col(date_text)), parse_date(F.col(datetime_text)))
    first = first_of_month(F.col(year_text), F.col(month_text))
    gone = (date_text, datetime_text, year_text, month_text)
    part = df.withColumn("_full", full).withColumn("_first", first).drop(*gone)
    return part.withColumns({
        "measured_on": F.coalesce("_full", "_first"),
        "period_label": F.when(F.col("_full").isNull(), F.col(label))}).drop("_full", "_first", label)


def quality_flag(value: Column, reason: Column, measured_on: Column, as_of: Column) -> Column:
    return (F.when(reason == "non_numeric", "non_numeric")
            .when(reason == "out_of_range", "out_of_range")
            .when(measured_on > as_of, "future_date")
            .when(value < 0, "negative"))


# Period buckets: what rows are grouped by, and how a group is spelled. Rows are
# grouped by a date, so only groups, not rows, are turned into text.
BUCKETS = {
    "month": (lambda d: F.trunc(d, "month"), lambda g: F.date_format(g, "yyyy-MM")),
    "quarter": (lambda d: F.trunc(d, "quarter"),
                lambda g: F.concat(F.year(g).cast("string"), F.lit("-Q"), F.quarter(g).cast("string"))),
    "year": (lambda d: F.trunc(d, "year"), lambda g: F.year(g).cast("string")),
    "none": (lambda d: d, lambda g: g.cast("string")),
}

METRICS = {"avg": F.avg, "max": F.max, "min": F.min, "count": F.count}


def rate(part: Column, whole: Column) -> Column:
    """Share in percent, one decimal, half up; 0.0 for an empty whole."""
    share = F.lit(100).cast("decimal(3,0)") * part.cast("decimal(18,0)") / F.nullif(
        whole.cast("decimal(18,0)"), F.lit(0).cast("decimal(18,0)"))
    return F.coalesce(F.round(share, 1), F.lit(0)).cast("decimal(5,1)")


def output_column(status: Column, code: Column, site: Column, raw: Column) -> Column:
    """Name a mapped column carries in the wide output."""
    named = F.when(F.coalesce(site, F.lit("")) != "",
                   F.concat(code, F.lit(C.SITE_SEPARATOR), site)).otherwise(code)
    return (F.when(status.isin(*C.AUTO_STATUSES), named)
            .when(status == "unmapped", F.concat(F.lit(C.UNMAPPED_PREFIX), raw))
            .otherwise(raw))


def known_status(status: Column) -> Column:
    """Anything outside the closed list counts as unmapped, never as automatic."""
    return F.when(status.isin(*C.STATUSES), status).otherwise("unmapped")


def dict_type_of(code: Column) -> Column:
    return F.when(code.startswith(C.MEASUREMENT_PREFIX), C.DICT_MEASUREMENT).otherwise(C.DICT_METADATA)


def term_kind_of(code: Column) -> Column:
    return F.when(code.startswith(C.MEASUREMENT_PREFIX), "measurement").otherwise("metadata")


def canonical_verdict(verdict: Column, candidate: Column) -> Column:
    """Accept words become the candidate code, reject words ``no_match``; codes stay."""
    word = strip(verdict)
    return (F.when(F.lower(word).isin(*C.DECISION_ACCEPT_WORDS), candidate)
            .when(F.lower(word).isin(*C.DECISION_REJECT_WORDS), C.VERDICT_NO_MATCH)
            .when(word != "", word))


def adopted_code(verdict: Column, candidate: Column) -> Column:
    """The code a stored verdict stands for; null for none."""
    refused = verdict.isin(C.VERDICT_NO_MATCH, C.VERDICT_REJECT) | (F.lower(verdict) == "rejected")
    accepted = (verdict == C.VERDICT_ACCEPT) | (F.lower(verdict) == "approved")
    return F.when(refused, F.lit(None)).when(accepted, candidate).otherwise(verdict)


def queue_code(verdict: Column, candidate: Column) -> Column:
    """The code a filled review-queue line asks for; null when it asks for none."""
    word = F.lower(strip(verdict))
    return (F.when((word == "") | word.isin(*C.QUEUE_REJECT_WORDS), F.lit(None))
            .when(word.isin(*C.QUEUE_ACCEPT_WORDS), blank_to_null(candidate))
            .otherwise(strip(verdict)))


def limit_verdict(value: Column, low: Column, high: Column) -> Column:
    return F.when(value > high, C.OVER_LIMIT).when(value < low, C.UNDER_LIMIT)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def contains_word(word: str, *texts: Column) -> Column:
    """Case-insensitive search of a keyword in any text; an empty keyword matches all."""
    needle = word.strip().lower()
    return F.lit(True) if not needle else any_of([F.lower(t).contains(needle) for t in texts])


def json_or(text: Column, schema: str, fallback: Column) -> Column:
    """Parse a JSON column; null or unreadable text gives the fallback."""
    return F.when(F.try_parse_json(text).isNotNull(), F.from_json(text, schema)).otherwise(fallback)
