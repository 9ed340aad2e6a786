"""Parsing and scalar column functions.

All functions take and return ``Column``; none call Python per row.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "col_of", "to_int", "parse_locale_number", "parse_percent", "parse_duration",
    "strip", "blank_to_null", "split_tags", "section_of", "date_parts", "days_since",
    "text_length", "clean_content",
]


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_int(c) -> Column:
    """R ``as.integer`` — truncate toward zero, NULL on junk text."""
    d = col_of(c).cast("string").try_cast("double")
    return F.when(F.isnan(d), F.lit(None)).otherwise(d).try_cast("int")


def parse_locale_number(c, thousands: str = ".", decimal: str = ",") -> Column:
    """``"1.234"`` → 1234, ``"1,23"`` → 1.23; blank or junk → NULL.

    Thousands separators are removed literally (not as a regex), the decimal
    mark becomes a point.
    """
    s = F.trim(col_of(c).cast("string"))
    s = F.replace(s, F.lit(thousands), F.lit(""))
    s = F.replace(s, F.lit(decimal), F.lit("."))
    return F.when(s == "", F.lit(None)).otherwise(s).try_cast("double")


def parse_percent(c, decimal: str = ",", thousands: str = ".") -> Column:
    """``"45,67%"`` → 45.67 (percent points, not a fraction)."""
    s = F.regexp_replace(F.trim(col_of(c).cast("string")), "%$", "")
    s = F.replace(s, F.lit(thousands), F.lit(""))
    s = F.replace(s, F.lit(decimal), F.lit("."))
    return F.when(s == "", F.lit(None)).otherwise(s).try_cast("double")


def parse_duration(c) -> Column:
    """``hh:mm:ss`` → seconds (double); any value containing ``<`` counts as 0."""
    s = F.trim(col_of(c).cast("string"))
    s = F.when(s.contains("<"), F.lit("00:00:00")).otherwise(s)
    parts = F.split(s, ":")
    ok = s.rlike(r"^-?\d+:\d{1,2}:\d{1,2}(\.\d+)?$")
    h = F.get(parts, 0).try_cast("double")
    m = F.get(parts, 1).try_cast("double")
    sec = F.get(parts, 2).try_cast("double")
    return F.when(ok, h * 3600 + m * 60 + sec)


def strip(c) -> Column:
    """Strip all leading/trailing whitespace (``trim`` only strips spaces)."""
    return F.regexp_replace(col_of(c), r"^\s+|\s+$", "")


def blank_to_null(c) -> Column:
    c = col_of(c)
    return F.when(F.length(strip(c)) == 0, F.lit(None)).otherwise(c)


def split_tags(c, sep: str = ",") -> Column:
    """Split on the literal ``sep`` without trimming. As in R only one
    trailing empty piece is dropped: ``a,,b,`` → a, "", b; ``""`` → nothing."""
    parts = F.split(col_of(c), r"\Q" + sep.replace(r"\E", r"\E\\E\Q") + r"\E")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def section_of(url) -> Column:
    """First non-empty path segment of a URL, NULL if none or unparsable."""
    path = F.try_parse_url(col_of(url), F.lit("PATH"))
    segs = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.get(segs, 0)


def date_parts(c) -> dict[str, Column]:
    """Zero-padded text parts ``Year``, ``Month``, ``Day`` of a date."""
    d = F.to_date(col_of(c))
    return {"Year": F.date_format(d, "yyyy"), "Month": F.date_format(d, "MM"),
            "Day": F.date_format(d, "dd")}


def days_since(c, ref: str = "2024-02-29") -> Column:
    """Whole days from the date to a fixed reference date."""
    return F.datediff(F.lit(ref).cast("date"), F.to_date(col_of(c)))


def clean_content(c) -> Column:
    """X2 pre-step: ``\\n\\n`` then ``\\n`` → one space each."""
    return F.replace(F.replace(col_of(c), F.lit("\n\n"), F.lit(" ")), F.lit("\n"), F.lit(" "))


def text_length(c, clean: bool = False) -> Column:
    """Length in characters (code points); NULL text counts 0."""
    c = col_of(c)
    if clean:
        c = clean_content(c)
    return F.coalesce(F.char_length(c), F.lit(0))
