"""Column expressions for metadata, dates and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def coalesce_blank(a: Column, b: Column) -> Column:
    """``a`` unless it is null or the empty string, else ``b``."""
    return F.coalesce(F.nullif(a, F.lit("")), b)


def to_number(c: Column) -> Column:
    """Text to double; unparseable text and NaN become null."""
    number = F.trim(c).try_cast("double")
    return F.when(~F.isnan(number), number)


# The accepted date spellings, in the order they are tried.
_FULL_YEAR = ("yyyy-M-d", "yyyyMMdd", "d-M-yyyy", "ddMMyyyy", "M-d-yyyy", "MMddyyyy")
_SHORT_YEAR = ("d-M-yy", "ddMMyy", "M-d-yy", "MMddyy")


def parse_date(text: Column) -> Column:
    """Date from text in year-first, day-first or month-first order, tried in turn.

    Two-digit years 00-68 are 20xx, 69-99 are 19xx.
    """
    plain = F.regexp_replace(F.trim(text), "[^0-9]+", "-")
    full = F.coalesce(*[F.try_to_date(plain, f) for f in _FULL_YEAR])
    short = F.coalesce(*[F.try_to_date(plain, f) for f in _SHORT_YEAR])
    century = F.when(F.substring(plain, -2, 2) >= "69", 100).otherwise(0)
    return F.coalesce(full, F.add_months(short, -12 * century))


def infer_year(text: Column) -> Column:
    """Year of a date written in any of the accepted orders; null when blank or unparseable."""
    return F.year(parse_date(text))


def window_bound(date_text: Column, time_text: Column, year: Column | None = None) -> Column:
    """Timestamp of a deployment bound; the time defaults to midnight.

    A month and day alone (``04-15``, ``04/15``) gets ``year`` when one is given;
    other spellings are parsed like :func:`infer_year`.
    """
    day = F.trim(date_text)
    if year is not None:
        short = day.rlike(r"^[0-9]{1,2}[-/][0-9]{1,2}$")
        day = F.when(short, F.concat_ws("-", year.cast("string"), day)).otherwise(day)
    clock = F.split(coalesce_blank(F.trim(time_text), F.lit("00:00:00")), ":")
    hms = [F.coalesce(F.get(clock, i), F.lit("0")).try_cast("int") for i in range(3)]
    valid = hms[0].between(0, 23) & hms[1].between(0, 59) & hms[2].between(0, 59)
    at = parse_date(day).cast("timestamp") + F.make_dt_interval(hours=hms[0], mins=hms[1], secs=hms[2])
    return F.when(valid, at)


def valid_window(seconds: Column | float, interval: Column) -> Column:
    """Odd number of readings that covers ``seconds``, at least 3."""
    if not isinstance(seconds, Column):
        seconds = F.lit(float(seconds))
    k = F.bround(seconds / interval).cast("int")
    return F.greatest(F.when(k % 2 == 0, k + 1).otherwise(k), F.lit(3))


def title_case(c: Column) -> Column:
    return F.initcap(c)


def sentence_case(c: Column) -> Column:
    """Underscores to spaces, first letter upper case, the rest lower case."""
    words = F.lower(F.regexp_replace(c, "_", " "))
    return F.concat(F.upper(F.left(words, F.lit(1))), F.substr(words, F.lit(2)))
