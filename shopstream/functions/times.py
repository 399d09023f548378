"""Time helpers on strings (D-*). Unparseable times count as missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import Named, col

SECONDS, DAY, DAY_KEY, MINUTE_KEY = "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyyMMdd", "yyyyMMddHHmm"


def parse_time(c: Named) -> Column:
    return F.try_to_timestamp(col(c), F.lit(SECONDS))


def format_time(c: Named) -> Column:
    return F.date_format(col(c), SECONDS)


def time_before(a: Named, b: Named) -> Column:
    return F.coalesce(parse_time(a) < parse_time(b), F.lit(False))


def time_after(a: Named, b: Named) -> Column:
    return F.coalesce(parse_time(a) > parse_time(b), F.lit(False))


def seconds_between(a: Named, b: Named) -> Column:
    """a - b in seconds; 0 if either is missing."""
    return F.coalesce(F.unix_timestamp(parse_time(a)) - F.unix_timestamp(parse_time(b)), F.lit(0)).cast("long")


def date_hour(c: Named) -> Column:
    """``yyyy-MM-dd_HH``, cut from the text."""
    parts = F.split(col(c), " ")
    return F.concat(parts[0], F.lit("_"), F.split(F.get(parts, F.lit(1)), ":")[0])


def today() -> Column:
    return F.date_format(F.current_date(), DAY)


def yesterday() -> Column:
    return F.date_format(F.date_sub(F.current_date(), 1), DAY)


def format_date(c: Named) -> Column:
    return F.date_format(col(c), DAY)


def date_key(c: Named) -> Column:
    return F.date_format(col(c), DAY_KEY)


def parse_date_key(c: Named) -> Column:
    return F.to_date(F.try_to_timestamp(col(c), F.lit(DAY_KEY)))


def minute_key(c: Named) -> Column:
    return F.date_format(col(c), MINUTE_KEY)


def epoch_day(c: Named) -> Column:
    """Epoch seconds as ``yyyyMMdd``."""
    return F.from_unixtime(col(c), DAY_KEY)


def day_of(c: Named) -> Column:
    return F.to_date(col(c))
