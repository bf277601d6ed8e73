"""Times in the formats that people and systems write, as Column expressions.

Accepted, with blanks around: a date alone, or a date and a time, then perhaps a zone.

* dates: year first (``2024-3-9``, ``2024/03/09``, ``2024.03.09``), day first (``9.3.2024``, ``09/03/24``,
  ``9-3-2024``), named months (``9 Mar 2024``, ``March 9, 2024``, ``Sat, 09 Mar 2024``); years of two digits are
  1970 to 2069
* times: ``14:05``, ``14:05:09``, ``14:05:09.25``, ``2:05 PM``
* zones: ``Z``, ``UTC``, ``GMT``, ``+03:00``, ``-0330``, ``+03``; without one the time is UTC
* digits alone: seconds since 1970 (9 or 10 digits), milliseconds (13), ``yyyyMMdd`` (8), ``yyyyMMddHHmm`` (12),
  ``yyyyMMddHHmmss`` (14)

All else is null: texts without a whole date (nothing is filled in from a clock), days and hours that do not
exist, unknown names, and anything behind the time.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .norm import col, iso_ts

MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def _names(words: tuple[str, ...]) -> str:
    return "|".join(f"{w[:3]}(?:{w[3:]})?" if len(w) > 3 else w for w in words)


_MONTH = f"(?:{_names(MONTHS)})"
#: groups: 1 year, 3 month, 4 day | 5 day, 7 month, 8 year | 9 day, 10 month, 11 year | 12 month, 13 day, 14 year,
#: then 15 hour, 16 minute, 17 second, 18 fraction, 19 half of the day, 20 zone
TIME = (
    rf"(?i)\A\s*(?:(?:{_names(DAYS)}),?\s+)?"
    r"(?:(\d{4})([-/.])(\d{1,2})\2(\d{1,2})|(\d{1,2})([-/.])(\d{1,2})\6(\d{4}|\d{2})"
    rf"|(\d{{1,2}})[ -]({_MONTH})\.?[ ,-]+(\d{{4}})|({_MONTH})\.?\s+(\d{{1,2}}),?\s+(\d{{4}}))"
    r"(?:(?:T|,?\s+)(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?(?:\s*([ap]m))?)?"
    r"\s*(z|utc|gmt|[+-]\d{2}:?\d{2}|[+-]\d{2})?\s*\z"
)
PARTS = "$1$8$11$14|$3$7$10$12|$4$5$9$13|$15|$16|$17|$18|$19|$20"


def _int(x: Column) -> Column:
    return F.when(x != "", x).try_cast("int")


def _offset_seconds(zone: Column) -> Column:
    """Of ``+hh:mm``, ``+hhmm`` or ``+hh``; 0 for names of UTC; null beyond 18 hours or 59 minutes."""
    digits = F.regexp_replace(zone, "[^0-9]", "")
    hours, minutes = _int(F.substring(digits, 1, 2)), F.coalesce(_int(F.substring(digits, 3, 2)), F.lit(0))
    seconds = F.when((hours <= 18) & (minutes < 60), (hours * 3600 + minutes * 60) * F.when(zone.startswith("-"), -1).otherwise(1))
    return F.when(zone.rlike("^[+-]"), seconds).otherwise(F.lit(0))


def _digits(x: Column) -> Column:
    at = lambda i, n: _int(F.substring(x, i, n))
    whole = lambda h, m, s: F.try_make_timestamp(at(1, 4), at(5, 2), at(7, 2), h, m, s.cast("decimal(16,6)"))
    zero, n = F.lit(0), F.length(x)
    return (F.when(n.isin(9, 10), F.timestamp_seconds(x.try_cast("long")))
            .when(n == 13, F.timestamp_millis(x.try_cast("long")))
            .when(n == 8, whole(zero, zero, zero))
            .when(n == 12, whole(at(9, 2), at(11, 2), zero))
            .when(n == 14, whole(at(9, 2), at(11, 2), at(13, 2))))


def _written(x: Column) -> Column:
    parts = F.split(F.regexp_replace(x, TIME, PARTS), r"\|")
    part = lambda i: F.get(parts, F.lit(i))
    year = _int(part(0))
    year = F.when(F.length(part(0)) == 2, year + F.when(year < 70, 2000).otherwise(1900)).otherwise(year)
    names = F.array(*[F.lit(m[:3]) for m in MONTHS])
    month = F.coalesce(_int(part(1)), F.array_position(names, F.lower(F.substring(part(1), 1, 3))).cast("int"))
    hour, half = F.coalesce(_int(part(3)), F.lit(0)), F.lower(part(7))
    # 12 AM is midnight, 12 PM is noon, 13 PM does not exist
    hour = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "pm", 12).otherwise(0))
    second = F.concat(F.when(part(5) == "", "0").otherwise(part(5)), F.lit("."), F.substring(part(6), 1, 6), F.lit("0")).try_cast("decimal(16,6)")
    at = F.try_make_timestamp(year, month, _int(part(2)), hour, F.coalesce(_int(part(4)), F.lit(0)), F.when(second < 60, second))
    return F.timestamp_micros(F.unix_micros(at) - _offset_seconds(part(8)).cast("long") * 1_000_000)


def best_effort_ts(c: Column | str) -> Column:
    """Text → TIMESTAMP by the grammar above, ISO-8601 first; null for anything else.

    The text is bound once, as the element of a one-element array: the grammar names it many times, and spelled out
    each time it makes generated methods that are too long for the JVM to compile."""
    return F.get(F.transform(F.array(col(c)), _best_effort), F.lit(0))


def _best_effort(x: Column) -> Column:
    digits = F.regexp_extract(x, r"\A\s*(\d+)\s*\z", 1)
    other = F.when(digits != "", _digits(digits)).when(x.rlike(TIME), _written(x))
    return F.coalesce(iso_ts(x), other)
