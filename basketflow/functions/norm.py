"""Normalisation and parsing helpers shared by RAW, MART, features and imports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import java_anchor


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def norm(c: Column | str) -> Column:
    """lower(trim(x)): trims spaces only, lower-cases Unicode text."""
    return F.lower(F.trim(col(c)))


def strip_ws(c: Column | str) -> Column:
    """Strip leading/trailing Unicode whitespace (like Python ``str.strip``),
    unlike ``trim`` which removes spaces only."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def matches(c: Column | str, pattern: str) -> Column:
    """Anchored regex match where ``$`` means end of text (not before a final
    newline, as in Java)."""
    return col(c).rlike(java_anchor(pattern))


def iso_date(c: Column | str) -> Column:
    """Whole ``YYYY-MM-DD`` text → DATE, anything else (``2025``, ``2025-02-30``,
    trailing junk) → NULL."""
    x = col(c)
    return F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}\z"), F.try_to_date(x, "yyyy-MM-dd"))


def iso_ts(c: Column | str) -> Column:
    """ISO-8601 timestamp text with or without zone → TIMESTAMP; blank or
    unparseable → NULL. A text without a whole date is unparseable: Spark
    would read ``12:30`` as today and ``2025`` as its first day."""
    x = col(c)
    return F.when(F.trim(x).rlike(r"^\d{4}-\d{2}-\d{2}(?!\d)"), F.try_to_timestamp(x))


def iso_text(ts: Column | str) -> Column:
    """TIMESTAMP → ``YYYY-MM-DDTHH:MM:SSZ`` (UTC session)."""
    return F.date_format(col(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def ts_text(ts: Column | str) -> Column:
    """TIMESTAMP → ``YYYY-MM-DD HH:MM:SS`` for result tables."""
    return F.date_format(col(ts), "yyyy-MM-dd HH:mm:ss")


def int_flag(cond: Column) -> Column:
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def nonblank(c: Column | str) -> Column:
    x = col(c)
    return x.isNotNull() & (x != "")


def zpad(x: Column | str, width: int) -> Column:
    """Integer → text zero-padded to ``width`` (like ``%0<width>d``), never
    truncated: ``lpad`` alone cuts longer text, and ``format_string`` runs
    Java's formatter per row (several times slower)."""
    v = col(x).cast("long")
    s = F.abs(v).cast("string")
    digits = F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, "0"))
    neg = F.concat(F.lit("-"), F.when(F.length(s) >= width - 1, s).otherwise(F.lpad(s, width - 1, "0")))
    return F.when(v < 0, neg).otherwise(digits)


def key_id(prefix: str, x: Column | str, width: int) -> Column:
    """``prefix`` + zero-padded integer, e.g. ``key_id('ord-', k, 6)``."""
    return F.concat(F.lit(prefix), zpad(x, width))
