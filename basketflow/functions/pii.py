"""PII normalisation and salted hashing as column expressions (no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C
from .norm import col, strip_ws


def check_salt(salt: str | None) -> str:
    """Salt is stripped and must hold at least 16 characters."""
    s = (salt or "").strip()
    if len(s) < C.PII_MIN_SALT_LENGTH:
        raise ValueError(f"PII hash salt must be at least {C.PII_MIN_SALT_LENGTH} characters long")
    return s


def normalize_email(c: Column | str) -> Column:
    return F.lower(strip_ws(col(c)))


def normalize_phone(c: Column | str) -> Column:
    """struct(value, ok): spaces, brackets and dashes removed; ``+…`` kept;
    ``8``/``7`` followed by 10 digits becomes ``+7…``; anything else keeps the
    original text with ``ok = false``."""
    x = col(c)
    cleaned = F.regexp_replace(strip_ws(x), r"(?U)[\s()\-]", "")
    plus7 = F.concat(F.lit("+7"), F.substring(cleaned, 2, 1 << 30))
    value = (
        F.when(cleaned.startswith("+"), cleaned)
        .when(cleaned.rlike(r"^[78][0-9]{10}\z"), plus7)
        .otherwise(x)
    )
    ok = cleaned.startswith("+") | cleaned.rlike(r"^[78][0-9]{10}\z")
    return F.struct(value.alias("value"), ok.alias("ok"))


def normalize_phone_digits(c: Column | str) -> Column:
    """Digits only; 10 digits get a leading 7; 11 digits starting with 8 get 7
    instead; a leading ``+`` is added; empty stays empty."""
    digits = F.regexp_replace(col(c), r"(?U)\D", "")
    d10 = F.when(F.length(digits) == 10, F.concat(F.lit("7"), digits)).otherwise(digits)
    d11 = F.when(
        (F.length(d10) == 11) & d10.startswith("8"), F.concat(F.lit("7"), F.substring(d10, 2, 1 << 30))
    ).otherwise(d10)
    return F.when(F.length(d11) > 0, F.concat(F.lit("+"), d11)).otherwise(d11)


def hash_value(c: Column | str, salt: str) -> Column:
    """sha256(salt + ':' + strip(value)) in lower hex; NULL or blank → ''."""
    s = check_salt(salt)
    v = strip_ws(col(c))
    return F.when(v.isNull() | (v == ""), F.lit("")).otherwise(F.sha2(F.concat(F.lit(s + ":"), v), 256))
