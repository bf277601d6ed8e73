"""Contract checks as data jobs: one-row-per-check assertion tables
(check, expected, actual, ok) computed over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import pii as X


def _row(df: DataFrame, check: str, expected: str, actual, ok) -> DataFrame:
    return df.agg(actual.alias("actual")).select(
        F.lit(check).alias("check"), F.lit(expected).alias("expected"), F.col("actual").cast("long").alias("actual"),
        ok(F.col("actual")).alias("ok"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def raw_counts(raw: dict[str, tuple[DataFrame, str]], expected: dict[str, tuple[str, int]]) -> DataFrame:
    """Distinct ids per RAW table against expectations ``('=', n)`` or ``('>=', n)``."""
    parts = []
    for name, (df, key) in raw.items():
        op, n = expected[name]
        parts.append(_row(df, f"raw_{name}_uniq", f"{op} {n}", F.count_distinct(key),
                          (lambda a, n=n: a == n) if op == "=" else (lambda a, n=n: a >= n)))
    return _union(parts)


def compare(pairs: dict[str, tuple[DataFrame, object, DataFrame, object]], op: str = "=") -> DataFrame:
    """Checks whose expectation is itself computed: for each check name,
    (expected_df, expected_agg, actual_df, actual_agg).  All aggregates are
    global (one row each) and are combined by a union and one small grouping,
    never by a join."""
    parts = []
    for name, (edf, eagg, adf, aagg) in pairs.items():
        parts.append(edf.agg(eagg.cast("long").alias("v")).select(F.lit(name).alias("check"), F.lit("e").alias("k"), "v"))
        parts.append(adf.agg(aagg.cast("long").alias("v")).select(F.lit(name).alias("check"), F.lit("a").alias("k"), "v"))
    u = _union(parts)
    g = u.groupBy("check").agg(F.max(F.when(F.col("k") == "e", F.col("v"))).alias("expected"),
                               F.max(F.when(F.col("k") == "a", F.col("v"))).alias("actual"))
    ok = {"=": F.col("actual") == F.col("expected"), ">=": F.col("actual") >= F.col("expected"),
          ">": F.col("actual") > F.col("expected")}[op]
    return g.select("check", "expected", "actual", ok.alias("ok"))


def mart_counts(customers: DataFrame, purchases: DataFrame, items: DataFrame,
                min_customers: int = 45, min_purchases: int = 200) -> DataFrame:
    """Each table is counted once; the checks are rows over the three counts."""
    counts = _union([df.select(F.lit(name).alias("t"), F.count(F.lit(1)).alias("c"))
                     for name, df in (("c", customers), ("p", purchases), ("i", items))])
    one = counts.agg(*[F.max(F.when(F.col("t") == t, F.col("c"))).alias(t) for t in "cpi"])

    def check(name: str, expected: str, actual: str, ok) -> F.Column:
        return F.struct(F.lit(name).alias("check"), F.lit(expected).alias("expected"), F.col(actual).cast("long").alias("actual"), ok.alias("ok"))

    return one.select(F.inline(F.array(
        check("mart_customers_final", f">= {min_customers}", "c", F.col("c") >= min_customers),
        check("mart_purchases_final", f">= {min_purchases}", "p", F.col("p") >= min_purchases),
        check("mart_items_gt_purchases", "> purchases", "i", F.col("i") > F.col("p")))))


def quality_bounds(snapshot: DataFrame) -> DataFrame:
    """invalid_rows ≥ 0 and 0 ≤ ratio ≤ 1 for every snapshot row; the snapshot is read once."""
    ratio = F.col("duplicates_ratio")
    one = snapshot.agg(F.count_if(F.col("invalid_rows") < 0).alias("n"), F.count_if((ratio < 0) | (ratio > 1)).alias("r"))

    def check(name: str, actual: str) -> F.Column:
        return F.struct(F.lit(name).alias("check"), F.lit("0 violations").alias("expected"), F.col(actual).alias("actual"), (F.col(actual) == 0).alias("ok"))

    return one.select(F.inline(F.array(check("invalid_rows_non_negative", "n"), check("ratio_in_unit_interval", "r"))))


def pii_hash(contacts: DataFrame, salt: str) -> DataFrame:
    """Over every email: the same address spelled differently (case, padding)
    hashes equal, different addresses hash different, hashes are 64 lower-hex,
    blank gives ''."""
    e = X.normalize_email("email")
    h1 = X.hash_value(e, salt)
    h2 = X.hash_value(X.normalize_email(F.concat(F.lit(" \t"), F.upper("email"), F.lit("  "))), salt)
    t = contacts.select(e.alias("e"), h1.alias("h1"), h2.alias("h2"))
    return _union([
        _row(t, "same_after_normalising", "0 violations", F.count_if(F.col("h1") != F.col("h2")), lambda a: a == 0),
        t.agg((F.count_distinct("e") - F.count_distinct("h1")).alias("actual")).select(
            F.lit("different_values_differ").alias("check"), F.lit("0 collisions").alias("expected"),
            F.col("actual").cast("long").alias("actual"), (F.col("actual") == 0).alias("ok")),
        _row(t, "hex64", "0 violations",
             F.count_if((F.col("e") != "") & ~F.col("h1").rlike(C.java_anchor(C.HASH_PATTERN))), lambda a: a == 0),
        _row(t, "blank_is_empty", "0 violations",
             F.count_if(X.hash_value(F.lit("  \t"), salt) != ""), lambda a: a == 0),
    ])
