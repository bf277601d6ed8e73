"""PII anonymisation of documents before they enter the stream.

Every string field named ``email`` or ``phone`` — at any depth, through
nested objects, arrays and maps — is normalised and replaced by its salted
SHA-256.  The walk is driven by the DataFrame schema on the driver and
compiles to one projection of built-in expressions (``struct``,
``transform``, ``transform_values``): no UDF, no per-row Python.  Non-string
values under those names and NULLs are left as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import pii as X
from ..functions.json_text import rewrite_members

PII_ENTITIES = ("customers", "purchases")


def _contains_pii(dt: T.DataType, keys) -> bool:
    if isinstance(dt, T.StructType):
        return any(
            (f.name in keys and isinstance(f.dataType, T.StringType)) or _contains_pii(f.dataType, keys)
            for f in dt.fields
        )
    if isinstance(dt, T.ArrayType):
        return _contains_pii(dt.elementType, keys)
    if isinstance(dt, T.MapType):
        return isinstance(dt.valueType, T.StringType) or _contains_pii(dt.valueType, keys)
    return False


def _hash_leaf(name: str, c: Column, salt: str) -> Column:
    if name == "email":
        v = X.normalize_email(c)
    else:
        v = X.normalize_phone(c).getField("value")
    return F.when(c.isNull(), c).otherwise(X.hash_value(v, salt))


def _walk(c: Column, dt: T.DataType, salt: str, keys) -> Column:
    if not _contains_pii(dt, keys):
        return c
    if isinstance(dt, T.StructType):
        parts = []
        for f in dt.fields:
            sub = c.getField(f.name)
            if f.name in keys and isinstance(f.dataType, T.StringType):
                parts.append(_hash_leaf(f.name, sub, salt).alias(f.name))
            else:
                parts.append(_walk(sub, f.dataType, salt, keys).alias(f.name))
        return F.when(c.isNull(), F.lit(None)).otherwise(F.struct(*parts))
    if isinstance(dt, T.ArrayType):
        return F.transform(c, lambda x: _walk(x, dt.elementType, salt, keys))
    if isinstance(dt, T.MapType):
        if isinstance(dt.valueType, T.StringType):
            return F.transform_values(c, lambda k, v: F.when(k.isin(*keys), _hash_leaf_dyn(k, v, salt)).otherwise(v))
        return F.transform_values(c, lambda k, v: _walk(v, dt.valueType, salt, keys))
    return c


def _hash_leaf_dyn(k: Column, v: Column, salt: str) -> Column:
    return F.when(k == "email", _hash_leaf("email", v, salt)).otherwise(_hash_leaf("phone", v, salt))


def hash_document(df: DataFrame, column: str, salt: str, keys=("email", "phone")) -> DataFrame:
    """Replace every string ``email``/``phone`` inside ``column`` by its hash."""
    X.check_salt(salt)
    dt = df.schema[column].dataType
    if isinstance(dt, T.StringType) and column in keys:
        return df.withColumn(column, _hash_leaf(column, F.col(column), salt))
    return df.withColumn(column, _walk(F.col(column), dt, salt, set(keys)))


def hash_entities(docs: dict[str, DataFrame], column: str, salt: str, entities=PII_ENTITIES) -> dict[str, DataFrame]:
    """Hash the chosen entities only (the pipeline default: customers and
    purchases; pass all four to hash store managers too)."""
    return {e: (hash_document(df, column, salt) if e in entities else df) for e, df in docs.items()}


def phone_report(df: DataFrame, entity: str, id_col: str, phone_col: str) -> DataFrame:
    """(entity, document id) for every phone that cannot be normalised.  The
    report deliberately carries no phone number."""
    ok = X.normalize_phone(F.col(phone_col)).getField("ok")
    return df.where(F.col(phone_col).isNotNull() & ~ok).select(F.lit(entity).alias("entity"),
                                                             F.col(id_col).alias("doc_id"))


def phone_report_counts(report: DataFrame) -> DataFrame:
    return report.groupBy("entity").agg(F.count(F.lit(1)).alias("unnormalized"))


def hash_any_json(df: DataFrame, text_col: str, salt: str, keys=("email", "phone")) -> DataFrame:
    """JSON text with every string member named ``email`` or ``phone`` hashed, at any depth and without a schema:
    unknown fields, maps and arrays are searched like any others, and all else stays byte for byte.

    Any JSON value will do; null text stays null. Text that is no JSON fails the job without showing it, so nothing
    passes in clear. Strings of an array under such a name are not members and stay, as in the original."""
    X.check_salt(salt)
    return rewrite_members(df, text_col, {k: lambda value, k=k: _hash_leaf(k, value, salt) for k in keys})


class UnknownFieldsError(ValueError):
    """Documents carry fields the declared schema does not know; hashing them
    through the schema would drop them (or let PII pass unhashed)."""


#: what an unreadable or non-object document is reported as
NOT_AN_OBJECT = "(not a JSON object)"


def _unknown(value: Column, dt: T.DataType, path: str) -> Column:
    """Paths inside the variant ``value`` that ``dt`` does not know, as an array: judged row by row,
    so that one document of another shape cannot hide what the others carry."""
    none = F.array().cast("array<string>")
    if isinstance(dt, T.StructType):
        known = {f.name: f.dataType for f in dt.fields}
        fields = F.map_keys(F.try_variant_get(value, "$", "map<string,variant>"))
        here = F.transform(F.filter(fields, lambda k: ~k.isin(*known)), lambda k: F.concat(F.lit(path + "." if path else ""), k))
        below = [_unknown(F.try_variant_get(value, f"$['{n}']", "variant"), t, f"{path}.{n}" if path else n)
                 for n, t in known.items() if isinstance(t, (T.StructType, T.ArrayType))]
        return F.coalesce(F.concat(here, *below) if below else here, _scalar(value, path))
    if isinstance(dt, T.ArrayType) and isinstance(dt.elementType, (T.StructType, T.ArrayType)):
        parts = F.try_variant_get(value, "$", "array<variant>")
        inner = F.transform(parts, lambda v: _unknown(v, dt.elementType, path + "[]"))
        return F.coalesce(F.flatten(inner), _scalar(value, path))
    return none


def _scalar(value: Column, path: str) -> Column:
    """A value that is no object or array where one is declared: nothing if it is missing or null."""
    return F.when(value.isNull() | (F.schema_of_variant(value) == "VOID"), F.array().cast("array<string>")).otherwise(F.array(F.lit(path or NOT_AN_OBJECT)))


def unknown_fields(df: DataFrame, text_col: str, schema: T.StructType) -> list[str]:
    """Field paths present in any document but absent from ``schema``, and `NOT_AN_OBJECT` if any text
    is no JSON object. One distributed pass; paths, never values, reach the driver."""
    value = F.try_parse_json(F.col(text_col))
    broken = F.array(F.lit(NOT_AN_OBJECT))
    is_object = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
    bad = F.when(F.col(text_col).isNull(), F.array().cast("array<string>")).when(is_object, _unknown(value, schema, "")).otherwise(broken)
    return sorted(r["p"] for r in df.select(F.explode(bad).alias("p")).distinct().collect())


def hash_json_documents(df: DataFrame, text_col: str, schema: T.StructType, salt: str,
                        keys=("email", "phone")) -> DataFrame:
    """JSON text → documents with PII hashed → JSON text.  The batch fails if
    any document has a field outside ``schema``.  Missing fields stay missing
    (explicit JSON nulls are written as missing, which the RAW extractors
    read the same way).  The clear-text input column is replaced, never kept
    beside the hashed one."""
    extra = unknown_fields(df, text_col, schema)
    if extra:
        raise UnknownFieldsError(f"documents carry fields outside the declared schema: {', '.join(extra)}")
    parsed = df.withColumn(text_col, F.from_json(F.col(text_col), schema))
    hashed = hash_document(parsed, text_col, salt, keys)
    return hashed.withColumn(text_col, F.to_json(F.col(text_col)))
