"""JSON field extraction with "missing is a default, not NULL" semantics.

The original engine extracts fields with functions that return ``''`` for a
missing or non-string value, ``0`` for a missing number and ``false`` for a
missing boolean, and an empty array for a missing array.  A purchase without
``total_amount`` therefore passes ``total_amount >= 0``.  Spark's extractors
return NULL instead, so every helper here wraps the extraction in a default.

Documents are parsed once per row into a VARIANT (``try_parse_json``) and
every field is read from that binary value, instead of re-parsing the JSON
text once per field.  Malformed text gives a NULL variant, so all its fields
take their defaults.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse(payload: Column | str) -> Column:
    """Parse JSON text to VARIANT; malformed text → NULL."""
    c = F.col(payload) if isinstance(payload, str) else payload
    return F.try_parse_json(c)


def _path(*keys: str) -> str:
    return "$" + "".join(f"['{k}']" for k in keys)


def _type_of(doc: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(doc, path, "variant"))


def js_str(doc: Column, *keys: str) -> Column:
    """String field; missing, null, number, object → ``''``."""
    path = _path(*keys)
    return F.when(_type_of(doc, path) == "STRING", F.try_variant_get(doc, path, "string")).otherwise(F.lit(""))


def js_double(doc: Column, *keys: str) -> Column:
    """Float field; missing / not a number → ``0.0``.  A numeric string (``"5"``)
    is accepted as its number."""
    return F.coalesce(F.try_variant_get(doc, _path(*keys), "double"), F.lit(0.0))


def js_double_or_null(doc: Column, *keys: str) -> Column:
    return F.try_variant_get(doc, _path(*keys), "double")


def js_bool(doc: Column, *keys: str) -> Column:
    """Boolean field as 0/1 int; anything but a JSON boolean → 0."""
    path = _path(*keys)
    return (
        F.when(_type_of(doc, path) == "BOOLEAN", F.try_variant_get(doc, path, "boolean"))
        .otherwise(F.lit(False))
        .cast("int")
    )


def text_of(v: Column) -> Column:
    """A VARIANT that is a string as its text; anything else → ``''``."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.lit(""))


def flag_of(v: Column) -> Column:
    """A VARIANT that is a boolean as 0/1 int; anything else → 0."""
    return F.when(F.schema_of_variant(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean")).otherwise(F.lit(False)).cast("int")


def js_array(doc: Column, *keys: str) -> Column:
    """Array field as ``array<variant>``; missing / not an array → ``[]``."""
    return F.coalesce(
        F.try_variant_get(doc, _path(*keys), "array<variant>"),
        F.array().cast("array<variant>"),
    )


def js_text(doc: Column) -> Column:
    """Canonical JSON text of a VARIANT value."""
    return F.to_json(doc)


def materialize_row(df):
    """Emit every row through a one-element ``inline``: the columns computed
    above become generator outputs, so later filters are evaluated on them
    instead of being pushed down and re-evaluating each column's expression
    once per predicate that reads it."""
    return df.select(F.inline(F.array(F.struct(*[F.col(c) for c in df.columns]))))


def with_doc(df, payload: str = "payload", name: str = "_doc"):
    """Add the parsed document as a column, parsed exactly once per row.

    A plain projection is not enough: the optimizer pushes later filters
    (the MART rules) through projections, substituting the parse into every
    predicate that reads a field, so one row would be parsed once per
    reference.  Emitting the parsed value from a one-element ``inline`` makes
    it a generator output, which predicates cannot be pushed beneath.
    """
    keep = [c for c in df.columns]
    row = F.struct(parse(payload).alias(name), *[F.col(c) for c in keep])
    return df.select(F.inline(F.array(row)))


#: follows the text inside the brackets of `strict_parse`
END = "\u0007end"


def strict_parse(text: Column | str) -> Column:
    """Parse text that must hold exactly one JSON value.

    ``parse_json`` stops after the first complete value and ignores what
    follows (``{"a": 1} junk`` parses, and so does ``[1]]``).  The text is put into an array
    before a mark: trailing content is a syntax error or closes the array before the mark, and
    a second value makes the array longer, so only a single well-formed value survives.
    """
    c = F.col(text) if isinstance(text, str) else text
    arr = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), c, F.lit(', "\\u0007end"]'))), "$", "array<variant>")
    marked = (F.size(arr) == 2) & (F.try_variant_get(F.element_at(arr, -1), "$", "string") == F.lit(END))
    return F.when(marked, F.element_at(arr, 1))
