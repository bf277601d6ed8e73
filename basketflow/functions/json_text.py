"""Rewriting strings inside JSON text without a schema.

Outside strings JSON text has no quotes, so once escaped quotes are hidden, splitting at quotes gives what is
outside and inside strings in turn. The string behind a key and a colon is that member's value, at any
depth, whatever fields, maps and arrays lie around it. Everything but the rewritten values stays as it
is, byte for byte. Built-in array functions only: one narrow projection, no parse tree, no UDF.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: stand for an escaped backslash and an escaped quote while the text is split; JSON text has no raw control characters
SLASH, QUOTE = "\u0001", "\u0002"
COLON = r"\A[ \t\r\n]*:[ \t\r\n]*\z"


def _hidden(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\\\"), F.lit(SLASH)), F.lit('\\"'), F.lit(QUOTE))


def _shown(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(QUOTE), F.lit('\\"')), F.lit(SLASH), F.lit("\\\\"))


def decoded(inner: Column) -> Column:
    """The text that the inside of a JSON string (escapes hidden) stands for."""
    value = F.try_variant_get(F.try_parse_json(F.concat(F.lit('"'), _shown(inner), F.lit('"'))), "$", "string")
    plain = ~inner.contains("\\") & ~inner.contains(SLASH) & ~inner.contains(QUOTE)
    return F.when(plain, inner).otherwise(value)


def rewrite_members(df: DataFrame, column: str, rules: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """``df`` with the JSON text of ``column`` where each string member named as in ``rules`` has the value that its rule
    makes of it; the rules' results must need no escapes. Text that is no JSON value fails the job, without
    showing it. Null stays null; numbers, objects and arrays under such a name are kept, and searched."""
    text = F.col(column)
    whole = F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"\\u0007end"]')))
    parts = F.try_variant_get(whole, "$", "array<variant>")
    # raw control characters are no JSON; none may pass for a hidden escape
    good = (F.size(parts) == 2) & (F.try_variant_get(F.element_at(parts, -1), "$", "string") == F.lit("\u0007end")) & ~text.rlike("[\u0001\u0002]")
    checked = F.when(text.isNull() | F.coalesce(good, F.lit(False)), text).otherwise(F.raise_error(F.lit(f"column {column}: a text is no JSON value")).cast("string"))
    taken = "_json_parts"
    while taken in df.columns:
        taken = f"_{taken}"
    # a one-element inline keeps the split from being done again for every element
    split = df.select("*", F.inline(F.array(F.struct(F.split(_hidden(checked), '"').alias(taken)))))
    pieces = F.col(taken)

    def rewritten(piece: Column, i: Column) -> Column:
        # places beyond either end read as null, and so match nothing
        key = decoded(F.when(i >= 3, F.get(pieces, i - 2)))
        colon = F.get(pieces, i - 1).rlike(COLON)
        got = piece
        for name, rule in rules.items():
            got = F.when((i % 2 == 1) & (i >= 3) & colon & (key == name), rule(decoded(piece))).otherwise(got)
        return got

    out = _shown(F.array_join(F.transform(pieces, rewritten), '"'))
    return split.select(*[(out.alias(c) if c == column else F.col(c)) for c in df.columns])
