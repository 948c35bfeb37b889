"""Indented JSON of a column as a native expression, in the reference's two forms.

``php``: ``json_encode(.., JSON_PRETTY_PRINT)``, four blanks, ``/`` as ``\\/`` and other
than ASCII as ``\\uXXXX``; ``js``: ``JSON.stringify(.., null, 2)``, two blanks, characters
as they are.  Both keep null fields, print whole doubles without a fraction, and
write empty lists and maps (PHP has one kind of array) as ``[]``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters with a short escape.
SHORT = {"\\": "\\\\", '"': '\\"', "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def _unit(c: Column) -> Column:
    """``\\uXXXX`` of a character, two of them beyond the basic plane."""
    h = F.lower(F.hex(F.encode(c, "UTF-16BE")))
    one = F.concat(F.lit("\\u"), F.substring(h, 1, 4))
    return F.when(F.length(h) > 4, F.concat(one, F.lit("\\u"), F.substring(h, 5, 4))).otherwise(one)


def json_string(c: Column, php: bool) -> Column:
    out = c
    for raw, escaped in SHORT.items():
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    if php:
        out = F.replace(out, F.lit("/"), F.lit("\\/"))
    rest = r"[^\x20-\x7F]" if php else r"[\x00-\x1F]"
    spelt = F.array_join(F.transform(F.split(out, ""), lambda x: F.when(x.rlike(rest), _unit(x)).otherwise(x)), "")
    return F.concat(F.lit('"'), F.when(out.rlike(rest), spelt).otherwise(out), F.lit('"'))


def _number(c: Column) -> Column:
    whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
    return F.when(whole, F.floor(c).cast("bigint").cast("string")).otherwise(c.cast("string"))


def _lines(items: Column, pad: str, inner: str, left: str, right: str) -> Column:
    return F.concat(F.lit(f"{left}\n{inner}"), F.array_join(items, f",\n{inner}"), F.lit(f"\n{pad}{right}"))


def pretty_json(c: Column, kind: T.DataType, php: bool = True, depth: int = 0) -> Column:
    """The value ``c`` of type ``kind`` as indented JSON text; null is ``null``."""
    step = "    " if php else "  "
    pad, inner = step * depth, step * (depth + 1)

    def name(x: Column) -> Column:
        return F.concat(json_string(x, php), F.lit(": "))

    if isinstance(kind, T.StructType):
        fields = [F.concat(name(F.lit(f.name)), pretty_json(c.getField(f.name), f.dataType, php, depth + 1)) for f in kind.fields]
        text = _lines(F.array(*fields), pad, inner, "{", "}")
    elif isinstance(kind, T.ArrayType):
        items = F.transform(c, lambda x: pretty_json(x, kind.elementType, php, depth + 1))
        text = F.when(F.size(c) == 0, F.lit("[]")).otherwise(_lines(items, pad, inner, "[", "]"))
    elif isinstance(kind, T.MapType):
        items = F.transform(F.map_entries(c), lambda e: F.concat(name(e["key"]), pretty_json(e["value"], kind.valueType, php, depth + 1)))
        text = F.when(F.size(c) == 0, F.lit("[]")).otherwise(_lines(items, pad, inner, "{", "}"))
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        text = _number(c.cast("double"))
    elif isinstance(kind, (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType)):
        text = c.cast("string")
    else:
        text = json_string(c.cast("string"), php)
    return F.when(c.isNull(), F.lit("null")).otherwise(text)
