"""Canonical text of nested rows: the same for the same values, in whatever order fields and map entries stand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Digits after the point of a number in floating point.
DIGITS = 9


def _quoted(x: Column, masks: dict[str, str]) -> Column:
    for pattern, mask in masks.items():
        x = F.regexp_replace(x, pattern, mask.replace("\\", "\\\\").replace("$", "\\$"))
    for char, escape in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        x = F.replace(x, F.lit(char), F.lit(escape))
    return F.concat(F.lit('"'), x, F.lit('"'))


def _number(x: Column, digits: int) -> Column:
    """Scientific, so that every size keeps its digits; minus zero is zero."""
    return F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf").otherwise(F.format_string(f"%.{digits}e", F.when(x == 0, F.lit(0.0)).otherwise(x.cast("double"))))


def canonical(x: Column, kind: T.DataType, masks: dict[str, str] | None = None, digits: int = DIGITS, drop: frozenset[str] = frozenset(), path: str = "") -> Column:
    """The text of a value of any type: fields and map keys in order of their names, numbers in a fixed form, null as null.

    masks: regular expressions whose matches inside strings give way to a text; drop: paths of fields (a.b; of array elements and
    map values too) that are left out.
    """
    masks = masks or {}
    deeper = lambda y, t, p: canonical(y, t, masks, digits, drop, p)
    if isinstance(kind, T.StructType):
        parts = []
        for field in sorted(kind.fields, key=lambda f: f.name):
            own = f"{path}.{field.name}".lstrip(".")
            if own not in drop:
                parts.append(F.concat(F.lit(f'"{field.name}":'), deeper(x.getField(field.name), field.dataType, own)))
        text = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(x, lambda y: deeper(y, kind.elementType, path)), ","), F.lit("]"))
    elif isinstance(kind, T.MapType):
        key = lambda e: _quoted(e["key"].cast("string"), {})
        pairs = F.array_sort(F.transform(F.map_entries(x), lambda e: F.concat(key(e), F.lit(":"), deeper(e["value"], kind.valueType, path))))
        text = F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        text = _number(x, digits)
    elif isinstance(kind, (T.IntegralType, T.BooleanType)):
        text = x.cast("string")
    elif isinstance(kind, T.DecimalType):
        text = _number(x.cast("double"), digits)
    else:
        text = _quoted(x.cast("string"), masks)
    return F.when(x.isNull(), "null").otherwise(text)


def canonical_rows(rows: DataFrame, **options) -> DataFrame:
    """rows with text (the row's canonical text) and digest (its SHA-256)."""
    text = canonical(F.struct(*rows.columns), rows.schema, **options)
    return rows.withColumn("text", text).withColumn("digest", F.sha2("text", 256))


def leaves(x: Column, kind: T.DataType, path: str = "", digits: int = DIGITS) -> Column:
    """An array of (path, value) of all leaves of a nested value: a.b[0].c, with texts as in canonical. Maps are leaves."""
    if isinstance(kind, T.StructType):
        parts = [leaves(x.getField(f.name), f.dataType, f"{path}.{f.name}".lstrip("."), digits) for f in kind.fields]
        return F.concat(*parts) if parts else F.array().cast("array<struct<path:string,value:string>>")
    if isinstance(kind, T.ArrayType):
        inner = F.transform(F.coalesce(x, F.array().cast(kind)), lambda y, i: F.transform(leaves(y, kind.elementType, "", digits), lambda leaf: F.struct(F.concat(F.lit(f"{path}["), i.cast("string"), F.lit("]"), F.when(leaf["path"] == "", "").otherwise(F.concat(F.lit("."), leaf["path"]))).alias("path"), leaf["value"].alias("value"))))
        return F.flatten(inner)
    return F.array(F.struct(F.lit(path).alias("path"), canonical(x, kind, digits=digits).alias("value")))


def leaf_diff(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """keys, path, left, right of the leaves that differ or that one side lacks. The two have their own schemas."""
    sides = []
    for rows, name in ((left, "left"), (right, "right")):
        own = [c for c in rows.columns if c not in keys]
        each = rows.select(*keys, F.inline(leaves(F.struct(*own), rows.select(*own).schema)))
        sides.append(each.withColumnRenamed("value", name))
    return sides[0].join(sides[1], [*keys, "path"], "full_outer").where(~F.col("left").eqNullSafe(F.col("right"))).select(*keys, "path", "left", "right")
