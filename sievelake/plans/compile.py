"""From a query's nodes to one boolean Column.

Attributes have types here, so what the types rule out is settled before Spark sees it: a literal of another
family than the column, an unknown column and NaN operands give a plain false, never a cast. Predicates stay
bare (a null condition keeps no row, and bare ones reach the Parquet reader); only below a NOT a null is turned
into false, because there a row without the attribute must stay.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievelake.functions import spatial, text
from sievelake.plans.nodes import And, Kind, Node, Not, Or, Predicate, Query, Shape

EXACT = 1 << 53  # integers up to here are exact as doubles
LONG = range(-(1 << 63), 1 << 63)


def family(value: Any) -> str | None:
    """int, float, str, bool or list for a literal; numbers are int or float."""
    if isinstance(value, bool):
        return "bool"
    for kind, name in ((int, "int"), (float, "float"), (str, "str"), ((list, tuple), "list")):
        if isinstance(value, kind):
            return name
    return None


def column_family(kind: T.DataType | None) -> str | None:
    if kind is None:
        return None
    if isinstance(kind, T.IntegralType):
        return "int"
    if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
        return "float"
    if isinstance(kind, T.StringType):
        return "str"
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, T.ArrayType):
        return "list"
    if isinstance(kind, T.VariantType):
        return "variant"
    return "other"


def column_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    return F.col(column_name(name))


def _variant(c: Column, of: str, kind: str) -> Column:
    """A variant's value where it is of the wanted family, else null. The guard keeps Spark from casting '7' to 7."""
    told = F.schema_of_variant(c)
    good = {"num": told.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)"), "str": told == "STRING", "list": told.startswith("ARRAY"), "numbers": told.rlike("^ARRAY<(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL[^>]*)>$"), "strings": told == "ARRAY<STRING>"}[of]
    return F.when(good, F.try_variant_get(c, "$", kind))


def _text(shape: Shape, name: str) -> Column | None:
    """The attribute as text, or None if it can't be."""
    found = column_family(shape.types.get(name))
    return column(name) if found == "str" else _variant(column(name), "str", "string") if found == "variant" else None


def _list_literal(values: list | tuple, kind: T.DataType) -> Column | None:
    inner = column_family(kind)
    out = []
    for v in values:
        f = family(v)
        if inner in ("int", "float") and f in ("int", "float") and not (isinstance(v, float) and math.isnan(v)):
            if inner == "int" and (f == "float" and v != int(v)):
                return None
            out.append(F.lit(int(v) if inner == "int" else float(v)))
        elif inner == f == "str" or inner == f == "bool":
            out.append(F.lit(v))
        elif inner == f == "list" and (nested := _list_literal(v, kind.elementType)) is not None:
            out.append(nested)
        else:
            return None
    return F.array(*out).cast(T.ArrayType(kind)) if out else F.array().cast(T.ArrayType(kind))


def _is_nan(value: Any) -> bool:
    return isinstance(value, float) and math.isnan(value)


def _equal_sides(shape: Shape, p: Predicate) -> tuple[Column, Column] | None:
    """The two sides of an equality, or None where nothing can be equal."""
    value = p.args[0]
    kind, of = shape.types.get(p.attribute), family(value)
    inner, c = column_family(kind), column(p.attribute)
    if of is None or inner is None or _is_nan(value):
        return None
    if inner == "variant":
        if of in ("int", "float"):
            return _variant(c, "num", "double"), F.lit(float(value))
        if of == "list" and value and (literal := _list_literal(value, T.DoubleType() if family(value[0]) in ("int", "float") else T.StringType())) is not None:
            numbers = family(value[0]) in ("int", "float")
            return _variant(c, "numbers" if numbers else "strings", "array<double>" if numbers else "array<string>"), literal
        return (_variant(c, "str", "string"), F.lit(value)) if of == "str" else None
    if inner == "int" and of == "float":
        if math.isinf(value) or value != int(value):
            return None
        return (c, F.lit(int(value))) if abs(value) < EXACT else (c.cast("double"), F.lit(value))
    if inner == "int" and of == "int":
        return (c, F.lit(value)) if value in LONG else None
    if inner == "float" and of in ("int", "float"):
        return (c if isinstance(kind, T.DoubleType) else c.cast("double")), F.lit(float(value))
    if inner == of and inner in ("str", "bool"):
        return c, F.lit(value)
    if inner == of == "list" and (literal := _list_literal(value, kind.elementType)) is not None:
        return c, literal
    return None


def _range(shape: Shape, p: Predicate) -> Column:
    low, high = p.args
    kind, c = shape.types.get(p.attribute), column(p.attribute)
    inner, of = column_family(kind), {family(low), family(high)}
    if inner is None or _is_nan(low) or _is_nan(high):
        return F.lit(False)
    if of <= {"int", "float"}:
        if inner == "variant":
            return _variant(c, "num", "double").between(float(low), float(high))
        if inner == "float":
            return (c if isinstance(kind, T.DoubleType) else c.cast("double")).between(float(low), float(high))
        if inner == "int":
            if any(abs(v) >= EXACT and isinstance(v, float) and not math.isinf(v) for v in (low, high)):
                return c.cast("double").between(float(low), float(high))
            low, high = (v if isinstance(v, float) or v in LONG else math.copysign(math.inf, v) for v in (low, high))
            if low == math.inf or high == -math.inf:
                return F.lit(False)
            parts = [c >= F.lit(math.ceil(low))] if low != -math.inf else []
            parts += [c <= F.lit(math.floor(high))] if high != math.inf else []
            return reduce(and_, parts) if parts else c.isNotNull()
    if of == {"str"} and inner in ("str", "variant"):
        words = _text(shape, p.attribute)
        return words.between(low, high)
    if of == {"list"} and inner == "list":
        bounds = [_list_literal(v, kind.elementType) for v in (low, high)]
        if None not in [None if b is None else 1 for b in bounds]:
            return (c >= bounds[0]) & (c <= bounds[1])
    return F.lit(False)


def coordinates(shape: Shape, name: str) -> tuple[Column, Column] | None:
    """The point's x and y as doubles: two columns of their own, a struct of x and y, or a list of exactly two numbers."""
    if name in shape.points:
        pair = shape.points[name]
        return (column(pair[0]), column(pair[1])) if all(column_family(shape.types.get(c)) in ("int", "float") for c in pair) else None
    kind, c = shape.types.get(name), column(name)
    if isinstance(kind, T.StructType) and {"x", "y"} <= set(kind.names) and all(column_family(kind[f].dataType) in ("int", "float") for f in "xy"):
        return c["x"].cast("double"), c["y"].cast("double")
    if isinstance(kind, T.ArrayType) and column_family(kind.elementType) in ("int", "float"):
        return tuple(F.when(F.size(c) == 2, F.get(c, F.lit(i))).cast("double") for i in (0, 1))  # type: ignore[return-value]
    if isinstance(kind, T.VariantType):
        two = _variant(c, "list", "array<double>")
        return tuple(F.when(F.size(two) == 2, F.get(two, F.lit(i))) for i in (0, 1))  # type: ignore[return-value]
    return None


def compile_predicate(shape: Shape, p: Predicate) -> Column:
    """A condition that is null or false where the row lacks the attribute."""
    if p.kind == Kind.EQUALS:
        sides = _equal_sides(shape, p)
        return sides[0] == sides[1] if sides else F.lit(False)
    if p.kind == Kind.RANGE:
        return _range(shape, p)
    if p.kind in (Kind.WITHIN_BOX, Kind.NEAR):
        point = coordinates(shape, p.attribute)
        test = spatial.in_box if p.kind == Kind.WITHIN_BOX else spatial.in_circle
        return test(*point, *map(float, p.args)) if point else F.lit(False)
    c = _text(shape, p.attribute)
    if c is None:
        return F.lit(False)
    if p.kind == Kind.PREFIX:
        return c.startswith(p.args[0])
    return {Kind.CONTAINS: text.has_word, Kind.FUZZY: text.resembles, Kind.SUBSTRING: text.has_substring}[p.kind](c, *p.args)


def compile_node(shape: Shape, node: Node | None) -> Column:
    if node is None:
        return F.lit(True)
    if isinstance(node, Predicate):
        return compile_predicate(shape, node)
    if isinstance(node, Not):
        if node.child is None:
            return F.lit(True)
        if isinstance(node.child, Predicate) and node.child.kind == Kind.EQUALS:
            sides = _equal_sides(shape, node.child)  # never null, and the reader can use it
            return ~sides[0].eqNullSafe(sides[1]) if sides else F.lit(True)
        return ~F.coalesce(compile_node(shape, node.child), F.lit(False))
    parts = [compile_node(shape, c) for c in node.children]
    if isinstance(node, And):
        return reduce(and_, parts) if parts else F.lit(True)
    assert isinstance(node, Or)
    return reduce(or_, parts) if parts else F.lit(False)


def shape_of(df: DataFrame, points: dict[str, tuple[str, str]] | None = None) -> Shape:
    return Shape({f.name: f.dataType for f in df.schema.fields}, points or {})


def apply_query(df: DataFrame, query: Query, id_column: str, points: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """The rows that the query asks for. Ties of a top-k go to the lower id, whichever its direction."""
    shape = shape_of(df, points)
    out = df if query.where is None else df.filter(compile_node(shape, query.where))
    if query.top_k is None:
        return out
    top = query.top_k
    if top.attribute not in shape.types or top.k <= 0:
        return out.filter(F.lit(False))
    key = column(top.attribute)
    if isinstance(shape.types[top.attribute], T.VariantType):
        key = _variant(key, "num", "double")
    return out.filter(key.isNotNull()).orderBy(key.desc() if top.descending else key.asc(), column(id_column).asc()).limit(top.k)
