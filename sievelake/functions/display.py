"""The text under which sketches know a value."""

from __future__ import annotations

import math
from decimal import Decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def display(value: Column, kind: T.DataType) -> Column:
    """Whole doubles lose their fraction and none has an exponent, so that 1, 1.0 and '1' are one."""
    if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
        wide = value.cast("double")
        exact = wide.cast("string")
        plain = _plain_digits(exact)
        special = F.when(F.isnan(wide), "NaN").when(wide == math.inf, "inf").when(wide == -math.inf, "-inf")
        return special.when((wide == 0) & exact.startswith("-"), "-0").when(F.contains(exact, F.lit("E")), plain).otherwise(F.regexp_replace(exact, r"\.0$", ""))
    if isinstance(kind, T.ArrayType):
        tag = "Float" if isinstance(kind.elementType, (T.DoubleType, T.FloatType)) else "Int" if isinstance(kind.elementType, T.IntegralType) else None
        if tag is None:
            one = lambda x: F.concat(F.lit('String("'), x.cast("string"), F.lit('")'))
        elif tag == "Float":
            one = lambda x: F.concat(F.lit("Float("), F.when(display(x, kind.elementType).rlike(r"^-?\d+$"), F.concat(display(x, kind.elementType), F.lit(".0"))).otherwise(display(x, kind.elementType)), F.lit(")"))
        else:
            one = lambda x: F.concat(F.lit("Int("), x.cast("string"), F.lit(")"))
        return F.concat(F.lit("["), F.array_join(F.transform(value, one), ", "), F.lit("]"))
    return value.cast("string")


def _plain_digits(text: Column) -> Column:
    """A number in scientific notation, written out."""
    parts = F.split(F.ltrim(text, F.lit("-")), "E")
    digits = F.regexp_replace(F.replace(F.get(parts, F.lit(0)), F.lit("."), F.lit("")), "0+$", "")
    exponent = F.coalesce(F.get(parts, F.lit(1)), F.lit("0")).cast("int")
    before = exponent + 1
    large = F.when(F.length(digits) <= before, F.rpad(digits, before, "0")).otherwise(F.concat(F.substring(digits, F.lit(1), before), F.lit("."), F.substring(digits, before + 1, F.length(digits))))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    return F.concat(F.when(text.startswith("-"), "-").otherwise(""), F.when(exponent >= 0, large).otherwise(small))


def display_of(value: Any) -> str:
    """The same for a literal."""
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        if math.isinf(value):
            return "inf" if value > 0 else "-inf"
        if value == int(value):
            return "-0" if value == 0 and math.copysign(1, value) < 0 else format(Decimal(repr(value)), ".0f")
        return format(Decimal(repr(value)), "f")
    if isinstance(value, (list, tuple)):
        inner = [f"{'Float' if isinstance(v, float) else 'Int' if isinstance(v, int) else 'String'}({_debug(v)})" for v in value]
        return "[" + ", ".join(inner) + "]"
    return str(value)


def _debug(value: Any) -> str:
    if isinstance(value, str):
        return f'"{value}"'
    text = display_of(value)
    return f"{text}.0" if isinstance(value, float) and text.lstrip("-").isdigit() else text
