"""Numeric functions as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once for each row. Written out, an expression runs again wherever body names it, and inside a
    function of a list's elements once for each of them."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lenient_double(c: Column, default: float | None = 0.0) -> Column:
    """A number in a string, else the default. Java's suffixes d and f don't make one."""
    text = F.trim(c.cast("string"))
    out = F.when(~F.coalesce(text.rlike(r"[dDfF]$"), F.lit(False)) | F.lower(text).rlike("inf$"), text.try_cast("double"))
    return out if default is None else F.coalesce(out, F.lit(float(default)))


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, and 0.0 where b is 0 or either is null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def clamp_1000(c: Column) -> Column:
    """Rounded half to even, within 0 and 1000."""
    return F.greatest(F.lit(0), F.least(F.lit(1000), F.rint(F.least(F.greatest(c, F.lit(-1.0)), F.lit(2000.0))).cast("int")))


def total(values: Column) -> Column:
    """Sum from left to right, so that the result doesn't depend on the partitioning."""
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def softmax(logits: Column) -> Column:
    powers = bind(F.array_max(logits), lambda top: F.transform(logits, lambda x: F.exp(x - top)))
    return bind(powers, lambda e: bind(total(e), lambda z: F.transform(e, lambda x: x / z)))


def argmax(values: Column) -> Column:
    """1-based place of the largest value, the first of ties; null for an empty list."""
    return F.when(F.size(values) > 0, F.array_position(values, F.array_max(values)).cast("int"))


def label_at(classes: list[str], place: Column) -> Column:
    return F.get(F.array(*map(F.lit, classes)), place - 1)


def heat(value: Column, most: Column) -> dict[str, Column]:
    """Cell colours of a heat map: intensity, red, green, blue, and the text colour. The numbers are fixed values."""
    t = safe_ratio(value, most)
    shade = (F.lit(255) - F.lit(170) * t).cast("int")
    return {"intensity": t, "red": shade, "green": shade + (F.lit(35) * (F.lit(1) - t)).cast("int"), "blue": F.lit(255), "text_colour": F.when(t > 0.65, "white").otherwise("black")}
