"""Vector expressions over arrays; arithmetic is in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestack.functions.text import col


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column | str, b: Column | str) -> Column:
    """0 where either vector has no length; null where sizes differ."""
    length = norm(a) * norm(b)
    value = F.when(length == 0, 0.0).otherwise(dot(a, b) / length)
    return F.when(F.size(col(a)) == F.size(col(b)), value)


def normalized(v: Column | str) -> Column:
    """Unit length as float; a vector of zeros stays."""
    return F.transform(col(v), lambda x: F.when(norm(v) == 0, x).otherwise(x.cast("double") / norm(v)).cast("float"))


def is_finite(v: Column | str) -> Column:
    return ~F.exists(col(v), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def log_gain(grade: Column, top: Column, index: Column) -> Column:
    """Discounted gain scaled by 2^-top: it cannot overflow, and keeps tiny grades."""
    return F.pow(F.lit(2.0), grade - top) * -F.expm1(-grade * F.log(F.lit(2.0))) / F.log2(index + 2.0)
