"""Vector expressions over array columns; components are summed as doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def unit(a: Column) -> Column:
    """a divided by its length; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(F.arrays_zip(a.alias("v"), F.array_repeat(n, F.size(a)).alias("n")), lambda z: z["v"].cast("double") / z["n"])).otherwise(F.transform(a, lambda x: x.cast("double")))


def cosine(a: Column, b: Column, epsilon: float = 1e-9) -> Column:
    """Cosine within 0 and 1; 1 if either vector is (nearly) zero."""
    na, nb = norm(a), norm(b)
    return F.when((na < epsilon) | (nb < epsilon), 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot(a, b) / (na * nb))))


def softmax(x: Column) -> Column:
    top = F.array_max(x)
    e = F.transform(F.arrays_zip(x.alias("v"), F.array_repeat(top, F.size(x)).alias("m")), lambda z: F.exp(z["v"].cast("double") - z["m"].cast("double")))
    total = _sum(e)
    return F.transform(F.arrays_zip(e.alias("v"), F.array_repeat(total, F.size(x)).alias("s")), lambda z: z["v"] / z["s"])


def argmax(x: Column) -> Column:
    """Position of the first largest component, from 0."""
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation of two histograms; 1 if both are flat."""
    n = F.size(a).cast("double")
    sa, sb = _sum(F.transform(a, lambda x: x.cast("double"))), _sum(F.transform(b, lambda x: x.cast("double")))
    cov = dot(a, b) - sa * sb / n
    var = (dot(a, a) - sa * sa / n) * (dot(b, b) - sb * sb / n)
    return F.when(F.abs(var) > 1e-12, cov / F.sqrt(F.abs(var))).otherwise(1.0)
