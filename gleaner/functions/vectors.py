"""Vector arithmetic on array columns, in double precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a variance is raised by before its root is divided by.
EPSILON = 1e-5


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def truncate(v: Column, dim: int) -> Column:
    return F.slice(v, 1, dim)


def l2_normalize(v: Column) -> Column:
    """Unit length; the zero vector stays."""
    v = doubles(v)
    return F.element_at(F.transform(F.array(F.sqrt(dot(v, v))), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)), 1)


def layer_norm(v: Column, eps: float = EPSILON) -> Column:
    """Mean 0 and variance 1 over the whole vector, without weights."""
    v = doubles(v)
    n = F.size(v)

    def scaled(m: Column) -> Column:
        def by(var: Column) -> Column:
            return F.transform(v, lambda x: (x - m) / F.sqrt(var + F.lit(eps)))

        var = total(F.transform(v, lambda x: (x - m) * (x - m))) / n
        return F.element_at(F.transform(F.array(var), by), 1)

    return F.when(n > 0, F.element_at(F.transform(F.array(total(v) / n), scaled), 1)).otherwise(v)
