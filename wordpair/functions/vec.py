"""Dense-vector expressions on ARRAY<FLOAT|DOUBLE> columns.

All of these are built-in higher-order functions (``aggregate``, ``zip_with``,
``transform``): they run on the JVM, but a lambda is interpreted and splits
whole-stage codegen.  Where every row of a large table meets a vector, the
operators use Arrow blocks instead.  Sums are accumulated in DOUBLE whatever the
element type.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan() -> Column:
    return F.lit(float("nan"))


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _d(x: Column) -> Column:
    return x.cast("double")


def dot(a, b) -> Column:
    """Inner product, DOUBLE."""
    return F.aggregate(F.zip_with(as_col(a), as_col(b), lambda x, y: _d(x) * _d(y)),
                       F.lit(0.0), lambda acc, x: acc + x)


def sqnorm(a) -> Column:
    return F.aggregate(as_col(a), F.lit(0.0), lambda acc, x: acc + _d(x) * _d(x))


def norm(a) -> Column:
    return F.sqrt(sqnorm(a))


def vadd(a, b) -> Column:
    return F.zip_with(as_col(a), as_col(b), lambda x, y: _d(x) + _d(y))


def vsub(a, b) -> Column:
    return F.zip_with(as_col(a), as_col(b), lambda x, y: _d(x) - _d(y))


def vscale(a, s) -> Column:
    s = F.lit(s) if isinstance(s, (int, float)) else as_col(s)
    return F.transform(as_col(a), lambda x: _d(x) * s)


def safe_div(num: Column, den: Column) -> Column:
    """IEEE division: x/0 is +-inf or NaN (Spark SQL would give NULL or raise)."""
    return (F.when(den != 0, num / den)
            .when(num > 0, F.lit(float("inf")))
            .when(num < 0, F.lit(float("-inf")))
            .otherwise(nan()))


def cosine(a, b) -> Column:
    """Cosine similarity; a zero-norm side gives NaN, as floating point does."""
    return safe_div(dot(a, b), norm(a) * norm(b))


def normalize(a) -> Column:
    """v / ||v||; a zero vector becomes all-NaN.

    Vector and norm are bound once a row, as variables of outer lambdas over one
    element: inside the inner lambda they would be worked out for every component."""
    def over(v: Column) -> Column:
        return F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: safe_div(_d(x), n)))[0]
    return F.transform(F.array(as_col(a)), over)[0]
