"""Vector arithmetic on array columns. Products are taken in double."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SCORE_DIGITS = 10  # scores are compared at this precision, so summation order cannot break ties


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def l2_norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column | str, floor: float = 1e-12) -> Column:
    """v / max(|v|, floor), as doubles."""
    v = _col(v)
    scale = F.greatest(l2_norm(v), F.lit(floor))
    # The norm rides along as a one-element array, so it is computed once per row.
    return F.flatten(
        F.transform(F.array(scale), lambda n: F.transform(v, lambda x: x.cast("double") / n))
    )


def max_abs_diff(a: Column | str, b: Column | str) -> Column:
    return F.array_max(F.zip_with(_col(a), _col(b), lambda x, y: F.abs(x.cast("double") - y.cast("double"))))
