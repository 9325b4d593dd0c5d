"""Vector math as Spark SQL higher-order functions (V1-V4, P10).

Vectors are ``array<float>``; arithmetic is always carried out in double.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["let", "dot", "norm_sq", "cosine", "cosine_distance", "normalize", "vec_lit", "seq_norm_sq", "cosine_to",
           "cosine_array", "dot_array"]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row: inside a lambda over
    elements a plain column expression would be computed again for each of them."""
    return F.get(F.transform(F.array(value), body), 0)


def dot(a, b, strict: bool = False) -> Column:
    """V1: dot product (cosine of unit vectors).

    ``strict`` raises on a length mismatch like the reference; otherwise a
    mismatch gives null.
    """
    a, b = _c(a), _c(b)
    s = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                    F.lit(0.0).cast("double"), lambda acc, x: acc + x)
    mismatch = F.size(a) != F.size(b)
    if strict:
        return F.when(mismatch, F.raise_error(F.lit("Vector dimension mismatch"))).otherwise(s)
    return F.when(mismatch, F.lit(None).cast("double")).otherwise(s)


def norm_sq(a) -> Column:
    return F.aggregate(_c(a), F.lit(0.0).cast("double"),
                       lambda acc, x: acc + x.cast("double") * x.cast("double"))


def cosine(a, b, strict: bool = False, na=None, nb=None) -> Column:
    """V2 (lenient: 0 on length mismatch or zero norm) / V3 (strict: raise on
    length mismatch, 0 on zero norm).  ``na`` and ``nb`` are the squared norms where they are known."""
    a, b = _c(a), _c(b)
    na, nb = norm_sq(a) if na is None else na, norm_sq(b) if nb is None else nb
    d = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                    F.lit(0.0).cast("double"), lambda acc, x: acc + x)
    mismatch = F.size(a) != F.size(b)
    zero = (na == 0) | (nb == 0)
    val = d / (F.sqrt(na) * F.sqrt(nb))
    if strict:
        return (F.when(mismatch, F.raise_error(F.lit("Vectors must have the same length")))
                .when(zero, F.lit(0.0)).otherwise(val))
    return F.when(mismatch | zero, F.lit(0.0)).otherwise(val)


def cosine_distance(a, b) -> Column:
    """V4: 1 - dot of unit vectors."""
    return F.lit(1.0) - dot(a, b, strict=True)


def normalize(v) -> Column:
    """P10: L2-normalise (norm in double, stored float); zero vector kept."""
    v = _c(v)
    return let(F.sqrt(norm_sq(v)), lambda n: F.when(n == 0, v)
               .otherwise(F.transform(v, lambda x: (x.cast("double") / n).cast("float"))))


def _sql_double(x: float) -> str:
    x = float(x)
    if math.isnan(x):
        return "CAST('NaN' AS DOUBLE)"
    if math.isinf(x):
        return "CAST('Infinity' AS DOUBLE)" if x > 0 else "CAST('-Infinity' AS DOUBLE)"
    return repr(x) + "D"


def vec_lit(values) -> Column:
    """A small driver-side vector as one literal ``array<double>`` expression
    (a single plan node, not one literal call per element)."""
    return F.expr("array(" + ", ".join(_sql_double(x) for x in values) + ")")


def seq_norm_sq(values) -> float:
    """Sum of squares with the same left-to-right double arithmetic as ``norm_sq``."""
    s = 0.0
    for x in values:
        s += float(x) * float(x)
    return s


def cosine_to(vec, na, target, strict: bool = True) -> Column:
    """Cosine of a vector column to one driver-side vector.

    ``na`` is the column's squared norm computed once per row (shared by all
    targets); the target's norm is a literal.  Same formula and arithmetic
    order as :func:`cosine`.
    """
    v = _c(vec)
    nb = seq_norm_sq(target)
    d = F.aggregate(F.zip_with(v, vec_lit(target), lambda x, y: x.cast("double") * y.cast("double")),
                    F.lit(0.0).cast("double"), lambda acc, x: acc + x)
    mismatch = F.size(v) != F.lit(len(target))
    zero = (na == 0) | F.lit(nb == 0)
    val = d / (F.sqrt(na) * F.lit(math.sqrt(nb)))
    if strict:
        return (F.when(mismatch, F.raise_error(F.lit("Vectors must have the same length")))
                .when(zero, F.lit(0.0)).otherwise(val))
    return F.when(mismatch | zero, F.lit(0.0)).otherwise(val)


def _dot_sql(vec: str, target) -> str:
    arr = "array(" + ", ".join(_sql_double(x) for x in target) + ")"
    return (f"aggregate(zip_with(`{vec}`, {arr}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), "
            f"CAST(0 AS DOUBLE), (acc, z) -> acc + z)")


def cosine_array(vec: str, na: str, targets: list, strict: bool = True) -> Column:
    """``array(cosine(vec, t1), cosine(vec, t2), ...)`` against driver-side
    targets, built as ONE SQL expression (one parse instead of many small
    plan-building calls).  Same formula and arithmetic order as :func:`cosine`;
    ``na`` is the row's squared norm computed once."""
    if not targets:
        return F.array().cast("array<double>")
    parts = []
    for t in targets:
        nb = seq_norm_sq(t)
        zero = f"`{na}` = 0" + (" OR TRUE" if nb == 0 else "")
        bad = (f"raise_error('Vectors must have the same length')" if strict else "CAST(0 AS DOUBLE)")
        parts.append(f"CASE WHEN size(`{vec}`) <> {len(t)} THEN {bad} WHEN {zero} THEN CAST(0 AS DOUBLE) "
                     f"ELSE {_dot_sql(vec, t)} / (sqrt(`{na}`) * {_sql_double(math.sqrt(nb))}) END")
    return F.expr("array(" + ", ".join(parts) + ")")


def dot_array(vec: str, targets: list) -> Column:
    """``array(dot(vec, t1), ...)`` against driver-side targets as one SQL expression."""
    if not targets:
        return F.array().cast("array<double>")
    return F.expr("array(" + ", ".join(_dot_sql(vec, t) for t in targets) + ")")
