"""Reproducible draws.

A draw is a hash of its seed and labels, so it does not depend on the
partitioning, the plan, or a task being run again after an executor is lost.
"""

from __future__ import annotations

from math import exp, factorial

from pyspark.sql import Column, functions as F


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value if isinstance(value, Column) else F.lit(value)


def uniform(seed: int | str, *labels) -> Column:
    """Uniform on [0, 1) with 52 bits: the head of md5("seed-label-...")."""
    text = F.concat_ws("-", F.lit(str(seed)), *[_col(x).cast("string") for x in labels])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


# Cumulative Poisson(1) probabilities; beyond 17 the tail is below one step of a draw.
POISSON_CDF = [sum(exp(-1) / factorial(j) for j in range(k + 1)) for k in range(18)]


def poisson_one(u: Column) -> Column:
    """Poisson(1) count by inversion of a uniform."""
    total = F.lit(0)
    for bound in POISSON_CDF:
        total = total + F.when(u >= F.lit(bound), 1).otherwise(0)
    return total


def normal_pair(seed: int | str, *labels) -> Column:
    """Standard normal by Box-Muller from two hashed uniforms."""
    a = uniform(seed, F.lit("a"), *labels)
    b = uniform(seed, F.lit("b"), *labels)
    return F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - a)) * F.cos(F.lit(6.283185307179586) * b)
