"""Tolerance joins planned as bucketed equi-joins.

Spark plans ``abs(a - b) <= tol`` on its own as a nested loop.  Here both sides
get the bucket ``floor(x / tol)``, the probe side is copied into the two
neighbouring buckets, and the exact predicate filters the equi-join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Copies of the probe side per bucket: spreads a bucket that holds much of the build side.
DEFAULT_SALT = 1


def _bucket(x: Column, width: float) -> Column:
    return F.floor(x / F.lit(float(width))).cast("long")


def _around(x: Column, width: float) -> Column:
    return F.explode(F.transform(F.array(*[F.lit(i) for i in (-1, 0, 1)]), lambda i: _bucket(x, width) + i))


def band_join(
    build: DataFrame,
    probe: DataFrame,
    axes: Sequence[tuple[str, str, float]],
    keys: Sequence[str] = (),
    salt: int = DEFAULT_SALT,
) -> DataFrame:
    """Inner join where every axis satisfies ``abs(build.a - probe.b) <= tol``.

    ``axes`` lists (build column, probe column, tolerance).  ``keys`` are equal on
    both sides and appear once.  Other column names must differ.  ``salt`` > 1
    splits hot buckets of the build side by copying the (smaller) probe side.
    """
    join_cols = list(keys)
    for n, (a, b, width) in enumerate(axes):
        build = build.withColumn(f"_bucket{n}", _bucket(F.col(a), width))
        probe = probe.withColumn(f"_bucket{n}", _around(F.col(b), width))
        join_cols.append(f"_bucket{n}")
    if salt > 1:
        hashed = F.xxhash64(*[F.col(c) for c in build.columns])
        build = build.withColumn("_salt", F.pmod(hashed, F.lit(salt)).cast("int"))
        probe = probe.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
        join_cols.append("_salt")
    joined = build.join(probe, join_cols)
    for a, b, width in axes:
        joined = joined.filter(F.abs(F.col(a) - F.col(b)) <= F.lit(float(width)))
    helpers = [c for c in join_cols if c not in keys]
    return joined.drop(*helpers)
