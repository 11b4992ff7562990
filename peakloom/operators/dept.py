"""Carbon types from DEPT experiments."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peakloom.operators.band import band_join
from peakloom.operators.greedy import greedy_matches

LIST_TOLERANCE = 0.1


def infer_types(all_carbons: DataFrame, d135: DataFrame, d90: DataFrame, keys: Sequence[str], tol: float = 0.8) -> DataFrame:
    """Type of every carbon peak: Cq without a DEPT-135 hit, CH with a DEPT-90 hit,
    else CH3 or CH2 by the sign of the DEPT-135 height.

    Inputs have keys, peak_id, ppm; ``d135`` also has height.
    """
    keys = list(keys)
    target = all_carbons.select(*keys, F.col("peak_id").alias("target"), F.col("ppm").alias("target_ppm"))

    def hits(reference: DataFrame) -> DataFrame:
        ref = reference.select(*keys, F.col("peak_id").alias("ref"), F.col("ppm").alias("ref_ppm"))
        pairs = band_join(target, ref, [("target_ppm", "ref_ppm", tol)], keys)
        pairs = pairs.withColumn("distance", F.abs(F.col("target_ppm") - F.col("ref_ppm")))
        return greedy_matches(pairs, keys, "target", "ref", "distance")

    heights = d135.select(*keys, F.col("peak_id").alias("ref"), "height")
    hit135 = hits(d135).join(heights, [*keys, "ref"]).select(*keys, F.col("target").alias("peak_id"), "height")
    hit90 = hits(d90).select(*keys, F.col("target").alias("peak_id"), F.lit(True).alias("in90"))
    typed = all_carbons.join(hit135, [*keys, "peak_id"], "left").join(hit90, [*keys, "peak_id"], "left")
    kind = (
        F.when(F.col("height").isNull(), F.lit("Cq"))
        .when(F.col("in90"), F.lit("CH"))
        .otherwise(F.when(F.col("height") >= 0, F.lit("CH3")).otherwise(F.lit("CH2")))
    )
    return typed.withColumn("type", kind).drop("height", "in90")


def first_fit_rest(values: Sequence[float], removers: Sequence[float], tol: float = LIST_TOLERANCE) -> list[float]:
    """Values left after each remover, in order, takes the first free value within ``tol``."""
    left = list(enumerate(values))
    for r in removers:
        for at, (_, v) in enumerate(left):
            if r - tol <= v <= r + tol:
                del left[at]
                break
    return [v for _, v in left]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _rest(values: pd.Series, removers: pd.Series) -> pd.Series:
    return pd.Series([first_fit_rest(list(v), list(r)) for v, r in zip(values, removers)])


def type_lists(all_c: Column, plus135: Column, minus135: Column, d90: Column) -> list[Column]:
    """Typed query lists (0 to 3 hydrogens) of one spectrum from its four DEPT lists."""
    return [
        _rest(all_c, F.concat(plus135, minus135)).alias("h0"),
        d90.alias("h1"),
        minus135.alias("h2"),
        _rest(plus135, d90).alias("h3"),
    ]
