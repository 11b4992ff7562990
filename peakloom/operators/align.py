"""Regional shift model of a peak series, and the corrected peak positions.

All differences are integers on the tick grid.  Equal positions are merged with
their counts first, so a dense spectrum costs at most its grid size.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peakloom.config import Region
from peakloom.functions import spectra
from peakloom.functions.spectra import TICKS_PER_PPM
from peakloom.operators.band import band_join

PAIR = ["series_id", "region", "order_a", "order_b"]


def _ticks(ppm: float) -> int:
    return round(ppm * TICKS_PER_PPM)


def with_ticks(peaks: DataFrame, regions: Sequence[Region]) -> DataFrame:
    return peaks.withColumn("tick", spectra.ticks(F.col("ppm"))).withColumn(
        "region", spectra.region_index(F.col("ppm"), regions)
    )


def pair_deltas(peaks: DataFrame, regions: Sequence[Region]) -> DataFrame:
    """Histogram of position differences between two samples of a series, per region.

    Columns: series_id, region, order_a, order_b, delta (ticks of b minus a), n.
    Only order_a < order_b is joined; the other direction is the mirror image.
    """
    values = (
        with_ticks(peaks, regions).groupBy("series_id", "region", "order_index", "tick").agg(F.count("*").alias("n"))
    )
    left = values.withColumnsRenamed({"order_index": "order_a", "tick": "tick_a", "n": "n_a"})
    right = values.withColumnsRenamed({"order_index": "order_b", "tick": "tick_b", "n": "n_b"})
    widest = max(_ticks(r.tol) for r in regions)
    tol = F.get(F.array(*[F.lit(_ticks(r.tol)) for r in regions]), F.col("region"))
    one_way = (
        band_join(left, right, [("tick_a", "tick_b", widest)], keys=["series_id", "region"])
        .filter("order_a < order_b")
        .withColumn("delta", F.col("tick_b") - F.col("tick_a"))
        .filter(F.abs("delta") <= tol)
        .groupBy(*PAIR, "delta")
        .agg(F.sum(F.col("n_a") * F.col("n_b")).alias("n"))
    )
    both = F.explode(
        F.array(
            F.struct("order_a", "order_b", "delta"),
            F.struct(F.col("order_b").alias("order_a"), F.col("order_a").alias("order_b"), (-F.col("delta")).alias("delta")),
        )
    )
    return one_way.select("series_id", "region", both.alias("d"), "n").select("series_id", "region", "d.*", "n")


def densest_windows(deltas: DataFrame, regions: Sequence[Region]) -> DataFrame:
    """Per sample pair and region: median and spread of the densest window of differences.

    Columns: PAIR, n, shift, residual (ppm).  The earliest window wins ties.
    """
    widths = [_ticks(spectra.window_width(r.tol)) for r in regions]
    # One frame width for all regions: differences are scaled to their common multiple.
    common = math.lcm(*widths)
    scale = F.get(F.array(*[F.lit(common // w) for w in widths]), F.col("region"))
    width = F.get(F.array(*[F.lit(w) for w in widths]), F.col("region"))
    group = Window.partitionBy(*PAIR)
    ahead = group.orderBy("scaled").rangeBetween(0, common)
    inside = (
        deltas.withColumn("scaled", F.col("delta") * scale)
        .withColumn("n_window", F.sum("n").over(ahead))
        .withColumn("best", F.max(F.struct("n_window", -F.col("delta"))).over(group))
        .withColumn("start", -F.col("best")["col2"])
        .filter((F.col("delta") >= F.col("start")) & (F.col("delta") <= F.col("start") + width))
        .withColumn("middle", F.expr("percentile(delta, 0.5D, n)").over(group))
        .withColumn("miss", F.abs(F.col("delta") - F.col("middle")))
    )
    return inside.groupBy(*PAIR).agg(
        F.sum("n").alias("n"),
        (F.first("middle") / TICKS_PER_PPM).alias("shift"),
        (F.expr("percentile(miss, 0.5D, n)") / TICKS_PER_PPM).alias("residual"),
    )


def grow_shifts(pairs: Sequence, n_samples: int) -> list[float]:
    """Cumulative shift of every sample, grown from the first one along the best supported pairs.

    ``pairs`` are (order_a, order_b, n, shift, residual), at most one per ordered pair.
    """
    known = {(p["order_a"], p["order_b"]): p for p in pairs}
    total = {0: 0.0}
    while len(total) < n_samples:
        links = [known[a, b] for a in sorted(total) for b in range(n_samples) if b not in total and (a, b) in known]
        if not links:
            break
        top = max(links, key=lambda p: p["n"] / (p["residual"] + 0.02))
        if top["n"] < 2:
            break
        total[top["order_b"]] = total[top["order_a"]] + top["shift"]
    return [total.get(i, 0.0) for i in range(n_samples)]


def shift_model(windows: DataFrame, n_samples: int) -> DataFrame:
    """Columns: series_id, region, order_index, shift; groups hold at most n_samples squared rows."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def grow(pairs: pd.Series) -> pd.Series:
        return pairs.map(lambda p: grow_shifts(p, n_samples))

    pair = F.struct("order_a", "order_b", "n", "shift", "residual")
    return (
        windows.groupBy("series_id", "region")
        .agg(F.array_sort(F.collect_list(pair)).alias("pairs"))
        .select("series_id", "region", F.posexplode(grow("pairs")).alias("order_index", "shift"))
    )


def apply_shift(peaks: DataFrame, shifts: DataFrame, regions: Sequence[Region]) -> DataFrame:
    """Add ``ppm_corr`` and ``tick_corr``; the shift is subtracted. Unknown shifts count as zero."""
    moved = F.floor(F.coalesce("shift", F.lit(0.0)) * TICKS_PER_PPM + 0.5).cast("long")
    return (
        with_ticks(peaks, regions)
        .join(shifts, ["series_id", "region", "order_index"], "left")
        .withColumn("tick_corr", F.col("tick") - moved)
        .withColumn("ppm_corr", F.col("tick_corr") / F.lit(float(TICKS_PER_PPM)))
        .drop("shift")
    )
