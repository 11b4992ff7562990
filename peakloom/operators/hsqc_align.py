"""Two-dimensional alignment of HSQC peak series: coarse shift and scored pair candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peakloom.config import HsqcTrackConfig
from peakloom.functions import spectra
from peakloom.operators.band import band_join


def _scaled(dc, dh, c_scale: float, h_scale: float):
    return F.sqrt((dc / c_scale) * (dc / c_scale) + (dh / h_scale) * (dh / h_scale))


def coarse_shift(peaks: DataFrame, config: HsqcTrackConfig) -> DataFrame:
    """Median move of each sample onto the first one: series_id, order_index, c_move, h_move.

    Each peak takes its nearest reference peak inside twice the tolerances (at least
    2.0 and 0.25 ppm); the medians are clipped to that window.  The move is added.
    """
    c_win, h_win = max(2.0, 2 * config.c_tol), max(0.25, 2 * config.h_tol)
    ref = peaks.filter("order_index = 0").select(
        "series_id", F.col("peak_id").alias("ref_id"), F.col("c_ppm").alias("ref_c"), F.col("h_ppm").alias("ref_h")
    )
    moving = peaks.filter("order_index > 0").select("series_id", "order_index", "peak_id", "c_ppm", "h_ppm")
    near = band_join(moving, ref, [("c_ppm", "ref_c", c_win), ("h_ppm", "ref_h", h_win)], ["series_id"])
    dc, dh = F.col("ref_c") - F.col("c_ppm"), F.col("ref_h") - F.col("h_ppm")
    best = F.min(F.struct(_scaled(dc, dh, c_win, h_win).alias("d"), "ref_id", dc.alias("dc"), dh.alias("dh"))).alias("b")
    nearest = near.groupBy("series_id", "order_index", "peak_id").agg(best)
    return nearest.groupBy("series_id", "order_index").agg(
        spectra.clip(F.median("b.dc"), -c_win, c_win).alias("c_move"),
        spectra.clip(F.median("b.dh"), -h_win, h_win).alias("h_move"),
    )


def apply_coarse_shift(peaks: DataFrame, moves: DataFrame) -> DataFrame:
    """Adds c_corr and h_corr, on a grid of 1e-5 ppm."""
    return (
        peaks.join(moves, ["series_id", "order_index"], "left")
        .withColumn("c_corr", F.round(F.col("c_ppm") + F.coalesce("c_move", F.lit(0.0)), 5))
        .withColumn("h_corr", F.round(F.col("h_ppm") + F.coalesce("h_move", F.lit(0.0)), 5))
        .drop("c_move", "h_move")
    )


def pair_candidates(peaks: DataFrame, config: HsqcTrackConfig) -> DataFrame:
    """Pairs of peaks of two samples inside box and span, with score and mutual-nearest flag.

    Columns: series_id, order_a, order_b, a, b, distance, reciprocal, score.
    """
    def side(name: str) -> DataFrame:
        return peaks.select(
            "series_id",
            F.col("order_index").alias(f"order_{name}"),
            F.col("peak_id").alias(name),
            F.col("c_corr").alias(f"c_{name}"),
            F.col("h_corr").alias(f"h_{name}"),
        )

    c_limit, h_limit = min(config.c_tol, config.c_span_tol), min(config.h_tol, config.h_span_tol)
    pairs = band_join(side("a"), side("b"), [("c_a", "c_b", c_limit), ("h_a", "h_b", h_limit)], ["series_id"])
    distance = _scaled(F.col("c_a") - F.col("c_b"), F.col("h_a") - F.col("h_b"), config.c_tol, config.h_tol)
    pairs = pairs.filter("order_a < order_b").withColumn("distance", distance)
    by_a = Window.partitionBy("series_id", "order_a", "order_b", "a").orderBy("distance", "b")
    by_b = Window.partitionBy("series_id", "order_a", "order_b", "b").orderBy("distance", "a")
    ranked = pairs.withColumn("_ra", F.row_number().over(by_a)).withColumn("_rb", F.row_number().over(by_b))
    mutual = (F.col("_ra") == 1) & (F.col("_rb") == 1)
    bonus = F.when(mutual, F.lit(config.reciprocal_bonus)).otherwise(F.lit(0.0))
    score = F.greatest(F.lit(0.0), F.lit(1.0) - F.col("distance") * 0.5) + bonus
    return ranked.select(
        "series_id", "order_a", "order_b", "a", "b", "distance", mutual.alias("reciprocal"), score.alias("score")
    )
