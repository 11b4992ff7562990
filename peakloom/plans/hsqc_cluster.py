"""Cross-sample HSQC clustering: align, pair, grow, pack, label, clean."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakloom.config import ClusterConfig, HsqcTrackConfig
from peakloom.functions import masks, vectors
from peakloom.operators import clusters, exchange, hsqc_align, hsqc_clusters, hsqc_tracks, residual
from peakloom.session import cut_lineage


def aligned(peaks: DataFrame, config: HsqcTrackConfig) -> DataFrame:
    """Peaks (series_id, order_index, peak_id, c_ppm, h_ppm, intensity) with corrected places."""
    return hsqc_align.apply_coarse_shift(peaks, hsqc_align.coarse_shift(peaks, config))


def candidates(peaks: DataFrame, n_samples: int, config: HsqcTrackConfig) -> DataFrame:
    """All candidate tracks of aligned peaks."""
    return hsqc_tracks.scored_tracks(peaks, hsqc_align.pair_candidates(peaks, config), n_samples, config)


def build_tracks(peaks: DataFrame, n_samples: int, config: HsqcTrackConfig) -> DataFrame:
    """Disjoint tracks of every series, and a track for each peak left over if single tracks are kept."""
    moved = cut_lineage(aligned(peaks, config))
    found = cut_lineage(candidates(moved, n_samples, config))
    packed = exchange.pack_by_exchange(found.withColumn("weight", F.col("score")), ["series_id"], n_samples).drop("weight")
    if config.keep_singletons:
        packed = cut_lineage(packed)
        packed = packed.unionByName(hsqc_tracks.single_tracks(moved, packed, n_samples))
    return packed


def common_mask_tracks(strict: DataFrame, n_samples: int) -> DataFrame:
    """For every common mask of two or more samples the tracks that cover it, cut to its samples and packed again.

    A single-sample mask takes the tracks of exactly that sample.  ``source_mask``: the mask before the cut.
    """
    bit = lambda m: masks.sample_bit(m["order_index"], n_samples)
    pool = (
        strict.select("series_id", F.col("track_id").alias("source_id"), F.col("mask").alias("source_mask"), "members", "score", "reciprocal_fraction")
        .withColumn("common", F.explode(masks.submasks(F.col("source_mask"), n_samples)))
        .withColumn("members", F.filter("members", lambda m: F.col("common").bitwiseAND(bit(m)) != 0))
    )
    # Cut tracks of one mask are told apart by the track they come from.
    pool = cut_lineage(
        pool.select("series_id", *hsqc_tracks.described(n_samples), "score", "reciprocal_fraction", "source_mask", "source_id").withColumn("track_id", F.col("source_id"))
    )
    several = masks.popcount(F.col("mask")) >= 2
    packed = exchange.pack_by_exchange(pool.filter(several).withColumn("weight", F.col("score")), ["series_id", "mask"], n_samples)
    return packed.drop("weight").unionByName(pool.filter(~several))


def label_tracks(rows: DataFrame, n_samples: int, config: ClusterConfig) -> DataFrame:
    """series_id, idx, label by the model: masks alone, trend clusters, or the quality-guarded choice."""
    if config.model == "mask_only":
        return clusters.mask_labels(rows, n_samples)
    labels = hsqc_clusters.hsqc_trend_labels(rows, n_samples, config)
    if config.model == "pmtc":
        return labels
    score = F.array(F.least("score", F.lit(1.5)) * 0.15)
    plain = rows.withColumn("features", F.concat("profile", vectors.differences(F.col("profile")), score)).withColumnRenamed("center_c", "center")
    return clusters.guarded(cut_lineage(plain), labels, n_samples, config).select("series_id", "idx", "label")


def cluster_hsqc(peaks: DataFrame, n_samples: int, track_config: HsqcTrackConfig, config: ClusterConfig, common_mask: bool = False) -> DataFrame:
    """HSQC peak lists of many series to labelled, cleaned tracks."""
    if n_samples < 2:
        raise ValueError("cross-sample clustering needs at least two samples")
    found = build_tracks(peaks, n_samples, track_config)
    if common_mask:
        found = common_mask_tracks(cut_lineage(found), n_samples)
    rows = cut_lineage(hsqc_clusters.describe(hsqc_clusters.number_tracks(found), n_samples))
    labelled = rows.join(label_tracks(rows, n_samples, config), ["series_id", "idx"])
    axes = [("center_c", track_config.c_tol * 0.5), ("center_h", track_config.h_tol * 0.5)]
    cleaned = cut_lineage(residual.mask_residual(cut_lineage(labelled), n_samples, config, axes, strict=False))
    return residual.drop_reused_singles(cleaned)


def cluster_points(labelled: DataFrame, n_samples: int) -> DataFrame:
    """One row per cluster: number of tracks, most frequent mask and the points (c, h) in order of the tracks."""
    per_mask = labelled.groupBy("series_id", "label", "mask").agg(F.count("*").alias("n"), F.min("idx").alias("first"))
    top = F.max(F.struct("n", (-F.col("first")).alias("neg_first"), "mask")).alias("top")
    heads = per_mask.groupBy("series_id", "label").agg(top, F.sum("n").alias("n_tracks"))
    point = F.struct("idx", F.format_string("(%.4f,%.4f)", "center_c", "center_h").alias("text"))
    points = F.array_join(F.transform(F.array_sort(F.collect_list(point)), lambda p: p["text"]), ";")
    texts = labelled.groupBy("series_id", "label").agg(points.alias("points"))
    return heads.join(texts, ["series_id", "label"]).select(
        "series_id", "label", "n_tracks", masks.to_text(F.col("top.mask"), n_samples).alias("mask_text"), "points"
    )
