"""Trend clusters of HSQC tracks.

Tracks (series_id, idx, mask, members, center_c, center_h, score) of one presence mask are split by
their intensity trend; tracks of one sample stay unassigned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakloom.config import ClusterConfig
from peakloom.functions import masks, vectors
from peakloom.operators.kmeans import kmeans, zscores
from peakloom.session import cut_lineage

BUCKET = ["series_id", "mask"]
UNASSIGNED = "HSQC_unassigned"
TREND_DEVIATION = 0.45
TREND_PARTS = 4


def number_tracks(tracks: DataFrame) -> DataFrame:
    """Adds idx: the place of a track in its series by carbon and proton centre."""
    order = Window.partitionBy("series_id").orderBy("center_c", "center_h", "track_id")
    return tracks.withColumn("idx", (F.row_number().over(order) - 1).cast("long"))


def trend_profile(members: Column, n_samples: int) -> Column:
    """Log sizes by sample less their median, 0 where the track is absent."""
    middle = vectors.sorted_median(F.transform(members, lambda m: m["v"]))
    by_order = F.map_from_arrays(F.transform(members, lambda m: m["order_index"]), F.transform(members, lambda m: m["v"]))
    return F.array(*[F.coalesce(F.try_element_at(by_order, F.lit(i)) - middle, F.lit(0.0)) for i in range(n_samples)])


def describe(tracks: DataFrame, n_samples: int) -> DataFrame:
    """Adds profile and features: profile, its steps, weighted centres and score."""
    place = [F.col("center_c") * (0.20 / 220.0), F.col("center_h") * (0.20 / 12.0), F.least("score", F.lit(1.5)) * 0.15]
    wide = tracks.withColumn("profile", trend_profile(F.col("members"), n_samples))
    return wide.withColumn("features", F.concat("profile", vectors.differences(F.col("profile")), F.array(*place)))


def feature_count(n_samples: int) -> int:
    return 2 * n_samples + 2


def bucket_plan(tracks: DataFrame, n_samples: int, config: ClusterConfig) -> DataFrame:
    """Per bucket of tracks of two or more samples: size, deviation and number of parts k.

    Three triggers: too many tracks, too large a share of the series, or a feature that varies by more than the limit.
    """
    dim = feature_count(n_samples)
    several = tracks.filter(masks.popcount(F.col("mask")) >= 2)
    spread = [F.coalesce(F.stddev_samp(F.col("features")[i]), F.lit(0.0)) for i in range(dim)]
    stats = several.groupBy(*BUCKET).agg(F.count("*").alias("size"), F.greatest(*spread).alias("deviation"))
    totals = tracks.groupBy("series_id").agg(F.count("*").alias("n_tracks"))
    share = F.greatest(F.ceil(F.col("n_tracks") * config.fraction_limit(n_samples)), F.lit(1))
    least = config.min_cluster_size
    by_trend = (F.col("size") >= 2 * least) & (F.col("deviation") > TREND_DEVIATION)
    k = F.greatest(
        F.ceil(F.col("size") / config.track_limit(n_samples)),
        F.ceil(F.col("size") / share),
        F.when(by_trend, F.least(F.lit(TREND_PARTS), F.greatest(F.lit(2), F.floor(F.col("size") / least)))).otherwise(1),
    )
    return stats.join(totals, "series_id").withColumn("k", k.cast("int"))


def split_buckets(tracks: DataFrame, plan: DataFrame, n_samples: int) -> DataFrame:
    """series_id, mask, idx, part: k-means on scaled features; a bucket it leaves whole is cut by centre."""
    dim = feature_count(n_samples)
    points = cut_lineage(tracks.join(plan.filter("k > 1").select(*BUCKET, "k", "size"), BUCKET))
    found = kmeans(zscores(points.select(*BUCKET, "idx", "k", "features"), BUCKET, dim), BUCKET, dim)
    parts = points.join(found.select(*BUCKET, "idx", F.col("label").alias("part")), [*BUCKET, "idx"])
    top = parts.groupBy(*BUCKET).agg(F.max("part").alias("top"))
    order = Window.partitionBy(*BUCKET).orderBy("center_c", "center_h", "idx")
    chunk = F.greatest(F.ceil(F.col("size") / F.col("k")), F.lit(1))
    cut = parts.join(top, BUCKET).withColumn("slice", F.floor((F.row_number().over(order) - 1) / chunk))
    part = F.when(F.col("top") > 0, F.col("part")).otherwise(F.col("slice"))
    whole = tracks.join(plan.filter("k = 1").select(*BUCKET), BUCKET, "left_semi")
    return cut.select(*BUCKET, "idx", part.cast("int").alias("part")).unionByName(whole.select(*BUCKET, "idx", F.lit(0).alias("part")))


def attach_small(parts: DataFrame, tracks: DataFrame, least: int) -> DataFrame:
    """Parts of fewer than ``least`` tracks join the part of their bucket whose mean carbon centre is nearest.

    A bucket without a large part keeps its parts.
    """
    rows = parts.join(tracks.select("series_id", "idx", "center_c"), ["series_id", "idx"])
    sizes = cut_lineage(rows.groupBy(*BUCKET, "part").agg(F.count("*").alias("n"), F.avg("center_c").alias("mean")))
    good = sizes.filter(F.col("n") >= least).select(*BUCKET, F.col("part").alias("good"), F.col("mean").alias("good_mean"))
    near = F.min(F.struct(F.abs(F.col("mean") - F.col("good_mean")).alias("d"), F.col("good"))).alias("near")
    moved = sizes.filter(F.col("n") < least).join(good, BUCKET).groupBy(*BUCKET, "part").agg(near)
    joined = parts.join(moved, [*BUCKET, "part"], "left")
    return joined.withColumn("part", F.coalesce("near.good", "part")).drop("near")


def hsqc_trend_labels(tracks: DataFrame, n_samples: int, config: ClusterConfig) -> DataFrame:
    """series_id, idx, label: H01, H02, ... by the smallest idx of a cluster, or the label of unassigned tracks."""
    plan = cut_lineage(bucket_plan(tracks, n_samples, config))
    parts = cut_lineage(attach_small(split_buckets(tracks, plan, n_samples), tracks, config.min_cluster_size))
    first = parts.groupBy(*BUCKET, "part").agg(F.min("idx").alias("first"))
    number = F.row_number().over(Window.partitionBy("series_id").orderBy("first"))
    named = first.withColumn("label", F.format_string("H%02d", number)).drop("first")
    labels = parts.join(named, [*BUCKET, "part"]).select("series_id", "idx", "label")
    lone = tracks.filter(masks.popcount(F.col("mask")) < 2).select("series_id", "idx", F.lit(UNASSIGNED).alias("label"))
    return labels.unionByName(lone)
