"""Registered queries: k-means, quality measures, track clustering and cleanup."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peakloom.config import AlignConfig, ClusterConfig, PackConfig
from peakloom.functions import vectors
from peakloom.operators import clusters, quality, residual, tracks
from peakloom.operators.kmeans import kmeans
from peakloom.plans import cross_sample, series_queries
from peakloom.plans import fixtures as fx
from peakloom.plans.fixtures import N_SAMPLES
from peakloom.plans.registry import query
from peakloom.session import cut_lineage, table

WIDE = AlignConfig(span_limit=1.2, residual_gate=1.0)
PACK = PackConfig(high_mask_bonus=0.10, stratify_by_mask=False)
COMMON = PackConfig()
STRICT = ClusterConfig(max_cluster_rise=1)
DIM = 64


def vectors_of(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.lit(0).alias("part"), F.col("vec_id").alias("idx"), "label", F.col("embedding").cast("array<double>").alias("features")
    )


@query(
    "vector_to_mean",
    """WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS j FROM embeddings),
        m AS (SELECT label, j, avg(x) AS m FROM e GROUP BY 1, 2)
       SELECT vec_id, e.label, round(sqrt(sum((x - m) * (x - m)) / 64), 6) AS rms,
         round(1 - sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))), 6) AS cosine
       FROM e JOIN m ON m.label = e.label AND m.j = e.j GROUP BY 1, 2""",
)
def vector_to_mean(spark, sf_dir):
    """RMS and cosine distance of every vector to the mean of its label."""
    points = vectors_of(spark, sf_dir)
    means = points.groupBy("label").agg(F.array(*[F.avg(F.col("features")[j]) for j in range(DIM)]).alias("mean"))
    x, m = F.col("features"), F.col("mean")
    return points.join(means, "label").select(
        F.col("idx").alias("vec_id"),
        "label",
        F.round(vectors.rms_euclid(x, m), 6).alias("rms"),
        F.round(vectors.cosine_distance(x, m), 6).alias("cosine"),
    )


SSE_SQL = """WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS j FROM embeddings),
    s AS (SELECT label, sum(v) * n / 64 AS sse, n FROM (SELECT label, j, var_pop(x) AS v, count(*) AS n FROM e GROUP BY 1, 2)
      GROUP BY label, n)"""


@query(
    "cluster_quality",
    SSE_SQL
    + """ SELECT round(sum(sse) / sum(n), 9) AS cohesion,
        round(sum(CASE WHEN n > 2 THEN pow(greatest(0, sse / n - 0.42), 2) * n ELSE 0 END), 9) AS overmerge,
        count(*) AS n_clusters FROM s""",
)
def cluster_quality(spark, sf_dir):
    stats = quality.cohesion(vectors_of(spark, sf_dir), ["part"], DIM)
    return stats.select(F.round("cohesion", 9).alias("cohesion"), F.round("overmerge", 9).alias("overmerge"), "n_clusters")


@query(
    "silhouette",
    """WITH d AS (SELECT a.vec_id, a.label, b.label AS other, sum(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / 8) AS t,
          count(*) AS n FROM embeddings a CROSS JOIN embeddings b GROUP BY 1, 2, 3),
        p AS (SELECT vec_id, coalesce(max(CASE WHEN label = other AND n > 1 THEN t / (n - 1) END), 0) AS a,
          min(CASE WHEN label <> other THEN t / n END) AS b FROM d GROUP BY 1)
       SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM p""",
)
def silhouette(spark, sf_dir):
    value = quality.silhouette(vectors_of(spark, sf_dir), ["part"])
    return value.select(F.round("silhouette", 6).alias("silhouette"))


@query("kmeans_vectors")
def kmeans_vectors(spark, sf_dir):
    points = vectors_of(spark, sf_dir).drop("label").withColumn("k", F.lit(10))
    return kmeans(points, ["part"], DIM).select(F.col("idx").alias("vec_id"), F.col("label").alias("cluster"))


def described(spark, sf_dir) -> DataFrame:
    """Globally packed tracks of all series with profiles and features."""
    selected = series_queries.packed(spark, sf_dir, PACK)
    return cut_lineage(tracks.describe(selected, N_SAMPLES))


@query("kmeans_tracks")
def kmeans_tracks(spark, sf_dir):
    """Two-way split of every mask bucket by trend features."""
    points = described(spark, sf_dir).withColumn("k", F.lit(2))
    cut = clusters.split_by_feature(
        points.select("series_id", "mask", "idx", "center", "k", "features"), ["series_id", "mask"], 2 * N_SAMPLES
    )
    return cut.select("series_id", "mask", "idx", "piece")


@query("cluster_pmtc")
def cluster_pmtc(spark, sf_dir):
    return clusters.pmtc(described(spark, sf_dir), N_SAMPLES, ClusterConfig())


@query("cluster_directional")
def cluster_directional(spark, sf_dir):
    return clusters.directional(described(spark, sf_dir), N_SAMPLES, ClusterConfig())


@query("cluster_profile_merge")
def cluster_profile_merge(spark, sf_dir):
    rows = described(spark, sf_dir)
    return clusters.merge_by_profile(rows, clusters.pmtc(rows, N_SAMPLES, STRICT), N_SAMPLES, STRICT)


@query("cluster_guarded")
def cluster_guarded(spark, sf_dir):
    """Quality-guarded labels with the strategy chosen for each series."""
    rows = described(spark, sf_dir)
    return clusters.guarded(rows, clusters.pmtc(rows, N_SAMPLES, STRICT), N_SAMPLES, STRICT)


def _blocks(spark, sf_dir, config, pack, common_mask):
    labelled = cross_sample.cluster_series(fx.peaks(spark, sf_dir), N_SAMPLES, WIDE, pack, config, common_mask)
    return cross_sample.cluster_blocks(labelled, N_SAMPLES)


@query("cluster_13c_global")
def cluster_13c_global(spark, sf_dir):
    """Default workflow: global packing, quality-guarded labels, cleanup."""
    return _blocks(spark, sf_dir, STRICT, PACK, False)


@query("cluster_13c_common_mask")
def cluster_13c_common_mask(spark, sf_dir):
    """Common-mask front end with trend labels."""
    return _blocks(spark, sf_dir, ClusterConfig(model="pmtc"), COMMON, True)


@query("cluster_13c_mask_only")
def cluster_13c_mask_only(spark, sf_dir):
    """Common-mask front end, labels are the masks."""
    return _blocks(spark, sf_dir, ClusterConfig(model="mask_only"), COMMON, True)


def simple_tracks(spark, sf_dir) -> DataFrame:
    """Cell tracks labelled by mask, numbered by cell."""
    members = fx.members(spark, sf_dir).groupBy("series_id", "cell").agg(
        F.array_sort(F.collect_list(F.struct("order_index", "peak_id", "ppm"))).alias("members")
    )
    rows = series_queries.masked(spark, sf_dir).join(members, ["series_id", "cell"])
    return rows.select(
        "series_id",
        F.col("cell").cast("long").alias("idx"),
        "mask",
        "center",
        "members",
        F.concat(F.lit("M"), F.col("mask").cast("string")).alias("label"),
    )


@query("mask_residual")
def mask_residual(spark, sf_dir):
    return residual.mask_residual(
        simple_tracks(spark, sf_dir), N_SAMPLES, ClusterConfig(), [("center", 0.5)]
    ).select("series_id", "idx", "mask", "label")


@query(
    "small_cluster_filter",
    """SELECT series_id, mask, count(*) AS n_tracks, min(cell) AS first_cell FROM fx_masks GROUP BY 1, 2 HAVING count(*) >= 5""",
)
def small_cluster_filter(spark, sf_dir):
    groups = series_queries.masked(spark, sf_dir).groupBy("series_id", "mask")
    return groups.agg(F.count("*").alias("n_tracks"), F.min("cell").alias("first_cell")).filter("n_tracks >= 5")


@query(
    "cluster_display_order",
    """SELECT series_id, mask, n_tracks, CAST(row_number() OVER (PARTITION BY series_id ORDER BY mask DESC, n_tracks DESC)
        AS INTEGER) AS pos FROM (SELECT series_id, mask, count(*) AS n_tracks FROM fx_masks GROUP BY 1, 2)""",
)
def cluster_display_order(spark, sf_dir):
    groups = series_queries.masked(spark, sf_dir).groupBy("series_id", "mask").agg(F.count("*").alias("n_tracks"))
    order = Window.partitionBy("series_id").orderBy(F.desc("mask"), F.desc("n_tracks"))
    return groups.withColumn("pos", F.row_number().over(order))


@query(
    "merge_clusters",
    """SELECT series_id, array_to_string(list_sort(list(printf('%.3f', center)) ), ', ') AS text, count(*) AS n
       FROM fx_masks WHERE bit_count(mask) >= 2 GROUP BY 1""",
)
def merge_clusters(spark, sf_dir):
    """The values of all multi-sample clusters of a series as one text list."""
    rows = series_queries.masked(spark, sf_dir).filter("n_members >= 2")
    texts = F.array_join(F.array_sort(F.collect_list(F.format_string("%.3f", F.col("center")))), ", ")
    return rows.groupBy("series_id").agg(texts.alias("text"), F.count("*").alias("n"))


LABELS_SQL = """SELECT series_id, cell, mask % 4 AS truth, mask % 3 AS found FROM fx_masks"""


@query(
    "adjusted_rand",
    f"""WITH l AS ({LABELS_SQL}),
        c AS (SELECT series_id, truth, found, count(*) AS n FROM l GROUP BY 1, 2, 3),
        t AS (SELECT series_id, sum(n * (n - 1) / 2.0::DOUBLE) AS s FROM (SELECT series_id, truth, sum(n) AS n FROM c GROUP BY 1, 2) GROUP BY 1),
        f AS (SELECT series_id, sum(n * (n - 1) / 2.0::DOUBLE) AS s FROM (SELECT series_id, found, sum(n) AS n FROM c GROUP BY 1, 2) GROUP BY 1),
        b AS (SELECT series_id, sum(n * (n - 1) / 2.0::DOUBLE) AS tp, sum(n) * (sum(n) - 1) / 2.0::DOUBLE AS every FROM c GROUP BY 1),
        x AS (SELECT b.series_id, tp, t.s AS tr, f.s AS fo, t.s * f.s / nullif(every, 0) AS ex FROM b
          JOIN t ON t.series_id = b.series_id JOIN f ON f.series_id = b.series_id),
        p AS (SELECT *, coalesce(tp / nullif(fo, 0), 1) AS pr, coalesce(tp / nullif(tr, 0), 1) AS re FROM x)
       SELECT series_id, round(coalesce((tp - ex) / nullif((tr + fo) / 2 - ex, 0), 0), 6) AS ari, round(pr, 6) AS precision,
         round(re, 6) AS recall, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0), 6) AS f1 FROM p""",
)
def adjusted_rand(spark, sf_dir):
    labels = series_queries.masked(spark, sf_dir).select(
        "series_id", (F.col("mask") % 4).alias("truth"), (F.col("mask") % 3).alias("found")
    )
    scores = quality.agreement(labels, ["series_id"], "truth", "found")
    return scores.select("series_id", *[F.round(c, 6).alias(c) for c in ("ari", "precision", "recall", "f1")])


@query(
    "recovery_1ppm",
    """WITH tracks AS (SELECT series_id, concat('M', CAST(mask AS VARCHAR)) AS label, center FROM fx_masks),
        sizes AS (SELECT series_id, label, count(*) AS n FROM tracks GROUP BY 1, 2),
        atoms AS (SELECT query_id AS component, peak_id, shift FROM fx_query_peaks),
        totals AS (SELECT component, count(*) AS n_atoms FROM atoms GROUP BY 1),
        found AS (SELECT t.series_id, t.label, component, count(DISTINCT peak_id) AS recovered FROM tracks t
          JOIN atoms a ON abs(t.center - a.shift) <= 1.0 GROUP BY 1, 2, 3),
        best AS (SELECT f.*, recovered / n AS ratio, row_number() OVER (PARTITION BY f.series_id, component
          ORDER BY recovered DESC, recovered / n DESC, f.label) AS r FROM found f JOIN sizes s ON s.series_id = f.series_id AND s.label = f.label),
        rated AS (SELECT series_id, b.component, label, recovered, n_atoms, recovered / n_atoms AS recall, ratio FROM best b
          JOIN totals t ON t.component = b.component WHERE r = 1)
       SELECT series_id, component, label, recovered, n_atoms, round(recall, 6) AS recall, round(ratio, 6) AS ratio, CASE
         WHEN recall >= 0.8 AND ratio >= 0.7 THEN 'good' WHEN recall >= 0.8 THEN 'mixed' WHEN ratio >= 0.7 THEN 'fragmented' ELSE 'poor' END AS status
       FROM rated""",
)
def recovery_1ppm(spark, sf_dir):
    """Atoms of each query spectrum within 1 ppm of the best mask cluster of every series."""
    labelled = series_queries.masked(spark, sf_dir).select("series_id", F.concat(F.lit("M"), F.col("mask").cast("string")).alias("label"), "center")
    atoms = fx.query_peaks(spark, sf_dir).select(F.col("query_id").alias("component"), F.col("peak_id").alias("atom_id"), F.col("shift").alias("ppm"))
    return quality.recovery(labelled, atoms).withColumns({c: F.round(c, 6) for c in ("recall", "ratio")})
