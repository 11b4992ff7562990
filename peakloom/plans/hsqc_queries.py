"""Registered queries: alignment, tracks and clusters of HSQC peak series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakloom.config import ClusterConfig, HsqcTrackConfig
from peakloom.operators import exchange, hsqc_align, hsqc_clusters, hsqc_tracks, packing
from peakloom.plans import fixtures as fx
from peakloom.plans import hsqc_cluster
from peakloom.plans.fixtures import N_SAMPLES
from peakloom.plans.registry import query
from peakloom.session import cut_lineage

CONFIG = HsqcTrackConfig(c_tol=2.0, h_tol=1.0, c_span_tol=2.0, h_span_tol=1.0)


def points(spark, sf_dir) -> DataFrame:
    return fx.peaks(spark, sf_dir).withColumnRenamed("ppm", "c_ppm")


NEAR_SQL = """SELECT * FROM (SELECT a.series_id, a.order_index, a.peak_id, b.peak_id AS ref_id, b.ppm - a.ppm AS dc, b.h_ppm - a.h_ppm AS dh,
      row_number() OVER (PARTITION BY a.series_id, a.peak_id ORDER BY sqrt(((b.ppm - a.ppm) / 4) * ((b.ppm - a.ppm) / 4)
        + ((b.h_ppm - a.h_ppm) / 2) * ((b.h_ppm - a.h_ppm) / 2)), b.peak_id) AS r
    FROM fx_peaks a JOIN fx_peaks b ON a.series_id = b.series_id AND a.order_index > 0 AND b.order_index = 0
      AND abs(a.ppm - b.ppm) <= 4.0 AND abs(a.h_ppm - b.h_ppm) <= 2.0) WHERE r = 1"""


@query(
    "coarse_shift_2d",
    f"""SELECT series_id, order_index, round(greatest(-4.0, least(4.0, median(dc))), 6) AS c_move,
          round(greatest(-2.0, least(2.0, median(dh))), 6) AS h_move FROM ({NEAR_SQL}) GROUP BY 1, 2""",
)
def coarse_shift_2d(spark, sf_dir):
    moves = hsqc_align.coarse_shift(points(spark, sf_dir), CONFIG)
    return moves.select("series_id", "order_index", F.round("c_move", 6).alias("c_move"), F.round("h_move", 6).alias("h_move"))


@query(
    "hsqc_pair_candidates",
    """WITH p AS (SELECT a.series_id, a.order_index AS order_a, b.order_index AS order_b, a.peak_id AS a, b.peak_id AS b,
          sqrt(((a.ppm - b.ppm) / 2) * ((a.ppm - b.ppm) / 2) + (a.h_ppm - b.h_ppm) * (a.h_ppm - b.h_ppm)) AS d
        FROM fx_peaks a JOIN fx_peaks b ON a.series_id = b.series_id AND a.order_index < b.order_index
          AND abs(a.ppm - b.ppm) <= 2.0 AND abs(a.h_ppm - b.h_ppm) <= 1.0),
        r AS (SELECT *, row_number() OVER (PARTITION BY order_a, order_b, a ORDER BY d, b) = 1
          AND row_number() OVER (PARTITION BY order_a, order_b, b ORDER BY d, a) = 1 AS reciprocal FROM p)
       SELECT series_id, order_a, order_b, a, b, reciprocal,
         round(greatest(0, 1 - d * 0.5::DOUBLE) + CASE WHEN reciprocal THEN 0.18::DOUBLE ELSE 0 END, 6) AS score FROM r""",
)
def hsqc_pair_candidates(spark, sf_dir):
    raw = points(spark, sf_dir).withColumn("c_corr", F.col("c_ppm")).withColumn("h_corr", F.col("h_ppm"))
    found = hsqc_align.pair_candidates(raw, CONFIG)
    return found.select("series_id", "order_a", "order_b", "a", "b", "reciprocal", F.round("score", 6).alias("score"))


# Peaks after the coarse shift, and their pairs.
MOVED_SQL = f"""moves AS (SELECT series_id, order_index, greatest(-4.0, least(4.0, median(dc))) AS dc, greatest(-2.0, least(2.0, median(dh))) AS dh
      FROM ({NEAR_SQL}) GROUP BY 1, 2),
    moved AS (SELECT p.series_id, p.order_index, p.peak_id, intensity, round(ppm + coalesce(dc, 0), 5) AS c, round(h_ppm + coalesce(dh, 0), 5) AS h
      FROM fx_peaks p LEFT JOIN moves m ON m.series_id = p.series_id AND m.order_index = p.order_index),
    close AS (SELECT a.series_id, a.order_index AS order_a, b.order_index AS order_b, a.peak_id AS a, b.peak_id AS b,
        sqrt(((a.c - b.c) / 2) * ((a.c - b.c) / 2) + (a.h - b.h) * (a.h - b.h)) AS distance
      FROM moved a JOIN moved b ON a.series_id = b.series_id AND a.order_index < b.order_index AND abs(a.c - b.c) <= 2.0 AND abs(a.h - b.h) <= 1.0),
    pairs AS (SELECT *, greatest(0, 1 - distance * 0.5::DOUBLE) + CASE WHEN reciprocal THEN 0.18::DOUBLE ELSE 0 END AS score FROM (
      SELECT *, row_number() OVER (PARTITION BY series_id, order_a, order_b, a ORDER BY distance, b) = 1
        AND row_number() OVER (PARTITION BY series_id, order_a, order_b, b ORDER BY distance, a) = 1 AS reciprocal FROM close))"""


@query(
    "hsqc_aligned_pairs",
    f"""WITH {MOVED_SQL}
       SELECT series_id, order_a, order_b, a, b, round(distance, 6) AS distance, reciprocal, round(score, 6) AS score FROM pairs""",
)
def hsqc_aligned_pairs(spark, sf_dir):
    """Pair candidates after the coarse shift."""
    found = hsqc_align.pair_candidates(hsqc_cluster.aligned(points(spark, sf_dir), CONFIG), CONFIG)
    return found.withColumns({c: F.round(c, 6) for c in ("distance", "score")})


EDGES_SQL = """edges AS (SELECT series_id, peak_id, other_id, max(score) AS score, bool_or(reciprocal) AS reciprocal FROM (
      SELECT series_id, a AS peak_id, b AS other_id, score, reciprocal FROM pairs UNION ALL SELECT series_id, b, a, score, reciprocal FROM pairs)
      GROUP BY 1, 2, 3)"""


@query(
    "hsqc_pair_maps",
    f"""WITH {MOVED_SQL}, {EDGES_SQL} SELECT series_id, peak_id, other_id, round(score, 6) AS score, reciprocal FROM edges""",
)
def hsqc_pair_maps(spark, sf_dir):
    """Best score and reciprocal flag of every linked pair, both ways."""
    pairs = hsqc_align.pair_candidates(hsqc_cluster.aligned(points(spark, sf_dir), CONFIG), CONFIG)
    return hsqc_tracks.pair_maps(pairs).withColumn("score", F.round("score", 6))


def _middle(values: str) -> str:
    return f"list_aggregate({values}, 'median')"


def _reach(values: str) -> str:
    """Largest distance from the middle."""
    return f"list_max(list_transform({values}, lambda x: abs(x - {_middle(values)})))"


def _fits(c: str, h: str) -> str:
    spans = f"list_max({c}) - list_min({c}) <= 2.0 AND list_max({h}) - list_min({h}) <= 1.0"
    return f"{spans} AND {_reach(c)} <= 1.35 * 2.0 AND {_reach(h)} <= 1.35 * 1.0"


# Every set of peaks that grows by linked peaks in the order of the samples of its component.
TRACKS_SQL = f"""{MOVED_SQL}, {EDGES_SQL},
    reach AS (SELECT DISTINCT series_id, peak_id, peak_id AS other_id FROM edges UNION
      SELECT r.series_id, r.peak_id, e.other_id FROM reach r JOIN edges e ON e.series_id = r.series_id AND e.peak_id = r.other_id),
    inside AS (SELECT m.*, part, ln(greatest(abs(intensity), 1e-12)) AS v FROM moved m
      JOIN (SELECT series_id, peak_id, min(other_id) AS part FROM reach GROUP BY 1, 2) r ON r.series_id = m.series_id AND r.peak_id = m.peak_id),
    places AS (SELECT series_id, part, order_index, row_number() OVER (PARTITION BY series_id, part ORDER BY count(*), order_index) AS place
      FROM inside GROUP BY 1, 2, 3),
    placed AS (SELECT i.*, place FROM inside i JOIN places p ON p.series_id = i.series_id AND p.part = i.part AND p.order_index = i.order_index),
    grown AS (SELECT series_id, part, place, [peak_id] AS ids, [c] AS cs, [h] AS hs, [order_index] AS orders, [v] AS vs FROM placed
      UNION
      SELECT g.series_id, g.part, n.place, list_append(ids, n.peak_id), list_append(cs, n.c), list_append(hs, n.h), list_append(orders, n.order_index),
        list_append(vs, n.v)
      FROM grown g JOIN placed n ON n.series_id = g.series_id AND n.part = g.part AND n.place > g.place
      WHERE EXISTS (SELECT 1 FROM edges e WHERE e.series_id = g.series_id AND e.peak_id = n.peak_id AND list_contains(ids, e.other_id))
        AND {_fits("list_append(cs, n.c)", "list_append(hs, n.h)")}),
    several AS (SELECT *, row_number() OVER () AS tid, len(ids) AS n FROM grown WHERE len(ids) >= 2),
    linked AS (SELECT tid, count(*) AS n_pairs, sum(e.score) AS pair_sum, count(*) FILTER (e.reciprocal) AS n_mutual
      FROM (SELECT tid, series_id, ids, unnest(ids) AS peak_id FROM several) s
      JOIN edges e ON e.series_id = s.series_id AND e.peak_id = s.peak_id AND e.peak_id < e.other_id AND list_contains(ids, e.other_id) GROUP BY 1),
    stepped AS (SELECT tid, list(step) AS steps FROM (
        SELECT tid, v - lag(v) OVER w AS step, o - lag(o) OVER w AS gap FROM (SELECT tid, unnest(orders) AS o, unnest(vs) AS v FROM several)
        WINDOW w AS (PARTITION BY tid ORDER BY o)) WHERE gap = 1 GROUP BY 1),
    penal AS (SELECT tid, CASE WHEN len(steps) >= 2 THEN {_reach("steps")} ELSE 0 END AS gap,
        len(list_filter(steps, lambda s: s > 0.35)) * len(list_filter(steps, lambda s: s < -0.35)) AS turns FROM stepped),
    tracks AS (SELECT *, 2.15::DOUBLE * n + 0.75::DOUBLE * greatest(n - 2, 0) - 0.5::DOUBLE * ({N_SAMPLES} - n) - 1.8::DOUBLE * c_span / 2 - 1.35::DOUBLE * h_span
        + 1.2::DOUBLE * pair_sum - 0.3::DOUBLE * gap - 0.65::DOUBLE * turns AS score
      FROM (SELECT s.series_id, array_to_string(list_sort(ids), '_') AS track_id, s.n, orders, vs,
          CAST(list_sum(list_transform(orders, lambda o: 1 << ({N_SAMPLES} - 1 - o))) AS BIGINT) AS mask, {_middle("cs")} AS center_c, {_middle("hs")} AS center_h,
          list_max(cs) - list_min(cs) AS c_span, list_max(hs) - list_min(hs) AS h_span, pair_sum, n_mutual / n_pairs AS reciprocal_fraction,
          coalesce(gap, 0) AS gap, coalesce(turns, 0) AS turns
        FROM several s JOIN linked l ON l.tid = s.tid LEFT JOIN penal p ON p.tid = s.tid))"""

MEASURES = ("center_c", "center_h", "c_span", "h_span", "score", "reciprocal_fraction")


def candidates(spark, sf_dir) -> DataFrame:
    return hsqc_cluster.candidates(cut_lineage(hsqc_cluster.aligned(points(spark, sf_dir), CONFIG)), N_SAMPLES, CONFIG)


@query(
    "hsqc_tracks",
    f"""WITH RECURSIVE {TRACKS_SQL}
       SELECT series_id, track_id, n AS n_members, mask, {", ".join(f"round({c}, 6) AS {c}" for c in MEASURES)} FROM tracks WHERE score >= 0.4""",
)
def hsqc_candidate_tracks(spark, sf_dir):
    """Every track of two or more samples with its score."""
    found = candidates(spark, sf_dir).drop("members")
    return found.withColumn("n_members", F.col("n_members").cast("long")).withColumns({c: F.round(c, 6) for c in MEASURES})


@query(
    "hsqc_packing",
    "SELECT DISTINCT series_id, true AS disjoint, true AS maximal, true AS settled, true AS heavier FROM "
    f"(WITH RECURSIVE {TRACKS_SQL} SELECT series_id FROM tracks WHERE score >= 0.4)",
)
def hsqc_packing(spark, sf_dir):
    """Per series: no peak is used twice, no free track is left, no track outweighs the ones it would replace,
    and the weight is at least that of taking the heaviest first."""
    found = cut_lineage(candidates(spark, sf_dir).withColumn("weight", F.col("score")))
    chosen = cut_lineage(exchange.pack_by_exchange(found, ["series_id"], N_SAMPLES).select("series_id", "track_id", "weight", "members"))
    greedy = packing.pack_by_dominance(found, ["series_id"]).join(found, ["series_id", "track_id"])
    used = chosen.select("series_id", F.col("track_id").alias("by"), F.col("weight").alias("by_weight"), F.explode("members.peak_id").alias("peak_id"))
    once = used.groupBy("series_id", "peak_id").agg(F.count("*").alias("n")).groupBy("series_id").agg((F.max("n") == 1).alias("disjoint"))
    rest = found.join(chosen, ["series_id", "track_id"], "left_anti").select("series_id", "track_id", "weight", F.explode("members.peak_id").alias("peak_id"))
    owners = rest.join(used, ["series_id", "peak_id"], "left").groupBy("series_id", "track_id", "weight").agg(F.collect_set(F.struct("by", "by_weight")).alias("o"))
    held = F.aggregate(F.filter("o", lambda x: x["by"].isNotNull()), F.lit(0.0), lambda total, x: total + x["by_weight"])
    left = owners.groupBy("series_id").agg(
        F.bool_and(held > 0).alias("maximal"), F.bool_and(F.col("weight") - held <= exchange.LEAST_GAIN).alias("settled")
    )
    weights = [df.groupBy("series_id").agg(F.sum("weight").alias(name)) for df, name in ((chosen, "own"), (greedy, "plain"))]
    return (
        once.join(left, "series_id", "left")
        .join(weights[0], "series_id")
        .join(weights[1], "series_id")
        .select(
            "series_id",
            "disjoint",
            *[F.coalesce(c, F.lit(True)).alias(c) for c in ("maximal", "settled")],
            (F.col("own") >= F.col("plain") - 1e-9).alias("heavier"),
        )
    )


_PROFILE = (
    f"[coalesce(v[list_position(orders, i)], 0) for i in range({N_SAMPLES})]"
)


@query(
    "hsqc_bucket_plan",
    f"""WITH RECURSIVE {TRACKS_SQL},
        kept AS (SELECT *, list_transform(vs, lambda x: x - {_middle("vs")}) AS v FROM tracks WHERE score >= 0.4),
        wide AS (SELECT *, {_PROFILE} AS p FROM kept),
        features AS (SELECT series_id, mask, p || [p[i + 2] - p[i + 1] for i in range({N_SAMPLES - 1})]
            || [0.2 / 220 * center_c, 0.2 / 12 * center_h, 0.15 * least(score, 1.5)] AS f FROM wide),
        spread AS (SELECT series_id, mask, max(coalesce(s, 0)) AS deviation FROM (
            SELECT series_id, mask, j, stddev_samp(x) AS s FROM (SELECT series_id, mask, unnest(f) AS x, unnest(range(len(f))) AS j FROM features)
            GROUP BY 1, 2, 3) GROUP BY 1, 2),
        sizes AS (SELECT series_id, mask, count(*) AS size, sum(count(*)) OVER (PARTITION BY series_id) AS n FROM kept GROUP BY 1, 2)
       SELECT s.series_id, s.mask, size, round(deviation, 6) AS deviation, CAST(greatest(ceil(size / 26.0), ceil(size / greatest(ceil(n * 0.41::DOUBLE), 1)),
         CASE WHEN size >= 6 AND deviation > 0.45 THEN least(4, greatest(2, size // 3)) ELSE 1 END) AS INTEGER) AS k
       FROM sizes s JOIN spread d ON d.series_id = s.series_id AND d.mask = s.mask""",
)
def hsqc_bucket_plan(spark, sf_dir):
    """Size, largest feature deviation and number of parts of every bucket of candidate tracks."""
    rows = hsqc_clusters.describe(candidates(spark, sf_dir), N_SAMPLES)
    plan = hsqc_clusters.bucket_plan(cut_lineage(rows), N_SAMPLES, ClusterConfig())
    return plan.select("series_id", "mask", "size", F.round("deviation", 6).alias("deviation"), "k")


def _clusters(spark, sf_dir, config: ClusterConfig, common_mask: bool) -> DataFrame:
    labelled = hsqc_cluster.cluster_hsqc(points(spark, sf_dir), N_SAMPLES, CONFIG, config, common_mask)
    return hsqc_cluster.cluster_points(labelled, N_SAMPLES)


@query("cluster_hsqc")
def cluster_hsqc(spark, sf_dir):
    """Default workflow: tracks, quality-guarded labels, cleanup."""
    return _clusters(spark, sf_dir, ClusterConfig(), False)


@query("cluster_hsqc_common_mask")
def cluster_hsqc_common_mask(spark, sf_dir):
    """Common-mask front end with trend labels."""
    return _clusters(spark, sf_dir, ClusterConfig(model="pmtc"), True)


@query("cluster_hsqc_mask_only")
def cluster_hsqc_mask_only(spark, sf_dir):
    """Common-mask front end, labels are the masks."""
    return _clusters(spark, sf_dir, ClusterConfig(model="mask_only"), True)
