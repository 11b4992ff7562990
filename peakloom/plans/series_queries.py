"""Registered queries: alignment, candidate tracks, presence masks, trend vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peakloom.config import DEFAULT_REGIONS, AlignConfig, PackConfig
from peakloom.functions import masks, spectra, vectors
from peakloom.operators import align, packing, tracks
from peakloom.operators.band import band_join
from peakloom.operators.components import connected_components
from peakloom.plans import fixtures as fx
from peakloom.plans.fixtures import N_SAMPLES
from peakloom.plans.registry import query

# Wide preset: gate 1.0 ppm and span 1.2 ppm.
WIDE = AlignConfig(span_limit=1.2, residual_gate=1.0)
PACK = PackConfig(high_mask_bonus=0.10)

REGION_SQL = "CASE WHEN ppm < 50 THEN 0 WHEN ppm < 110 THEN 1 WHEN ppm < 165 THEN 2 ELSE 3 END"
TOL_TICKS_SQL = "CASE region WHEN 0 THEN 20000 WHEN 1 THEN 30000 WHEN 2 THEN 20000 ELSE 50000 END"
WIDTH_TICKS_SQL = "CASE region WHEN 0 THEN 6400 WHEN 1 THEN 9600 WHEN 2 THEN 6400 ELSE 11000 END"
TICKED_SQL = f"SELECT *, CAST(round(ppm * 100000) AS BIGINT) AS tick, {REGION_SQL} AS region FROM fx_peaks"
DELTA_SQL = f"""SELECT a.series_id, a.region, a.order_index AS order_a, b.order_index AS order_b,
      b.tick - a.tick AS delta, count(*) AS n
    FROM ({TICKED_SQL}) a JOIN ({TICKED_SQL}) b ON a.series_id = b.series_id AND a.region = b.region
      AND a.order_index <> b.order_index AND abs(b.tick - a.tick) <= {TOL_TICKS_SQL.replace("region", "a.region")}
    GROUP BY 1, 2, 3, 4, 5"""


@query("region_tolerance", f"""SELECT series_id, peak_id, ppm, CAST(region AS INTEGER) AS region,
    CASE region WHEN 0 THEN 0.2::DOUBLE WHEN 1 THEN 0.3::DOUBLE WHEN 2 THEN 0.2::DOUBLE ELSE 0.5::DOUBLE END AS tol
    FROM ({TICKED_SQL})""")
def region_tolerance(spark, sf_dir):
    ppm = F.col("ppm")
    return fx.peaks(spark, sf_dir).select(
        "series_id",
        "peak_id",
        "ppm",
        spectra.region_index(ppm, DEFAULT_REGIONS).alias("region"),
        spectra.region_tolerance(ppm, DEFAULT_REGIONS).alias("tol"),
    )


@query("pair_deltas", DELTA_SQL)
def pair_deltas(spark, sf_dir):
    return align.pair_deltas(fx.peaks(spark, sf_dir), DEFAULT_REGIONS)


WINDOW_SQL = f"""WITH d AS ({DELTA_SQL}),
    e AS (SELECT d.*, {WIDTH_TICKS_SQL} AS width FROM d),
    w AS (SELECT x.series_id, x.region, x.order_a, x.order_b, x.delta, x.width, sum(y.n) AS c FROM e x JOIN e y
      ON y.series_id = x.series_id AND y.region = x.region AND y.order_a = x.order_a AND y.order_b = x.order_b
        AND y.delta BETWEEN x.delta AND x.delta + x.width GROUP BY 1, 2, 3, 4, 5, 6),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id, region, order_a, order_b
      ORDER BY c DESC, delta) AS r FROM w) WHERE r = 1),
    inside AS (SELECT e.*, unnest(range(e.n)) AS k FROM e JOIN best b ON b.series_id = e.series_id
      AND b.region = e.region AND b.order_a = e.order_a AND b.order_b = e.order_b
      AND e.delta BETWEEN b.delta AND b.delta + b.width),
    mid AS (SELECT *, median(delta) OVER (PARTITION BY series_id, region, order_a, order_b) AS m FROM inside),
    win AS (SELECT series_id, region, order_a, order_b, count(*) AS n, round(min(m) / 100000, 6) AS shift,
      round(median(abs(delta - m)) / 100000, 6) AS residual FROM mid GROUP BY 1, 2, 3, 4)"""


@query("densest_window", WINDOW_SQL + " SELECT * FROM win")
def densest_window(spark, sf_dir):
    deltas = align.pair_deltas(fx.peaks(spark, sf_dir), DEFAULT_REGIONS)
    return align.densest_windows(deltas, DEFAULT_REGIONS).select(
        *align.PAIR, "n", F.round("shift", 6).alias("shift"), F.round("residual", 6).alias("residual")
    )


def shifts(spark, sf_dir):
    deltas = align.pair_deltas(fx.peaks(spark, sf_dir), DEFAULT_REGIONS)
    return align.shift_model(align.densest_windows(deltas, DEFAULT_REGIONS), N_SAMPLES)


def corrected(spark, sf_dir):
    return align.apply_shift(fx.peaks(spark, sf_dir), shifts(spark, sf_dir), DEFAULT_REGIONS)


@query("shift_model")
def shift_model(spark, sf_dir):
    return shifts(spark, sf_dir)


# Shift of each sample straight from the first one: the growth rule with a single step.
@query(
    "apply_pair_shift",
    WINDOW_SQL
    + f""" SELECT p.series_id, p.peak_id, p.ppm,
        (p.tick - coalesce(CAST(floor(w.shift * 100000 + 0.5) AS BIGINT), 0)) / 100000.0::DOUBLE AS ppm_corr
      FROM ({TICKED_SQL}) p LEFT JOIN (SELECT * FROM win WHERE order_a = 0 AND n >= 2) w
        ON w.series_id = p.series_id AND w.region = p.region AND w.order_b = p.order_index""",
)
def apply_pair_shift(spark, sf_dir):
    peaks = fx.peaks(spark, sf_dir)
    windows = align.densest_windows(align.pair_deltas(peaks, DEFAULT_REGIONS), DEFAULT_REGIONS)
    direct = windows.filter("order_a = 0 AND n >= 2").select(
        "series_id", "region", F.col("order_b").alias("order_index"), "shift"
    )
    return align.apply_shift(peaks, direct, DEFAULT_REGIONS).select("series_id", "peak_id", "ppm", "ppm_corr")


@query("apply_shift")
def apply_shift(spark, sf_dir):
    return corrected(spark, sf_dir).select("series_id", "sample_id", "peak_id", "ppm", "ppm_corr")


def raw_ticks(spark, sf_dir):
    """Peaks whose corrected position is the raw one."""
    return align.with_ticks(fx.peaks(spark, sf_dir), DEFAULT_REGIONS).withColumn("tick_corr", F.col("tick"))


SEED_SQL = f"""SELECT a.series_id, a.peak_id AS seed_id, a.order_index AS seed_order, a.tick AS seed_tick,
      b.order_index, b.peak_id, b.tick, row_number() OVER (PARTITION BY a.series_id, a.peak_id, b.order_index
        ORDER BY abs(b.tick - a.tick), b.peak_id) AS rank
    FROM ({TICKED_SQL}) a JOIN ({TICKED_SQL}) b ON a.series_id = b.series_id AND a.order_index <> b.order_index
      AND abs(b.tick - a.tick) <= 100000"""


@query(
    "seed_candidates",
    f"SELECT series_id, seed_id, order_index, peak_id, CAST(rank AS INTEGER) AS rank FROM ({SEED_SQL}) WHERE rank <= 3",
)
def seed_candidates(spark, sf_dir):
    return tracks.seed_candidates(raw_ticks(spark, sf_dir), WIDE).select(
        "series_id", "seed_id", "order_index", "peak_id", "rank"
    )


def _combo_sql() -> str:
    """Candidate tracks with the five samples written out as joins."""
    picks = f"pick AS (SELECT * FROM ({SEED_SQL}) WHERE rank <= 3)"
    steps = [
        f"c0 AS (SELECT series_id, peak_id AS seed_id, order_index AS seed_order, [tick] AS t, [peak_id] AS i FROM ({TICKED_SQL}))"
    ]
    for s in range(N_SAMPLES):
        steps.append(
            f"""c{s + 1} AS (SELECT * FROM c{s} UNION ALL SELECT c.series_id, c.seed_id, c.seed_order,
            list_append(c.t, p.tick), list_append(c.i, p.peak_id) FROM c{s} c JOIN pick p
            ON p.series_id = c.series_id AND p.seed_id = c.seed_id AND p.order_index = {s})"""
        )
    return (
        f"WITH {picks}, "
        + ", ".join(steps)
        + f""", fit AS (SELECT *, len(i) AS n, list_max(t) - list_min(t) AS span, list_median(t) AS mid FROM c{N_SAMPLES}
             WHERE len(i) >= 2 AND list_max(t) - list_min(t) <= 120000),
        scored AS (SELECT series_id, seed_id, array_to_string(list_sort(i), '_') AS track_id, list_sort(i) AS ids, n,
          round((SELECT sum(exp(-0.5::DOUBLE * pow((abs(u.x - mid) / 100000.0::DOUBLE) / 0.4::DOUBLE, 2.0::DOUBLE)))
              FROM (SELECT unnest(t) AS x) u) / n + n / 5.0::DOUBLE * 0.25::DOUBLE
            - greatest(0.0::DOUBLE, (span / 100000.0::DOUBLE - 1.0) * 5.0), 9) AS score FROM fit),
        top AS (SELECT *, row_number() OVER (PARTITION BY series_id, seed_id ORDER BY score DESC, n DESC, ids) AS r
          FROM scored),
        cand AS (SELECT series_id, track_id, min(n) AS n_members, round(max(score), 6) AS score FROM top WHERE r <= 6
          GROUP BY 1, 2
          UNION ALL SELECT series_id, CAST(peak_id AS VARCHAR), 1, 0.15::DOUBLE FROM fx_peaks)"""
    )


@query("candidate_tracks", _combo_sql() + " SELECT series_id, track_id, CAST(n_members AS INTEGER) AS n_members, score FROM cand")
def candidate_tracks(spark, sf_dir):
    found = tracks.candidate_tracks(raw_ticks(spark, sf_dir), N_SAMPLES, WIDE)
    return found.select("series_id", "track_id", "n_members", F.round("score", 6).alias("score"))


@query(
    "track_weights",
    _combo_sql()
    + """ SELECT series_id, track_id, CASE WHEN n_members <= 1 THEN 0.02::DOUBLE ELSE round(greatest(score, 0) * n_members
        - 1.1::DOUBLE + 0.1::DOUBLE * pow(greatest(n_members - 2, 0), 2), 4) END AS weight FROM cand""",
)
def track_weights(spark, sf_dir):
    found = candidate_tracks(spark, sf_dir)
    weight = tracks.track_weight(F.col("score"), F.col("n_members"), PACK)
    return found.select("series_id", "track_id", F.round(weight, 4).alias("weight"))


@query(
    "conflict_components",
    f"""SELECT series_id, peak_id AS node, min(peak_id) OVER (PARTITION BY series_id, g) AS component FROM (
        SELECT *, sum(CASE WHEN tick - prev <= 15000 THEN 0 ELSE 1 END) OVER (PARTITION BY series_id ORDER BY tick,
          peak_id) AS g FROM (SELECT *, lag(tick) OVER (PARTITION BY series_id ORDER BY tick, peak_id) AS prev
          FROM ({TICKED_SQL})))""",
)
def peak_components(spark, sf_dir):
    """Components of the graph that links peaks of a series within 0.15 ppm."""
    peaks = raw_ticks(spark, sf_dir)
    left = peaks.select("series_id", F.col("peak_id").alias("src"), F.col("tick").alias("tick_a"))
    right = peaks.select("series_id", F.col("peak_id").alias("dst"), F.col("tick").alias("tick_b"))
    links = band_join(left, right, [("tick_a", "tick_b", 15000)], keys=["series_id"])
    return connected_components(links, ["series_id"])


def packed(spark, sf_dir, config: PackConfig) -> DataFrame:
    """Corrected peaks to selected tracks; stratified packing lets masks reuse peaks."""
    found = tracks.candidate_tracks(corrected(spark, sf_dir), N_SAMPLES, WIDE)
    weighed = found.withColumn("mask", tracks.presence_mask(F.col("members"), N_SAMPLES)).withColumn(
        "weight", tracks.track_weight(F.col("score"), F.col("n_members"), config)
    )
    keys = ["series_id", "mask"] if config.stratify_by_mask else ["series_id"]
    return packing.pack_tracks(weighed, keys, config)


def _packed_output(chosen: DataFrame) -> DataFrame:
    return chosen.select(
        "series_id", "track_id", "mask", "n_members", "score", tracks.track_center(F.col("members")).alias("center"), "solve_mode"
    )


@query("set_packing")
def set_packing(spark, sf_dir):
    return _packed_output(packed(spark, sf_dir, PackConfig(high_mask_bonus=0.10, stratify_by_mask=False)))


@query("set_packing_by_mask")
def set_packing_by_mask(spark, sf_dir):
    return _packed_output(packed(spark, sf_dir, PACK))


def masked(spark, sf_dir) -> DataFrame:
    """Simple tracks with mask, size, median centre and span."""
    return (
        fx.members(spark, sf_dir)
        .groupBy("series_id", "cell")
        .agg(
            F.sum(masks.sample_bit(F.col("order_index"), N_SAMPLES)).alias("mask"),
            F.count("*").alias("n_members"),
            F.median("ppm").alias("center"),
            (F.max("ppm") - F.min("ppm")).alias("span"),
        )
    )


def _bits(column: str) -> str:
    return "concat(" + ", ".join(f"CAST(({column} >> {i}) & 1 AS VARCHAR)" for i in reversed(range(N_SAMPLES))) + ")"


@query(
    "presence_mask",
    f"SELECT series_id, cell, mask, {_bits('mask')} AS mask_text, n_members, round(center, 6) AS center, round(span, 6) AS span FROM fx_masks",
)
def presence_mask(spark, sf_dir):
    return masked(spark, sf_dir).select(
        "series_id",
        "cell",
        "mask",
        masks.to_text(F.col("mask"), N_SAMPLES).alias("mask_text"),
        "n_members",
        F.round("center", 6).alias("center"),
        F.round("span", 6).alias("span"),
    )


@query(
    "mask_counts",
    """SELECT series_id, mask, n FROM (SELECT series_id, mask, count(*) AS n, row_number() OVER (PARTITION BY series_id
        ORDER BY count(*) DESC, min(cell)) AS r FROM fx_masks GROUP BY 1, 2) WHERE r = 1""",
)
def mask_counts(spark, sf_dir):
    """Dominant mask of each series; the one seen first wins ties."""
    counts = masked(spark, sf_dir).groupBy("series_id", "mask").agg(F.count("*").alias("n"), F.min("cell").alias("first"))
    top = F.max(F.struct("n", (-F.col("first")).alias("neg_first"), "mask")).alias("top")
    return counts.groupBy("series_id").agg(top).select("series_id", "top.mask", "top.n")


@query(
    "mask_algebra",
    """WITH m AS (SELECT DISTINCT mask FROM fx_masks)
       SELECT a.mask AS high, b.mask AS low, CAST(bit_count(a.mask) AS INTEGER) AS high_size,
         (a.mask & b.mask) = b.mask AS contains, (a.mask & b.mask) = b.mask AND a.mask <> b.mask AS strict_superset,
         round(bit_count(a.mask & b.mask)::DOUBLE / bit_count(a.mask | b.mask), 6) AS jaccard
       FROM m a JOIN m b ON bit_count(a.mask) >= bit_count(b.mask)""",
)
def mask_algebra(spark, sf_dir):
    """Relations of the masks that occur; there are at most 2**n - 1 of them."""
    seen = masked(spark, sf_dir).select("mask").distinct()
    high, low = seen.select(F.col("mask").alias("high")), F.broadcast(seen.select(F.col("mask").alias("low")))
    a, b = F.col("high"), F.col("low")
    return high.join(low, masks.popcount(a) >= masks.popcount(b)).select(
        "high",
        "low",
        masks.popcount(a).alias("high_size"),
        masks.contains(a, b).alias("contains"),
        masks.strict_superset(a, b).alias("strict_superset"),
        F.round(masks.jaccard(a, b), 6).alias("jaccard"),
    )


@query(
    "common_mask_pool",
    f"""SELECT t.series_id, c.common_mask, count(*) AS pool, count(DISTINCT t.mask) AS source_masks, min(t.cell) AS first_cell
       FROM fx_masks t JOIN (SELECT unnest(range(1, {2**N_SAMPLES})) AS common_mask) c
         ON CASE WHEN bit_count(c.common_mask) = 1 THEN t.mask = c.common_mask ELSE (t.mask & c.common_mask) = c.common_mask END
       GROUP BY 1, 2""",
)
def common_mask_pool(spark, sf_dir):
    pool = masked(spark, sf_dir).withColumn("common_mask", F.explode(masks.submasks(F.col("mask"), N_SAMPLES)))
    return pool.groupBy("series_id", "common_mask").agg(
        F.count("*").alias("pool"), F.count_distinct("mask").alias("source_masks"), F.min("cell").alias("first_cell")
    )


@query(
    "mask_projection",
    """SELECT m.series_id, m.cell, c.common_mask, count(*) AS n_kept, round(median(m.ppm), 6) AS center,
         round(max(m.ppm) - min(m.ppm), 6) AS span
       FROM fx_members m JOIN fx_masks t ON t.series_id = m.series_id AND t.cell = m.cell
         JOIN (SELECT unnest(range(1, 32)) AS common_mask) c
         ON (CASE WHEN bit_count(c.common_mask) = 1 THEN t.mask = c.common_mask
             ELSE (t.mask & c.common_mask) = c.common_mask END) AND (c.common_mask & (1 << (4 - m.order_index))) <> 0
       GROUP BY 1, 2, 3""",
)
def mask_projection(spark, sf_dir):
    """Tracks restricted to the samples of each common mask they belong to."""
    common = masked(spark, sf_dir).select(
        "series_id", "cell", F.explode(masks.submasks(F.col("mask"), N_SAMPLES)).alias("common_mask")
    )
    bit = masks.sample_bit(F.col("order_index"), N_SAMPLES)
    return (
        fx.members(spark, sf_dir)
        .join(common, ["series_id", "cell"])
        .filter(F.col("common_mask").bitwiseAND(bit) != 0)
        .groupBy("series_id", "cell", "common_mask")
        .agg(
            F.count("*").alias("n_kept"),
            F.round(F.median("ppm"), 6).alias("center"),
            F.round(F.max("ppm") - F.min("ppm"), 6).alias("span"),
        )
    )


@query(
    "step_log_change",
    """SELECT series_id, cell, order_index, round(v - lag(v) OVER (PARTITION BY series_id, cell ORDER BY order_index), 6)
         AS step, order_index - lag(order_index) OVER (PARTITION BY series_id, cell ORDER BY order_index) = 1 AS adjacent
       FROM (SELECT *, ln(greatest(intensity, 1e-12)) AS v FROM fx_members)""",
)
def step_log_change(spark, sf_dir):
    """Log change from the previous observed sample, flagged when the samples are neighbours."""
    order = Window.partitionBy("series_id", "cell").orderBy("order_index")
    value = F.log(F.greatest("intensity", F.lit(1e-12)))
    return (
        fx.members(spark, sf_dir)
        .withColumn("v", value)
        .select(
            "series_id",
            "cell",
            "order_index",
            F.round(F.col("v") - F.lag("v").over(order), 6).alias("step"),
            (F.col("order_index") - F.lag("order_index").over(order) == 1).alias("adjacent"),
        )
    )


def log_profiles(spark, sf_dir) -> DataFrame:
    """Median-centred log profile of every simple track, absent samples at zero."""
    value = F.log(F.greatest("intensity", F.lit(1e-12))).alias("v")
    cells = (
        fx.members(spark, sf_dir)
        .select("series_id", "cell", "order_index", value)
        .groupBy("series_id", "cell")
        .agg(F.median("v").alias("mid"), F.map_from_entries(F.collect_list(F.struct("order_index", "v"))).alias("by_order"))
    )
    profile = F.array(
        *[F.coalesce(F.try_element_at("by_order", F.lit(i)) - F.col("mid"), F.lit(0.0)) for i in range(N_SAMPLES)]
    )
    return cells.select("series_id", "cell", profile.alias("profile"))


PROFILE_SQL = """SELECT m.series_id, m.cell, """ + ", ".join(
    f"coalesce(max(CASE WHEN order_index = {i} THEN v END) - median(v), 0) AS v{i}" for i in range(N_SAMPLES)
) + """ FROM (SELECT *, ln(greatest(intensity, 1e-12)) AS v FROM fx_members) m GROUP BY 1, 2"""


@query(
    "log_profile",
    "SELECT series_id, cell, " + ", ".join(f"round(v{i}, 6) AS v{i}" for i in range(N_SAMPLES)) + f" FROM ({PROFILE_SQL})",
)
def log_profile(spark, sf_dir):
    return log_profiles(spark, sf_dir).select(
        "series_id", "cell", *[F.round(F.col("profile")[i], 6).alias(f"v{i}") for i in range(N_SAMPLES)]
    )


@query(
    "column_zscore",
    "SELECT series_id, cell, "
    + ", ".join(
        f"""round((v{i} - avg(v{i}) OVER w) / CASE WHEN coalesce(var_samp(v{i}) OVER w, 0) > 1e-12
        THEN sqrt(var_samp(v{i}) OVER w) ELSE 1 END, 6) AS z{i}"""
        for i in range(N_SAMPLES)
    )
    + f" FROM ({PROFILE_SQL}) WINDOW w AS (PARTITION BY series_id)",
)
def column_zscore(spark, sf_dir):
    """Column z-scores per series from pre-aggregated moments."""
    profiles = log_profiles(spark, sf_dir)
    moments = profiles.groupBy("series_id").agg(
        *[F.avg(F.col("profile")[i]).alias(f"m{i}") for i in range(N_SAMPLES)],
        *[F.coalesce(F.var_samp(F.col("profile")[i]), F.lit(0.0)).alias(f"s{i}") for i in range(N_SAMPLES)],
    )
    scaled = [
        F.round(
            (F.col("profile")[i] - F.col(f"m{i}"))
            / F.when(F.col(f"s{i}") > 1e-12, F.sqrt(f"s{i}")).otherwise(F.lit(1.0)),
            6,
        ).alias(f"z{i}")
        for i in range(N_SAMPLES)
    ]
    return profiles.join(moments, "series_id").select("series_id", "cell", *scaled)


@query(
    "cluster_steps",
    """SELECT series_id, mask, order_index, n, round(mean_step, 6) AS mean_step, round(scale, 6) AS scale FROM (
        SELECT s.series_id, t.mask, s.order_index, count(*) AS n, avg(step) AS mean_step,
          greatest(coalesce(stddev_samp(step), 0), 1e-6) AS scale FROM (
          SELECT series_id, cell, order_index, v - lag(v) OVER w AS step, order_index - lag(order_index) OVER w AS gap
          FROM (SELECT *, ln(greatest(intensity, 1e-12)) AS v FROM fx_members)
          WINDOW w AS (PARTITION BY series_id, cell ORDER BY order_index)) s
        JOIN fx_masks t ON t.series_id = s.series_id AND t.cell = s.cell WHERE gap = 1 GROUP BY 1, 2, 3)""",
)
def cluster_steps(spark, sf_dir):
    """Mean and spread of each log step, the mask taken as cluster."""
    order = Window.partitionBy("series_id", "cell").orderBy("order_index")
    steps = (
        fx.members(spark, sf_dir)
        .withColumn("v", F.log(F.greatest("intensity", F.lit(1e-12))))
        .withColumn("step", F.col("v") - F.lag("v").over(order))
        .withColumn("gap", F.col("order_index") - F.lag("order_index").over(order))
        .filter("gap = 1")
    )
    return (
        steps.join(masked(spark, sf_dir).select("series_id", "cell", "mask"), ["series_id", "cell"])
        .groupBy("series_id", "mask", "order_index")
        .agg(
            F.count("*").alias("n"),
            F.round(F.avg("step"), 6).alias("mean_step"),
            F.round(F.greatest(F.coalesce(F.stddev_samp("step"), F.lit(0.0)), F.lit(1e-6)), 6).alias("scale"),
        )
    )


@query(
    "profile_cosine",
    f"""SELECT a.series_id, a.cell, round(CASE WHEN na <= 1e-12 OR nb <= 1e-12 THEN 1.0::DOUBLE ELSE 1 - ab / (na * nb) END, 6)
          AS cosine, round(sqrt(dd / {N_SAMPLES}), 6) AS rms FROM (
        SELECT x.series_id, x.cell, sqrt({" + ".join(f"x.v{i}*x.v{i}" for i in range(N_SAMPLES))}) AS na,
          sqrt({" + ".join(f"y.v{i}*y.v{i}" for i in range(N_SAMPLES))}) AS nb,
          {" + ".join(f"x.v{i}*y.v{i}" for i in range(N_SAMPLES))} AS ab,
          {" + ".join(f"(x.v{i}-y.v{i})*(x.v{i}-y.v{i})" for i in range(N_SAMPLES))} AS dd
        FROM ({PROFILE_SQL}) x JOIN ({PROFILE_SQL}) y ON x.series_id = y.series_id AND y.cell = x.cell + 1) a""",
)
def profile_cosine(spark, sf_dir):
    """Cosine and RMS distance between the profiles of neighbouring cells."""
    profiles = log_profiles(spark, sf_dir)
    following = profiles.select("series_id", (F.col("cell") - 1).alias("cell"), F.col("profile").alias("other"))
    a, b = F.col("profile"), F.col("other")
    return profiles.join(following, ["series_id", "cell"]).select(
        "series_id",
        "cell",
        F.round(vectors.cosine_distance(a, b), 6).alias("cosine"),
        F.round(vectors.rms_euclid(a, b), 6).alias("rms"),
    )


@query(
    "singleton_antijoin",
    """SELECT p.series_id, p.sample_id, p.peak_id FROM fx_peaks p WHERE NOT EXISTS (
        SELECT 1 FROM fx_members m JOIN fx_masks t ON t.series_id = m.series_id AND t.cell = m.cell
        WHERE t.n_members >= 2 AND m.series_id = p.series_id AND m.sample_id = p.sample_id AND m.peak_id = p.peak_id)""",
)
def singleton_antijoin(spark, sf_dir):
    """Peaks that no multi-sample track covers."""
    multi = masked(spark, sf_dir).filter("n_members >= 2").select("series_id", "cell")
    covered = fx.members(spark, sf_dir).join(multi, ["series_id", "cell"], "left_semi")
    keys = ["series_id", "sample_id", "peak_id"]
    return fx.peaks(spark, sf_dir).select(*keys).join(covered.select(*keys), keys, "left_anti")


@query(
    "reused_peak_filter",
    """WITH half AS (SELECT series_id, sample_id, order_index, ppm, peak_id, CAST(floor(ppm * 2) AS INTEGER) AS c2 FROM fx_peaks),
        narrow AS (SELECT series_id, c2, count(DISTINCT sample_id) AS n FROM half GROUP BY 1, 2),
        multi AS (SELECT m.series_id, m.sample_id, m.peak_id FROM fx_members m JOIN fx_masks t
          ON t.series_id = m.series_id AND t.cell = m.cell WHERE t.n_members >= 2)
       SELECT h.series_id, h.sample_id, h.peak_id FROM half h JOIN narrow n ON n.series_id = h.series_id AND n.c2 = h.c2
       WHERE n.n = 1 AND (h.series_id, h.sample_id, h.peak_id) NOT IN (SELECT series_id, sample_id, peak_id FROM multi)""",
)
def reused_peak_filter(spark, sf_dir):
    """Single-sample tracks (half-ppm cells) whose peak no multi-sample track uses."""
    half = fx.peaks(spark, sf_dir).select(
        "series_id", "sample_id", "peak_id", F.floor(F.col("ppm") * 2).cast("int").alias("c2")
    )
    single = half.groupBy("series_id", "c2").agg(F.count_distinct("sample_id").alias("n")).filter("n = 1")
    keys = ["series_id", "sample_id", "peak_id"]
    multi = masked(spark, sf_dir).filter("n_members >= 2").select("series_id", "cell")
    used = fx.members(spark, sf_dir).join(multi, ["series_id", "cell"], "left_semi").select(*keys)
    return half.join(single, ["series_id", "c2"], "left_semi").select(*keys).join(used, keys, "left_anti")


@query(
    "dedup_member_set",
    """SELECT series_id, ids, round(max(score), 6) AS score, count(*) AS copies FROM (
        SELECT series_id, c2, array_to_string(list_sort(list(peak_id)), '_') AS ids, avg(intensity) AS score FROM (
          SELECT series_id, peak_id, intensity, unnest([CAST(floor(ppm) AS INTEGER), CAST(floor(ppm + 0.5) AS INTEGER) + 1000]) AS c2
          FROM fx_peaks) GROUP BY 1, 2) GROUP BY 1, 2""",
)
def dedup_member_set(spark, sf_dir):
    """Overlapping cells give the same member sets more than once; keep the best score of each."""
    cells = F.array(F.floor("ppm").cast("int"), F.floor(F.col("ppm") + 0.5).cast("int") + 1000)
    sets = (
        fx.peaks(spark, sf_dir)
        .select("series_id", "peak_id", "intensity", F.explode(cells).alias("c2"))
        .groupBy("series_id", "c2")
        .agg(F.array_sort(F.collect_list("peak_id")).alias("members"), F.avg("intensity").alias("score"))
    )
    ids = F.array_join(F.transform("members", lambda p: p.cast("string")), "_").alias("ids")
    return sets.groupBy("series_id", ids).agg(F.round(F.max("score"), 6).alias("score"), F.count("*").alias("copies"))


@query(
    "sample_numbering",
    """SELECT series_id, sample_id, peak_id, concat('S', CAST(order_index + 1 AS VARCHAR), '_P', lpad(CAST(row_number() OVER (
        PARTITION BY series_id, sample_id ORDER BY ppm, peak_id) AS VARCHAR), 3, '0')) AS label FROM fx_peaks""",
)
def sample_numbering(spark, sf_dir):
    """Peak labels per sample in ppm order."""
    order = Window.partitionBy("series_id", "sample_id").orderBy("ppm", "peak_id")
    label = F.format_string("S%d_P%03d", F.col("order_index") + 1, F.row_number().over(order))
    return fx.peaks(spark, sf_dir).select("series_id", "sample_id", "peak_id", label.alias("label"))


@query(
    "natural_sample_order",
    """SELECT name, CAST(row_number() OVER (ORDER BY regexp_replace(name, '[0-9]+$', ''),
        CASE WHEN regexp_extract(name, '([0-9]*)$', 1) <> '' THEN CAST(regexp_extract(name, '([0-9]*)$', 1) AS BIGINT) ELSE -1 END,
        name) AS INTEGER) AS pos FROM (SELECT DISTINCT p_brand AS name FROM part)""",
)
def natural_sample_order(spark, sf_dir):
    from peakloom.session import table

    names = table(spark, sf_dir, "part").select(F.col("p_brand").alias("name")).distinct()
    order = Window.orderBy(*spectra.natural_key(F.col("name")))
    return names.select("name", F.row_number().over(order).alias("pos"))
