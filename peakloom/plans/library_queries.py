"""Registered queries: library filter, matching, scores and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peakloom.config import CarbonSearch, FineRange, HsqcSearch, LibraryFilter
from peakloom.functions import scoring
from peakloom.operators import assignment, environment
from peakloom.operators.band import band_join
from peakloom.plans import fixtures as fx
from peakloom.plans import library_search as search
from peakloom.plans.registry import query
from peakloom.session import broadcast_if_small

LIMITS = LibraryFilter()
GLOBAL = CarbonSearch()
# A gap between 150 and 160 ppm is left on purpose: such shifts have no window.
FINE = CarbonSearch(
    window=None,
    fine_ranges=(FineRange(0, 90, 0.5, 2.0), FineRange(90, 150, 1.0, 3.0), FineRange(160, 220, 1.0, 4.0)),
)
HSQC = HsqcSearch()

SCORE_SQL = "CASE WHEN d < 0.5 THEN 1.0 WHEN d > 2.0 THEN 0.0 ELSE round(1.0::DOUBLE - (d - 0.5) / 1.5::DOUBLE + 1e-9, 2) END"
ELIGIBLE_SQL = """SELECT q.query_id, m.mol_id, m.name, m.carbon_count, m.fw
    FROM fx_molecules m JOIN (SELECT query_id, count(*) AS n FROM fx_query_peaks GROUP BY 1) q
      ON m.carbon_count <= q.n + CAST(floor(0.1::DOUBLE * q.n + 0.5) AS INTEGER)
    WHERE m.carbon_count BETWEEN 5 AND 30 AND m.fw BETWEEN 100 AND 500"""
# Each carbon with its nearest peak of every query, scored with the global window.
BEST_SQL = f"""SELECT query_id, mol_id, c_index, c_shift, peak_id, shift, {SCORE_SQL} AS self_score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, mol_id, c_index ORDER BY d, peak_id) AS r FROM (
      SELECT q.query_id, c.mol_id, c.c_index, c.c_shift, q.peak_id, q.shift, abs(c.c_shift - q.shift) AS d
      FROM fx_carbons c JOIN fx_query_peaks q ON abs(c.c_shift - q.shift) <= 2.0)) WHERE r = 1"""


def nearest_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest peak of every query within the yellow window, per carbon (peaks may be shared)."""
    pairs = band_join(
        fx.carbons(spark, sf_dir).filter("c_shift IS NOT NULL"),
        broadcast_if_small(fx.query_peaks(spark, sf_dir).drop("h_shift", "h_type")),
        [("c_shift", "shift", 2.0)],
    )
    best = F.min(F.struct(F.abs(F.col("c_shift") - F.col("shift")).alias("d"), "peak_id", "shift", "c_shift")).alias("b")
    return (
        pairs.groupBy("query_id", "mol_id", "c_index")
        .agg(best)
        .select("query_id", "mol_id", "c_index", "b.c_shift", "b.peak_id", "b.shift", F.lit(True).alias("type_matched"))
    )


@query("library_filter", ELIGIBLE_SQL)
def library_filter(spark, sf_dir):
    pairs = search.eligible_molecules(fx.molecules(spark, sf_dir), fx.query_peaks(spark, sf_dir), LIMITS)
    return search.assert_within_limit(pairs).drop("max_carbons")


@query(
    "mol_carbon_join",
    """SELECT m.mol_id, m.name, m.carbon_count, c.c_index, c.h_count, c.c_shift
       FROM fx_molecules m JOIN fx_carbons c ON m.mol_id = c.mol_id
       WHERE m.carbon_count BETWEEN 5 AND 30 AND m.fw BETWEEN 100 AND 500""",
)
def mol_carbon_join(spark, sf_dir):
    kept = fx.molecules(spark, sf_dir).filter("carbon_count BETWEEN 5 AND 30 AND fw BETWEEN 100 AND 500")
    return kept.join(fx.carbons(spark, sf_dir), "mol_id").select(
        "mol_id", "name", "carbon_count", "c_index", "h_count", "c_shift"
    )


@query(
    "threshold_lookup_fine",
    """SELECT mol_id, c_index, c_shift,
         CASE WHEN c_shift BETWEEN 0 AND 90 THEN 0.5::DOUBLE WHEN c_shift BETWEEN 90 AND 150 THEN 1.0
              WHEN c_shift BETWEEN 160 AND 220 THEN 1.0 END AS green,
         CASE WHEN c_shift BETWEEN 0 AND 90 THEN 2.0::DOUBLE WHEN c_shift BETWEEN 90 AND 150 THEN 3.0
              WHEN c_shift BETWEEN 160 AND 220 THEN 4.0 END AS yellow
       FROM fx_carbons""",
)
def threshold_lookup_fine(spark, sf_dir):
    green, yellow = scoring.window_bounds(F.col("c_shift"), FINE)
    return fx.carbons(spark, sf_dir).select(
        "mol_id", "c_index", "c_shift", green.alias("green"), yellow.alias("yellow")
    )


@query(
    "best_peak_per_carbon",
    f"SELECT query_id, mol_id, c_index, c_shift, peak_id, shift FROM ({BEST_SQL})",
)
def best_peak_per_carbon(spark, sf_dir):
    return nearest_peaks(spark, sf_dir).drop("type_matched")


def _scored_pairs(spark, sf_dir, config, tol):
    pairs = band_join(
        fx.carbons(spark, sf_dir).filter("c_shift IS NOT NULL"),
        broadcast_if_small(fx.query_peaks(spark, sf_dir)),
        [("c_shift", "shift", tol)],
    )
    green, yellow = scoring.window_bounds(F.col("c_shift"), config)
    delta = F.abs(F.col("c_shift") - F.col("shift"))
    same = F.col("h_count") == F.col("h_type")
    return pairs.select(
        "query_id",
        "mol_id",
        "c_index",
        "peak_id",
        scoring.carbon_score(delta, same, green, yellow).alias("score"),
        scoring.carbon_colour(delta, same, green, yellow).alias("colour"),
    )


@query(
    "carbon_score_global",
    f"""SELECT query_id, mol_id, c_index, peak_id,
          CASE WHEN h_count <> h_type THEN 0.0::DOUBLE ELSE {SCORE_SQL} END AS score,
          CASE WHEN h_count <> h_type OR d > 2.0 THEN 'red' WHEN d < 0.5 THEN 'green' ELSE 'yellow' END AS colour
        FROM (SELECT q.query_id, c.mol_id, c.c_index, q.peak_id, c.h_count, q.h_type, abs(c.c_shift - q.shift) AS d
              FROM fx_carbons c JOIN fx_query_peaks q ON abs(c.c_shift - q.shift) <= 2.0)""",
)
def carbon_score_global(spark, sf_dir):
    return _scored_pairs(spark, sf_dir, GLOBAL, 2.0)


@query(
    "carbon_score_fine",
    """SELECT query_id, mol_id, c_index, peak_id,
         CASE WHEN h_count <> h_type OR g IS NULL THEN 0.0::DOUBLE WHEN d < g THEN 1.0 WHEN d > y THEN 0.0
              ELSE round(1.0::DOUBLE - (d - g) / (y - g) + 1e-9, 2) END AS score,
         CASE WHEN h_count <> h_type OR g IS NULL OR d > y THEN 'red' WHEN d < g THEN 'green' ELSE 'yellow' END AS colour
       FROM (SELECT q.query_id, c.mol_id, c.c_index, q.peak_id, c.h_count, q.h_type, abs(c.c_shift - q.shift) AS d,
               CASE WHEN c_shift BETWEEN 0 AND 90 THEN 0.5::DOUBLE WHEN c_shift BETWEEN 90 AND 150 THEN 1.0
                    WHEN c_shift BETWEEN 160 AND 220 THEN 1.0 END AS g,
               CASE WHEN c_shift BETWEEN 0 AND 90 THEN 2.0::DOUBLE WHEN c_shift BETWEEN 90 AND 150 THEN 3.0
                    WHEN c_shift BETWEEN 160 AND 220 THEN 4.0 END AS y
             FROM fx_carbons c JOIN fx_query_peaks q ON abs(c.c_shift - q.shift) <= 4.0)""",
)
def carbon_score_fine(spark, sf_dir):
    return _scored_pairs(spark, sf_dir, FINE, 4.0)


def _library_match(spark, sf_dir, config):
    return search.match_library(
        fx.carbons(spark, sf_dir), fx.molecules(spark, sf_dir), fx.query_peaks(spark, sf_dir), config, LIMITS
    )


@query("assign_13c_untyped")
def assign_13c_untyped(spark, sf_dir):
    return _library_match(spark, sf_dir, GLOBAL)


@query("assign_13c_typed")
def assign_13c_typed(spark, sf_dir):
    return _library_match(spark, sf_dir, CarbonSearch(typed=True))


@query("assign_13c_merged")
def assign_13c_merged(spark, sf_dir):
    return _library_match(spark, sf_dir, CarbonSearch(merge_equivalent=True))


@query("assign_13c_fine")
def assign_13c_fine(spark, sf_dir):
    return _library_match(spark, sf_dir, FINE)


@query("match_table_13c")
def match_table_13c(spark, sf_dir):
    """Matches with a null row for every carbon that got no peak."""
    pairs = search.eligible_molecules(fx.molecules(spark, sf_dir), fx.query_peaks(spark, sf_dir), LIMITS)
    atoms = pairs.select("query_id", "mol_id").join(
        fx.carbons(spark, sf_dir).select("mol_id", "c_index", "h_count", "c_shift"), "mol_id"
    )
    return assignment.with_unmatched(atoms, _library_match(spark, sf_dir, GLOBAL))


ENV_SQL = f"""WITH best AS ({BEST_SQL}),
    hop1 AS (SELECT mol_id, src AS root, dst AS atom FROM fx_edges),
    hop2 AS (SELECT DISTINCT h.mol_id, h.root, e.dst AS atom FROM hop1 h JOIN fx_edges e
             ON e.mol_id = h.mol_id AND e.src = h.atom WHERE e.dst <> h.root),
    hop3 AS (SELECT DISTINCT h.mol_id, h.root, e.dst AS atom FROM hop2 h JOIN fx_edges e
             ON e.mol_id = h.mol_id AND e.src = h.atom WHERE e.dst <> h.root),
    near AS (SELECT DISTINCT * FROM ({{hops}})),
    scored AS (SELECT * FROM best WHERE self_score > 0),
    env AS (SELECT s.query_id, s.mol_id, s.c_index, s.self_score,
        CASE WHEN count(n.atom) = 0 THEN 1.0 ELSE coalesce(sum(o.self_score), 0) / count(n.atom) END AS env_score
      FROM scored s LEFT JOIN near n ON n.mol_id = s.mol_id AND n.root = s.c_index
      LEFT JOIN scored o ON o.query_id = s.query_id AND o.mol_id = s.mol_id AND o.c_index = n.atom
      GROUP BY 1, 2, 3, 4)"""
HOPS = {
    1: "SELECT * FROM hop1",
    2: "SELECT * FROM hop1 UNION ALL SELECT * FROM hop2",
    3: "SELECT * FROM hop1 UNION ALL SELECT * FROM hop2 UNION ALL SELECT * FROM hop3",
}


def _env(spark, sf_dir, level):
    scored = environment.self_scores(nearest_peaks(spark, sf_dir), GLOBAL).filter("self_score > 0")
    return environment.environment_scores(scored, fx.edges(spark, sf_dir), level)


def _register_env(level):
    sql = ENV_SQL.format(hops=HOPS[level])
    sql += " SELECT query_id, mol_id, c_index, round(self_score, 6) AS self_score, round(env_score, 6) AS env_score FROM env"

    @query(f"env_score_l{level}", sql)
    def env_score(spark, sf_dir):
        return _env(spark, sf_dir, level).select(
            "query_id",
            "mol_id",
            "c_index",
            F.round("self_score", 6).alias("self_score"),
            F.round("env_score", 6).alias("env_score"),
        )


for _level in (1, 2, 3):
    _register_env(_level)

MOLECULE_SQL = (
    ENV_SQL.format(hops=HOPS[1])
    + f""", sums AS (SELECT query_id, mol_id, sum(0.7::DOUBLE * self_score + 0.3::DOUBLE * env_score) AS t, count(*) AS k
        FROM env GROUP BY 1, 2),
      scores AS (SELECT e.query_id, e.mol_id, e.name, e.carbon_count, e.fw,
        round(coalesce(t, 0) / carbon_count + 1e-9, 4) AS c_score, coalesce(k, 0) AS n_scored
        FROM ({ELIGIBLE_SQL}) e LEFT JOIN sums s ON s.query_id = e.query_id AND s.mol_id = e.mol_id)"""
)


def nearest_scores(spark, sf_dir):
    scored = _env(spark, sf_dir, 1)
    pairs = search.eligible_molecules(fx.molecules(spark, sf_dir), fx.query_peaks(spark, sf_dir), LIMITS)
    return environment.molecule_scores(pairs, scored, GLOBAL).drop("max_carbons")


@query("molecule_score", MOLECULE_SQL + " SELECT * FROM scores")
def molecule_score(spark, sf_dir):
    return nearest_scores(spark, sf_dir)


@query(
    "top20_nearest_13c",
    MOLECULE_SQL
    + """ SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id
        ORDER BY c_score DESC, carbon_count DESC, mol_id) AS INTEGER) AS rank FROM scores) WHERE rank <= 20""",
)
def top20_nearest_13c(spark, sf_dir):
    return search.top_molecules(nearest_scores(spark, sf_dir), "c_score")


def exact_ranking(spark, sf_dir, config=GLOBAL):
    return search.carbon_ranking(
        fx.carbons(spark, sf_dir),
        fx.molecules(spark, sf_dir),
        fx.edges(spark, sf_dir),
        fx.query_peaks(spark, sf_dir),
        config,
        LIMITS,
    )


@query("top20_13c")
def top20_13c(spark, sf_dir):
    """Ranking on optimal assignments."""
    return search.top_molecules(exact_ranking(spark, sf_dir), "c_score", GLOBAL.top_n)


@query("top20_13c_typed")
def top20_13c_typed(spark, sf_dir):
    config = CarbonSearch(typed=True, env_level=2, self_weight=0.6, env_weight=0.4)
    return search.top_molecules(exact_ranking(spark, sf_dir, config), "c_score", config.top_n)


@query(
    "score_details",
    ENV_SQL.format(hops=HOPS[1])
    + """ SELECT query_id, mol_id, c_index, round(0.7::DOUBLE * self_score + 0.3::DOUBLE * env_score, 6) AS composite FROM env""",
)
def score_details(spark, sf_dir):
    details = environment.score_details(_env(spark, sf_dir, 1), GLOBAL)
    return details.select("query_id", "mol_id", "c_index", F.round("composite", 6).alias("composite"))


@query(
    "score_average_per_molecule",
    f"""SELECT query_id, mol_id, round(avg(self_score), 6) AS avg_score, count(*) AS n_carbons, min(name) AS name
        FROM ({BEST_SQL}) b JOIN fx_molecules m USING (mol_id) GROUP BY 1, 2""",
)
def score_average_per_molecule(spark, sf_dir):
    """Average score per molecule, pre-aggregated before the name join."""
    scored = environment.self_scores(nearest_peaks(spark, sf_dir), GLOBAL)
    means = scored.groupBy("query_id", "mol_id").agg(
        F.round(F.avg("self_score"), 6).alias("avg_score"), F.count("*").alias("n_carbons")
    )
    return means.join(fx.molecules(spark, sf_dir).select("mol_id", "name"), "mol_id")


@query(
    "score_atom_join",
    f"""SELECT b.query_id, b.mol_id, b.c_index, b.self_score, c.h_count,
          CASE c.h_count WHEN 0 THEN 's' WHEN 1 THEN 'd' WHEN 2 THEN 't' ELSE 'q' END AS multiplicity,
          CAST(greatest(c.h_count, 1) AS DOUBLE) AS stick
        FROM ({BEST_SQL}) b JOIN fx_carbons c ON c.mol_id = b.mol_id AND c.c_index = b.c_index""",
)
def score_atom_join(spark, sf_dir):
    scored = environment.self_scores(nearest_peaks(spark, sf_dir), GLOBAL)
    atoms = fx.carbons(spark, sf_dir).select("mol_id", "c_index", "h_count")
    return scored.join(atoms, ["mol_id", "c_index"]).select(
        "query_id",
        "mol_id",
        "c_index",
        "self_score",
        "h_count",
        scoring.multiplicity(F.col("h_count")).alias("multiplicity"),
        scoring.stick_height(F.col("h_count")).alias("stick"),
    )


CH_SQL = """SELECT mol_id, c_index, h_count, c, CAST(row_number() OVER (PARTITION BY mol_id, c_index ORDER BY o) - 1
        AS INTEGER) AS h_pos, h FROM (
      SELECT mol_id, c_index, h_count, c_shift AS c, 1 AS o, h1 AS h FROM fx_carbons WHERE h_count IN (1, 2)
      UNION ALL SELECT mol_id, c_index, h_count, c_shift, 2, h2 FROM fx_carbons WHERE h_count = 2
      UNION ALL SELECT mol_id, c_index, h_count, round(c_shift, 2), 1,
        CASE WHEN h2 IS NULL THEN round((round(h1, 2) + round(h3, 2)) / 2 + 1e-9, 2)
             ELSE round((round(h1, 2) + round(h2, 2) + round(h3, 2)) / 3 + 1e-9, 2) END FROM fx_carbons WHERE h_count = 3)
    WHERE h IS NOT NULL AND c IS NOT NULL"""


@query("ch_points", CH_SQL)
def ch_points(spark, sf_dir):
    return search.ch_points(fx.carbons(spark, sf_dir)).drop("point_id")


# Score of every point against the nearest peak (by distance) of each query.
NEAR_HSQC_SQL = f"""SELECT *, CASE WHEN dc = 0 THEN TRUE ELSE abs(dh / dc) > 0.2::DOUBLE / 1.0::DOUBLE END AS steep,
      abs(dc) <= 1.0 AND abs(dh) <= 0.2::DOUBLE AS inside FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, mol_id, c_index, h_pos ORDER BY distance, peak_id) AS r FROM (
      SELECT q.query_id, p.mol_id, p.c_index, p.h_pos, q.peak_id, q.shift - p.c AS dc, q.h_shift - p.h AS dh,
        sqrt((q.shift - p.c) * (q.shift - p.c) + (q.h_shift - p.h) * 10 * ((q.h_shift - p.h) * 10)) AS distance
      FROM ({CH_SQL}) p CROSS JOIN fx_query_peaks q)) WHERE r = 1"""
POINT_SCORE_SQL = """CASE WHEN inside THEN 1.0::DOUBLE WHEN steep THEN least(1.0, 0.2::DOUBLE / nullif(abs(dh), 0))
      ELSE least(1.0, 1.0::DOUBLE / nullif(abs(dc), 0)) END"""


def nearest_points(spark, sf_dir):
    """Every point with its nearest peak of each query."""
    points = search.ch_points(fx.carbons(spark, sf_dir)).select("mol_id", "c_index", "h_pos", "c", "h")
    arrays = assignment.peak_arrays(fx.query_peaks(spark, sf_dir), mode=1)
    return (
        assignment.nearest_peaks_of_points(points, arrays)
        .withColumn("dc", F.col("shift") - F.col("c"))
        .withColumn("dh", F.col("h_shift") - F.col("h"))
    )


@query(
    "hsqc_distance",
    f"SELECT query_id, mol_id, c_index, h_pos, peak_id, round(distance, 6) AS distance FROM ({NEAR_HSQC_SQL})",
)
def hsqc_distance(spark, sf_dir):
    return nearest_points(spark, sf_dir).select(
        "query_id", "mol_id", "c_index", "h_pos", "peak_id", F.round("distance", 6).alias("distance")
    )


@query(
    "hsqc_point_score",
    f"""SELECT query_id, mol_id, c_index, h_pos, round({POINT_SCORE_SQL}, 6) AS point_score,
          round(CASE WHEN inside THEN 1.0::DOUBLE ELSE 1.0 / greatest(abs(dc) / 1.0, abs(dh) / 0.2::DOUBLE) END, 6)
            AS pair_score
        FROM ({NEAR_HSQC_SQL})""",
)
def hsqc_point_score(spark, sf_dir):
    dc, dh = F.col("dc"), F.col("dh")
    return nearest_points(spark, sf_dir).select(
        "query_id",
        "mol_id",
        "c_index",
        "h_pos",
        F.round(scoring.hsqc_point_score(dc, dh, HSQC.c_tol, HSQC.h_tol), 6).alias("point_score"),
        F.round(scoring.hsqc_pair_score(dc, dh, HSQC.c_tol, HSQC.h_tol), 6).alias("pair_score"),
    )


NEAR_MOLECULE_SQL = f"""SELECT query_id, mol_id, round(avg({POINT_SCORE_SQL}) + 1e-9, 4) AS ch_score,
    count(*) AS total_points, CAST(sum(CAST(inside AS INTEGER)) AS BIGINT) AS in_tolerance
    FROM ({NEAR_HSQC_SQL}) GROUP BY 1, 2"""


def nearest_hsqc_scores(spark, sf_dir):
    dc, dh = F.col("dc"), F.col("dh")
    inside = scoring.in_box(dc, dh, HSQC.c_tol, HSQC.h_tol).cast("int")
    return (
        nearest_points(spark, sf_dir)
        .withColumn("point_score", scoring.hsqc_point_score(dc, dh, HSQC.c_tol, HSQC.h_tol))
        .groupBy("query_id", "mol_id")
        .agg(
            scoring.half_up(F.avg("point_score"), 4).alias("ch_score"),
            F.count("*").alias("total_points"),
            F.sum(inside).alias("in_tolerance"),
        )
    )


@query("hsqc_molecule_score", NEAR_MOLECULE_SQL)
def hsqc_molecule_score(spark, sf_dir):
    return nearest_hsqc_scores(spark, sf_dir)


@query(
    "combined_nearest_top20",
    MOLECULE_SQL
    + f""", joint AS (SELECT s.query_id, s.mol_id, s.name, s.carbon_count, s.c_score, h.ch_score,
        round(s.c_score * 0.5::DOUBLE + h.ch_score * 0.5::DOUBLE + 1e-9, 4) AS combined_score
        FROM scores s JOIN ({NEAR_MOLECULE_SQL}) h ON h.query_id = s.query_id AND h.mol_id = s.mol_id)
      SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY combined_score DESC,
        carbon_count DESC, mol_id) AS INTEGER) AS rank FROM joint) WHERE rank <= 20""",
)
def combined_nearest_top20(spark, sf_dir):
    c_scores = nearest_scores(spark, sf_dir).drop("fw", "n_scored")
    both = search.combined_ranking(c_scores, nearest_hsqc_scores(spark, sf_dir), 0.5, 0.5)
    return search.top_molecules(both, "combined_score")


def _hsqc_matches(spark, sf_dir, config):
    points = search.ch_points(fx.carbons(spark, sf_dir))
    solved = assignment.match_hsqc(points, fx.query_peaks(spark, sf_dir), config)
    return solved.withColumn("distance", F.round("distance", 2)).drop("gain")


def _register_hsqc(mode):
    @query(f"assign_hsqc_mode{mode}")
    def assign_hsqc(spark, sf_dir):
        return _hsqc_matches(spark, sf_dir, HsqcSearch(mode=mode))


for _mode in (1, 2, 3):
    _register_hsqc(_mode)


@query("assign_hsqc_merged")
def assign_hsqc_merged(spark, sf_dir):
    return _hsqc_matches(spark, sf_dir, HsqcSearch(merge_equivalent=True))


@query("top20_hsqc")
def top20_hsqc(spark, sf_dir):
    scores = search.hsqc_ranking(
        search.ch_points(fx.carbons(spark, sf_dir)),
        fx.molecules(spark, sf_dir),
        fx.query_peaks(spark, sf_dir),
        HSQC,
    )
    return search.top_molecules(scores, "ch_score", HSQC.top_n)


@query("combined_top20")
def combined_top20(spark, sf_dir):
    """Combined ranking on optimal assignments of both spectra."""
    molecules = fx.molecules(spark, sf_dir)
    points = search.ch_points(fx.carbons(spark, sf_dir)).join(
        molecules.filter("carbon_count BETWEEN 5 AND 30 AND fw BETWEEN 100 AND 500").select("mol_id"), "mol_id"
    )
    ch_scores = search.hsqc_ranking(points, molecules, fx.query_peaks(spark, sf_dir), HSQC)
    c_scores = exact_ranking(spark, sf_dir).drop("max_carbons", "n_scored")
    return search.top_molecules(search.combined_ranking(c_scores, ch_scores, 0.5, 0.5), "combined_score")


@query(
    "multiset_remaining",
    f"""SELECT q.query_id, q.peak_id, q.shift FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id, round(shift) ORDER BY peak_id) AS rn FROM fx_query_peaks) q
        LEFT JOIN (SELECT query_id, round(shift) AS k, count(DISTINCT mol_id) % 3 AS used FROM ({BEST_SQL}) GROUP BY 1, 2) u
          ON u.query_id = q.query_id AND u.k = round(q.shift) WHERE rn > coalesce(used, 0)""",
)
def multiset_remaining(spark, sf_dir):
    """Multiset difference: drop as many equal values of a query as were used."""
    order = Window.partitionBy("query_id", "k").orderBy("peak_id")
    values = fx.query_peaks(spark, sf_dir).withColumn("k", F.round("shift"))
    used = (
        nearest_peaks(spark, sf_dir)
        .groupBy("query_id", F.round("shift").alias("k"))
        .agg((F.count_distinct("mol_id") % 3).alias("used"))
    )
    return (
        values.withColumn("rn", F.row_number().over(order))
        .join(used, ["query_id", "k"], "left")
        .filter(F.col("rn") > F.coalesce("used", F.lit(0)))
        .select("query_id", "peak_id", "shift")
    )
