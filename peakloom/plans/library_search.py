"""Library search: 13C, HSQC and combined ranking of structures against query spectra."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peakloom.config import CarbonSearch, HsqcSearch, LibraryFilter, check_weights
from peakloom.functions import scoring
from peakloom.operators import assignment, environment
from peakloom.session import broadcast_if_small, cut_lineage


def query_sizes(peaks: DataFrame, limits: LibraryFilter) -> DataFrame:
    """Per query: number of peaks and the largest molecule it may match."""
    slack = F.floor(F.lit(limits.missing_fraction) * F.col("n_query") + 0.5).cast("int")
    return (
        peaks.groupBy("query_id")
        .agg(F.count("*").cast("int").alias("n_query"))
        .withColumn("max_carbons", F.col("n_query") + slack)
    )


def eligible_molecules(molecules: DataFrame, peaks: DataFrame, limits: LibraryFilter) -> DataFrame:
    """(query, molecule) pairs inside the carbon-count and weight ranges.

    The query side is expanded over the few allowed carbon counts, so the
    query-dependent limit becomes an equi-join instead of a nested loop.
    """
    kept = molecules.filter(
        F.col("carbon_count").between(limits.carbon_min, limits.carbon_max)
        & F.col("fw").between(limits.fw_min, limits.fw_max)
    )
    top = F.least(F.col("max_carbons"), F.lit(limits.carbon_max))
    sizes = (
        query_sizes(peaks, limits)
        .filter(top >= limits.carbon_min)
        .select("query_id", "max_carbons", F.explode(F.sequence(F.lit(limits.carbon_min), top)).alias("carbon_count"))
    )
    return kept.join(broadcast_if_small(sizes), "carbon_count").select(
        "query_id", "mol_id", "name", "carbon_count", "fw", "max_carbons"
    )


def assert_within_limit(pairs: DataFrame) -> DataFrame:
    """Fail the job if a molecule above the query's size limit got through."""
    check = F.assert_true(F.col("carbon_count") <= F.col("max_carbons"), F.lit("molecule exceeds the size limit"))
    return pairs.filter(check.isNull())


def library_carbons(carbons: DataFrame, molecules: DataFrame, limits: LibraryFilter) -> DataFrame:
    kept = molecules.filter(
        F.col("carbon_count").between(limits.carbon_min, limits.carbon_max)
        & F.col("fw").between(limits.fw_min, limits.fw_max)
    ).select("mol_id", "carbon_count")
    return carbons.join(kept, "mol_id").select("mol_id", "c_index", "h_count", "c_shift", "carbon_count")


def match_library(
    carbons: DataFrame, molecules: DataFrame, peaks: DataFrame, search: CarbonSearch, limits: LibraryFilter
) -> DataFrame:
    bounded = peaks.join(broadcast_if_small(query_sizes(peaks, limits)), "query_id").drop("n_query", "h_shift")
    return assignment.match_carbons(library_carbons(carbons, molecules, limits), bounded, search)


def carbon_ranking(
    carbons: DataFrame,
    molecules: DataFrame,
    edges: DataFrame,
    peaks: DataFrame,
    search: CarbonSearch,
    limits: LibraryFilter,
) -> DataFrame:
    """13C molecule scores for every eligible (query, molecule) pair."""
    matches = match_library(carbons, molecules, peaks, search, limits)
    # Two joins read the scored atoms; the matching is worked out once for both.
    scored = cut_lineage(environment.self_scores(matches, search).filter("self_score > 0"))
    scored = environment.environment_scores(scored, edges, search.env_level)
    return environment.molecule_scores(eligible_molecules(molecules, peaks, limits), scored, search)


def ch_points(carbons: DataFrame) -> DataFrame:
    """HSQC points of every protonated carbon.

    CH gives one point, CH2 one per known proton, CH3 a single point at the mean
    of its (rounded) proton shifts.  Carbons whose proton list is incomplete give none.
    """
    usable = carbons.filter("h_count BETWEEN 1 AND 3 AND c_shift IS NOT NULL AND size(h_shifts) = h_count")
    known = F.filter("h_shifts", lambda h: h.isNotNull())
    cents = F.transform(known, lambda h: F.round(h, 2))
    mean = scoring.half_up(F.aggregate(cents, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(known), F.lit(0)), 2)
    methyl = F.when(F.size(known) > 0, F.array(mean)).otherwise(F.array().cast("array<double>"))
    return (
        usable.withColumn("_h", F.when(F.col("h_count") == 3, methyl).otherwise(known))
        .withColumn("c", F.when(F.col("h_count") == 3, F.round("c_shift", 2)).otherwise(F.col("c_shift")))
        .select("mol_id", "c_index", "h_count", "c", F.posexplode("_h").alias("h_pos", "h"))
        .withColumn("point_id", F.col("c_index") * 4 + F.col("h_pos"))
    )


def hsqc_ranking(points: DataFrame, molecules: DataFrame, peaks: DataFrame, search: HsqcSearch) -> DataFrame:
    """HSQC score per (query, molecule): mean point score, matched and total points."""
    matched = assignment.match_hsqc(points, peaks, search)
    dc, dh = F.col("shift") - F.col("c"), F.col("h_shift") - F.col("h")
    sums = (
        matched.withColumn("point_score", scoring.hsqc_point_score(dc, dh, search.c_tol, search.h_tol))
        .withColumn("inside", scoring.in_box(dc, dh, search.c_tol, search.h_tol).cast("int"))
        .groupBy("query_id", "mol_id")
        .agg(
            F.sum("point_score").alias("total_score"),
            F.count("*").alias("matched_points"),
            F.sum("inside").alias("in_tolerance"),
        )
    )
    totals = points.groupBy("mol_id").agg(F.count("*").alias("total_points"))
    return (
        sums.join(totals, "mol_id")
        .join(molecules.select("mol_id", "name", "carbon_count"), "mol_id")
        .withColumn("ch_score", F.col("total_score") / F.col("total_points"))
        .drop("total_score")
    )


def combined_ranking(c_scores: DataFrame, ch_scores: DataFrame, c_weight: float, ch_weight: float) -> DataFrame:
    """Weighted sum of both scores for molecules that have both."""
    check_weights(c_weight, ch_weight)
    return (
        c_scores.join(ch_scores.select("query_id", "mol_id", "ch_score"), ["query_id", "mol_id"])
        .withColumn("combined_score", scoring.half_up(F.col("c_score") * c_weight + F.col("ch_score") * ch_weight, 4))
    )


def top_molecules(scores: DataFrame, score: str, n: int = 20) -> DataFrame:
    """Best molecules per query; larger molecules win ties, then the lower id."""
    order = Window.partitionBy("query_id").orderBy(F.desc(score), F.desc("carbon_count"), "mol_id")
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def result_page(ranked: DataFrame, page: int, per_page: int = 5) -> DataFrame:
    """One page of a ranked list."""
    return ranked.filter(F.col("rank").between((page - 1) * per_page + 1, page * per_page))
