"""Carbon scores, their neighbourhood means, and molecule scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakloom.config import CarbonSearch
from peakloom.functions import scoring


def reachable(edges: DataFrame, level: int) -> DataFrame:
    """Atoms within ``level`` bonds of a root, the root itself excluded.

    At most three hops on a graph of bounded degree: unrolled joins on (molecule,
    atom), a key as fine as the atoms themselves.
    """
    hop = edges.select("mol_id", F.col("src").alias("root"), F.col("dst").alias("atom"))
    found, frontier = hop, hop
    for _ in range(level - 1):
        step = edges.select("mol_id", F.col("src").alias("atom"), F.col("dst").alias("next"))
        frontier = (
            frontier.join(step, ["mol_id", "atom"])
            .select("mol_id", "root", F.col("next").alias("atom"))
            .filter("atom <> root")
            .distinct()
        )
        found = found.unionByName(frontier)
    return found.distinct() if level > 1 else found


def self_scores(matches: DataFrame, search: CarbonSearch) -> DataFrame:
    """Add ``self_score`` to matched carbons."""
    green, yellow = scoring.window_bounds(F.col("c_shift"), search)
    delta = F.abs(F.col("c_shift") - F.col("shift"))
    return matches.withColumn("self_score", scoring.carbon_score(delta, F.col("type_matched"), green, yellow))


def environment_scores(scored: DataFrame, edges: DataFrame, level: int) -> DataFrame:
    """Add ``env_score``: mean self score of the reachable atoms, 1 for an isolated atom.

    ``scored`` lists the carbons with a positive score; all others count as zero,
    so only the reach size is needed for them.
    """
    near = reachable(edges, level)
    size = near.groupBy("mol_id", "root").agg(F.count("*").alias("reach"))
    sums = (
        scored.select("query_id", "mol_id", F.col("c_index").alias("atom"), "self_score")
        .join(near, ["mol_id", "atom"])
        .groupBy("query_id", "mol_id", F.col("root").alias("c_index"))
        .agg(F.sum("self_score").alias("near_sum"))
    )
    return (
        scored.join(size.withColumnRenamed("root", "c_index"), ["mol_id", "c_index"], "left")
        .join(sums, ["query_id", "mol_id", "c_index"], "left")
        .withColumn(
            "env_score",
            F.when(F.col("reach").isNull(), F.lit(1.0)).otherwise(
                F.coalesce("near_sum", F.lit(0.0)) / F.col("reach")
            ),
        )
        .drop("reach", "near_sum")
    )


def molecule_scores(eligible: DataFrame, scored: DataFrame, search: CarbonSearch) -> DataFrame:
    """Mean composite score per (query, molecule), 4 decimals; absent carbons add zero."""
    value = scoring.composite(F.col("self_score"), F.col("env_score"), search.self_weight, search.env_weight)
    sums = (
        scored.withColumn("composite", value)
        .groupBy("query_id", "mol_id")
        .agg(F.sum("composite").alias("total"), F.count("*").alias("n_scored"))
    )
    return eligible.join(sums, ["query_id", "mol_id"], "left").select(
        *eligible.columns,
        scoring.half_up(F.coalesce("total", F.lit(0.0)) / F.col("carbon_count"), 4).alias("c_score"),
        F.coalesce("n_scored", F.lit(0)).alias("n_scored"),
    )


def score_details(scored: DataFrame, search: CarbonSearch) -> DataFrame:
    """Per-atom breakdown rows of a molecule score."""
    value = scoring.composite(F.col("self_score"), F.col("env_score"), search.self_weight, search.env_weight)
    return scored.select(
        "query_id", "mol_id", "c_index", "c_shift", "shift", "self_score", "env_score", value.alias("composite")
    )
