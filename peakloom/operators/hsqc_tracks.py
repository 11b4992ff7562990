"""HSQC tracks: one signal of two dimensions followed across the samples of a series.

A track takes at most one peak of each sample.  The samples of a component of the pair graph are visited in
the order of their number of peaks (then sample order); a peak joins a track when it is a pair with one of
its members and the track stays within its limits.  All tracks are grown at once, one sample per join;
a track carries the sums its score needs, so no step looks back.  No track is left out: the limits are
those of spans and distances, not of counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakloom.config import HsqcTrackConfig
from peakloom.functions import masks, vectors
from peakloom.operators.components import connected_components
from peakloom.session import cut_lineage

# Distance of a member from the middle of its track, in tolerances, and the log step that counts as a move.
MIDDLE_REACH = 1.35
MOVE = 0.35

def _member() -> Column:
    """What a track keeps of a peak; ``v`` is the log of its size, 1 where there is none."""
    size = F.greatest(F.abs(F.coalesce("intensity", F.lit(1.0))), F.lit(1e-12))
    return F.struct(
        F.col("order_index").cast("int").alias("order_index"),
        F.col("peak_id").cast("long").alias("peak_id"),
        F.col("c_corr").alias("c"),
        F.col("h_corr").alias("h"),
        F.log(size).alias("v"),
    )


def pair_maps(pairs: DataFrame) -> DataFrame:
    """Symmetric edges of the pair graph: series_id, peak_id, other_id, score, reciprocal.

    A pair that was found more than once keeps its best score, and is reciprocal if any of them was.
    """
    one = pairs.groupBy("series_id", F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).agg(
        F.max("score").alias("score"), F.bool_or("reciprocal").alias("reciprocal")
    )
    ends = F.array(
        F.struct(F.col("low").alias("peak_id"), F.col("high").alias("other_id")),
        F.struct(F.col("high").alias("peak_id"), F.col("low").alias("other_id")),
    )
    return one.select("series_id", F.inline(ends), "score", "reciprocal")


def visiting_order(peaks: DataFrame, edges: DataFrame) -> DataFrame:
    """Peaks of the pair graph with their component and the place of their sample in it.

    ``peaks``: series_id, order_index, peak_id, c_corr, h_corr, intensity.  Adds component, place and the member struct.
    """
    parts = connected_components(edges, ["series_id"], "peak_id", "other_id").withColumnRenamed("node", "peak_id")
    inside = cut_lineage(peaks.join(parts, ["series_id", "peak_id"]).withColumn("member", _member()))
    sizes = inside.groupBy("series_id", "component", "order_index").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("series_id", "component").orderBy("n", "order_index"))
    placed = sizes.select("series_id", "component", "order_index", place.alias("place"))
    return inside.join(placed, ["series_id", "component", "order_index"]).select(
        "series_id", "component", "order_index", "peak_id", "place", "member"
    )


def _values(members: Column, field: str) -> Column:
    return F.transform(members, lambda m: m[field])


def _span(values: Column) -> Column:
    return F.array_max(values) - F.array_min(values)


def _reach(values: Column) -> Column:
    """Largest distance from the middle of the values."""
    middle = vectors.sorted_median(values)
    return F.array_max(F.transform(values, lambda x: F.abs(x - middle)))


def within_limits(members: Column, config: HsqcTrackConfig) -> Column:
    """Spans inside the limits, and no member too far from the middle."""
    out = F.lit(True)
    for field, tol, span in (("c", config.c_tol, config.c_span_tol), ("h", config.h_tol, config.h_span_tol)):
        values = _values(members, field)
        out = out & (_span(values) <= span) & (_reach(values) <= MIDDLE_REACH * tol)
    return out


def _new_steps(members: Column, other: Column) -> Column:
    """Log steps that a further member makes with its neighbours in sample order."""
    near = F.filter(members, lambda m: F.abs(m["order_index"] - other["order_index"]) == 1)
    return F.transform(near, lambda m: F.when(m["order_index"] < other["order_index"], other["v"] - m["v"]).otherwise(m["v"] - other["v"]))


def _count(values: Column, test) -> Column:
    return F.size(F.filter(values, test))


def grow_tracks(placed: DataFrame, edges: DataFrame, n_samples: int, config: HsqcTrackConfig) -> DataFrame:
    """Every track within the limits, single peaks included, with the running sums of its score.

    Columns: series_id, ids (in visiting order), members, n_pairs, n_mutual, pair_sum, steps, ups, downs.
    """
    ends = placed.select("series_id", F.col("peak_id").alias("other_id"), "place", F.col("member").alias("other"))
    links = cut_lineage(edges.join(ends, ["series_id", "other_id"]).select("series_id", "peak_id", "place", "other", "score", "reciprocal"))
    tracks = None
    for place in range(1, n_samples + 1):
        begun = placed.filter(F.col("place") == place).select(
            "series_id",
            F.array(F.col("member.peak_id")).alias("ids"),
            F.array("member").alias("members"),
            F.lit(0).cast("long").alias("n_pairs"),
            F.lit(0).cast("long").alias("n_mutual"),
            F.lit(0.0).alias("pair_sum"),
            F.array().cast("array<double>").alias("steps"),
            F.lit(0).alias("ups"),
            F.lit(0).alias("downs"),
        )
        if tracks is None:
            tracks = begun
            continue
        state = F.struct(*[c for c in tracks.columns if c not in ("series_id", "ids")])
        met = tracks.select("series_id", "ids", F.explode("ids").alias("peak_id"), state.alias("s")).join(
            links.filter(F.col("place") == place), ["series_id", "peak_id"]
        )
        grown = met.groupBy("series_id", "ids", "other").agg(
            F.any_value("s").alias("s"),
            F.count("*").alias("n"),
            F.sum(F.col("reciprocal").cast("long")).alias("mutual"),
            F.sum("score").alias("score"),
        )
        new = _new_steps(F.col("s.members"), F.col("other"))
        longer = grown.withColumn("new", new).select(
            "series_id",
            F.array_append("ids", F.col("other.peak_id")).alias("ids"),
            F.array_append("s.members", F.col("other")).alias("members"),
            (F.col("s.n_pairs") + F.col("n")).alias("n_pairs"),
            (F.col("s.n_mutual") + F.col("mutual")).alias("n_mutual"),
            (F.col("s.pair_sum") + F.col("score")).alias("pair_sum"),
            F.concat("s.steps", "new").alias("steps"),
            (F.col("s.ups") + _count(F.col("new"), lambda x: x > MOVE)).alias("ups"),
            (F.col("s.downs") + _count(F.col("new"), lambda x: x < -MOVE)).alias("downs"),
        )
        tracks = tracks.unionByName(cut_lineage(longer.filter(within_limits(F.col("members"), config)))).unionByName(begun)
    return tracks


def track_score(n_samples: int, config: HsqcTrackConfig) -> Column:
    """Coverage and pair scores less spans, gaps between log steps and changes of direction."""
    n = F.size("members")
    c_span, h_span = (_span(_values(F.col("members"), f)) for f in ("c", "h"))
    gap = F.when(F.size("steps") >= 2, _reach(F.col("steps"))).otherwise(F.lit(0.0))
    # Each rise met by a fall is one change of direction.
    turns = F.col("ups") * F.col("downs")
    return (
        n * 2.15
        + F.greatest(n - 2, F.lit(0)) * 0.75
        - (F.lit(n_samples) - n) * 0.50
        - c_span * 1.80 / config.c_span_tol
        - h_span * 1.35 / config.h_span_tol
        + F.col("pair_sum") * config.pair_weight
        - gap * 0.30
        - turns * 0.65
    )


def scored_tracks(peaks: DataFrame, pairs: DataFrame, n_samples: int, config: HsqcTrackConfig) -> DataFrame:
    """Candidate tracks of enough samples and score.

    Columns: series_id, track_id, members (by sample), n_members, mask, center_c, center_h, c_span, h_span, score,
    reciprocal_fraction.
    """
    edges = cut_lineage(pair_maps(pairs))
    placed = cut_lineage(visiting_order(peaks, edges))
    tracks = grow_tracks(placed, edges, n_samples, config).filter(F.size("members") >= max(2, config.min_track_size))
    scored = tracks.withColumn("score", track_score(n_samples, config)).filter(F.col("score") >= config.min_score)
    return scored.select("series_id", *described(n_samples), "score", (F.col("n_mutual") / F.greatest("n_pairs", F.lit(1))).alias("reciprocal_fraction"))


def described(n_samples: int) -> list[Column]:
    """Id, mask, centre and spans of a track from its members."""
    members = F.array_sort("members")
    c, h = _values(F.col("members"), "c"), _values(F.col("members"), "h")
    bits = F.aggregate(members, F.lit(0).cast("long"), lambda acc, m: acc + masks.sample_bit(m["order_index"], n_samples))
    return [
        F.array_join(F.transform(F.array_sort(_values(F.col("members"), "peak_id")), lambda i: i.cast("string")), "_").alias("track_id"),
        members.alias("members"),
        F.size("members").alias("n_members"),
        bits.alias("mask"),
        vectors.sorted_median(c).alias("center_c"),
        vectors.sorted_median(h).alias("center_h"),
        _span(c).alias("c_span"),
        _span(h).alias("h_span"),
    ]


def single_tracks(peaks: DataFrame, tracks: DataFrame, n_samples: int) -> DataFrame:
    """A track of score 0 for each peak that no track of ``tracks`` uses."""
    used = tracks.select("series_id", F.explode("members.peak_id").alias("peak_id")).distinct()
    lone = peaks.join(used, ["series_id", "peak_id"], "left_anti").select("series_id", F.array(_member()).alias("members"))
    return lone.select("series_id", *described(n_samples), F.lit(0.0).alias("score"), F.lit(0.0).alias("reciprocal_fraction"))
