"""Selection of disjoint tracks: heaviest first, then exchanges that gain weight, all in distributed rounds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakloom.operators.packing import pack_by_dominance
from peakloom.session import cut_lineage

LEAST_GAIN = 0.05


def _owners(uses: DataFrame, chosen: DataFrame, keys: list[str]) -> DataFrame:
    """Every track that is not chosen with the chosen tracks it shares peaks with: owners, their number and weight."""
    taken = uses.join(chosen, [*keys, "track_id"], "left_semi")
    owner = taken.select(*keys, "peak_id", F.struct(F.col("track_id").alias("id"), "weight").alias("owner"))
    rest = uses.join(chosen, [*keys, "track_id"], "left_anti")
    met = rest.join(owner, [*keys, "peak_id"], "left").groupBy(*keys, "track_id", "weight").agg(F.collect_set("owner").alias("owners"))
    held = F.aggregate("owners", F.lit(0.0), lambda total, o: total + o["weight"])
    return met.withColumn("held", held)


def _best_inside(single: DataFrame, uses: DataFrame, keys: list[str], most: int) -> DataFrame:
    """For each chosen track the tracks that could take its place together: the heaviest first, then disjoint ones.

    ``single``: tracks in conflict with that one only.  Each takes one of its peaks, so ``most`` (its peaks) rounds do.
    """
    left = cut_lineage(uses.join(single.select(*keys, "track_id", "owner"), [*keys, "track_id"]))
    picks = None
    for _ in range(most):
        top = left.groupBy(*keys, "owner").agg(F.max(F.struct("weight", "track_id")).alias("top"))
        won = cut_lineage(top.select(*keys, "owner", F.col("top.track_id").alias("track_id"), F.col("top.weight").alias("weight")))
        if won.isEmpty():
            break
        picks = won if picks is None else picks.unionByName(won)
        used = left.join(won.select(*keys, "owner", "track_id"), [*keys, "owner", "track_id"], "left_semi")
        hit = left.join(used.select(*keys, "owner", "peak_id").distinct(), [*keys, "owner", "peak_id"], "left_semi")
        left = cut_lineage(left.join(hit.select(*keys, "owner", "track_id").distinct(), [*keys, "owner", "track_id"], "left_anti"))
    return single.select(*keys, "owner", "track_id", "weight").limit(0) if picks is None else picks


def pack_by_exchange(tracks: DataFrame, keys: Sequence[str], most_members: int, least_gain: float = LEAST_GAIN) -> DataFrame:
    """Disjoint tracks of (keys, track_id, members, weight) that no exchange improves by more than ``least_gain``.

    Exchanges: a track takes the place of all the chosen ones it shares peaks with (of none, if it is free), or a
    chosen track gives way to tracks that conflict with it alone.  In a round every exchange that gains most
    at each peak it touches is made, so exchanges of one round never meet.  The weight rises in every round.
    """
    keys = list(keys)
    uses = cut_lineage(
        tracks.filter("weight > 0").select(*keys, "track_id", F.col("weight").cast("double").alias("weight"), F.explode("members.peak_id").alias("peak_id"))
    )
    chosen = cut_lineage(pack_by_dominance(tracks, keys))
    while True:
        state = cut_lineage(_owners(uses, chosen, keys))
        over = state.filter((F.size("owners") == 0) | (F.col("weight") - F.col("held") > least_gain))
        taking = over.select(
            *keys, F.concat(F.lit("t"), "track_id").alias("move"), (F.col("weight") - F.col("held")).alias("gain"), F.array("track_id").alias("come"),
            F.col("owners.id").alias("go"),
        )
        single = state.filter(F.size("owners") == 1).select(*keys, "track_id", "weight", F.col("owners")[0]["id"].alias("owner"), "held")
        picks = _best_inside(single, uses, keys, most_members)
        sums = picks.groupBy(*keys, "owner").agg(F.sum("weight").alias("sum"), F.collect_list("track_id").alias("come"))
        held = single.select(*keys, "owner", "held").distinct()
        giving = sums.join(held, [*keys, "owner"]).select(
            *keys, F.concat(F.lit("g"), "owner").alias("move"), (F.col("sum") - F.col("held")).alias("gain"), "come", F.array("owner").alias("go")
        )
        moves = cut_lineage(taking.unionByName(giving.filter(F.col("gain") > least_gain)))
        if moves.isEmpty():
            return tracks.join(chosen, [*keys, "track_id"], "left_semi")
        touched = moves.select(*keys, "move", "gain", F.explode(F.concat("come", "go")).alias("track_id")).join(uses.drop("weight"), [*keys, "track_id"])
        rank = F.struct("gain", "move")
        top = touched.groupBy(*keys, "peak_id").agg(F.max(rank).alias("top"))
        won = (
            touched.join(top, [*keys, "peak_id"])
            .groupBy(*keys, "move")
            .agg(F.bool_and(F.struct("gain", "move") == F.col("top")).alias("won"))
            .filter("won")
            .select(*keys, "move")
        )
        made = cut_lineage(moves.join(won, [*keys, "move"], "left_semi"))
        gone, come = (made.select(*keys, F.explode(c).alias("track_id")) for c in ("go", "come"))
        chosen = cut_lineage(chosen.join(gone, [*keys, "track_id"], "left_anti").unionByName(come))
