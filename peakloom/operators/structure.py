"""Assignment of measured shifts to predicted atoms, statuses and manual edits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peakloom.config import AssignConfig
from peakloom.functions import scoring
from peakloom.operators.assignment import COMPLETE_SCALE, solve_matching


def nearest_positions(short: np.ndarray, long: np.ndarray) -> list[int]:
    """For each value of ``short`` its partner in ``long``: least total distance, one to one.

    On a line an optimal assignment keeps the order of both lists, so a table over the
    sorted lists finds it row by row.
    """
    s, t = np.argsort(short, kind="stable"), np.argsort(long, kind="stable")
    best = np.zeros(len(long) + 1)
    took = []
    for i in s:
        use = best[:-1] + np.abs(long[t] - short[i])
        row = np.concatenate([[np.inf], np.minimum.accumulate(use)])
        took.append(np.concatenate([[False], use <= row[:-1]]) & np.isfinite(row))
        best = row
    out = [0] * len(short)
    j = len(long)
    for i in reversed(range(len(s))):
        while not took[i][j]:
            j -= 1
        out[s[i]] = int(t[j - 1])
        j -= 1
    return out


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _nearest(predicted: pd.Series, observed: pd.Series) -> pd.Series:
    """Per predicted value the position of its observed value, -1 without one."""

    def solve(p, o):
        p, o = np.asarray(p, float), np.asarray(o, float)
        if len(p) <= len(o):
            return nearest_positions(p, o)
        out = [-1] * len(p)
        for j, i in enumerate(nearest_positions(o, p)):
            out[i] = j
        return out

    return pd.Series([solve(p, o) for p, o in zip(predicted, observed)])


def assign_nearest(predicted: DataFrame, observed: DataFrame) -> DataFrame:
    """Observed shift of every predicted atom of a molecule: mol_id, atom_id, obs_id, observed.

    Inputs: (mol_id, atom_id, predicted) and (mol_id, obs_id, shift).  A molecule is one
    structure-file record, so its lists are short.
    """
    p = predicted.filter("predicted IS NOT NULL").groupBy("mol_id").agg(
        F.array_sort(F.collect_list(F.struct("atom_id", "predicted"))).alias("p")
    )
    o = observed.filter("shift IS NOT NULL").groupBy("mol_id").agg(
        F.array_sort(F.collect_list(F.struct("obs_id", "shift"))).alias("o")
    )
    solved = p.join(o, "mol_id").withColumn("at", _nearest(F.col("p")["predicted"], F.col("o")["shift"]))
    rows = solved.select("mol_id", "o", F.explode(F.arrays_zip("p", "at")).alias("z")).filter("z.at >= 0")
    pick = F.get("o", F.col("z.at"))
    return rows.select("mol_id", "z.p.atom_id", pick["obs_id"].alias("obs_id"), pick["shift"].alias("observed"))


def assign_hsqc(predicted: DataFrame, points: DataFrame, config: AssignConfig, limit: int) -> DataFrame:
    """Measured HSQC point of every predicted point: most pairs first, then least distance.

    Inputs: (mol_id, point_id, c, h, h_count) and (mol_id, obs_id, obs_c, obs_h,
    intensity); ``limit`` bounds the measured points of a molecule.  Negative points
    fit CH2 only.
    """
    allowed = F.col("intensity").isNull() | (F.col("intensity") >= 0) | (F.col("h_count") == 2)
    dc, dh = F.abs(F.col("c") - F.col("obs_c")), F.abs(F.col("h") - F.col("obs_h"))
    distance = dc / config.c_tol * 0.7 + dh / config.h_tol * 0.3
    pairs = (
        predicted.dropna(subset=["c", "h"])
        .join(points, "mol_id")
        .filter(allowed)
        .withColumn("gain", F.lit(COMPLETE_SCALE) - distance)
    )
    return solve_matching(pairs, ["mol_id"], "point_id", "obs_id", "gain", limit, ["c", "h", "obs_c", "obs_h"])


def hydrogen_groups(hydrogens: Column, tol: float) -> Column:
    """Equivalence groups of the hydrogens of one carbon.

    ``hydrogens`` is array<struct<h_idx, shift>>.  Three hydrogens form one group with
    the mean of their known shifts; otherwise they are taken by shift (unknown last) and
    join the first group whose mean is within ``tol``.
    Result: array<struct<atoms, predicted, suffix>>.
    """
    ordered = F.array_sort(
        F.transform(
            hydrogens,
            lambda h: F.struct(
                h["shift"].isNull().alias("unknown"), h["shift"].alias("shift"), h["h_idx"].cast("int").alias("h_idx")
            ),
        )
    )

    def single(h: Column) -> Column:
        return F.struct(
            F.array(h["h_idx"]).alias("atoms"),
            F.coalesce(h["shift"], F.lit(0.0)).alias("total"),
            F.when(h["unknown"], F.lit(0)).otherwise(F.lit(1)).alias("known"),
        )

    def place(groups: Column, h: Column) -> Column:
        fits = F.transform(
            groups, lambda g: (g["known"] > 0) & ~h["unknown"] & (F.abs(h["shift"] - g["total"] / g["known"]) <= tol)
        )
        at = F.array_position(F.transform(fits, lambda f: F.coalesce(f, F.lit(False))), True) - 1
        joined = F.transform(
            groups,
            lambda g, i: F.when(
                i == at,
                F.struct(
                    F.array_append(g["atoms"], h["h_idx"]).alias("atoms"),
                    (g["total"] + h["shift"]).alias("total"),
                    (g["known"] + 1).alias("known"),
                ),
            ).otherwise(g),
        )
        return F.when(at >= 0, joined).otherwise(F.array_append(groups, single(h)))

    kind = "array<struct<atoms:array<int>,total:double,known:int>>"
    folded = F.aggregate(ordered, F.array().cast(kind), lambda groups, h: place(groups, h).cast(kind))
    known = F.filter(F.transform(hydrogens, lambda h: h["shift"]), lambda s: s.isNotNull())
    methyl = F.array(
        F.struct(
            F.transform(hydrogens, lambda h: h["h_idx"].cast("int")).alias("atoms"),
            F.aggregate(known, F.lit(0.0), lambda a, x: a + x).alias("total"),
            F.size(known).alias("known"),
        )
    ).cast(kind)
    groups = F.when(F.size(hydrogens) == 3, methyl).otherwise(folded)
    letters = F.split(F.lit("a,b,c,d,e,f,g,h"), ",")
    return F.transform(
        groups,
        lambda g, i: F.struct(
            g["atoms"].alias("atoms"),
            (g["total"] / F.nullif(g["known"], F.lit(0))).alias("predicted"),
            F.when((F.size(groups) == 1) | (F.size(g["atoms"]) > 1), F.lit("")).otherwise(F.get(letters, i)).alias("suffix"),
        ),
    )


def with_status(assigned: DataFrame, predicted: DataFrame, observed: DataFrame, config: AssignConfig) -> DataFrame:
    """Add ``error`` and ``status``; ambiguity looks at all shifts of the molecule.

    Pass the assigned shifts as ``observed`` to judge a table after manual edits.
    """
    all_p = predicted.filter("predicted IS NOT NULL").groupBy("mol_id").agg(F.collect_list("predicted").alias("_all_p"))
    all_o = observed.filter("shift IS NOT NULL").groupBy("mol_id").agg(F.collect_list("shift").alias("_all_o"))
    joined = assigned.join(all_p, "mol_id", "left").join(all_o, "mol_id", "left")
    status = scoring.carbon_status(F.col("predicted"), F.col("observed"), F.col("_all_p"), F.col("_all_o"), config)
    return (
        joined.withColumn("error", F.abs(F.col("predicted") - F.col("observed")))
        .withColumn("status", status)
        .drop("_all_p", "_all_o")
    )


def proton_status(groups: DataFrame, config: AssignConfig) -> DataFrame:
    error = F.abs(F.col("predicted") - F.col("observed"))
    return groups.withColumn("error", error).withColumn(
        "status", scoring.error_status(error, config.h_yellow, config.h_red)
    )


def prefer_hsqc_carbon(assigned: DataFrame, hsqc: DataFrame) -> DataFrame:
    """Replace the observed carbon shift by that of the HSQC point with the least carbon error."""
    best = hsqc.groupBy("mol_id", "atom_id").agg(
        F.min(F.struct(F.abs(F.col("c") - F.col("obs_c")).alias("d"), "obs_c")).alias("b")
    )
    return (
        assigned.join(best.select("mol_id", "atom_id", F.col("b.obs_c").alias("_c")), ["mol_id", "atom_id"], "left")
        .withColumn("observed", F.coalesce("_c", "observed"))
        .drop("_c")
    )


def edit_shifts(assigned: DataFrame, edits: DataFrame) -> DataFrame:
    """Set observed shifts from (mol_id, atom_id, new_shift); null clears a shift."""
    changed = edits.withColumn("_edited", F.lit(True))
    return (
        assigned.join(changed, ["mol_id", "atom_id"], "left")
        .withColumn("observed", F.when(F.col("_edited"), F.col("new_shift")).otherwise(F.col("observed")))
        .drop("new_shift", "_edited")
    )


def swap_observed(assigned: DataFrame, swaps: DataFrame) -> DataFrame:
    """Exchange the observed shifts of atom pairs (mol_id, atom_a, atom_b)."""
    both = swaps.select("mol_id", F.col("atom_a").alias("atom_id"), F.col("atom_b").alias("_from")).unionByName(
        swaps.select("mol_id", F.col("atom_b").alias("atom_id"), F.col("atom_a").alias("_from"))
    )
    source = assigned.select("mol_id", F.col("atom_id").alias("_from"), F.col("observed").alias("_observed"))
    moved = both.join(source, ["mol_id", "_from"]).select("mol_id", "atom_id", "_observed", F.lit(True).alias("_moved"))
    return (
        assigned.join(moved, ["mol_id", "atom_id"], "left")
        .withColumn("observed", F.when(F.col("_moved"), F.col("_observed")).otherwise(F.col("observed")))
        .drop("_observed", "_moved")
    )


def split_group(group: Column, shifts: Column) -> Column:
    """One group per hydrogen, taking the given shifts in order; labels a, b, ..."""
    letters = F.split(F.lit("a,b,c,d,e,f,g,h"), ",")
    return F.transform(
        group["atoms"],
        lambda a, i: F.struct(
            F.array(a).alias("atoms"),
            group["predicted"].alias("predicted"),
            F.get(letters, i).alias("suffix"),
            F.get(shifts, i).alias("observed"),
        ),
    )


def merge_groups(groups: Column, shift: Column) -> Column:
    """All hydrogens of a carbon as one group with the mean of the known predictions."""
    known = F.filter(F.transform(groups, lambda g: g["predicted"]), lambda p: p.isNotNull())
    mean = F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(known), F.lit(0))
    return F.struct(
        F.flatten(F.transform(groups, lambda g: g["atoms"])).alias("atoms"),
        mean.alias("predicted"),
        F.lit("").alias("suffix"),
        shift.alias("observed"),
    )


def relabel(assigned: DataFrame, labels: DataFrame) -> DataFrame:
    """Display labels from (mol_id, atom_id, label), digits only; the 1-based atom number otherwise."""
    valid = labels.filter(F.col("label").rlike(r"^\d+$"))
    return assigned.join(valid, ["mol_id", "atom_id"], "left").withColumn(
        "label", F.coalesce("label", (F.col("atom_id") + 1).cast("string"))
    )

