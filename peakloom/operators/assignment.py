"""One-to-one assignment of library signals to query peaks.

Candidate pairs are built and pruned in Spark; only groups whose candidates
really compete reach the Python matcher, as short arrays.

The peaks of all queries are few and are sent to the molecules, so the candidates of a molecule
are made, matched and dropped in one row; no pair is shuffled.  Only molecules of more than
``WHOLE_GROUP`` signals go pair by pair.

Pruning is exact: with at most ``m`` peaks in a group, a peak never needs a row
outside its own ``m`` best rows, because at most ``m - 1`` of those can be taken by
other peaks.  A group therefore ships at most ``m * m`` pairs to one task, whatever
the size of the molecule, and the per-peak limit is applied before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peakloom.config import CarbonSearch, HsqcSearch
from peakloom.functions import scoring
from peakloom.operators.band import band_join
from peakloom.session import broadcast_if_small, cut_lineage, spread

# Gain of a pair is this scale minus its cost, and a row left out costs the scale.
SCORE_SCALE = 10_000.0
# For complete matchings every pair outweighs any sum of distances.
COMPLETE_SCALE = 1_000_000.0
# Signals of a molecule that are kept in one row; larger molecules are matched from shuffled pairs.
WHOLE_GROUP = 1_000
# Gains that differ by more leave no doubt which matching is best.
CLEAR_GAIN = 1e-3
# Points that meet the peaks of a query in one row, and points worked on at once.
POINTS_PER_ROW = 64
POINTS_AT_ONCE = 1 << 15


def max_gain_matching(rows: Sequence[int], cols: Sequence[int], gains: Sequence[float]) -> list[int]:
    """Positions of the edges in a one-to-one matching of maximum total gain.

    Works from the side with fewer nodes, whose nodes need only their k best edges
    (k nodes can block at most k - 1 of them).  The matching grows along the best
    alternating path (Bellman-Ford on the residual graph) while the total rises.
    """
    few, many = (rows, cols) if len(set(rows)) <= len(set(cols)) else (cols, rows)
    size = len(set(few))
    near: dict[int, list[int]] = {}
    for e in sorted(range(len(few)), key=lambda e: (few[e], -gains[e], many[e])):
        mine = near.setdefault(few[e], [])
        if len(mine) < size:
            mine.append(e)
    holder: dict[int, int] = {}  # node of the larger side -> matched edge
    open_nodes = set(near)
    while open_nodes:
        reach = {node: (0.0, None) for node in open_nodes}
        changed = sorted(open_nodes)
        while changed:
            moved = set()
            for node in changed:
                value = reach[node][0]
                for e in near[node]:
                    held = holder.get(many[e])
                    if held is None or held == e:
                        continue
                    gain = value + gains[e] - gains[held]
                    if few[held] not in reach or gain > reach[few[held]][0] + 1e-9:
                        reach[few[held]] = (gain, e)
                        moved.add(few[held])
            changed = sorted(moved)
        best_gain, best_edge = 1e-9, None
        for node in sorted(reach):
            for e in near[node]:
                if many[e] not in holder and reach[node][0] + gains[e] > best_gain:
                    best_gain, best_edge = reach[node][0] + gains[e], e
        if best_edge is None:
            break
        e = best_edge
        while e is not None:
            holder[many[e]] = e
            start, e = few[e], reach[few[e]][1]
        open_nodes.discard(start)
    return sorted(holder.values())


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _choose_edges(rows: pd.Series, cols: pd.Series, gains: pd.Series) -> pd.Series:
    return pd.Series(
        [None if r is None else max_gain_matching(list(r), list(c), list(g)) for r, c, g in zip(rows, cols, gains)]
    )


# Marked so that no filter on the chosen edges is pushed below the projection, which would run the matcher twice.
_choose_edges = _choose_edges.asNondeterministic()


def max_group_size(df: DataFrame, keys: Sequence[str]) -> int:
    """Largest group of a (small) table."""
    top = df.groupBy(*keys).count().agg(F.max("count")).first()[0]
    return int(top or 1)


def solve_matching(
    edges: DataFrame,
    keys: Sequence[str],
    row: str,
    col: str,
    gain: str,
    limit: int,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Best one-to-one matching inside every ``keys`` group.

    ``edges`` holds one row per candidate pair; ``limit`` is a proven bound of the
    number of distinct ``col`` values per group.
    """
    best = Window.partitionBy(*keys, col).orderBy(F.desc(gain), row)
    kept = [*keys, row, col, gain, *carry]
    pruned = edges.select(*kept).withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") <= limit).drop("_rank")
    grouped = pruned.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(row, col, gain, *carry))).alias("_edges")
    )
    rows, cols, gains = (F.col("_edges")[name] for name in (row, col, gain))
    contested = (F.size(F.array_distinct(rows)) < F.size(rows)) | (F.size(F.array_distinct(cols)) < F.size(cols))
    chosen = _choose_edges(
        F.when(contested, rows.cast("array<long>")), F.when(contested, cols.cast("array<long>")), F.when(contested, gains)
    )
    return (
        grouped.withColumn("_chosen", chosen)
        .withColumn(
            "_edges",
            F.when(F.col("_chosen").isNull(), F.col("_edges")).otherwise(
                F.transform("_chosen", lambda i: F.get(F.col("_edges"), i))
            ),
        )
        .select(*keys, F.explode("_edges").alias("_edge"))
        .select(*keys, "_edge.*")
    )


def carbon_candidates(carbons: DataFrame, peaks: DataFrame, search: CarbonSearch) -> DataFrame:
    """Pairs of a carbon and a query peak that score above zero.

    Carbons outside every fine range can only score zero and take no part.
    """
    green, yellow = scoring.window_bounds(F.col("c_shift"), search)
    widest = search.window.yellow if search.window else max(r.yellow for r in search.fine_ranges)
    build = (
        carbons.filter("c_shift IS NOT NULL")
        .withColumn("_green", green)
        .withColumn("_yellow", yellow)
        .filter("_yellow IS NOT NULL")
    )
    pairs = band_join(build, broadcast_if_small(peaks), [("c_shift", "shift", widest)])
    delta = F.abs(F.col("c_shift") - F.col("shift"))
    gain = F.lit(SCORE_SCALE) - scoring.pair_cost(delta, F.col("_green"), F.col("_yellow"))
    return pairs.withColumn("gain", gain).filter((delta < F.col("_yellow")) & (F.col("gain") > 0))


def match_carbons(carbons: DataFrame, peaks: DataFrame, search: CarbonSearch) -> DataFrame:
    """Matched carbons: query_id, mol_id, c_index, c_shift, peak_id, shift, type_matched.

    ``carbons`` may carry extra pair conditions in an ``eligible`` column of its
    own; unmatched carbons are simply absent (see ``with_unmatched``).
    """
    if not search.typed:
        return _match_once(carbons, peaks, search, by_type=False).withColumn("type_matched", F.lit(True))
    first = _match_once(carbons, peaks, search, by_type=True).withColumn("type_matched", F.lit(True))
    # Second phase: what is left on both sides, regardless of type.
    pairs = carbon_candidates(carbons.drop("h_count"), peaks.drop("h_type"), search)
    pairs = _restrict(pairs)
    used_atoms = first.select("query_id", "mol_id", "c_index")
    used_peaks = first.select("query_id", "mol_id", "peak_id").distinct()
    left = pairs.join(used_atoms, ["query_id", "mol_id", "c_index"], "left_anti").join(
        used_peaks, ["query_id", "mol_id", "peak_id"], "left_anti"
    )
    second = _solve_carbons(left, peaks, search, ["query_id", "mol_id"], ["query_id"])
    return first.unionByName(second.withColumn("type_matched", F.lit(False)))


def _restrict(pairs: DataFrame) -> DataFrame:
    """Apply the query-dependent size limit when both of its columns are present."""
    if {"carbon_count", "max_carbons"} <= set(pairs.columns):
        return pairs.filter("carbon_count <= max_carbons")
    return pairs


def _match_once(carbons: DataFrame, peaks: DataFrame, search: CarbonSearch, by_type: bool) -> DataFrame:
    pairs = _restrict(carbon_candidates(carbons, peaks, search))
    keys = ["query_id", "mol_id"]
    if by_type:
        pairs = pairs.filter("h_count = h_type")
        return _solve_carbons(pairs, peaks, search, [*keys, "h_type"], ["query_id", "h_type"]).drop("h_type")
    return _solve_carbons(pairs, peaks, search, keys, ["query_id"])


def _solve_carbons(pairs: DataFrame, peaks: DataFrame, search: CarbonSearch, keys, peak_keys) -> DataFrame:
    limit = max_group_size(peaks, peak_keys)
    carry = ["c_shift", "shift"]
    if not search.merge_equivalent:
        return solve_matching(pairs, keys, "c_index", "peak_id", "gain", limit, carry)
    # Equivalent carbons (equal to 6 decimals) form one row and share its peak.
    shared = pairs.withColumn("row_key", F.round(F.col("c_shift") * 1e6).cast("long"))
    heads = shared.dropDuplicates([*keys, "row_key", "peak_id"])
    solved = solve_matching(heads, keys, "row_key", "peak_id", "gain", limit, ["shift"])
    return shared.select(*keys, "row_key", "peak_id", "c_index", "c_shift").join(
        solved.select(*keys, "row_key", "peak_id", "shift"), [*keys, "row_key", "peak_id"]
    ).select(*keys, "c_index", "peak_id", "c_shift", "shift")


def with_unmatched(eligible_carbons: DataFrame, matches: DataFrame) -> DataFrame:
    """All carbons of the eligible molecules; those without a peak keep a null shift."""
    found = matches.select(
        "query_id", "mol_id", "c_index", "peak_id", F.col("shift").alias("user_shift"), "type_matched"
    )
    return eligible_carbons.join(found, ["query_id", "mol_id", "c_index"], "left").withColumn(
        "type_matched", F.coalesce("type_matched", F.lit(False))
    )


def hsqc_class(h_count: Column, mode: int) -> Column:
    """Group in which points and peaks may meet: all, {CH, CH3} / CH2, or each type alone."""
    if mode == 1:
        return F.lit(0)
    if mode == 2:
        return F.when(h_count == 2, F.lit(2)).otherwise(F.lit(13))
    return h_count.cast("int")


def peak_arrays(peaks: DataFrame, mode: int) -> DataFrame:
    """One row per query and class with the array of its peaks (a query spectrum is short)."""
    return (
        peaks.withColumn("h_class", hsqc_class(F.col("h_type"), mode))
        .groupBy("query_id", "h_class")
        .agg(F.array_sort(F.collect_list(F.struct("peak_id", "shift", "h_shift"))).alias("peaks"))
    )


def _pair_terms(c: Column, h: Column, shift: Column, h_shift: Column, search: HsqcSearch) -> tuple[Column, Column]:
    """(distance, assignment cost) of a point and a peak."""
    dc, dh = c - shift, h - h_shift
    distance = scoring.hsqc_distance(dc, dh)
    score = scoring.hsqc_pair_score(dc, dh, search.c_tol, search.h_tol)
    return distance, (F.lit(1.0) - score) * SCORE_SCALE + distance * 0.001


def ranked_peaks(search: HsqcSearch) -> Column:
    """The peaks of a joined ``peak_arrays`` row, best first by assignment cost."""

    def keyed(p: Column) -> Column:
        _, cost = _pair_terms(F.col("c"), F.col("h"), p["shift"], p["h_shift"], search)
        return F.struct(
            cost.alias("sort_key"),
            p["peak_id"].alias("peak_id"),
            p["shift"].alias("shift"),
            p["h_shift"].alias("h_shift"),
        )

    return F.array_sort(F.transform("peaks", keyed))


def _point_rows(columns: Sequence[str]):
    """Arrow function: consecutive points as lists of at most ``POINTS_PER_ROW``, one list per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = pa.StructArray.from_arrays([batch.column(n) for n in columns], list(columns))
            starts = np.append(np.arange(0, len(flat), POINTS_PER_ROW), len(flat)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(starts), flat)], ["points"])

    return run


def _nearest_of_points(columns: Sequence[str]):
    """Arrow function: lists of points beside the peaks of a query to each point with its nearest peak.

    An unknown distance comes first, as it does in a sort; equal ones go to the earlier peak.
    """

    def numbers(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        known = values.is_valid().to_numpy(zero_copy_only=False)
        return np.where(known, values.to_numpy(zero_copy_only=False).astype(float), 0.0), known

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points, peaks, queries = batch.column("points"), batch.column("peaks"), batch.column("query_id")
            for rows in queries.to_pandas().to_frame("q").groupby("q", dropna=False).indices.values():
                own = peaks.slice(int(rows[0]), 1).flatten()
                query = queries.slice(int(rows[0]), 1)
                (shift, has_shift), (h_shift, has_h_shift) = (numbers(own.field(n)) for n in ("shift", "h_shift"))
                mine = points.take(pa.array(rows)).flatten()
                for at in range(0, len(mine), POINTS_AT_ONCE):
                    some = mine.slice(at, POINTS_AT_ONCE)
                    inner = some.flatten()
                    place = {n: inner[some.type.get_field_index(n)] for n in columns}
                    (c, has_c), (h, has_h) = numbers(place["c"]), numbers(place["h"])
                    dc, dh = c[:, None] - shift[None, :], h[:, None] - h_shift[None, :]
                    distance = np.sqrt(dc * dc + (dh * 10) * (dh * 10))
                    known = (has_c & has_h)[:, None] & (has_shift & has_h_shift)[None, :]
                    nearest = np.where(known, distance, -np.inf).argmin(axis=1)
                    row = np.arange(len(some))
                    gap = pa.array(distance[row, nearest], mask=~known[row, nearest])
                    met = own.take(pa.array(nearest)).flatten()
                    named = {n: met[own.type.get_field_index(n)] for n in ("peak_id", "shift", "h_shift")}
                    columns_out = [query.take(pa.array(np.zeros(len(some), np.int64))), *place.values(), *named.values(), gap]
                    yield pa.RecordBatch.from_arrays(columns_out, ["query_id", *columns, *named, "distance"])

    return run


def nearest_peaks_of_points(points: DataFrame, arrays: DataFrame) -> DataFrame:
    """query_id, the columns of ``points`` (with c and h), peak_id, shift, h_shift, distance: the nearest peak of each query.

    ``arrays`` are the ``peak_arrays`` of one class.  Points stay where they are, so nothing but the peaks is moved.
    """
    fields = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in points.schema.fields)
    packed = points.mapInArrow(_point_rows(points.columns), f"points array<struct<{fields}>>")
    joined = packed.crossJoin(broadcast_if_small(arrays.select("query_id", "peaks")))
    peak = {f.name: f.dataType for f in arrays.schema["peaks"].dataType.elementType.fields}
    schema = T.StructType([T.StructField("query_id", arrays.schema["query_id"].dataType), *points.schema.fields])
    for name in ("peak_id", "shift", "h_shift"):
        schema = schema.add(name, peak[name])
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields]).add("distance", T.DoubleType())
    return joined.mapInArrow(_nearest_of_points(points.columns), schema)


def hsqc_candidates(points: DataFrame, peaks: DataFrame, search: HsqcSearch) -> DataFrame:
    """Candidate pairs: each point with its best peaks of its class.

    Every pair has a positive score, so nothing can be cut by distance.  A molecule
    with n points needs only the n best peaks per point, taken from the peak array
    before any row is emitted.
    """
    build = points.withColumn("h_class", hsqc_class(F.col("h_count"), search.mode))
    sizes = build.groupBy("mol_id", "h_class").agg(F.count("*").alias("n_points"))
    arrays = broadcast_if_small(peak_arrays(peaks, search.mode))
    sized = spread(build.join(sizes, ["mol_id", "h_class"]), "mol_id", "point_id")
    best = F.slice(ranked_peaks(search), F.lit(1), F.least(F.col("n_points"), F.size("peaks")).cast("int"))
    distance, cost = _pair_terms(F.col("c"), F.col("h"), F.col("shift"), F.col("h_shift"), search)
    return (
        sized.join(arrays, "h_class")
        .select("query_id", "mol_id", "h_class", "point_id", "c", "h", "n_points", F.explode(best).alias("p"))
        .select("query_id", "mol_id", "h_class", "point_id", "c", "h", "n_points", "p.peak_id", "p.shift", "p.h_shift")
        .withColumn("distance", distance)
        .withColumn("gain", F.lit(SCORE_SCALE) - cost)
        .filter("gain > 0")
    )


def _contested_group(
    ids: Sequence[int | None], peak_known: Sequence[bool], order: np.ndarray, gains: np.ndarray, places: Sequence[tuple[float, float]], limit: int
) -> list[tuple[int, int]]:
    """Matched (point, peak) places of one molecule: each point with its best peaks, each peak with its best points.

    A pair whose point or peak has no id is, on that side, equal to no other pair.
    """
    edges = [(i, int(p), float(gains[i, p])) for i in range(len(ids)) for p in order[i, : len(ids)] if gains[i, p] > 0]
    number = [(i is not None, i or 0) for i in ids]
    kept, seen = [], {}
    for e in sorted(edges, key=lambda e: (e[1], -e[2], number[e[0]])):
        seen[e[1]] = seen.get(e[1], 0) + 1
        if seen[e[1]] <= limit:
            kept.append(e)
    kept.sort(key=lambda e: (number[e[0]], e[1], e[2], places[e[0]]))
    rows = [float("nan") if ids[e[0]] is None else ids[e[0]] for e in kept]
    cols = [e[1] if peak_known[e[1]] else float("nan") for e in kept]
    return [kept[n][:2] for n in max_gain_matching(rows, cols, [e[2] for e in kept])]


def _match_rows(search: HsqcSearch, limit: int):
    """Arrow function: rows of one molecule and one query, points and peaks as lists, to their matched pairs."""

    def places(numbers: dict[str, np.ndarray], starts: np.ndarray, sizes: np.ndarray, peaks: tuple[np.ndarray, ...], ids: list):
        """row, point, peak, gain and distance of the matches of rows that share their peaks; points as places in the flat list."""
        flat = np.concatenate([np.arange(s, s + n) for s, n in zip(starts, sizes, strict=True)])
        first = np.r_[0, np.cumsum(sizes)[:-1]]
        dc = numbers["c"][flat][:, None] - peaks[0][None, :]
        dh = numbers["h"][flat][:, None] - peaks[1][None, :]
        distance = np.sqrt(dc * dc + (dh * 10) * (dh * 10))
        inside = (np.abs(dc) <= search.c_tol) & (np.abs(dh) <= search.h_tol)
        with np.errstate(divide="ignore"):
            score = np.where(inside, 1.0, 1.0 / np.maximum(np.abs(dc) / search.c_tol, np.abs(dh) / search.h_tol))
        cost = (1.0 - score) * SCORE_SCALE + distance * 0.001
        gains = SCORE_SCALE - cost
        order = np.argsort(np.where(np.isnan(cost), -np.inf, cost), axis=1, kind="stable")
        row = np.arange(len(flat))
        best = gains[row, order[:, 0]]
        # Points whose best peaks differ and are clearly best take them: no other matching gains as much.
        ahead = (best > 0) & numbers["known"][flat] & peaks[2].all()
        if order.shape[1] > 1:
            ahead &= best - gains[row, order[:, 1]] > CLEAR_GAIN
        group = np.repeat(np.arange(len(sizes)), sizes)
        pairs = np.sort(group * order.shape[1] + order[:, 0])
        clear = np.logical_and.reduceat(ahead, first)
        clear[pairs[1:][pairs[1:] == pairs[:-1]] // order.shape[1]] = False
        taken = clear[group]
        found = [np.stack([group[taken], np.flatnonzero(taken), order[taken, 0]])]
        for g in np.flatnonzero(~clear):
            mine = slice(first[g], first[g] + sizes[g])
            own, spots = [ids[i] for i in flat[mine]], [(float(numbers["c"][i]), float(numbers["h"][i])) for i in flat[mine]]
            chosen = _contested_group(own, peaks[2], order[mine], gains[mine], spots, limit)
            if chosen:
                at, peak = np.array(chosen).T
                found.append(np.stack([np.full(len(at), g), first[g] + at, peak]))
        group, point, peak = np.concatenate(found, axis=1)
        return group, flat[point], peak, gains[point, peak], distance[point, peak]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points, peaks = batch.column("points"), batch.column("peaks")
            starts, ends = (points.offsets.to_numpy()[i : i + len(points)] for i in (0, 1))
            x, y = points.values, peaks.values
            numbers = {"c": x.field("c").to_numpy(zero_copy_only=False), "h": x.field("h").to_numpy(zero_copy_only=False)}
            ids = x.field("point_id").to_pylist()
            numbers["known"] = x.field("point_id").is_valid().to_numpy(zero_copy_only=False)
            named = y.field("peak_id").is_valid().to_numpy(zero_copy_only=False)
            shift, h_shift = (y.field(n).to_numpy(zero_copy_only=False).astype(float) for n in ("shift", "h_shift"))
            same = pd.DataFrame({"q": batch.column("query_id").to_pandas(), "k": batch.column("h_class").to_pandas()})
            for rows in same.groupby(["q", "k"], dropna=False).indices.values():
                at = peaks.offsets[int(rows[0])].as_py(), peaks.offsets[int(rows[0]) + 1].as_py()
                own = tuple(v[at[0] : at[1]] for v in (shift, h_shift, named))
                group, point, peak, gain, distance = places(numbers, starts[rows], (ends - starts)[rows], own, ids)
                take = pa.array(rows[group])
                chosen, met = x.take(pa.array(point)), y.take(pa.array(peak + at[0]))
                columns = [batch.column(n).take(take) for n in ("query_id", "mol_id", "h_class")]
                columns += [chosen.field("point_id"), met.field("peak_id"), pa.array(gain)]
                columns += [chosen.field("c"), chosen.field("h"), met.field("shift"), met.field("h_shift"), pa.array(distance)]
                yield pa.RecordBatch.from_arrays(columns, MATCH_COLUMNS)

    return run


MATCH_COLUMNS = ["query_id", "mol_id", "h_class", "point_id", "peak_id", "gain", "c", "h", "shift", "h_shift", "distance"]


def _match_in_rows(build: DataFrame, arrays: DataFrame, search: HsqcSearch, limit: int) -> DataFrame:
    """Matching of molecules of bounded size: points of a molecule and class in one row, met by each query's peaks."""
    groups = (
        spread(build, "mol_id", "h_class")
        .groupBy("mol_id", "h_class")
        .agg(F.array_sort(F.collect_list(F.struct("point_id", "c", "h"))).alias("points"))
    )
    joined = groups.join(broadcast_if_small(arrays), "h_class").select("query_id", "mol_id", "h_class", "points", "peaks")
    types = {f.name: f.dataType for f in joined.schema.fields}
    inner = {f.name: f.dataType for name in ("points", "peaks") for f in types[name].elementType.fields}
    own = {**types, **inner, "gain": T.DoubleType(), "distance": T.DoubleType()}
    return joined.mapInArrow(_match_rows(search, limit), T.StructType([T.StructField(n, own[n]) for n in MATCH_COLUMNS]))


def _match_points(build: DataFrame, peaks: DataFrame, search: HsqcSearch) -> DataFrame:
    """Best matching of the points (with ``h_class``) of each molecule and class with the peaks of each query."""
    keys = ["query_id", "mol_id", "h_class"]
    build = build.filter("mol_id IS NOT NULL AND h_class IS NOT NULL")
    classed = peaks.withColumn("h_class", hsqc_class(F.col("h_type"), search.mode))
    limit = max_group_size(classed, ["query_id", "h_class"])
    wide = build.groupBy("mol_id", "h_class").count().filter(F.col("count") > WHOLE_GROUP).select("mol_id", "h_class")
    if wide.isEmpty():
        return _match_in_rows(build, peak_arrays(peaks, search.mode), search, limit)
    wide = broadcast_if_small(cut_lineage(wide))
    whole = _match_in_rows(build.join(wide, ["mol_id", "h_class"], "left_anti"), peak_arrays(peaks, search.mode), search, limit)
    pairs = hsqc_candidates(build.join(wide, ["mol_id", "h_class"], "left_semi"), peaks, search)
    carry = ["c", "h", "shift", "h_shift", "distance"]
    return whole.unionByName(solve_matching(pairs, keys, "point_id", "peak_id", "gain", limit, carry))


def match_hsqc(points: DataFrame, peaks: DataFrame, search: HsqcSearch) -> DataFrame:
    """Matched points: query_id, mol_id, h_class, point_id, c, h, peak_id, shift, h_shift, distance."""
    build = points.withColumn("h_class", hsqc_class(F.col("h_count"), search.mode))
    if not search.merge_equivalent:
        return _match_points(build, peaks, search)
    # Points with identical coordinates form one row and share its peak.
    heads = build.groupBy("mol_id", "h_class", "c", "h").agg(
        F.min("point_id").alias("point_id"), F.first("h_count").alias("h_count")
    )
    solved = _match_points(heads, peaks, search).drop("point_id")
    return build.select("mol_id", "h_class", "c", "h", "point_id").join(solved, ["mol_id", "h_class", "c", "h"])
