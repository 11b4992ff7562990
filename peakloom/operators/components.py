"""Connected components: runs of edges are joined in place, then minimum labels are passed with pointer jumping."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakloom.session import cut_lineage

# Edges that are joined at once in a task; it bounds memory and changes no result.
RUN_EDGES = 200_000


def smallest_reachable(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` nodes the smallest one it reaches by the links a[i] - b[i]."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        for at in (a, b, root[a], root[b]):
            np.minimum.at(new, at, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _stars(run: pa.Table, keys: Sequence[str]) -> pa.Table:
    """Every node of a run of edges (keys, u, v) once, linked to the smallest node that the run connects it to."""
    n = run.num_rows
    group = np.zeros(2 * n, np.int64)
    for key in keys:
        values, codes = np.unique(run.column(key).to_numpy(), return_inverse=True)
        group = np.unique(group * len(values) + np.tile(codes, 2), return_inverse=True)[1]
    ends = pa.concat_arrays([run.column(c).combine_chunks() for c in ("u", "v")])
    values, codes = np.unique(ends.to_numpy(zero_copy_only=False), return_inverse=True)
    # Nodes are numbered by group and value, so the smallest number of a group is its smallest node.
    _, at, node = np.unique(group * len(values) + codes, return_index=True, return_inverse=True)
    root = smallest_reachable(node[:n], node[n:], len(at))
    of_key = [run.column(key).take(pa.array(at % n)) for key in keys]
    return pa.table([*of_key, ends.take(pa.array(at)), ends.take(pa.array(at[root]))], names=[*keys, "u", "v"])


def joined_runs(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Edges (keys, u, v) of the same components, fewer of them: stars inside runs of neighbouring edges.

    Edges with a null are passed as they are.  Runs follow the order of all columns, so a large group is
    spread over many tasks and a small one is mostly whole in one.
    """
    keys, names = list(keys), [*keys, "u", "v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            edges = pa.Table.from_batches(held)
            whole = edges.drop_null()
            if whole.num_rows < edges.num_rows:
                null = np.any([edges.column(c).is_null().to_numpy() for c in names], axis=0)
                yield from edges.filter(pa.array(null)).to_batches()
            if whole.num_rows:
                yield from _stars(whole, keys).to_batches(max_chunksize=50_000)

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= RUN_EDGES:
                yield from out()
                held, size = [], 0
        if size:
            yield from out()

    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.repartitionByRange(parts, *names).mapInArrow(run, pairs.schema)


def connected_components(
    edges: DataFrame, keys: Sequence[str] = (), src: str = "src", dst: str = "dst", cut: Callable[[DataFrame], DataFrame] = cut_lineage
) -> DataFrame:
    """Columns: keys, node, component (the smallest node id of the component).

    Runs of edges are first replaced by stars.  Each round then takes the smallest label among the
    neighbours and follows it to its own label, so the number of rounds grows with the logarithm of
    the longest path that is left.  Rounds are cut by ``cut``.
    """
    keys = list(keys)
    pairs = edges.select(*keys, F.col(src).alias("u"), F.col(dst).alias("v"))
    ends = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    both = cut(joined_runs(pairs, keys).select(*keys, F.inline(ends)).distinct())
    labels = cut(both.groupBy(*keys, F.col("u").alias("node")).agg(F.least("node", F.min("v")).alias("component")))
    while True:
        neighbour = labels.select(*keys, F.col("node").alias("v"), F.col("component").alias("near"))
        lower = both.join(neighbour, [*keys, "v"]).groupBy(*keys, F.col("u").alias("node")).agg(F.min("near").alias("near"))
        stepped = labels.join(lower, [*keys, "node"], "left").select(
            *keys, "node", F.col("component").alias("old"), F.least("component", "near").alias("component")
        )
        target = stepped.select(*keys, F.col("node").alias("component"), F.col("component").alias("jump"))
        moved = stepped.join(target, [*keys, "component"], "left").select(
            *keys, "node", "old", F.coalesce(F.least("jump", "component"), "component").alias("component")
        )
        moved = cut(moved)
        if moved.filter("old <> component").isEmpty():
            return moved.drop("old")
        labels = moved.drop("old")
