"""Connected components: edges are joined in runs, so long paths need few rounds."""

from __future__ import annotations

import random

from peakloom.operators import components
from peakloom.session import cut_lineage

EDGES = [(key, f"n{i:04d}", f"n{i + 1:04d}") for key in (1, 2) for i in range(300) if i != 150]


def _found(spark, rows):
    cuts = []

    def cut(df):
        cuts.append(df)
        return cut_lineage(df)

    edges = spark.createDataFrame(rows, "part int, src string, dst string")
    return {tuple(r) for r in components.connected_components(edges, ["part"], cut=cut).collect()}, len(cuts)


def test_long_paths_need_few_rounds(spark):
    rows = [*EDGES, (3, "a", "a")]
    random.Random(1).shuffle(rows)
    found, cuts = _found(spark, rows)
    whole = {(key, f"n{i:04d}", "n0000" if i <= 150 else "n0151") for key in (1, 2) for i in range(301)}
    assert found == whole | {(3, "a", "a")}
    assert cuts <= 7


def test_runs_of_any_length_and_nulls(spark, monkeypatch):
    rows = [*EDGES[:40], (1, None, "n0003"), (4, "b", None), (None, "d", "c"), (None, "e", "d")]
    whole, _ = _found(spark, rows)
    assert {r for r in whole if r[0] is None} == {(None, "c", "c"), (None, "d", "c"), (None, "e", "d")}
    assert (4, "b", "b") in whole and (1, "n0040", "n0000") in whole and (1, None, "n0000") in whole
    monkeypatch.setattr(components, "RUN_EDGES", 1)
    assert _found(spark, rows)[0] == whole
