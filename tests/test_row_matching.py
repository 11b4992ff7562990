"""HSQC matching of whole molecules in rows, against matching from pairs."""

import random

from peakloom.config import HsqcSearch
from peakloom.operators import assignment


def _tables(spark):
    rng = random.Random(3)
    points = [(m, i, rng.choice([1, 2, 3]), float(rng.randrange(0, 200)), rng.randrange(0, 120) / 10) for m in range(12) for i in range(1 + 3 * m)]
    peaks = [(q, p, p % 3 + 1, rng.randrange(0, 20_000) / 100, rng.randrange(0, 1_200) / 100) for q in range(3) for p in range(5 + q)]
    return (
        spark.createDataFrame(points, "mol_id long, point_id int, h_count int, c double, h double"),
        spark.createDataFrame(peaks, "query_id int, peak_id long, h_type int, shift double, h_shift double"),
    )


def _gains(df):
    """Pairs and total gain of each group."""
    out = {}
    for r in df.collect():
        key = (r.query_id, r.mol_id, r.h_class)
        n, total = out.get(key, (0, 0.0))
        out[key] = (n + 1, total + r.gain)
    return {k: (n, round(t, 5)) for k, (n, t) in out.items()}


def test_rows_and_pairs_give_the_same_matching(spark, monkeypatch):
    points, peaks = _tables(spark)
    for search in (HsqcSearch(), HsqcSearch(mode=3), HsqcSearch(merge_equivalent=True)):
        whole = assignment.match_hsqc(points, peaks, search)
        assert "Window" not in whole._jdf.queryExecution().optimizedPlan().toString()  # no pair is shuffled
        found = _gains(whole)
        with monkeypatch.context() as m:
            m.setattr(assignment, "WHOLE_GROUP", 4)  # larger molecules go pair by pair
            assert _gains(assignment.match_hsqc(points, peaks, search)) == found
