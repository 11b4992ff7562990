"""Nearest peak of every point, by lists of points, against a plain search."""

import math
import random

from peakloom.operators import assignment


def test_nearest_peak_of_each_query(spark):
    rng = random.Random(5)
    points = [(i % 7, i, rng.randrange(0, 40) / 2, rng.randrange(0, 20) / 10) for i in range(300)] + [(None, 1, 3.0, None), (2, None, None, 1.0)]
    peaks = [(q, p, 0, rng.randrange(0, 40) / 2, rng.randrange(0, 20) / 10) for q in (1, 2, None) for p in range(6)]
    peaks += [(2, 9, 0, None, 1.0)]
    arrays = assignment.peak_arrays(spark.createDataFrame(peaks, "query_id int, peak_id long, h_type int, shift double, h_shift double"), 1)
    found = assignment.nearest_peaks_of_points(spark.createDataFrame(points, "mol_id long, point_id int, c double, h double"), arrays)
    # Nothing but the peaks is dealt out: the points are not shuffled or sorted.
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "array_sort(transform" not in plan

    def plain(c, h, query):
        def key(p):
            known = None not in (c, h, p[3], p[4])
            return (known, math.sqrt((c - p[3]) ** 2 + ((h - p[4]) * 10) * ((h - p[4]) * 10)) if known else 0.0, p[1])

        best = min((p for p in peaks if p[0] == query), key=key)
        return best[1], best[3], best[4], key(best)[1] if key(best)[0] else None

    expected = sorted(((q, m, i, c, h, *plain(c, h, q)) for q in (1, 2, None) for m, i, c, h in points), key=repr)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == expected
