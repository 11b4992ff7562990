"""HSQC tracks, packing by exchanges and trend clusters against plain versions on small tables."""

import itertools
import random
from collections import defaultdict

from pyspark.sql import functions as F

from peakloom.config import ClusterConfig, HsqcTrackConfig
from peakloom.operators import exchange, hsqc_clusters, hsqc_tracks
from peakloom.plans import hsqc_cluster

CONFIG = HsqcTrackConfig(c_tol=1.0, h_tol=0.5, c_span_tol=1.5, h_span_tol=0.8)


def median(values):
    v = sorted(values)
    return (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2


def fits(members):
    for at, tol, span in ((2, CONFIG.c_tol, CONFIG.c_span_tol), (3, CONFIG.h_tol, CONFIG.h_span_tol)):
        values = [m[at] for m in members]
        if max(values) - min(values) > span or any(abs(x - median(values)) > 1.35 * tol for x in values):
            return False
    return True


def test_tracks_of_many_samples(spark):
    """All tracks come out, also in dense places and with more samples than any limit of old."""
    rng = random.Random(2)
    peaks = [(1, s, 100 * s + i, round(rng.uniform(0, 2.5), 2), round(rng.uniform(0, 1), 2), 1.0 + i) for s in range(12) for i in range(1 + s % 2)]
    df = spark.createDataFrame(peaks, "series_id long, order_index int, peak_id long, c_corr double, h_corr double, intensity double")
    near = lambda a, b: abs(a[3] - b[3]) <= CONFIG.c_tol and abs(a[4] - b[4]) <= CONFIG.h_tol
    links = [(a, b) for a in peaks for b in peaks if a[1] < b[1] and near(a, b)]
    linked = defaultdict(set)
    for a, b in links:
        linked[a[2]].add(b[2])
        linked[b[2]].add(a[2])
    pairs = spark.createDataFrame([(1, a[2], b[2], 0.5, False) for a, b in links], "series_id long, a long, b long, score double, reciprocal boolean")

    part = {p: p for p in linked}
    for _ in part:
        part = {p: min(part[p], *(part[q] for q in linked[p])) for p in part}
    sizes = defaultdict(int)
    for p in peaks:
        if p[2] in part:
            sizes[part[p[2]], p[1]] += 1
    want = set()
    for root in set(part.values()):
        order = sorted((s for r, s in sizes if r == root), key=lambda s: (sizes[root, s], s))
        sets = [()]
        for s in order:
            here = [p for p in peaks if p[1] == s and part.get(p[2]) == root]
            sets += [(*t, p) for t in sets for p in here if (not t or any(q[2] in linked[p[2]] for q in t)) and fits([(0, 0, *m[3:5]) for m in (*t, p)])]
        want |= {"_".join(map(str, sorted(p[2] for p in t))) for t in sets if len(t) >= 2}

    edges = hsqc_tracks.pair_maps(pairs)
    grown = hsqc_tracks.grow_tracks(hsqc_tracks.visiting_order(df, edges), edges, 12, CONFIG).filter(F.size("ids") >= 2)
    got = grown.select(F.array_join(F.transform(F.array_sort("ids"), lambda i: i.cast("string")), "_").alias("t")).collect()
    assert len(got) == len({r["t"] for r in got}) and {r["t"] for r in got} == want and max(t.count("_") for t in want) > 6


def test_exchanges(spark):
    """Two lighter tracks replace a heavier one; the weight is never below heaviest-first and disjoint."""
    rng = random.Random(7)
    rows = [(0, "x", [1, 2], 1.0), (0, "y", [1], 0.9), (0, "z", [2], 0.8), (0, "w", [9], 0.01)]
    for series in range(1, 25):
        for i in range(rng.randrange(1, 9)):
            rows.append((series, f"t{i}", sorted(rng.sample(range(7), rng.randrange(1, 4))), round(rng.uniform(0.1, 2), 3)))
    df = spark.createDataFrame(rows, "s long, track_id string, ids array<long>, weight double")
    df = df.withColumn("members", F.transform("ids", lambda i: F.struct(i.alias("peak_id"))))
    got = defaultdict(set)
    for r in exchange.pack_by_exchange(df, ["s"], 3).collect():
        got[r["s"]].add(r["track_id"])
    assert got[0] == {"y", "z", "w"}
    for series in range(25):
        own = {t: (set(ids), w) for s, t, ids, w in rows if s == series}
        picked = got[series]
        assert all(not own[a][0] & own[b][0] for a, b in itertools.combinations(picked, 2))
        total, used, plain = sum(own[t][1] for t in picked), set(), 0.0
        for ids, w in sorted(own.values(), key=lambda x: -x[1]):
            if not ids & used:
                used |= ids
                plain += w
        assert total >= plain - 1e-9
        for t in set(own) - picked:
            rivals = [own[p][1] for p in picked if own[p][0] & own[t][0]]
            assert rivals and own[t][1] - sum(rivals) <= exchange.LEAST_GAIN + 1e-9


def test_small_parts_join_nearest(spark):
    parts = spark.createDataFrame([(1, 3, i, p) for i, p in enumerate([0, 0, 0, 1, 2, 2, 2])], "series_id long, mask long, idx long, part int")
    tracks = parts.select("series_id", "idx", (F.col("idx") * 10.0).alias("center_c"))
    got = {r["idx"]: r["part"] for r in hsqc_clusters.attach_small(parts, tracks, 3).collect()}
    # The lone part at 30 is 20 from the mean of the first part and 20 from that of the last; the lower one wins.
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 2, 5: 2, 6: 2}


def test_labels_and_entry(spark):
    rng = random.Random(4)
    base = [(5.0 * i + 10, 0.2 * i + 1, rng.choice([1, -1])) for i in range(14)]
    peaks = [
        (1, s, 100 * s + i, c + rng.uniform(-0.05, 0.05), h + rng.uniform(-0.02, 0.02), 10.0 * 2.0 ** (d * s))
        for s in range(3)
        for i, (c, h, d) in enumerate(base)
        if (i + s) % 7
    ]
    df = spark.createDataFrame(peaks, "series_id long, order_index int, peak_id long, c_ppm double, h_ppm double, intensity double")
    labelled = hsqc_cluster.cluster_hsqc(df, 3, CONFIG, ClusterConfig(model="pmtc")).collect()
    by_label = defaultdict(set)
    for r in labelled:
        if r["n_members"] == 3:
            by_label[r["label"]].add(base[r["members"][0]["peak_id"] % 100][2])
    assert len(by_label) >= 2 and all(len(d) == 1 for d in by_label.values())
    empty = hsqc_cluster.cluster_hsqc(df.limit(0), 3, CONFIG, ClusterConfig(model="mask_only"))
    assert empty.count() == 0
