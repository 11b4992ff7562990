"""Spark operators on small hand-made inputs, against brute force or known answers."""

import itertools
import random

from pyspark.sql import functions as F

from peakloom.config import AssignConfig, CarbonSearch, ClusterConfig, PackConfig
from peakloom.operators import assignment, band, components, greedy, kmeans, packing, quality, residual, structure
from peakloom.sources import peaks as peak_files


def test_band_join_equals_nested_loop(spark):
    rng = random.Random(1)
    a = [(i, rng.uniform(-3, 3)) for i in range(60)]
    b = [(i, rng.uniform(-3, 3)) for i in range(60)]
    left = spark.createDataFrame(a, "i int, x double")
    right = spark.createDataFrame(b, "j int, y double")
    want = {(i, j) for (i, x), (j, y) in itertools.product(a, b) if abs(x - y) <= 0.25}
    for salt in (1, 4):
        got = band.band_join(left, right, [("x", "y", 0.25)], salt=salt).select("i", "j").collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want


def _typed_total(spark, carbons, peaks, search):
    c = spark.createDataFrame(carbons, "mol_id long, c_index int, h_count int, c_shift double")
    p = spark.createDataFrame(peaks, "query_id string, peak_id int, h_type int, shift double")
    return assignment.match_carbons(c, p, search).collect()


def test_hot_molecule_keeps_the_optimum(spark):
    """Many carbons, few peaks: the per-peak limit must not lose the best assignment."""
    rng = random.Random(3)
    carbons = [(1, i, 0, round(50 + rng.uniform(-1.5, 1.5), 3)) for i in range(400)]
    peaks = [("q", j, 0, 50 + j * 0.1) for j in range(4)]
    rows = _typed_total(spark, carbons, peaks, CarbonSearch())
    assert len(rows) == 4 and len({r.peak_id for r in rows}) == 4 and len({r.c_index for r in rows}) == 4
    assert all(abs(r.c_shift - r.shift) <= 0.5 for r in rows)
    total = sum(abs(r.c_shift - r.shift) for r in rows)
    best = 0.0
    near = {j: sorted(carbons, key=lambda c: abs(c[3] - peaks[j][3]))[:6] for j in range(4)}
    best = min(
        sum(abs(c[3] - peaks[j][3]) for j, c in enumerate(pick))
        for pick in itertools.product(*near.values())
        if len({c[1] for c in pick}) == 4
    )
    assert abs(total - best) < 1e-9


def test_typed_matching_flags_the_second_phase(spark):
    carbons = [(1, 0, 3, 20.0), (1, 1, 0, 20.1), (1, 2, 1, None)]
    peaks = [("q", 1, 3, 20.0), ("q", 2, 2, 20.2)]
    rows = {r.c_index: r for r in _typed_total(spark, carbons, peaks, CarbonSearch(typed=True))}
    assert rows[0].peak_id == 1 and rows[0].type_matched
    assert rows[1].peak_id == 2 and not rows[1].type_matched
    assert 2 not in rows


def test_equivalent_carbons_share_a_peak(spark):
    carbons = [(1, 0, 0, 20.0), (1, 1, 0, 20.0), (1, 2, 0, 21.0)]
    rows = _typed_total(spark, carbons, [("q", 1, 0, 20.0)], CarbonSearch(merge_equivalent=True))
    assert sorted(r.c_index for r in rows) == [0, 1]
    rows = _typed_total(spark, carbons, [("q", 1, 0, 20.0)], CarbonSearch())
    assert len(rows) == 1


def test_greedy_equals_sequential_pass(spark):
    rng = random.Random(5)
    pairs = [(1, i, j, round(rng.uniform(0, 1), 2)) for i in range(12) for j in range(12) if rng.random() < 0.4]
    df = spark.createDataFrame(pairs, "k int, l int, r int, d double")
    used_l, used_r, want = set(), set(), set()
    for _, i, j, d in sorted(pairs, key=lambda p: (p[3], p[1], p[2])):
        if i not in used_l and j not in used_r:
            used_l.add(i)
            used_r.add(j)
            want.add((i, j))
    got = {(r.l, r.r) for r in greedy.greedy_matches(df, ["k"], "l", "r", "d").collect()}
    assert got == want


def test_components_of_a_long_chain(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101)]
    out = components.connected_components(spark.createDataFrame(links, "src int, dst int")).collect()
    assert {r.component for r in out if r.node <= 40} == {0}
    assert {r.component for r in out if r.node >= 100} == {100}


def test_dominance_equals_heaviest_first(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(1, f"t{i:02d}", [(rng.randint(0, 12),) for _ in range(2)], float(rng.randint(1, 9))) for i in range(25)]
    df = spark.createDataFrame(rows, "series_id int, track_id string, members array<struct<peak_id:int>>, weight double")
    used, want = set(), set()
    for _, name, members, _w in sorted(rows, key=lambda r: (r[3], r[1]), reverse=True):
        ids = {m[0] for m in members}
        if not ids & used:
            used |= ids
            want.add(name)
    got = {r.track_id for r in packing.pack_by_dominance(df, ["series_id"]).collect()}
    assert got == want
    monkeypatch.setattr(packing, "LARGE_COMPONENT", 1)
    packed = packing.pack_tracks(df, ["series_id"], PackConfig()).collect()
    ids = [m.peak_id for r in packed for m in set(r.members)]
    assert len(ids) == len(set(ids))


def test_kmeans_finds_separate_groups(spark):
    rows = [(g, i, 2, [float(i // 5 * 10 + i % 5 * 0.1), 0.0]) for g in (1, 2) for i in range(10)]
    df = spark.createDataFrame(rows, "g int, idx long, k int, features array<double>")
    out = kmeans.kmeans(df, ["g"], 2).collect()
    for g in (1, 2):
        labels = {r.idx: r.label for r in out if r.g == g}
        assert len({labels[i] for i in range(5)}) == 1 and labels[0] != labels[9]


def test_silhouette_tiles_match_direct_formula(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(1, i, i % 3, [rng.gauss(i % 3, 0.4), rng.gauss(0, 1)]) for i in range(30)]
    df = spark.createDataFrame(rows, "g int, idx long, label int, features array<double>")

    def dist(a, b):
        return (sum((x - y) ** 2 for x, y in zip(a[3], b[3])) / 2) ** 0.5

    values = []
    for r in rows:
        means = {}
        for label in range(3):
            others = [o for o in rows if o[2] == label and o[1] != r[1]]
            means[label] = sum(dist(r, o) for o in others) / len(others)
        a, b = means[r[2]], min(v for k, v in means.items() if k != r[2])
        values.append((b - a) / max(a, b))
    want = sum(values) / len(values)
    for tile in (256, 4):
        monkeypatch.setattr(quality, "TILE_ROWS", tile)
        assert abs(quality.silhouette(df, ["g"]).first().silhouette - want) < 1e-9


def test_small_mask_cluster_is_dropped_only_when_explained(spark):
    rows = [(1, i, "C01", 7, 10.0 * i) for i in range(3)] + [(1, 10 + i, "C02", 6, 10.0 * i + 0.2) for i in range(3)]
    rows += [(1, 20 + i, "C03", 3, 10.0 * i + 5) for i in range(3)]
    df = spark.createDataFrame(rows, "series_id int, idx long, label string, mask long, center double")
    out = residual.mask_residual(df, 3, ClusterConfig(), [("center", 0.5)])
    assert {(r.idx, r.label) for r in out.collect()} == {(0, "C01"), (1, "C01"), (2, "C01"), (20, "C02"), (21, "C02"), (22, "C02")}


def test_hydrogen_groups(spark):
    rows = [([(0, 1.0), (1, 1.02)],), ([(0, 1.0), (1, 2.0)],), ([(0, None), (1, 2.0)],), ([(0, 1.0), (1, None), (2, 1.2)],)]
    df = spark.createDataFrame(rows, "h array<struct<h_idx:int,shift:double>>")
    out = [r.g for r in df.select(structure.hydrogen_groups(F.col("h"), 0.03).alias("g")).collect()]
    assert [len(g) for g in out] == [1, 2, 2, 1]
    assert [x.suffix for x in out[1]] == ["a", "b"] and out[2][1].predicted is None
    assert abs(out[3][0].predicted - 1.1) < 1e-9


def test_negative_points_fit_ch2_only(spark):
    predicted = spark.createDataFrame([(1, 0, 30.0, 1.0, 1), (1, 1, 31.0, 1.1, 2)], "mol_id int, point_id int, c double, h double, h_count int")
    points = spark.createDataFrame([(1, 7, 30.0, 1.0, -1.0)], "mol_id int, obs_id int, obs_c double, obs_h double, intensity double")
    rows = structure.assign_hsqc(predicted, points, AssignConfig(), 1).collect()
    assert [(r.point_id, r.obs_id) for r in rows] == [(1, 7)]


def test_peak_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Shift,Intensity,Integral\n10.5,3,7\nx,1,1\n")
    table = peak_files.read_delimited(spark, str(tmp_path / "a.csv")).collect()
    assert [(r["sample"], r.ppm, r.height, r.width, r.area) for r in table] == [("a", 10.5, 3.0, 1.0, 7.0)]
    (tmp_path / "b.txt").write_text("# comment\n10.5 3\n; x\n\n20.25\t4,8\n")
    table = peak_files.read_numeric(spark, str(tmp_path / "b.txt")).orderBy("ppm").collect()
    assert [(r.ppm, r.height, r.area) for r in table] == [(10.5, 3.0, None), (20.25, 4.0, 8.0)]
    (tmp_path / "c.xml").write_text('<L><Peak1D F1="12.5" intensity="3" type="0" width="0.5"/></L>')
    assert peak_files.read_xml(spark, str(tmp_path / "c.xml")).first().ppm == 12.5
    assert peak_files.find_column(["C ppm (13C)"], "ppm", loose=True) == "C ppm (13C)"


def test_files_fall_back_to_order(spark):
    ids = spark.createDataFrame([("A", 0), ("B", 1)], "id string, position int")
    files = spark.createDataFrame([("/d/A.csv",), ("/d/z1.csv",)], "path string")
    got = {r.id: r.path for r in peak_files.match_files(ids, files).collect()}
    assert got == {"A": "/d/A.csv", "B": "/d/z1.csv"}
