"""Batch assignment: errors stay with their molecule, results equal the best of all assignments."""

from dataclasses import replace
from itertools import permutations

import pytest
from test_structures import FW, block

from peakloom.config import AssignConfig
from peakloom.operators import batch
from peakloom.sources import peaks, sdf


def chain(name, shifts, fields=()):
    n = len(shifts)
    text = "\n".join(f"1[{i + 1}]  {s}" for i, s in enumerate(shifts) if s is not None)
    given = [("ID", name)] if name else []
    return block("t", ["C"] * n, [(i, i + 1, 1) for i in range(1, n)], fields=[*given, (sdf.CARBON_TAG, text), *fields])


def parse(spark, *records):
    rows = [("all.sdf", i + 1, r) for i, r in enumerate(records)]
    return sdf.parse_molecules(spark.createDataFrame(rows, "source_file string, record_no bigint, record string"))


def run(spark, folder, records, config=AssignConfig(), **more):
    return batch.assign_batch(parse(spark, *records), batch.list_files(spark, str(folder)), batch.read_lines(spark, str(folder)), config, **more)


def least(predicted, observed):
    known = [p for p in predicted if p is not None]
    a, b = sorted([known, observed], key=len)
    return min(sum(abs(x - y) for x, y in zip(a, c)) for c in permutations(b, len(a)))


def test_planted_faults(spark, tmp_path):
    shifts = {"good one": [20.0, 31.5, 33.0, 70.2], "b": [10.0, 12.0], "b2": [55.0], "mute": [40.0], "none": [41.0]}
    observed = {"good one": [33.4, 19.0, 72.0], "b": [11.5, 9.0, 200.0], "mute": [], "none": [44.5], "7": [12.0]}
    for name, values in observed.items():
        (tmp_path / f"{name}.csv").write_text("\n".join(f"{i + 1}\t{v}" for i, v in enumerate(values)) or "nothing\n\n")
    (tmp_path / "b.TSV").write_text("1\t999\n")  # the last path of a stem counts: b.csv
    (tmp_path / "stray.pdf").write_text("1 2 3")
    records = [
        chain("good one", shifts["good one"]),
        chain("broken", [20.0]).replace("  1  0  0", " xx  0  0"),
        chain("b", shifts["b"], [FW]),
        chain("b", shifts["b2"], [FW]),
        chain("lost", [10.0]),
        chain("mute", shifts["mute"]),
        block("t", ["C"], [], fields=[(sdf.CARBON_TAG, "1x[1] 12.5 [1] 99")]),
        chain("none", [None]),
        block("t", ["O"], [], fields=[("ID", "water")]),
    ]
    rows = run(spark, tmp_path, records).collect()
    notes = sorted((r["record_no"], r["kind"], r["reason"]) for r in rows if r["reason"])
    assert notes == [
        (2, "error", "unreadable atom or bond block"),
        (4, "warning", "repeated ID"),
        (5, "error", "no data file"),
        (6, "warning", "no shifts in the data file"),
        (8, "warning", "no predicted 13C shifts"),
        (9, "error", "no carbon atoms"),
    ]
    results = [r for r in rows if r["kind"] == "carbon"]
    assert sorted({r["record_no"] for r in results}) == [1, 3, 4, 6, 7, 8]
    for no, name, predicted in ((1, "good one", shifts["good one"]), (3, "b", shifts["b"]), (4, "b", shifts["b2"]), (7, "7", [12.5])):
        mine = sorted((r["atom_id"], r["predicted"], r["observed"], r["error"]) for r in results if r["record_no"] == no)
        assert [m[1] for m in mine] == predicted
        taken = [m for m in mine if m[2] is not None]
        assert len({m[2] for m in taken}) == len(taken) == min(len(predicted), len(observed[name]))
        assert sum(m[3] for m in taken) == pytest.approx(least(predicted, observed[name]))
    assert all(r["status"] == "missing" for r in results if r["record_no"] in (6, 8))


def test_enough_files_are_taken_by_order(spark, tmp_path):
    for i, value in enumerate([10.0, 20.0, 30.0]):
        (tmp_path / f"run-{i}.txt").write_text(f"{value};\n")
    rows = run(spark, tmp_path, [chain("x", [21.0]), chain("y", [9.0])]).collect()
    assert sorted((r["id"], r["kind"], r["observed"], r["reason"]) for r in rows if r["kind"] != "proton") == [
        ("x", "carbon", 10.0, None), ("x", "warning", None, "matched by order"),
        ("y", "carbon", 20.0, None), ("y", "warning", None, "matched by order"),
    ]


def test_points_go_before_lists(spark, tmp_path):
    c, h = tmp_path / "c", tmp_path / "h"
    c.mkdir(), h.mkdir()
    (c / "m.csv").write_text("20.4\n60.5\n")
    (h / "m.csv").write_text("20.1, 1.22, 5\n60.2, 3.61, -7\n")
    protons = (sdf.PROTON_TAG, "\n".join(f"1H[{i}]  {s}" for i, s in ((3, 1.2), (4, 1.2), (5, 1.2), (6, 3.6), (7, 3.6), (8, 3.6))))
    config = replace(AssignConfig(), use_hsqc=True)
    more = {"hsqc_files": batch.list_files(spark, str(h)), "hsqc_lines": batch.read_lines(spark, str(h))}
    rows = run(spark, c, [chain("m", [20.0, 60.0], [protons])], config, **more).collect()
    got = sorted((r["kind"], r["atom_id"], r["observed"], r["status"]) for r in rows)
    # A negative point fits CH2 only, so the second methyl keeps its shift of the list and no proton shift.
    assert got == [("carbon", 0, 20.1, "ok"), ("carbon", 1, 60.5, "ok"), ("proton", 0, 1.22, "ok"), ("proton", 1, None, "missing")]


def test_proton_lists(spark):
    carbons = spark.createDataFrame(
        [(1, 0, 20.0, 2, [5, 6], [1.0, 2.0]), (1, 1, 30.0, 3, [7, 8, 9], [0.9, None, 1.1]), (2, 0, 9.0, 0, [], [])],
        "mol_id int, atom_id int, predicted double, h_count int, h_indices array<int>, h_shifts array<double>",
    )
    shifts = spark.createDataFrame([(1, 1, 21.0)], "mol_id int, obs_id int, shift double")
    protons = spark.createDataFrame([(1, 1, 2.1), (1, 2, 0.95), (1, 3, 1.02)], "mol_id int, obs_id int, shift double")
    _, groups = batch.assign(carbons, shifts, AssignConfig(), protons=protons)
    got = sorted((r["atom_id"], r["group_no"], r["suffix"], round(r["predicted"], 3), r["observed"]) for r in groups.collect())
    total = sum(abs(g[3] - g[4]) for g in got)
    assert [(g[:4]) for g in got] == [(0, 0, "a", 1.0), (0, 1, "b", 2.0), (1, 0, "", 1.0)]
    assert total == pytest.approx(least([1.0, 2.0, 1.0], [2.1, 0.95, 1.02]))


def test_empty_inputs(spark):
    files = spark.createDataFrame([], "path string")
    lines = spark.createDataFrame([], "path string, line_no bigint, line string")
    assert batch.assign_batch(parse(spark, chain("x", [1.0])).limit(0), files, lines, AssignConfig()).count() == 0
    rows = batch.assign_batch(parse(spark, chain("x", [1.0])), files, lines, AssignConfig()).collect()
    assert [(r["kind"], r["reason"]) for r in rows] == [("error", "no data file")]


def test_ranks_of_a_distributed_sort(spark):
    df = spark.range(1000).selectExpr("cast((id * 7919) % 1000 as string) as path").repartition(7)
    got = peaks._numbered(df, "path").collect()
    assert [p for _, p in sorted((r["rank"], r["path"]) for r in got)] == sorted(str(i) for i in range(1000))
    assert peaks._numbered(df.limit(0), "path").count() == 0
