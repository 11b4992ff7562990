"""Hydrogens, charges, formulas, record numbers and lookups of structure files."""

import pytest

from peakloom.sources import sdf


def block(name, atoms, bonds, extra=(), codes=None, fields=()):
    codes = codes or [0] * len(atoms)
    lines = [name, "  prog", "", f"{len(atoms):3d}{len(bonds):3d}  0  0  0  0  0  0  0  0999 V2000"]
    lines += [f"    0.0000    0.0000    0.0000 {a:<3} 0{c:3d}  0" for a, c in zip(atoms, codes)]
    lines += [f"{a:3d}{b:3d}{o:3d}  0" for a, b, o in bonds]
    lines += [*extra, "M  END"]
    for tag, value in fields:
        lines += [f"> <{tag}>", value, ""]
    return "\n".join(lines) + "\n"


def parsed(spark, *blocks):
    rows = [("f.sdf", i + 1, b) for i, b in enumerate(blocks)]
    return sdf.parse_molecules(spark.createDataFrame(rows, "source_file string, record_no bigint, record string"))


FW = ("FW", "1.0")
RING = [(1, 2, 4), (2, 3, 4), (3, 4, 4), (4, 5, 4), (5, 6, 4), (6, 1, 4)]
CASES = {
    "ethanol": (["C", "C", "O"], [(1, 2, 1), (2, 3, 1)], (), None, "C2H6O", [3, 2, 1]),
    "benzene, aromatic bonds": (["C"] * 6, RING, (), None, "C6H6", [1] * 6),
    "pyridine": (["N", *["C"] * 5], RING, (), None, "C5H5N", [0, *[1] * 5]),
    "naphthalene carbons at the seam": (
        ["C"] * 10, [*RING, (6, 7, 4), (7, 8, 4), (8, 9, 4), (9, 10, 4), (10, 1, 4)], (), None, "C10H8", [0, 1, 1, 1, 1, 0, 1, 1, 1, 1],
    ),
    "ammonium by M CHG": (["C", "N"], [(1, 2, 1)], ("M  CHG  1   2   1",), None, "CH6N+", [3, 3]),
    "acetate by atom code 5": (["C", "C", "O", "O"], [(1, 2, 1), (2, 3, 2), (2, 4, 1)], (), [0, 0, 0, 5], "C2H3O2-", [3, 0, 0, 0]),
    "M CHG replaces codes": (["C", "O"], [(1, 2, 1)], ("M  CHG  1   2  -1",), [5, 0], "CH3O-", [3, 0]),
    "carbanion": (["C", "C"], [(1, 2, 1)], ("M  CHG  1   1  -1",), None, "C2H5-", [2, 3]),
    "sulfone": (["C", "S", "O", "O", "C"], [(1, 2, 1), (2, 3, 2), (2, 4, 2), (2, 5, 1)], (), None, "C2H6O2S", [3, 0, 0, 0, 3]),
    "unknown element": (["C", "Se"], [(1, 2, 1)], (), None, "CH3Se", [3, 0]),
    "drawn hydrogen": (["C", "H"], [(1, 2, 1)], (), None, "CH", [0, 0]),
}


def test_hydrogens_and_formula(spark):
    rows = parsed(spark, *[block(n, *case[:4], [FW]) for n, case in CASES.items()])
    added = {r["record_no"]: r["added"] for r in rows.select("record_no", "added").collect()}
    counts = {r["record_no"]: r for r in sdf.element_counts(rows).collect()}
    for i, (name, case) in enumerate(CASES.items(), start=1):
        got, strange = counts[i], name == "unknown element"
        assert (name, got["formula"], added[i]) == (name, case[4], case[5])
        assert (got["known"], got["weight"] is None, got["exact_mass"] is None) == (not strange, strange, strange)


def test_completed_record_reads_back_with_all_hydrogens(spark):
    text = block("m", ["O", "C", "C"], [(1, 2, 1), (2, 3, 1)], (), None, [("ID", "e"), FW, ("HydrogenShifts", "1H[5]  3.6\n1H[8]  1.2")])
    rows = parsed(spark, text)
    whole = sdf.library(rows).first()
    assert (whole["carbon_count"], whole["num_atoms"], whole["num_bonds"]) == (2, 9, 8)
    again = parsed(spark, whole["mol_block"])
    assert again.first()["added"] == [0] * 9
    columns = ["c_index", "h_count", "h_indices", "h_shifts", "connected_carbon"]
    first = sdf.carbon_rows(rows).select(*columns).orderBy("c_index").collect()
    # The hydrogen of the oxygen comes first, so those of the carbons start one later.
    assert [r["h_indices"] for r in first] == [[4, 5], [6, 7, 8]]
    assert [r["h_shifts"] for r in first] == [[3.6, None], [None, 1.2, None]]
    assert first == sdf.carbon_rows(again).select(*columns).orderBy("c_index").collect()
    assert sdf.element_counts(rows).first()["formula"] == sdf.element_counts(again).first()["formula"] == "C2H6O"


def test_records_without_id_stay_apart(spark):
    got = sdf.element_counts(parsed(spark, block("", ["C"], [], fields=[FW]), block("", ["O"], [], fields=[FW]))).collect()
    assert sorted((r["record_no"], r["formula"]) for r in got) == [(1, "CH4"), (2, "H2O")]


@pytest.mark.parametrize("block_bytes", ["1000b", "128m"])
def test_numbers_are_those_of_the_file_whatever_the_blocks(spark, tmp_path, block_bytes):
    for file, n in (("a.sdf", 57), ("B.SD", 3), ("ignored.txt", 2)):
        texts = [block(f"{file}-{i}", ["C"] * (1 + i % 5), [], fields=[("ID", f"{file}-{i}"), FW]) for i in range(1, n + 1)]
        (tmp_path / file).write_text("$$$$\n".join(texts) + "$$$$\n")
    (tmp_path / "empty.sdf").write_text("")
    (tmp_path / "gap.sdf").write_text(f"{block('x', ['C'], [], fields=[FW])}$$$$\n$$$$\n{block('y', ['C'], [], fields=[FW])}$$$$\n")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", block_bytes)
    if block_bytes == "1000b":
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        records = sdf.read_numbered(spark, str(tmp_path))
        assert (spark.read.option("lineSep", "$$$$").text(str(tmp_path / "a.sdf")).rdd.getNumPartitions() > 3) == (block_bytes == "1000b")
        got = sorted((r["source_file"], r["record_no"], r["record"].split("\n")[0]) for r in records.collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = [("a.sdf", i, f"a.sdf-{i}") for i in range(1, 58)] + [("B.SD", i, f"B.SD-{i}") for i in range(1, 4)]
    assert got == sorted([*want, ("gap.sdf", 1, "x"), ("gap.sdf", 3, "y")])


def test_lookup_by_id_and_number(spark):
    ids = ["p", "q", "q", ""]
    rows = parsed(spark, *[block(f"t{i}", ["C"] * (i + 1), [], fields=[("ID", n), FW]) for i, n in enumerate(ids)])
    requests = [
        (1, "f.sdf", "q", None), (2, "f.sdf", None, 4), (3, "f.sdf", " p ", 3), (4, "f.sdf", "z", 1),
        (5, "f.sdf", None, 5), (6, "other", None, 1), (7, "f.sdf", "", 2), (8, "f.sdf", None, None), (9, None, "p", 1), (1, "f.sdf", "q", None),
    ]
    asked = spark.createDataFrame(requests, "request_id int, source_file string, molecule_id string, record_no int")
    got = sorted((r["request_id"], r["molecule"] and r["molecule"]["record_no"], r["missing"]) for r in sdf.find_molecules(rows, asked).collect())
    assert got == [
        (1, 2, None), (1, 2, None), (2, 4, None), (3, 1, None), (4, None, "no molecule with ID z"),
        (5, None, "no molecule with number 5"), (6, None, "no molecule with number 1"), (7, 2, None),
        (8, None, "neither ID nor number"), (9, None, "no molecule with ID p"),
    ]
    assert sdf.find_molecules(rows.limit(0), asked.limit(0)).count() == 0
