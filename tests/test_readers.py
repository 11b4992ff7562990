"""Reader faults that were found on small files."""

import pytest

from peakloom.sources import peaks, sdf


def test_blank_first_title_and_mixed_suffix(spark, tmp_path):
    block = "{}\n  prog\n\n  1  0  0  0  0  0  0  0  0  0999 V2000\n    0.0 0.0 0.0 C\nM  END\n> <Predicted 13C shifts>\n1[1] 20.5\n2[99999999999] 7.0\n\n$$$$\n"
    (tmp_path / "a.Sdf").write_text(block.format("") + block.format("") + block.format("named"))
    records = sdf.read_records(spark, str(tmp_path))
    assert records.count() == 3
    shifts = sdf.with_shifts(records, sdf.CARBON_TAG, "shifts").select("shifts").collect()
    assert [r["shifts"] for r in shifts] == [{0: 20.5}] * 3
    assert all(r["record"].split("\n")[3].strip().endswith("V2000") for r in records.collect())


def test_loose_headers_match_words():
    assert peaks.find_column(["index", "carbon"], "ppm", loose=True) != "index"
    assert peaks.find_column(["C ppm", "height"], "ppm", loose=True) == "C ppm"


def test_each_file_is_read_by_its_own_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ppm,height\n10.5,3\n11.5,4\n")
    (tmp_path / "b.csv").write_text("\nintensity,width,shift\n5,0.2,20.5\n6,,21.5\n")
    (tmp_path / "c.csv").write_text("30.5,7\n31.5,8,2.5,0.3\n")
    found = peaks.read_delimited(spark, str(tmp_path)).orderBy("ppm").collect()
    assert [(r["sample"], r["ppm"], r["height"], r["width"]) for r in found] == [
        ("a", 10.5, 3.0, 1.0),
        ("a", 11.5, 4.0, 1.0),
        ("b", 20.5, 5.0, 0.2),
        ("b", 21.5, 6.0, 1.0),
        ("c", 30.5, 7.0, 1.0),
        ("c", 31.5, 8.0, 0.3),
    ]


def test_table_without_ppm_is_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name,height\nx,3\n")
    with pytest.raises(ValueError, match="ppm"):
        peaks.read_delimited(spark, str(tmp_path))
