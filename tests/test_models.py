"""Saved calibration models and manifests of corrected samples."""

import json

import pytest

from peakloom.config import CalibrationConfig
from peakloom.operators import calibrate
from peakloom.sinks import models


def peaks(spark):
    rows = [
        ("s", f"x {i % 2}", 10.0 + 3.7 * i, 5.0 + (i * 7) % 11, 0.5 + 0.1 * (i % 5), None, "CH" if i % 3 else "CH2") for i in range(40)
    ]
    return spark.createDataFrame(rows, "series_id string, sample string, ppm double, height double, width double, area double, type string")


@pytest.mark.parametrize("config", [CalibrationConfig(), CalibrationConfig(use_type=True, delta_clip=None)])
def test_round_trip(spark, tmp_path, config):
    df = peaks(spark)
    model = calibrate.train(df, ["series_id"], ["sample"], config)
    models.save_model(model, str(tmp_path / "m"))
    again = models.load_model(spark, str(tmp_path / "m"), {"series_id": "string"})
    assert (again.config.mode, again.config.delta_clip, again.config.use_type) == (config.mode, config.delta_clip, config.use_type)

    def deltas(m):
        return sorted((r["ppm"], r["delta"], r["height_corr"]) for r in calibrate.correct(df, m).collect())

    assert deltas(again) == deltas(model)
    with pytest.raises(Exception, match="(?i)exists"):
        models.save_model(model, str(tmp_path / "m"))


PLAIN = {
    "version": 3, "mode": "basic", "used_area": False, "used_type": False, "calibration_mode": "height_stabilize", "shrink_strength": 1.0,
    "delta_clip": 0.2, "global_bias": 0.1, "ppm_bin_width": 10.0, "width_bin_width": 1.0, "ppm_min": 0.0, "width_min": 0.0,
    "ppm_edges": [0.0, 10.0, 20.0], "width_edges": [0.0, 1.0], "ppm_bias": {"0": -0.3, "1": 0.05}, "width_bias": {}, "type_bias": {},
}


def test_one_object_over_many_lines(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps(PLAIN, indent=2))
    model = models.load_model(spark, str(tmp_path / "m.json"), {})
    rows = spark.createDataFrame([(5.0, 1.0, 0.5), (15.0, 1.0, 0.5), (25.0, 1.0, 0.5)], "ppm double, height double, width double")
    got = sorted((r["ppm"], round(r["delta"], 9)) for r in calibrate.correct(rows, model).collect())
    assert got == [(5.0, -0.2), (15.0, 0.15), (25.0, 0.1)]


@pytest.mark.parametrize(
    "change, message", [({"version": 2}, "version"), ({"global_bias": None}, "global_bias"), ({"ppm_edges": None, "version": None}, "version, ppm_edges")]
)
def test_faulty_models_are_refused(spark, tmp_path, change, message):
    (tmp_path / "m.json").write_text(json.dumps({**PLAIN, **change}))
    with pytest.raises(ValueError, match=message):
        models.load_model(spark, str(tmp_path / "m.json"), {})


def test_groups_of_different_settings_and_empty_models(spark, tmp_path):
    (tmp_path / "m.json").write_text("\n".join(json.dumps({"k": i, **PLAIN, "delta_clip": 0.1 * i}) for i in (1, 2)))
    with pytest.raises(ValueError, match="different settings"):
        models.load_model(spark, str(tmp_path / "m.json"), {"k": "int"})
    (tmp_path / "e.json").write_text("")
    with pytest.raises(ValueError, match="empty"):
        models.load_model(spark, str(tmp_path / "e.json"), {"k": "int"})


def test_manifest_names_the_written_folders(spark, tmp_path):
    rows = [("02", 1.0), ("02", 2.0), ("a b+c:d", 3.0)]
    found = models.save_samples(spark.createDataFrame(rows, "sample string, ppm double"), str(tmp_path / "out")).collect()
    assert sorted((r["sample_id"], r["order_index"], r["n_rows"]) for r in found) == [("02", 0, 2), ("a b+c:d", 1, 1)]
    for r in found:
        values = spark.read.option("header", True).csv("file://" + r["path"].removeprefix("file:").replace("///", "/")).collect()
        assert len(values) == r["n_rows"]
