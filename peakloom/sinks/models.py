"""Saved calibration models and manifests of corrected samples, as JSON lines written and read by Spark."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peakloom.config import CalibrationConfig
from peakloom.operators.calibrate import CalibrationModel
from peakloom.sinks import export

# Fixed value: version of the saved form.
VERSION = 3
BIAS = "map<string,double>"
FIELDS = (
    "version int, mode string, used_area boolean, used_type boolean, calibration_mode string, shrink_strength double, "
    "delta_clip double, global_bias double, n_rows bigint, ppm_bin_width double, width_bin_width double, "
    f"ppm_min double, width_min double, ppm_edges array<double>, width_edges array<double>, ppm_bias {BIAS}, width_bias {BIAS}, type_bias {BIAS}"
)
NEEDED = ("version", "calibration_mode", "global_bias", "ppm_bin_width", "width_bin_width", "ppm_min", "width_min", "ppm_edges", "width_edges")


def _as_map(table: DataFrame, keys: list[str], by: str, name: str) -> DataFrame:
    entries = F.array_sort(F.collect_list(F.struct(F.col(by).cast("string").alias("k"), F.col("bias").alias("v"))))
    return table.groupBy(*keys).agg(F.map_from_entries(entries).alias(name))


def model_rows(model: CalibrationModel) -> DataFrame:
    """One row per group: its keys and the fields of the saved form; biases by number of bin or by type.

    A row holds the bins of one group, whose number follows from the axis and not from the rows.
    """
    keys, config = list(model.keys), model.config
    rows = model.base
    for table, by, name in ((model.ppm_bias, "ppm_bin", "ppm_bias"), (model.width_bias, "width_bin", "width_bias"), (model.type_bias, "type", "type_bias")):
        if table is None:
            rows = rows.withColumn(name, F.create_map().cast(BIAS))
        else:
            rows = rows.join(_as_map(table, keys, by, name), keys, "left")
            rows = rows.withColumn(name, F.coalesce(name, F.create_map().cast(BIAS)))

    def edges(low: str, bins: str, width: float) -> Column:
        return F.transform(F.sequence(F.lit(0), F.col(bins)), lambda i: F.col(low) + i * F.lit(float(width)))

    typed = F.lit(model.type_bias is not None)
    return rows.select(
        *keys,
        F.lit(VERSION).alias("version"),
        F.when(typed, F.lit("with_type")).otherwise(F.lit("basic")).alias("mode"),
        F.col("by_area").alias("used_area"),
        typed.alias("used_type"),
        F.lit(config.mode).alias("calibration_mode"),
        F.lit(float(config.shrink)).alias("shrink_strength"),
        F.lit(config.delta_clip).cast("double").alias("delta_clip"),
        "global_bias",
        "n_rows",
        F.lit(float(config.ppm_bin_width)).alias("ppm_bin_width"),
        F.lit(float(config.width_bin_width)).alias("width_bin_width"),
        "ppm_min",
        "width_min",
        edges("ppm_min", "ppm_bins", config.ppm_bin_width).alias("ppm_edges"),
        edges("width_min", "width_bins", config.width_bin_width).alias("width_edges"),
        "ppm_bias",
        "width_bias",
        "type_bias",
    )


def save_model(model: CalibrationModel, path: str) -> None:
    """Write the groups of a model; a folder that is there already is refused, not replaced."""
    model_rows(model).write.option("ignoreNullFields", False).json(path)


def load_model(spark: SparkSession, path: str, keys: dict[str, str]) -> CalibrationModel:
    """A saved model; ``keys`` names the key columns with their types, empty for a model of one group.

    Raises ValueError for no rows, another version, missing fields, or groups of different settings.
    """
    columns = ", ".join([*(f"{k} {t}" for k, t in keys.items()), FIELDS])
    # One object over many lines is read as well as one object per line.
    rows = spark.read.schema(columns).option("mode", "FAILFAST").option("multiLine", not keys).json(path)
    settings = ("calibration_mode", "shrink_strength", "delta_clip", "ppm_bin_width", "width_bin_width", "used_type")
    found = rows.agg(
        F.count("*").alias("n"),
        F.count_if(F.col("version") != VERSION).alias("other"),
        *[F.count_if(F.col(c).isNull()).alias(f"no_{c}") for c in (*keys, *NEEDED)],
        F.count_distinct(F.struct(*settings)).alias("settings"),
        *[F.first(c, ignorenulls=True).alias(c) for c in settings],
    ).first()
    if not found["n"]:
        raise ValueError("the saved model is empty")
    missing = [c for c in (*keys, *NEEDED) if found[f"no_{c}"]]
    if missing:
        raise ValueError(f"the saved model lacks {', '.join(missing)}")
    if found["other"]:
        raise ValueError(f"the saved model is not of version {VERSION}")
    if found["settings"] > 1:
        raise ValueError("the groups of the saved model have different settings")
    config = replace(
        CalibrationConfig(),
        mode=found["calibration_mode"],
        shrink=1.0 if found["shrink_strength"] is None else found["shrink_strength"],
        delta_clip=found["delta_clip"],
        ppm_bin_width=found["ppm_bin_width"],
        width_bin_width=found["width_bin_width"],
        use_type=bool(found["used_type"]),
    )

    def table(name: str, by: str, kind: str) -> DataFrame:
        return rows.select(*keys, F.explode(name).alias(by, "bias")).withColumn(by, F.col(by).cast(kind))

    base = rows.select(
        *keys,
        "n_rows",
        "ppm_min",
        (F.size("ppm_edges") - 1).alias("ppm_bins"),
        "width_min",
        (F.size("width_edges") - 1).alias("width_bins"),
        F.coalesce("used_area", F.lit(False)).alias("by_area"),
        "global_bias",
    )
    types = table("type_bias", "type", "string") if config.use_type else None
    return CalibrationModel(tuple(keys), config, base, table("ppm_bias", "ppm_bin", "int"), table("width_bias", "width_bin", "int"), types)


def save_samples(corrected: DataFrame, path: str) -> DataFrame:
    """Write corrected peaks (sample, ...) as one folder per sample, and the manifest of the samples beside them.

    The manifest (sample_id, order_index, source_type, path, n_rows) comes from the written files, one row per sample.
    """
    export.write_samples(corrected, f"{path}/peaks")
    spark = corrected.sparkSession
    columns = ", ".join([*(f"`{f.name}` string" for f in corrected.schema.fields if f.name != "sample"), "sample string"])
    written = spark.read.schema(columns).option("header", True).csv(f"{path}/peaks")
    file = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    held = written.groupBy(F.col("sample").alias("sample_id")).agg(
        F.min(F.regexp_replace(file, "/[^/]*$", "")).alias("path"), F.count("*").alias("n_rows")
    )
    rows = held.select(
        "sample_id", (F.row_number().over(Window.orderBy("sample_id")) - 1).alias("order_index"), F.lit("1d").alias("source_type"), "path", "n_rows"
    )
    rows.write.json(f"{path}/manifest")
    return spark.read.schema(rows.schema).json(f"{path}/manifest")
