"""Intensity calibration: sequential median biases by position, width and type."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakloom.config import CalibrationConfig
from peakloom.functions import spectra
from peakloom.session import settle


@dataclass(frozen=True)
class CalibrationModel:
    """Bias tables, one set per ``keys`` group."""

    keys: tuple[str, ...]
    config: CalibrationConfig
    base: DataFrame  # keys, n_rows, ppm_min, ppm_bins, width_min, width_bins, by_area, global_bias
    ppm_bias: DataFrame
    width_bias: DataFrame
    type_bias: DataFrame | None


def prepare(peaks: DataFrame) -> DataFrame:
    """Defaults and cleaning: width at least 1e-6 (1.0 when unknown), rows without ppm or height dropped."""
    return peaks.withColumn("width", F.greatest(F.coalesce("width", F.lit(1.0)), F.lit(1e-6))).dropna(
        subset=["ppm", "height"]
    )


def enough_area(n_area: Column, n_rows: Column, round_up: bool = True) -> Column:
    """Area is usable from 30 percent of the rows (at least 3) on; the automatic mode truncates."""
    share = F.ceil(n_rows * 0.3) if round_up else F.floor(n_rows * 0.3)
    return n_area >= F.greatest(share, F.lit(3))


def _log(x: Column) -> Column:
    return F.log(F.greatest(x, F.lit(1e-8)))


def targets(peaks: DataFrame, keys: Sequence[str], sample: Sequence[str], config: CalibrationConfig) -> DataFrame:
    """Add ``target`` (wanted log correction) and ``by_area`` to prepared peaks."""
    keys, sample = list(keys), list(sample)
    sizes = peaks.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.count("area").alias("n_area"))
    wants_area = config.mode == "area_match" and config.use_area
    by_area = enough_area(F.col("n_area"), F.col("n_rows")) if wants_area else F.lit(False)
    work = peaks.join(sizes.select(*keys, by_area.alias("by_area")), keys)
    medians = peaks.groupBy(*keys, *sample).agg(F.median("height").alias("_ref"))
    work = work.join(medians, [*keys, *sample])
    ref = F.col("_ref")
    if config.use_type:
        typed = peaks.filter("type IS NOT NULL").groupBy(*keys, *sample, "type").agg(F.median("height").alias("_typed"))
        work = work.join(typed, [*keys, *sample, "type"], "left")
        ref = F.coalesce("_typed", "_ref")
    by_height = F.lit(float(config.shrink)) * (_log(ref) - _log(F.col("height")))
    target = F.when(F.col("by_area"), _log(F.col("area")) - _log(F.col("height"))).otherwise(by_height)
    return work.withColumn("target", target).drop("_ref", "_typed")


def _with_bins(work: DataFrame, config: CalibrationConfig) -> DataFrame:
    return work.withColumn(
        "ppm_bin", spectra.right_closed_bin(F.col("ppm"), F.col("ppm_min"), config.ppm_bin_width, F.col("ppm_bins"))
    ).withColumn(
        "width_bin",
        spectra.right_closed_bin(F.col("width"), F.col("width_min"), config.width_bin_width, F.col("width_bins")),
    )


def _subtract(work: DataFrame, keys: list[str], by: str) -> tuple[DataFrame, DataFrame]:
    """Median residual per bin, and the residual without it."""
    bias = work.filter(F.col(by).isNotNull()).groupBy(*keys, by).agg(F.median("residual").alias("bias")).dropna()
    bias = settle(bias)
    rest = (
        work.join(bias, [*keys, by], "left")
        .withColumn("residual", F.col("residual") - F.coalesce("bias", F.lit(0.0)))
        .drop("bias")
    )
    return bias, rest


def train(peaks: DataFrame, keys: Sequence[str], sample: Sequence[str], config: CalibrationConfig) -> CalibrationModel:
    """Fit the biases of every ``keys`` group; ``sample`` separates the spectra of a group."""
    keys = list(keys)
    # Each step is written once: the next one reads it both for its medians and for its rows.
    work = settle(targets(settle(prepare(peaks)), keys, sample, config))

    def n_bins(column: str, width: float) -> Column:
        return F.greatest(F.ceil((F.max(column) - F.min(column)) / F.lit(width)), F.lit(1)).cast("int")

    base = work.groupBy(*keys).agg(
        F.count("*").alias("n_rows"),
        F.min("ppm").alias("ppm_min"),
        n_bins("ppm", config.ppm_bin_width).alias("ppm_bins"),
        F.min("width").alias("width_min"),
        n_bins("width", config.width_bin_width).alias("width_bins"),
        F.bool_or("by_area").alias("by_area"),
        F.median("target").alias("global_bias"),
    )
    base = settle(base)
    binned = _with_bins(work.join(base.drop("by_area", "n_rows"), keys), config)
    rest = binned.withColumn("residual", F.col("target") - F.col("global_bias"))
    ppm_bias, rest = _subtract(settle(rest), keys, "ppm_bin")
    width_bias, rest = _subtract(settle(rest), keys, "width_bin")
    type_bias = _subtract(settle(rest), keys, "type")[0] if config.use_type else None
    return CalibrationModel(tuple(keys), config, base, ppm_bias, width_bias, type_bias)


def correct(peaks: DataFrame, model: CalibrationModel) -> DataFrame:
    """Add ``delta`` and ``height_corr``; bins without a bias add nothing.

    The correction is clipped only when heights are stabilised.  A model without keys holds for all rows.
    """
    keys, config = list(model.keys), model.config
    peaks = prepare(peaks)
    if not keys:
        keys, one = ["_all"], F.lit(0)
        peaks = peaks.withColumn("_all", one)
        tables = (model.base, model.ppm_bias, model.width_bias, model.type_bias)
        model = CalibrationModel(("_all",), config, *[t if t is None else t.withColumn("_all", one) for t in tables])
    work = _with_bins(peaks.join(model.base.drop("n_rows", "by_area"), keys), config)
    work = work.join(model.ppm_bias.withColumnRenamed("bias", "_p"), [*keys, "ppm_bin"], "left")
    work = work.join(model.width_bias.withColumnRenamed("bias", "_w"), [*keys, "width_bin"], "left")
    zero = F.lit(0.0)
    delta = F.col("global_bias") + F.coalesce("_p", zero) + F.coalesce("_w", zero)
    if model.type_bias is not None:
        work = work.join(model.type_bias.withColumnRenamed("bias", "_t"), [*keys, "type"], "left")
        delta = delta + F.coalesce("_t", zero)
    if config.delta_clip is not None and config.mode == "height_stabilize":
        delta = spectra.clip(delta, -config.delta_clip, config.delta_clip)
    return (
        work.withColumn("delta", delta)
        .withColumn("height_corr", F.greatest("height", F.lit(1e-8)) * F.exp("delta"))
        .drop("_all", "_p", "_w", "_t", "ppm_min", "ppm_bins", "width_min", "width_bins", "global_bias")
    )


def automatic_mode(peaks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mode each group would use: areas when enough rows have one, else heights."""
    usable = enough_area(F.count("area"), F.count("*"), round_up=False)
    return peaks.groupBy(*keys).agg(
        F.when(usable, F.lit("area_match")).otherwise(F.lit("height_stabilize")).alias("mode")
    )
