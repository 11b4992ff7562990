"""Registered queries: calibration, DEPT typing, intensity mixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peakloom.config import CalibrationConfig, MixtureConfig
from peakloom.operators import calibrate, dept, mixture
from peakloom.operators.band import band_join
from peakloom.plans import fixtures as fx
from peakloom.plans.registry import query
from peakloom.session import new_folder
from peakloom.sinks import models

HEIGHT = CalibrationConfig()
AREA = CalibrationConfig(mode="area_match")
TYPED = CalibrationConfig(use_type=True)
MIXTURE = MixtureConfig()


def heights(spark, sf_dir) -> DataFrame:
    """Peak table in calibration form; the type follows the number of the peak."""
    return fx.peaks(spark, sf_dir).select(
        "series_id",
        "sample_id",
        "peak_id",
        "ppm",
        F.col("intensity").alias("height"),
        "width",
        "area",
        F.concat(F.lit("T"), (F.col("peak_id") % 4).cast("string")).alias("type"),
    )


HEIGHT_SQL = """SELECT series_id, sample_id, peak_id, ppm, intensity AS height, width, area,
    concat('T', CAST(peak_id % 4 AS VARCHAR)) AS type FROM fx_peaks"""


def _train_sql(target: str, typed: bool) -> str:
    steps = f"""h AS ({HEIGHT_SQL}),
      s AS (SELECT *, median(height) OVER (PARTITION BY series_id, sample_id) AS ref,
        median(height) OVER (PARTITION BY series_id, sample_id, type) AS typed_ref,
        count(*) OVER (PARTITION BY series_id) AS n_rows, count(area) OVER (PARTITION BY series_id) AS n_area FROM h),
      t AS (SELECT *, {target} AS target, min(ppm) OVER (PARTITION BY series_id) AS p0,
        min(width) OVER (PARTITION BY series_id) AS w0 FROM s),
      b AS (SELECT *, CAST(greatest(ceil((ppm - p0) / 9.75::DOUBLE), 1) - 1 AS INTEGER) AS ppm_bin,
        CAST(greatest(ceil((width - w0) / 0.35::DOUBLE), 1) - 1 AS INTEGER) AS width_bin,
        median(target) OVER (PARTITION BY series_id) AS g FROM t),
      r1 AS (SELECT *, median(target - g) OVER (PARTITION BY series_id, ppm_bin) AS pb FROM b),
      r2 AS (SELECT *, median(target - g - coalesce(pb, 0)) OVER (PARTITION BY series_id, width_bin) AS wb FROM r1)"""
    if typed:
        steps += """, r3 AS (SELECT *, median(target - g - coalesce(pb, 0) - coalesce(wb, 0))
            OVER (PARTITION BY series_id, type) AS tb FROM r2)"""
    return "WITH " + steps


BY_HEIGHT = "1.235::DOUBLE * (ln(greatest(ref, 1e-8)) - ln(greatest(height, 1e-8)))"
BY_TYPE = "1.235::DOUBLE * (ln(greatest(typed_ref, 1e-8)) - ln(greatest(height, 1e-8)))"
BY_AREA = f"""CASE WHEN n_area >= greatest(ceil(n_rows * 0.3::DOUBLE), 3)
    THEN ln(greatest(area, 1e-8)) - ln(greatest(height, 1e-8)) ELSE {BY_HEIGHT} END"""


@query("calibration_target", _train_sql(BY_AREA, False) + " SELECT series_id, peak_id, round(target, 6) AS target FROM t")
def calibration_target(spark, sf_dir):
    work = calibrate.targets(calibrate.prepare(heights(spark, sf_dir)), ["series_id"], ["sample_id"], AREA)
    return work.select("series_id", "peak_id", F.round("target", 6).alias("target"))


@query(
    "calibration_bins",
    _train_sql(BY_HEIGHT, False)
    + """ SELECT DISTINCT series_id, 'ppm' AS axis, ppm_bin AS bin, round(pb, 6) AS bias FROM r2
      UNION ALL SELECT DISTINCT series_id, 'width', width_bin, round(wb, 6) FROM r2
      UNION ALL SELECT DISTINCT series_id, 'global', 0, round(g, 6) FROM r2""",
)
def calibration_bins(spark, sf_dir):
    model = calibrate.train(heights(spark, sf_dir), ["series_id"], ["sample_id"], HEIGHT)

    def rows(table, axis, bin_column, bias):
        return table.select(
            "series_id", F.lit(axis).alias("axis"), bin_column.alias("bin"), F.round(bias, 6).alias("bias")
        )

    return (
        rows(model.ppm_bias, "ppm", F.col("ppm_bin"), "bias")
        .unionByName(rows(model.width_bias, "width", F.col("width_bin"), "bias"))
        .unionByName(rows(model.base, "global", F.lit(0), "global_bias"))
    )


def _applied(spark, sf_dir, config):
    peaks = heights(spark, sf_dir)
    model = calibrate.train(peaks, ["series_id"], ["sample_id"], config)
    return calibrate.correct(peaks, model)


def _applied_output(spark, sf_dir, config):
    return _applied(spark, sf_dir, config).select(
        "series_id", "peak_id", F.round("delta", 6).alias("delta"), F.round("height_corr", 6).alias("height_corr")
    )


CLIPPED = "greatest(-0.63::DOUBLE, least(0.63::DOUBLE, {0}))"
SUM_2 = "g + coalesce(pb, 0) + coalesce(wb, 0)"
APPLIED = "SELECT series_id, peak_id, round({0}, 6) AS delta, round(greatest(height, 1e-8) * exp({0}), 6) AS height_corr FROM {1}"


@query("calibration_apply", _train_sql(BY_HEIGHT, False) + " " + APPLIED.format(CLIPPED.format(SUM_2), "r2"))
def calibration_apply(spark, sf_dir):
    return _applied_output(spark, sf_dir, HEIGHT)


@query("calibration_saved", _train_sql(BY_HEIGHT, False) + " " + APPLIED.format(CLIPPED.format(SUM_2), "r2"))
def calibration_saved(spark, sf_dir):
    """The model of all series written to files, read back and applied."""
    peaks = heights(spark, sf_dir)
    folder = new_folder(spark, "calibration")
    models.save_model(calibrate.train(peaks, ["series_id"], ["sample_id"], HEIGHT), folder)
    kind = dict(peaks.dtypes)["series_id"]
    corrected = calibrate.correct(peaks, models.load_model(spark, folder, {"series_id": kind}))
    return corrected.select("series_id", "peak_id", F.round("delta", 6).alias("delta"), F.round("height_corr", 6).alias("height_corr"))


@query("calibration_apply_area", _train_sql(BY_AREA, False) + " " + APPLIED.format(SUM_2, "r2"))
def calibration_apply_area(spark, sf_dir):
    return _applied_output(spark, sf_dir, AREA)


@query(
    "calibration_apply_typed",
    _train_sql(BY_TYPE, True) + " " + APPLIED.format(CLIPPED.format(SUM_2 + " + coalesce(tb, 0)"), "r3"),
)
def calibration_apply_typed(spark, sf_dir):
    return _applied_output(spark, sf_dir, TYPED)


@query(
    "calibration_mode",
    """SELECT series_id, sample_id, CASE WHEN count(area) >= greatest(floor(count(*) * 0.3::DOUBLE), 3)
        THEN 'area_match' ELSE 'height_stabilize' END AS mode FROM fx_peaks GROUP BY 1, 2""",
)
def calibration_mode(spark, sf_dir):
    return calibrate.automatic_mode(fx.peaks(spark, sf_dir), ["series_id", "sample_id"])


def dept_tables(spark, sf_dir):
    """First sample as all carbons, second as DEPT-135 (odd peaks negative), third as DEPT-90."""
    peaks = fx.peaks(spark, sf_dir)
    sign = F.when(F.col("peak_id") % 2 == 0, F.lit(1.0)).otherwise(F.lit(-1.0))
    signed = peaks.filter("order_index = 1").withColumn("height", F.col("intensity") * sign)
    return peaks.filter("order_index = 0"), signed, peaks.filter("order_index = 2")


@query("dept_infer")
def dept_infer(spark, sf_dir):
    every, d135, d90 = dept_tables(spark, sf_dir)
    return dept.infer_types(every, d135, d90, ["series_id"]).select("series_id", "peak_id", "ppm", "type")


@query(
    "dept_mutual_nearest",
    """WITH p AS (SELECT a.series_id, a.peak_id AS target, b.peak_id AS ref, abs(a.ppm - b.ppm) AS d
          FROM fx_peaks a JOIN fx_peaks b ON a.series_id = b.series_id AND a.order_index = 0 AND b.order_index = 1
            AND abs(a.ppm - b.ppm) <= 0.8::DOUBLE),
        r AS (SELECT *, row_number() OVER (PARTITION BY series_id, target ORDER BY d, ref) AS x,
          row_number() OVER (PARTITION BY series_id, ref ORDER BY d, target) AS y FROM p)
       SELECT series_id, target, ref, round(d, 6) AS distance FROM r WHERE x = 1 AND y = 1""",
)
def dept_mutual_nearest(spark, sf_dir):
    """First round of the greedy matching: pairs that are nearest from both sides."""
    every, d135, _ = dept_tables(spark, sf_dir)
    left = every.select("series_id", F.col("peak_id").alias("target"), F.col("ppm").alias("a"))
    right = d135.select("series_id", F.col("peak_id").alias("ref"), F.col("ppm").alias("b"))
    pairs = band_join(left, right, [("a", "b", 0.8)], ["series_id"]).withColumn("d", F.abs(F.col("a") - F.col("b")))
    by_target = Window.partitionBy("series_id", "target").orderBy("d", "ref")
    by_ref = Window.partitionBy("series_id", "ref").orderBy("d", "target")
    ranked = pairs.withColumn("x", F.row_number().over(by_target)).withColumn("y", F.row_number().over(by_ref))
    return ranked.filter("x = 1 AND y = 1").select("series_id", "target", "ref", F.round("d", 6).alias("distance"))


@query(
    "dept_uncovered",
    """SELECT a.series_id, a.peak_id, a.ppm FROM fx_peaks a WHERE order_index = 0 AND NOT EXISTS (SELECT 1 FROM fx_peaks b
        WHERE b.series_id = a.series_id AND b.order_index = 1 AND abs(a.ppm - b.ppm) <= 0.1::DOUBLE)""",
)
def dept_uncovered(spark, sf_dir):
    """Carbons that no DEPT-135 peak covers, peaks not being used up: a band anti-join."""
    every, d135, _ = dept_tables(spark, sf_dir)
    left = every.select("series_id", "peak_id", "ppm")
    hit = band_join(left, d135.select("series_id", F.col("ppm").alias("b")), [("ppm", "b", 0.1)], ["series_id"])
    return left.join(hit.select("series_id", "peak_id"), ["series_id", "peak_id"], "left_anti")


@query("dept_typing")
def dept_typing(spark, sf_dir):
    """Typed query lists of every series by the first-fit rule of the query form."""
    peaks = fx.peaks(spark, sf_dir)

    def values(where):
        picked = F.when(where, F.struct("peak_id", "ppm"))
        return F.transform(F.array_sort(F.collect_list(picked)), lambda s: s["ppm"])

    odd = F.col("peak_id") % 2 == 1
    lists = peaks.groupBy("series_id").agg(
        values(F.col("order_index") == 0).alias("all_c"),
        values((F.col("order_index") == 1) & ~odd).alias("plus"),
        values((F.col("order_index") == 1) & odd).alias("minus"),
        values(F.col("order_index") == 2).alias("d90"),
    )
    typed = lists.select(
        "series_id", *dept.type_lists(F.col("all_c"), F.col("plus"), F.col("minus"), F.col("d90"))
    )
    return typed.select(
        "series_id", F.explode(F.array(*[F.struct(F.lit(i).alias("h_type"), F.col(f"h{i}").alias("v")) for i in range(4)])).alias("t")
    ).select("series_id", "t.h_type", F.explode("t.v").alias("shift"))


def mixture_labels(spark, sf_dir):
    peaks = fx.peaks(spark, sf_dir)
    model = mixture.fit(peaks, ["sample_id"], MIXTURE)
    return mixture.label(peaks, model, ["sample_id"], MIXTURE), model


@query("mixture_model")
def mixture_model(spark, sf_dir):
    """Best mixture per sample by BIC."""
    _, model = mixture_labels(spark, sf_dir)
    return model.select("sample_id", "k", F.posexplode("parts").alias("cluster_id", "p"), "bic").select(
        "sample_id", "k", "cluster_id", "p.w", "p.m", "p.v", "bic"
    )


@query("mixture_clusters")
def mixture_clusters(spark, sf_dir):
    """Intensity clusters of every sample of every series after height calibration."""
    corrected = _applied(spark, sf_dir, HEIGHT).withColumn("intensity", F.col("height_corr"))
    keys = ["series_id", "sample_id"]
    model = mixture.fit(corrected, keys, MIXTURE)
    return mixture.summarize(mixture.label(corrected, model, keys, MIXTURE), keys)


@query(
    "sample_numbers",
    """SELECT sample_id, CAST(row_number() OVER (ORDER BY min(peak_id), sample_id) - 1 AS INTEGER) AS sample_no, count(*) AS n
       FROM fx_peaks GROUP BY 1""",
)
def sample_numbers(spark, sf_dir):
    numbered = mixture.number_samples(fx.peaks(spark, sf_dir), "sample_id", "peak_id")
    return numbered.groupBy("sample_id", "sample_no").agg(F.count("*").alias("n"))
