"""One-dimensional Gaussian mixtures on log intensity, fitted for all groups at once.

Equal values are merged first.  Groups with few distinct values are fitted in one
pass, each as a short array; for larger groups every EM step is one aggregation over
all groups and component counts, and only the parameters pass between steps.  Both
ways run the same steps from the same start.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peakloom.config import MixtureConfig
from peakloom.session import broadcast_if_small, cut_lineage, is_small

# Added to every variance, so a component on equal values stays finite.
VARIANCE_FLOOR = 1e-6
# Groups up to this many distinct values are fitted as one array.
SMALL_GROUP = 4_096


def _log_densities(x: Column, k_max: int) -> list[Column]:
    """Log of weight times density per component; null for components a model does not have."""
    out = []
    for i in range(k_max):
        p = F.get("parts", F.lit(i))
        gap = x - p["m"]
        out.append(F.log(p["w"]) - 0.5 * (F.log(p["v"]) + gap * gap / p["v"] + math.log(2 * math.pi)))
    return out


def _largest(columns: list[Column]) -> Column:
    return F.greatest(*columns) if len(columns) > 1 else columns[0]


def fit(values: DataFrame, keys: Sequence[str], config: MixtureConfig) -> DataFrame:
    """Parameters of the best mixture (lowest BIC) per group.

    ``values`` has keys and ``intensity``.  Columns: keys, k, parts (array of m, v, w by
    ascending mean), bic.
    """
    keys = list(keys)
    positive = F.greatest("intensity", F.lit(1e-8))
    x = (F.log(positive) if config.use_log else positive).alias("x")
    data = cut_lineage(values.select(*keys, x).groupBy(*keys, "x").agg(F.count("*").alias("n")))
    sizes = data.groupBy(*keys).agg(F.count("*").alias("distinct"))
    small = data.join(sizes.filter(F.col("distinct") <= SMALL_GROUP), keys, "left_semi")
    large = data.join(sizes.filter(F.col("distinct") > SMALL_GROUP), keys, "left_semi")
    fitted = _fit_small(small, keys, config)
    return fitted if large.isEmpty() else fitted.unionByName(_fit_large(cut_lineage(large), keys, config))


def em_fit(x: np.ndarray, n: np.ndarray, k: int, max_iter: int, tol: float):
    """(w, m, v, mean log likelihood) of a k-component mixture of weighted values."""
    total = n.sum()
    mean = (n * x).sum() / total
    w = np.full(k, 1.0 / k)
    m = np.quantile(np.repeat(x, n), [(i + 0.5) / k for i in range(k)])
    v = np.full(k, max((n * x * x).sum() / total - mean * mean, 0.0) + VARIANCE_FLOOR)
    last = -np.inf
    for _ in range(max_iter):
        d = np.log(w) - 0.5 * (np.log(2 * np.pi) + np.log(v) + (x[:, None] - m) ** 2 / v)
        top = d.max(axis=1)
        norm = top + np.log(np.exp(d - top[:, None]).sum(axis=1))
        share = np.exp(d - norm[:, None]) * n[:, None]
        r = np.maximum(share.sum(axis=0), 1e-12)
        m = (share * x[:, None]).sum(axis=0) / r
        v = np.maximum((share * x[:, None] ** 2).sum(axis=0) / r - m * m, 0.0) + VARIANCE_FLOOR
        w = r / total
        fit_now = (norm * n).sum() / total
        if abs(fit_now - last) < tol:
            return w, m, v, fit_now
        last = fit_now
    return w, m, v, last


_PART = T.StructType().add("m", "double").add("v", "double").add("w", "double")
_MODEL = T.StructType().add("k", "integer").add("parts", T.ArrayType(_PART)).add("bic", "double")


def _fit_small(data: DataFrame, keys: list[str], config: MixtureConfig) -> DataFrame:
    def best(x: np.ndarray, n: np.ndarray) -> tuple:
        found = None
        for k in range(config.min_components, min(config.max_components, int(n.sum())) + 1):
            w, m, v, loglik = em_fit(x, n, k, config.max_iter, config.tol)
            bic = -2.0 * loglik * n.sum() + (3 * k - 1) * math.log(n.sum())
            if found is None or bic < found[2]:
                found = (k, sorted(zip(m.tolist(), v.tolist(), w.tolist())), bic)
        return found

    @F.pandas_udf(_MODEL)
    def solve(x: pd.Series, n: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([best(np.array(a), np.array(b)) for a, b in zip(x, n)], columns=["k", "parts", "bic"])

    grouped = data.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("x", "n"))).alias("xs"))
    return grouped.select(*keys, solve(F.col("xs")["x"], F.col("xs")["n"]).alias("s")).select(*keys, "s.*")


def _fit_large(data: DataFrame, keys: list[str], config: MixtureConfig) -> DataFrame:
    ks = range(config.min_components, config.max_components + 1)
    # Start: means at evenly spaced quantiles, common variance, equal weights.
    points = sorted({(i + 0.5) / k for k in ks for i in range(k)})
    grid = "array(" + ", ".join(f"{p!r}D" for p in points) + ")"
    start = data.groupBy(*keys).agg(
        F.sum("n").alias("total"),
        F.expr(f"percentile(x, {grid}, n)").alias("q"),
        (F.sum(F.col("n") * F.col("x") * F.col("x")) / F.sum("n")).alias("xx"),
        (F.sum(F.col("n") * F.col("x")) / F.sum("n")).alias("mx"),
    )
    spread = F.greatest(F.col("xx") - F.col("mx") * F.col("mx"), F.lit(0.0)) + VARIANCE_FLOOR

    def initial(k: int) -> Column:
        parts = [
            F.struct(
                F.lit(1.0 / k).alias("w"), F.col("q")[points.index((i + 0.5) / k)].alias("m"), spread.alias("v")
            )
            for i in range(k)
        ]
        return F.struct(F.lit(k).alias("k"), F.array(*parts).alias("parts"))

    models = (
        start.select(*keys, "total", F.explode(F.array(*[initial(k) for k in ks])).alias("s"))
        .select(*keys, "total", "s.k", "s.parts", F.lit(-1e300).alias("fit"), F.lit(False).alias("done"))
        .filter("k <= total")
    )
    models = cut_lineage(models)
    small = is_small(models)
    for _ in range(config.max_iter):
        models = cut_lineage(_step(data, F.broadcast(models) if small else models, keys, config))
        if models.filter("NOT done").isEmpty():
            break
    bic = F.lit(-2.0) * F.col("fit") * F.col("total") + (F.lit(3) * F.col("k") - 1) * F.log("total")
    best = F.min(F.struct(bic.alias("bic"), "k", "parts")).alias("b")
    ordered = F.array_sort(F.transform("b.parts", lambda p: F.struct(p["m"].alias("m"), p["v"].alias("v"), p["w"].alias("w"))))
    return models.groupBy(*keys).agg(best).select(*keys, "b.k", ordered.alias("parts"), F.col("b.bic").alias("bic"))


def _step(data: DataFrame, models: DataFrame, keys: list[str], config: MixtureConfig) -> DataFrame:
    """One EM step; models that have converged pass through unchanged.

    ``fit`` is the mean log likelihood before the update.  The old parameters travel as
    grouping columns, so a step is a single join and a single aggregation.
    """
    k_max = config.max_components
    names = [f"d{i}" for i in range(k_max)]
    logs = data.join(models, keys).select(
        "*", *[F.when(~F.col("done"), d).alias(c) for c, d in zip(names, _log_densities(F.col("x"), k_max))]
    )
    logs = logs.withColumn("top", _largest([F.col(c) for c in names]))
    mass = sum((F.coalesce(F.exp(F.col(c) - F.col("top")), F.lit(0.0)) for c in names), F.lit(0.0))
    logs = logs.withColumn("norm", F.col("top") + F.log(mass))
    logs = logs.select("*", *[(F.exp(F.col(c) - F.col("norm")) * F.col("n")).alias(f"s{i}") for i, c in enumerate(names)])
    share = [F.col(f"s{i}") for i in range(k_max)]
    sums = logs.groupBy(*keys, "total", "k", "parts", "fit", "done").agg(
        F.sum(F.col("norm") * F.col("n")).alias("loglik"),
        *[F.sum(s).alias(f"r{i}") for i, s in enumerate(share)],
        *[F.sum(s * F.col("x")).alias(f"x{i}") for i, s in enumerate(share)],
        *[F.sum(s * F.col("x") * F.col("x")).alias(f"y{i}") for i, s in enumerate(share)],
    )

    def part(i: int) -> Column:
        r = F.greatest(F.col(f"r{i}"), F.lit(1e-12))
        mean = F.col(f"x{i}") / r
        return F.struct(
            (r / F.col("total")).alias("w"),
            mean.alias("m"),
            (F.greatest(F.col(f"y{i}") / r - mean * mean, F.lit(0.0)) + VARIANCE_FLOOR).alias("v"),
        )

    moved = F.slice(F.array(*[part(i) for i in range(k_max)]), F.lit(1), F.col("k"))
    fit_now = F.col("loglik") / F.col("total")
    return sums.select(
        *keys,
        "total",
        "k",
        F.when(F.col("done"), F.col("parts")).otherwise(moved).alias("parts"),
        F.when(F.col("done"), F.col("fit")).otherwise(fit_now).alias("fit"),
        (F.col("done") | (F.abs(fit_now - F.col("fit")) < config.tol)).alias("done"),
    )


def label(values: DataFrame, model: DataFrame, keys: Sequence[str], config: MixtureConfig) -> DataFrame:
    """Add ``cluster_id``: the likeliest component, numbered by ascending mean."""
    positive = F.greatest("intensity", F.lit(1e-8))
    x = F.log(positive) if config.use_log else positive
    scored = values.join(broadcast_if_small(model.select(*keys, "parts")), list(keys))
    densities = _log_densities(x, config.max_components)
    top = _largest(densities)
    chosen = F.coalesce(*[F.when(d == top, F.lit(i)) for i, d in enumerate(densities)])
    return scored.withColumn("cluster_id", chosen).drop("parts")


def summarize(labelled: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Size, mean intensity and sorted shift list of each intensity cluster."""
    shifts = F.array_join(F.transform(F.array_sort(F.collect_list("ppm")), lambda v: F.format_string("%.4f", v)), ",")
    return labelled.groupBy(*keys, "cluster_id").agg(
        F.count("*").alias("num_peaks"), F.avg("intensity").alias("mean_intensity"), shifts.alias("shift_values")
    )


def number_samples(df: DataFrame, label_column: str, ordinal: str) -> DataFrame:
    """Dense sample numbers in first-seen order; the distinct labels are few."""
    seen = df.groupBy(label_column).agg(F.min(ordinal).alias("_first"))
    numbered = seen.withColumn("sample_no", (F.row_number().over(Window.orderBy("_first", label_column)) - 1).cast("int"))
    return df.join(broadcast_if_small(numbered.drop("_first")), label_column)
