"""Match scores and statuses as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from peakloom.config import AssignConfig, CarbonSearch, FineRange

# A carbon without a query peak is scored as if it were this far away (ppm).
MISSING_DELTA = 1000.0


def half_up(value: Column, digits: int) -> Column:
    """Round half up; the small offset lifts values that are a half except for float noise."""
    return F.round(value + F.lit(1e-9), digits)


def window_bounds(shift: Column, search: CarbonSearch) -> tuple[Column, Column]:
    """(green, yellow) that apply to a library shift; null when no fine range contains it."""
    if search.window is not None:
        return F.lit(float(search.window.green)), F.lit(float(search.window.yellow))
    return _first_range(shift, search.fine_ranges, "green"), _first_range(shift, search.fine_ranges, "yellow")


def _first_range(shift: Column, ranges: Sequence[FineRange], field: str) -> Column:
    picked = F.lit(None).cast("double")
    for item in reversed(ranges):
        inside = (shift >= F.lit(float(item.low))) & (shift <= F.lit(float(item.high)))
        picked = F.when(inside, F.lit(float(getattr(item, field)))).otherwise(picked)
    return picked


def carbon_score(delta: Column, type_matched: Column, green: Column, yellow: Column) -> Column:
    """Carbon self score: 1 inside green, linear (2 dp) to yellow, else 0."""
    delta = F.coalesce(delta, F.lit(MISSING_DELTA))
    decay = half_up(F.lit(1.0) - (delta - green) / (yellow - green), 2)
    return (
        F.when(~type_matched | green.isNull(), F.lit(0.0))
        .when(delta < green, F.lit(1.0))
        .when(delta > yellow, F.lit(0.0))
        .otherwise(decay)
    )


def carbon_colour(delta: Column, type_matched: Column, green: Column, yellow: Column) -> Column:
    delta = F.coalesce(delta, F.lit(MISSING_DELTA))
    return (
        F.when(~type_matched | green.isNull(), F.lit("red"))
        .when(delta < green, F.lit("green"))
        .when(delta > yellow, F.lit("red"))
        .otherwise(F.lit("yellow"))
    )


def pair_cost(delta: Column, green: Column, yellow: Column) -> Column:
    """Assignment cost of a carbon-peak pair that scores above zero."""
    lost = F.when(delta <= green, F.lit(0.0)).otherwise((delta - green) / (yellow - green))
    return lost * F.lit(10000.0) + delta * F.lit(0.001)


def composite(self_score: Column, env_score: Column, self_weight: float, env_weight: float) -> Column:
    blended = F.lit(float(self_weight)) * self_score + F.lit(float(env_weight)) * env_score
    return F.when(self_score == 0, F.lit(0.0)).otherwise(blended)


def hsqc_distance(dc: Column, dh: Column) -> Column:
    """Distance with proton differences weighted tenfold."""
    return F.sqrt(dc * dc + (dh * 10) * (dh * 10))


def in_box(dc: Column, dh: Column, c_tol: float, h_tol: float) -> Column:
    return (F.abs(dc) <= F.lit(float(c_tol))) & (F.abs(dh) <= F.lit(float(h_tol)))


def hsqc_pair_score(dc: Column, dh: Column, c_tol: float, h_tol: float) -> Column:
    """1 inside the tolerance box, else the reciprocal of the worse tolerance ratio."""
    worst = F.greatest(F.abs(dc) / F.lit(float(c_tol)), F.abs(dh) / F.lit(float(h_tol)))
    return F.when(in_box(dc, dh, c_tol, h_tol), F.lit(1.0)).otherwise(F.lit(1.0) / worst)


def hsqc_point_score(dc: Column, dh: Column, c_tol: float, h_tol: float) -> Column:
    """Point score by the axis on which the deviation leaves the box; 0 without a query point."""
    tol_c, tol_h = F.lit(float(c_tol)), F.lit(float(h_tol))
    steep = F.when(dc == 0, F.lit(True)).otherwise(F.abs(dh / F.nullif(dc, F.lit(0.0))) > tol_h / tol_c)
    ratio = F.when(steep, tol_h / F.nullif(F.abs(dh), F.lit(0.0))).otherwise(tol_c / F.nullif(F.abs(dc), F.lit(0.0)))
    outside = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(ratio, F.lit(0.0))))
    return F.when(dc.isNull() | dh.isNull(), F.lit(0.0)).when(in_box(dc, dh, c_tol, h_tol), F.lit(1.0)).otherwise(outside)


def error_status(error: Column, yellow: float, red: float) -> Column:
    return (
        F.when(error.isNull(), F.lit("missing"))
        .when(error > red, F.lit("red"))
        .when(error > yellow, F.lit("yellow"))
        .otherwise(F.lit("ok"))
    )


def carbon_status(
    predicted: Column, observed: Column, all_predicted: Column, all_observed: Column, config: AssignConfig
) -> Column:
    """Status of an assigned carbon, including the two ambiguity rules.

    ``all_predicted`` and ``all_observed`` are the molecule's shift arrays.
    """
    error = F.abs(predicted - observed)
    near = F.array_sort(
        F.filter(F.transform(all_observed, lambda v: F.abs(v - predicted)), lambda d: d <= config.ambiguity_window)
    )
    crowded = (F.size(near) >= 2) & ((F.get(near, 0) + F.get(near, 1)) / 2 > config.ambiguity_mean_error)
    rivals = F.size(F.filter(all_predicted, lambda v: F.abs(v - observed) <= config.local_window))
    options = F.size(F.filter(all_observed, lambda v: F.abs(v - predicted) <= config.local_window))
    lonely = (rivals <= 1) & (options <= 1) & (error > config.c_yellow)
    return (
        F.when(error.isNull(), F.lit("missing"))
        .when(error > config.c_red, F.lit("red"))
        .when(crowded | lonely, F.lit("yellow"))
        .otherwise(error_status(error, config.c_yellow, config.c_red))
    )


def multiplicity(h_count: Column) -> Column:
    """s, d, t, q for 0 to 3 attached hydrogens."""
    return F.coalesce(
        F.get(F.array(*[F.lit(x) for x in ("s", "d", "t", "q")]), h_count), F.concat(F.lit("H"), h_count.cast("string"))
    )


def type_name(h_count: Column) -> Column:
    return F.coalesce(F.get(F.array(*[F.lit(x) for x in ("C", "CH", "CH2", "CH3")]), h_count), F.lit("unknown"))


def stick_height(h_count: Column) -> Column:
    """Stick height used when a carbon list is drawn (1 per attached hydrogen, 1 for none)."""
    return F.greatest(h_count, F.lit(1)).cast("double")
