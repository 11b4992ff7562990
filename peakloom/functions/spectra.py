"""Peak-axis expressions: ticks, regions, binning, natural sample order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from peakloom.config import Region

# Peak positions are compared on an integer grid of 1e-5 ppm, the resolution at
# which corrected positions are reported.
TICKS_PER_PPM = 100_000


def ticks(ppm: Column) -> Column:
    return F.round(ppm * TICKS_PER_PPM).cast("long")


def region_index(ppm: Column, regions: Sequence[Region]) -> Column:
    """Number of the region that contains ``ppm``; the last one when none does."""
    picked = F.lit(len(regions) - 1)
    for i in reversed(range(len(regions))):
        inside = (ppm >= float(regions[i].low)) & (ppm < float(regions[i].high))
        picked = F.when(inside, F.lit(i)).otherwise(picked)
    return picked.cast("int")


def region_tolerance(ppm: Column, regions: Sequence[Region]) -> Column:
    return F.get(F.array(*[F.lit(float(r.tol)) for r in regions]), region_index(ppm, regions))


def window_width(tol: float) -> float:
    """Width of the densest-shift window: 0.32 of the tolerance within [0.035, 0.11] ppm."""
    return max(0.035, min(0.11, tol * 0.32))


def right_closed_bin(x: Column, low: Column, width: float, n_bins: Column) -> Column:
    """Index of the bin (low + i*w, low + (i+1)*w]; the first bin also holds ``low``.

    Null outside the bins.
    """
    index = (F.greatest(F.ceil((x - low) / F.lit(float(width))), F.lit(1)) - 1).cast("int")
    return F.when((x >= low) & (index < n_bins), index)


def edge_bins(low: Column, high: Column, width: float) -> Column:
    """Number of bins that a range of edges from low up to (excluding) high + width forms."""
    edges = F.ceil((high + F.lit(float(width)) - low) / F.lit(float(width)))
    return F.greatest(edges - 1, F.lit(1)).cast("int")


def natural_key(name: Column) -> list[Column]:
    """Sort columns that place S10 after S2: prefix, numeric suffix, full text."""
    suffix = F.regexp_extract(name, r"(\d*)$", 1)
    return [
        F.regexp_replace(name, r"\d+$", ""),
        F.when(suffix != "", suffix.cast("long")).otherwise(F.lit(-1)),
        name,
    ]


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))
