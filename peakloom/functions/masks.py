"""Presence masks: one bit per ordered sample, the first sample is the highest bit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sample_bit(order_index: Column, n_samples: int) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), (F.lit(n_samples - 1) - order_index).cast("int"))


def to_text(mask: Column, n_samples: int) -> Column:
    return F.lpad(F.bin(mask), n_samples, "0")


def popcount(mask: Column) -> Column:
    return F.bit_count(mask)


def contains(high: Column, low: Column) -> Column:
    return high.bitwiseAND(low) == low


def strict_superset(high: Column, low: Column) -> Column:
    return contains(high, low) & (high != low)


def jaccard(a: Column, b: Column) -> Column:
    both = F.bit_count(a.bitwiseAND(b))
    either = F.bit_count(a.bitwiseOR(b))
    return F.when((a == 0) | (b == 0), F.lit(0.0)).otherwise(both / F.nullif(either, F.lit(0)))


def submasks(mask: Column, n_samples: int) -> Column:
    """All common masks a track belongs to.

    A mask of two or more samples accepts every track that covers it; a
    single-sample mask accepts only tracks seen in exactly that sample.
    """
    every = F.sequence(F.lit(1).cast("long"), F.lit(2**n_samples - 1).cast("long"))
    return F.filter(every, lambda m: F.when(F.bit_count(m) == 1, m == mask).otherwise(contains(mask, m)))
