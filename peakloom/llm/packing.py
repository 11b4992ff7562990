"""Packing into length buckets of least padding, and token-budget batches inside each bucket.

The lengths of all rows form one global histogram.  A dynamic program over it chooses the bucket
boundaries.  Every document is padded to the boundary of its bucket, and a batch takes as many as
the token budget holds (at least one, so a longer document is a batch of its own; none is cut).

The histogram has a row for each different length.  n different lengths take at least n * n / 2 tokens,
so it grows with the square root of the corpus at most: 6e9 tokens have at most 110,000.  The program
keeps the lower hull of its options, so a bucket takes one pass over the histogram.  Rows are numbered
inside a bucket by chunks of a hash order with offsets from chunk counts; no bucket meets in one task.

Nulls: a null text has no words, and every document has an end token.  Null and repeated ids keep
rows of their own.  An empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakloom.llm.common import packed, settle, text_of, unpacked, with_row, words_of

CHUNK_ROWS = 20_000
RESULTS = ("bucket", "bucket_tokens", "batch", "slot", "padding")


@dataclass(frozen=True)
class PackConfig:
    buckets: int = 16
    token_budget: int = 65_536


def token_count(text: str = "text") -> Column:
    """Words and the end token."""
    return (F.size(words_of(text_of(text))) + 1).cast("long")


def best_boundaries(longest: np.ndarray, count: np.ndarray, total: np.ndarray, buckets: int) -> list[int]:
    """Boundaries of least padding over a histogram sorted by length.

    ``longest``: greatest length of each bin, ``count``: rows, ``total``: sum of their lengths.  A bucket
    of the bins i to j costs longest[j] * rows - tokens.
    """
    n = len(longest)
    edge = [int(x) for x in longest]
    rows, tokens = [0, *itertools.accumulate(map(int, count))], [0, *itertools.accumulate(map(int, total))]
    cost: list[int | None] = [0] + [None] * n
    choice = []
    for _ in range(min(buckets, n)):
        after, back = [0] * (n + 1), np.zeros(n + 1, np.int64)
        # A bucket after bin i costs height - edge * slope, plus what its end alone decides; slopes rise,
        # edges rise, so the best option only moves on along the hull.
        hull: list[tuple[int, int, int]] = []
        best = 0
        for j in range(1, n + 1):
            if cost[j - 1] is not None:
                height, slope = cost[j - 1] + tokens[j - 1], rows[j - 1]
                if not hull or slope > hull[-1][1]:
                    while len(hull) > 1 and (height - hull[-2][0]) * (hull[-1][1] - hull[-2][1]) <= (hull[-1][0] - hull[-2][0]) * (slope - hull[-2][1]):
                        hull.pop()
                    hull.append((height, slope, j - 1))
            best = min(best, len(hull) - 1)
            x = edge[j - 1]
            while best + 1 < len(hull) and hull[best + 1][0] - x * hull[best + 1][1] < hull[best][0] - x * hull[best][1]:
                best += 1
            height, slope, back[j] = hull[best]
            after[j] = height - x * slope + x * rows[j] - tokens[j]
        choice.append(back)
        cost = after
    out, j = [], n
    for back in reversed(choice):
        if j == 0:
            break
        out.append(edge[j - 1])
        j = int(back[j])
    return out[::-1]


def boundaries(lengths: DataFrame, buckets: int) -> list[int]:
    """Bucket boundaries of a table with ``n_tokens``."""
    found = lengths.groupBy("n_tokens").agg(F.count("*").alias("n")).toArrow().sort_by("n_tokens")
    if not len(found):
        return []
    longest, count = found["n_tokens"].to_numpy(), found["n"].to_numpy()
    return best_boundaries(longest, count, longest * count, buckets)


def pack(lengths: DataFrame, config: PackConfig = PackConfig()) -> DataFrame:
    """Adds bucket, bucket_tokens, batch, slot and padding to every row; ``n_tokens`` must be there.

    Columns with these names are replaced; all others stay.  Batches of a bucket are numbered from 0; all but its last are full.
    """
    kept = [c for c in lengths.columns if c.lower() not in RESULTS]
    rows = settle(with_row(packed(lengths, "n_tokens")))
    edges = boundaries(rows, config.buckets)
    if not edges:
        kinds = {"bucket": "int", "bucket_tokens": "bigint", "batch": "bigint", "slot": "bigint", "padding": "bigint"}
        return rows.select(*unpacked(kept), *[F.lit(None).cast(v).alias(k) for k, v in kinds.items()])
    bucket = F.lit(len(edges) - 1)
    for i, edge in reversed(list(enumerate(edges))):
        bucket = F.when(F.col("n_tokens") <= edge, i).otherwise(bucket)
    total = rows.count()
    parts = max(1, math.ceil(total / CHUNK_ROWS))
    hashed = F.xxhash64("_row")
    own = rows.withColumns({"bucket": bucket.cast("int"), "_h": hashed, "_chunk": F.pmod(hashed, F.lit(parts))})
    sizes = own.groupBy("bucket", "_chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("bucket").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("bucket", "_chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("bucket", "_chunk").orderBy("_h", "_row")
    placed = own.withColumn("_at", F.row_number().over(inside) - 1).join(offsets, ["bucket", "_chunk"])
    edge = F.element_at(F.array(*[F.lit(e).cast("long") for e in edges]), F.col("bucket") + 1)
    hold = F.greatest(F.floor(F.lit(config.token_budget) / F.col("bucket_tokens")), F.lit(1)).cast("long")
    at = F.col("_at") + F.col("_before")
    return placed.withColumn("bucket_tokens", edge).select(
        *unpacked(kept),
        "bucket",
        "bucket_tokens",
        F.floor(at / hold).cast("long").alias("batch"),
        (at % hold).cast("long").alias("slot"),
        (F.col("bucket_tokens") - F.col("n_tokens")).alias("padding"),
    )


def pack_documents(docs: DataFrame, config: PackConfig = PackConfig()) -> DataFrame:
    """doc_id, n_tokens, bucket, bucket_tokens, batch, slot, padding for every document."""
    return pack(docs.select("doc_id", token_count().alias("n_tokens")), config)
