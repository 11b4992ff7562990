"""Spectroscopy views over the driver tables.

``VIEWS`` holds the same definitions as SQL for the oracle; every view reads its
whole table.  Line items of one order that share line number and type merge into
one atom, and events of one user and type merge on a 0.01 ppm grid, so the
shuffles are pre-aggregated and no molecule or spectrum grows without bound.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peakloom.session import broadcast_if_small, table

N_SAMPLES = 5


def _cents(column: str) -> Column:
    return F.round(F.col(column) * 100).cast("long")


def _hundredths(value: Column, modulus: int) -> Column:
    return (value % modulus).cast("double") / F.lit(100.0)


def carbons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mol_id, c_index, h_count, c_shift (some null), h_shifts (second one sometimes unknown)."""
    h_count = (F.col("l_quantity").cast("long") % 4).cast("int")
    atoms = (
        table(spark, sf_dir, "lineitem")
        .select(
            F.col("l_orderkey").alias("mol_id"),
            ((F.col("l_linenumber") - 1) * 4 + h_count).cast("int").alias("c_index"),
            h_count.alias("h_count"),
            _cents("l_extendedprice").alias("cents"),
            "l_partkey",
        )
        .groupBy("mol_id", "c_index", "h_count")
        .agg(F.sum("cents").alias("s"), F.min("l_partkey").alias("p"))
    )
    first, second, third = (_hundredths(F.col("p") * 37 + offset, 1200) for offset in (0, 41, 83))
    shifts = F.array(first, F.when(F.col("p") % 10 != 0, second), third)
    return atoms.select(
        "mol_id",
        "c_index",
        "h_count",
        F.when(F.col("s") % 50 != 0, _hundredths(F.col("s"), 22000)).alias("c_shift"),
        F.slice(shifts, F.lit(1), F.col("h_count")).alias("h_shifts"),
    )


def molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = carbons(spark, sf_dir).groupBy("mol_id").agg(F.count("*").cast("int").alias("carbon_count"))
    return (
        table(spark, sf_dir, "orders")
        .select(
            F.col("o_orderkey").alias("mol_id"),
            F.concat(F.lit("M"), F.col("o_orderkey").cast("string")).alias("name"),
            F.col("o_orderpriority").alias("source_file"),
            (F.lit(100.0) + _hundredths(_cents("o_totalprice"), 40000)).alias("fw"),
        )
        .join(counts, "mol_id")
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symmetric carbon chain: each atom is bonded to the next index of its molecule."""
    order = Window.partitionBy("mol_id").orderBy("c_index")
    chain = (
        carbons(spark, sf_dir)
        .select("mol_id", F.col("c_index").alias("src"), F.lead("c_index").over(order).alias("dst"))
        .filter("dst IS NOT NULL")
    )
    return chain.select(
        "mol_id",
        F.explode(
            F.array(
                F.struct(F.col("src"), F.col("dst")), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))
            )
        ).alias("e"),
    ).select("mol_id", "e.src", "e.dst")


def query_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query spectra: one per market segment, one peak per nation, from the whole customer table."""
    sums = (
        table(spark, sf_dir, "customer")
        .groupBy(F.col("c_mktsegment").alias("query_id"), F.col("c_nationkey").alias("peak_id"))
        .agg(F.sum(_cents("c_acctbal")).alias("s"))
    )
    return sums.select(
        "query_id",
        "peak_id",
        (F.col("peak_id") % 4).cast("int").alias("h_type"),
        _hundredths(F.col("s") % 22000 + 22000, 22000).alias("shift"),
        _hundredths(F.abs(F.col("s")), 1200).alias("h_shift"),
    )


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured shifts of each molecule: its library shifts moved by up to 2 ppm, some missing."""
    return (
        carbons(spark, sf_dir)
        .filter("c_shift IS NOT NULL AND c_index % 7 <> 3")
        .select(
            "mol_id",
            F.col("c_index").alias("obs_id"),
            F.round(F.col("c_shift") + ((F.col("mol_id") * 13 + F.col("c_index") * 29) % 41 - 20) / F.lit(10.0), 2).alias(
                "shift"
            ),
        )
    )


def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peak lists: one series per user, one sample per event type."""
    events = table(spark, sf_dir, "events")
    merged = (
        events.select("user_id", "event_type", "event_id", _cents("value").alias("cents"))
        .groupBy("user_id", "event_type", (F.col("cents") % 22000).alias("tick"))
        .agg(F.min("event_id").alias("peak_id"), F.sum("cents").alias("s"))
    )
    intensity = F.col("s").cast("double") / F.lit(100.0) + F.lit(1.0)
    width = F.lit(0.5) + (F.col("peak_id") % 30).cast("double") / F.lit(20.0)
    return merged.join(broadcast_if_small(samples(spark, sf_dir)), merged.event_type == F.col("sample_id")).select(
        F.col("user_id").alias("series_id"),
        "sample_id",
        "order_index",
        "peak_id",
        (F.col("tick").cast("double") / F.lit(100.0)).alias("ppm"),
        _hundredths(F.col("peak_id") * 37, 1200).alias("h_ppm"),
        intensity.alias("intensity"),
        width.alias("width"),
        F.when(F.col("peak_id") % 3 != 0, intensity * width).alias("area"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered samples; the distinct event types are a handful of names."""
    names = table(spark, sf_dir, "events").select(F.col("event_type").alias("sample_id")).distinct()
    return names.select(
        "sample_id", (F.row_number().over(Window.orderBy("sample_id")) - 1).cast("int").alias("order_index")
    )


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simple tracks: per series and whole-ppm cell, the strongest peak of each sample."""
    strongest = F.max(F.struct("intensity", (-F.col("peak_id")).alias("neg_id"), "ppm")).alias("top")
    return (
        peaks(spark, sf_dir)
        .groupBy("series_id", F.floor("ppm").cast("int").alias("cell"), "sample_id", "order_index")
        .agg(strongest)
        .select(
            "series_id",
            "cell",
            "sample_id",
            "order_index",
            (-F.col("top.neg_id")).alias("peak_id"),
            "top.ppm",
            "top.intensity",
        )
    )


VIEWS: dict[str, str] = {
    "fx_carbons": """
        SELECT mol_id, c_index, h_count,
          CASE WHEN s % 50 <> 0 THEN CAST(s % 22000 AS DOUBLE) / 100 END AS c_shift,
          CASE WHEN h_count >= 1 THEN CAST((p * 37) % 1200 AS DOUBLE) / 100 END AS h1,
          CASE WHEN h_count >= 2 AND p % 10 <> 0 THEN CAST((p * 37 + 41) % 1200 AS DOUBLE) / 100 END AS h2,
          CASE WHEN h_count >= 3 THEN CAST((p * 37 + 83) % 1200 AS DOUBLE) / 100 END AS h3
        FROM (
          SELECT l_orderkey AS mol_id,
            CAST((l_linenumber - 1) * 4 + CAST(l_quantity AS BIGINT) % 4 AS INTEGER) AS c_index,
            CAST(CAST(l_quantity AS BIGINT) % 4 AS INTEGER) AS h_count,
            CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS s, min(l_partkey) AS p
          FROM lineitem GROUP BY 1, 2, 3)""",
    "fx_molecules": """
        SELECT o_orderkey AS mol_id, concat('M', CAST(o_orderkey AS VARCHAR)) AS name, o_orderpriority AS source_file,
          100.0::DOUBLE + CAST(CAST(round(o_totalprice * 100) AS BIGINT) % 40000 AS DOUBLE) / 100 AS fw, carbon_count
        FROM orders JOIN (SELECT mol_id, CAST(count(*) AS INTEGER) AS carbon_count FROM fx_carbons GROUP BY 1) n
          ON n.mol_id = o_orderkey""",
    "fx_edges": """
        SELECT mol_id, c_index AS src, dst FROM (SELECT mol_id, c_index,
          lead(c_index) OVER (PARTITION BY mol_id ORDER BY c_index) AS dst FROM fx_carbons) WHERE dst IS NOT NULL
        UNION ALL
        SELECT mol_id, dst, c_index FROM (SELECT mol_id, c_index,
          lead(c_index) OVER (PARTITION BY mol_id ORDER BY c_index) AS dst FROM fx_carbons) WHERE dst IS NOT NULL""",
    "fx_query_peaks": """
        SELECT query_id, peak_id, CAST(peak_id % 4 AS INTEGER) AS h_type,
          CAST((s % 22000 + 22000) % 22000 AS DOUBLE) / 100 AS shift, CAST(abs(s) % 1200 AS DOUBLE) / 100 AS h_shift
        FROM (SELECT c_mktsegment AS query_id, c_nationkey AS peak_id,
          CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS BIGINT) AS s FROM customer GROUP BY 1, 2)""",
    "fx_observed": """
        SELECT mol_id, c_index AS obs_id,
          round(c_shift + ((mol_id * 13 + c_index * 29) % 41 - 20) / 10.0::DOUBLE, 2) AS shift
        FROM fx_carbons WHERE c_shift IS NOT NULL AND c_index % 7 <> 3""",
    "fx_samples": """
        SELECT event_type AS sample_id, CAST(row_number() OVER (ORDER BY event_type) - 1 AS INTEGER) AS order_index
        FROM (SELECT DISTINCT event_type FROM events)""",
    "fx_peaks": """
        SELECT series_id, m.sample_id, order_index, peak_id, CAST(tick AS DOUBLE) / 100 AS ppm,
          CAST(peak_id * 37 % 1200 AS DOUBLE) / 100 AS h_ppm, CAST(s AS DOUBLE) / 100 + 1 AS intensity,
          0.5::DOUBLE + CAST(peak_id % 30 AS DOUBLE) / 20 AS width,
          CASE WHEN peak_id % 3 <> 0 THEN (CAST(s AS DOUBLE) / 100 + 1) * (0.5::DOUBLE + CAST(peak_id % 30 AS DOUBLE) / 20)
          END AS area
        FROM (SELECT user_id AS series_id, event_type AS sample_id, CAST(round(value * 100) AS BIGINT) % 22000 AS tick,
            min(event_id) AS peak_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS s
          FROM events GROUP BY 1, 2, 3) m JOIN fx_samples o ON o.sample_id = m.sample_id""",
    "fx_members": """
        SELECT series_id, cell, sample_id, order_index, peak_id, ppm, intensity FROM (
          SELECT *, CAST(floor(ppm) AS INTEGER) AS cell, row_number() OVER (
            PARTITION BY series_id, floor(ppm), sample_id ORDER BY intensity DESC, peak_id) AS r FROM fx_peaks)
        WHERE r = 1""",
    "fx_masks": f"""
        SELECT series_id, cell, CAST(sum(1 << ({N_SAMPLES} - 1 - order_index)) AS BIGINT) AS mask,
          count(*) AS n_members, median(ppm) AS center, max(ppm) - min(ppm) AS span
        FROM fx_members GROUP BY 1, 2""",
}


def with_views(sql: str) -> str:
    """Prepend the views that ``sql`` uses, in dependency order, as common table expressions."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in set(re.findall(r"\bfx_\w+", text)) & VIEWS.keys() - needed:
            needed.add(name)
            visit(VIEWS[name])

    visit(sql)
    ctes = [f"{name} AS ({VIEWS[name]})" for name in VIEWS if name in needed]
    body = sql.strip()
    if not ctes:
        return body
    for lead in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(lead):
            return lead + ",\n".join(ctes) + ",\n" + body[len(lead) :]
    return "WITH " + ",\n".join(ctes) + "\n" + body
