"""Registered queries: structure assignment, statuses, hydrogen groups, edits, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakloom.config import AssignConfig
from peakloom.functions import scoring
from peakloom.operators import batch, structure
from peakloom.plans import fixtures as fx
from peakloom.plans import library_search, text_queries
from peakloom.plans.registry import query
from peakloom.session import settle
from peakloom.sinks import export
from peakloom.sources import sdf

CONFIG = AssignConfig()


def predicted(spark, sf_dir) -> DataFrame:
    return fx.carbons(spark, sf_dir).select(
        "mol_id", F.col("c_index").alias("atom_id"), "h_count", F.col("c_shift").alias("predicted")
    )


def paired(spark, sf_dir) -> DataFrame:
    """Every carbon with the observed shift of the same number, if there is one."""
    seen = fx.observed(spark, sf_dir).select("mol_id", F.col("obs_id").alias("atom_id"), F.col("shift").alias("observed"))
    return predicted(spark, sf_dir).join(seen, ["mol_id", "atom_id"], "left")


PAIRED_SQL = """SELECT c.mol_id, c.c_index AS atom_id, c.h_count, c.c_shift AS predicted, o.shift AS observed
    FROM fx_carbons c LEFT JOIN fx_observed o ON o.mol_id = c.mol_id AND o.obs_id = c.c_index"""
ERROR_SQL = "CASE WHEN e IS NULL THEN 'missing' WHEN e > {1} THEN 'red' WHEN e > {0} THEN 'yellow' ELSE 'ok' END"


@query(
    "error_status",
    f"SELECT mol_id, atom_id, round(e, 6) AS error, {ERROR_SQL.format(1.5, 3.0)} AS status FROM (SELECT *, abs(predicted - observed) AS e FROM ({PAIRED_SQL}))",
)
def error_status(spark, sf_dir):
    error = F.abs(F.col("predicted") - F.col("observed"))
    return paired(spark, sf_dir).select(
        "mol_id",
        "atom_id",
        F.round(error, 6).alias("error"),
        scoring.error_status(error, CONFIG.c_yellow, CONFIG.c_red).alias("status"),
    )


def _status_sql(paired_sql: str, observed_sql: str) -> str:
    return f"""WITH p AS MATERIALIZED ({paired_sql}), ob AS ({observed_sql}),
      near AS (SELECT p.mol_id, p.atom_id, abs(ob.shift - p.predicted) AS d, row_number() OVER (PARTITION BY p.mol_id, p.atom_id
        ORDER BY abs(ob.shift - p.predicted)) AS r FROM p JOIN ob ON ob.mol_id = p.mol_id AND abs(ob.shift - p.predicted) <= 1.5),
      two AS (SELECT mol_id, atom_id, sum(d) / 2 AS m FROM near WHERE r <= 2 GROUP BY 1, 2 HAVING count(*) = 2),
      rivals AS (SELECT p.mol_id, p.atom_id, count(*) AS n FROM p JOIN p q ON q.mol_id = p.mol_id
        AND abs(q.predicted - p.observed) <= 5.0 GROUP BY 1, 2),
      options AS (SELECT p.mol_id, p.atom_id, count(*) AS n FROM p JOIN ob ON ob.mol_id = p.mol_id
        AND abs(ob.shift - p.predicted) <= 5.0 GROUP BY 1, 2)
    SELECT mol_id, atom_id, observed, CASE WHEN e IS NULL THEN 'missing' WHEN e > 3.0 THEN 'red' WHEN m > 1.0 THEN 'yellow'
        WHEN coalesce(rn, 0) <= 1 AND coalesce(nn, 0) <= 1 AND e > 1.5 THEN 'yellow' WHEN e > 1.5 THEN 'yellow' ELSE 'ok' END AS status
    FROM (SELECT p.*, abs(predicted - observed) AS e, two.m, rivals.n AS rn, options.n AS nn FROM p
      LEFT JOIN two ON two.mol_id = p.mol_id AND two.atom_id = p.atom_id
      LEFT JOIN rivals ON rivals.mol_id = p.mol_id AND rivals.atom_id = p.atom_id
      LEFT JOIN options ON options.mol_id = p.mol_id AND options.atom_id = p.atom_id)"""


@query("carbon_status", _status_sql(PAIRED_SQL, "SELECT mol_id, shift FROM fx_observed"))
def carbon_status(spark, sf_dir):
    rows = structure.with_status(
        paired(spark, sf_dir), predicted(spark, sf_dir), fx.observed(spark, sf_dir), CONFIG
    )
    return rows.select("mol_id", "atom_id", "observed", "status")


EDITED_SQL = f"""WITH pair AS MATERIALIZED ({PAIRED_SQL})
    SELECT p.mol_id, p.atom_id, p.h_count, p.predicted, CASE WHEN p.atom_id % 5 = 0 THEN p.predicted + 1
      WHEN p.atom_id = 1 AND q.mol_id IS NOT NULL THEN q.observed WHEN p.atom_id = 2 AND q.mol_id IS NOT NULL THEN q.observed
      ELSE p.observed END AS observed
    FROM pair p LEFT JOIN pair q ON q.mol_id = p.mol_id AND q.atom_id = CASE p.atom_id WHEN 1 THEN 2 WHEN 2 THEN 1 END"""


@query(
    "manual_edits",
    _status_sql(EDITED_SQL, "SELECT mol_id, observed AS shift FROM p WHERE observed IS NOT NULL"),
)
def manual_edits(spark, sf_dir):
    """Edited and swapped shifts; the statuses then look at assigned shifts only."""
    rows = paired(spark, sf_dir)
    edits = rows.filter("atom_id % 5 = 0").select("mol_id", "atom_id", (F.col("predicted") + 1).alias("new_shift"))
    ones = rows.filter("atom_id = 1").select("mol_id")
    twos = rows.filter("atom_id = 2").select("mol_id")
    swaps = ones.join(twos, "mol_id").select("mol_id", F.lit(1).alias("atom_a"), F.lit(2).alias("atom_b"))
    changed = structure.edit_shifts(structure.swap_observed(rows, swaps), edits)
    judged = structure.with_status(
        changed, predicted(spark, sf_dir), changed.select("mol_id", F.col("observed").alias("shift")), CONFIG
    )
    return judged.select("mol_id", "atom_id", "observed", "status")


@query("assign_carbons")
def assign_carbons(spark, sf_dir):
    """Observed shifts assigned to predicted carbons with the least total difference."""
    atoms = predicted(spark, sf_dir)
    found = structure.assign_nearest(atoms, fx.observed(spark, sf_dir))
    rows = atoms.join(found, ["mol_id", "atom_id"], "left")
    return structure.with_status(rows, atoms, fx.observed(spark, sf_dir), CONFIG)


def measured_points(spark, sf_dir) -> DataFrame:
    """Measured HSQC points: the CH points of each molecule moved, every fourth negative, some missing."""
    points = library_search.ch_points(fx.carbons(spark, sf_dir)).filter("point_id % 9 <> 5")
    wobble = ((F.col("mol_id") * 7 + F.col("point_id") * 11) % 21 - 10) / F.lit(10.0)
    return points.select(
        "mol_id",
        F.col("point_id").alias("obs_id"),
        F.round(F.col("c") + wobble, 2).alias("obs_c"),
        F.round(F.col("h") + wobble / 10, 2).alias("obs_h"),
        F.when(F.col("point_id") % 4 == 0, F.lit(-1.0)).otherwise(F.lit(1.0)).alias("intensity"),
    )


@query("assign_hsqc_points")
def assign_hsqc_points(spark, sf_dir):
    points = library_search.ch_points(fx.carbons(spark, sf_dir))
    observed = measured_points(spark, sf_dir)
    limit = observed.groupBy("mol_id").count().agg(F.max("count")).first()[0] or 1
    found = structure.assign_hsqc(points, observed, CONFIG, limit)
    return found.withColumn("atom_id", F.floor(F.col("point_id") / 4).cast("int")).drop("gain")


@query("assign_with_hsqc")
def assign_with_hsqc(spark, sf_dir):
    """Carbon assignment overridden by the matched HSQC points."""
    atoms = predicted(spark, sf_dir)
    found = structure.assign_nearest(atoms, fx.observed(spark, sf_dir))
    rows = structure.prefer_hsqc_carbon(
        atoms.join(found, ["mol_id", "atom_id"], "left"), assign_hsqc_points(spark, sf_dir)
    )
    return structure.with_status(rows, atoms, fx.observed(spark, sf_dir), CONFIG)


def hydrogens(spark, sf_dir) -> DataFrame:
    """Hydrogen groups of each protonated carbon with a wide tolerance."""
    items = F.transform("h_shifts", lambda h, i: F.struct(i.alias("h_idx"), h.alias("shift")))
    rows = fx.carbons(spark, sf_dir).filter("h_count > 0").withColumn("hs", items)
    return rows.select(
        "mol_id", F.col("c_index").alias("atom_id"), "h_count", F.posexplode(structure.hydrogen_groups(F.col("hs"), 0.5)).alias("g_no", "g")
    ).select("mol_id", "atom_id", "h_count", "g_no", F.size("g.atoms").alias("n_h"), "g.predicted", "g.suffix")


GROUP_SQL = """SELECT mol_id, atom_id, h_count, CAST(g_no AS INTEGER) AS g_no, CAST(n_h AS INTEGER) AS n_h, predicted, suffix FROM (
    SELECT mol_id, c_index AS atom_id, h_count, 0 AS g_no, 1 AS n_h, h1 AS predicted, '' AS suffix FROM fx_carbons WHERE h_count = 1
    UNION ALL SELECT mol_id, c_index, h_count, 0, 3, CASE WHEN h2 IS NULL THEN (h1 + h3) / 2 ELSE (h1 + h2 + h3) / 3 END, ''
      FROM fx_carbons WHERE h_count = 3
    UNION ALL SELECT mol_id, c_index, h_count, 0, 2, (least(h1, h2) + greatest(h1, h2)) / 2, '' FROM fx_carbons
      WHERE h_count = 2 AND h2 IS NOT NULL AND abs(greatest(h1, h2) - least(h1, h2)) <= 0.5
    UNION ALL SELECT mol_id, c_index, h_count, unnest([0, 1]), 1, unnest([coalesce(least(h1, h2), h1), CASE WHEN h2 IS NOT NULL
      THEN greatest(h1, h2) END]), unnest(['a', 'b']) FROM fx_carbons
      WHERE h_count = 2 AND (h2 IS NULL OR abs(greatest(h1, h2) - least(h1, h2)) > 0.5))"""


@query("hydrogen_groups", f"SELECT mol_id, atom_id, h_count, g_no, n_h, round(predicted, 6) AS predicted, suffix FROM ({GROUP_SQL})")
def hydrogen_groups(spark, sf_dir):
    return hydrogens(spark, sf_dir).withColumn("predicted", F.round("predicted", 6))


@query(
    "proton_status",
    f"""SELECT mol_id, atom_id, g_no, round(e, 6) AS error, {ERROR_SQL.format(0.15, 0.3)} AS status FROM (
        SELECT *, abs(predicted - observed) AS e FROM (SELECT *, round(predicted + ((mol_id + atom_id) % 9 - 4) / 10.0::DOUBLE + 1e-9, 2)
          AS observed FROM ({GROUP_SQL})))""",
)
def proton_status(spark, sf_dir):
    wobble = ((F.col("mol_id") + F.col("atom_id")) % 9 - 4) / F.lit(10.0)
    groups = hydrogens(spark, sf_dir).withColumn("observed", scoring.half_up(F.col("predicted") + wobble, 2))
    judged = structure.proton_status(groups, CONFIG)
    return judged.select("mol_id", "atom_id", "g_no", F.round("error", 6).alias("error"), "status")


@query(
    "split_and_merge_groups",
    f"""SELECT mol_id, atom_id, 'merged' AS kind, 0 AS no, CAST(sum(n_h) AS INTEGER) AS n_h, round(avg(predicted), 6) AS predicted
        FROM ({GROUP_SQL}) GROUP BY 1, 2
        UNION ALL SELECT mol_id, atom_id, 'split', unnest(range(n_h)), 1, round(predicted, 6) FROM ({GROUP_SQL}) WHERE g_no = 0""",
)
def split_and_merge_groups(spark, sf_dir):
    """All groups of a carbon merged into one, and its first group split into single hydrogens."""
    items = F.transform("h_shifts", lambda h, i: F.struct(i.alias("h_idx"), h.alias("shift")))
    rows = fx.carbons(spark, sf_dir).filter("h_count > 0").select(
        "mol_id", F.col("c_index").alias("atom_id"), structure.hydrogen_groups(items, 0.5).alias("g")
    )
    nothing = F.array().cast("array<double>")
    merged = rows.select("mol_id", "atom_id", F.lit("merged").alias("kind"), F.lit(0).alias("no"), structure.merge_groups(F.col("g"), F.lit(None).cast("double")).alias("x"))
    split = rows.select(
        "mol_id", "atom_id", F.lit("split").alias("kind"), F.posexplode(structure.split_group(F.get("g", F.lit(0)), nothing)).alias("no", "x")
    )
    return merged.unionByName(split).select(
        "mol_id", "atom_id", "kind", "no", F.size("x.atoms").alias("n_h"), F.round("x.predicted", 6).alias("predicted")
    )


@query(
    "carbon_report",
    f"""SELECT mol_id, array_to_string(list(printf('%.1f', round(observed + 1e-9, 1) + 0.0) || ' (C-' || CAST(atom_id + 1 AS VARCHAR) || ', '
          || CASE h_count WHEN 0 THEN 's' WHEN 1 THEN 'd' WHEN 2 THEN 't' ELSE 'q' END || ')' ORDER BY observed, atom_id), ', ') AS carbon_text
        FROM ({PAIRED_SQL}) WHERE observed IS NOT NULL GROUP BY 1""",
)
def carbon_report(spark, sf_dir):
    rows = paired(spark, sf_dir).withColumn("label", (F.col("atom_id") + 1).cast("string"))
    return export.carbon_text(rows)


@query("journal_report")
def journal_report(spark, sf_dir):
    """Full report line of every molecule from its optimal assignment."""
    carbons = assign_carbons(spark, sf_dir).withColumn("label", (F.col("atom_id") + 1).cast("string"))
    wobble = ((F.col("mol_id") + F.col("atom_id")) % 9 - 4) / F.lit(10.0)
    protons = (
        hydrogens(spark, sf_dir)
        .withColumn("observed", F.round(F.col("predicted") + wobble, 2))
        .withColumn("label", (F.col("atom_id") + 1).cast("string"))
    )
    molecules = fx.molecules(spark, sf_dir).select(
        "mol_id",
        F.concat(F.lit("C"), F.col("carbon_count").cast("string")).alias("formula"),
        (F.col("carbon_count") * F.lit(12.0)).alias("exact_mass"),
    )
    return export.journal_text(
        molecules, export.carbon_text(carbons), export.proton_text(protons), "101", "401", "CDCl3"
    )


@query(
    "assign_batch",
    """WITH m AS (SELECT mol_id, name, carbon_count, mol_id % 11 = 0 AS broken, mol_id % 2 = 0 AS filed, mol_id % 10 = 4 AS silent
         FROM fx_molecules),
       k AS (SELECT *, CASE WHEN broken THEN 'unreadable atom or bond block' WHEN NOT filed THEN 'no data file' END AS error FROM m),
       p AS (SELECT mol_id, count(c_shift) AS n FROM fx_carbons GROUP BY 1),
       -- A line of two numbers holds index and shift; with a second number that is no shift both are taken.
       o AS (SELECT mol_id, sum(CASE WHEN shift BETWEEN 0 AND 240 THEN 1 ELSE 2 END) AS n FROM fx_observed GROUP BY 1)
       SELECT k.name AS id, 'error' AS kind, error AS reason, CAST(1 AS BIGINT) AS n_rows, CAST(0 AS BIGINT) AS n_observed FROM k
         WHERE error IS NOT NULL
       UNION ALL SELECT k.name, 'carbon', NULL, carbon_count, CASE WHEN silent THEN 0 ELSE least(coalesce(p.n, 0), coalesce(o.n, 0)) END
         FROM k LEFT JOIN p ON p.mol_id = k.mol_id LEFT JOIN o ON o.mol_id = k.mol_id WHERE error IS NULL AND carbon_count > 0
       UNION ALL SELECT k.name, 'proton', NULL, CASE WHEN carbon_count = 1 THEN 4 WHEN carbon_count = 2 THEN 2
         ELSE 2 + 2 * (carbon_count - 2) END, 0 FROM k WHERE error IS NULL AND carbon_count > 0
       UNION ALL SELECT k.name, 'warning', 'no predicted 13C shifts', 1, 0 FROM k LEFT JOIN p ON p.mol_id = k.mol_id
         WHERE error IS NULL AND coalesce(p.n, 0) = 0
       UNION ALL SELECT k.name, 'warning', 'no shifts in the data file', 1, 0 FROM k LEFT JOIN o ON o.mol_id = k.mol_id
         WHERE error IS NULL AND (silent OR coalesce(o.n, 0) = 0)""",
)
def assign_batch(spark, sf_dir):
    """All molecules as structure records against data files; some records are broken, some files missing or without numbers."""
    molecules = fx.molecules(spark, sf_dir).select("mol_id", "name")
    records = text_queries.structure_records(spark, sf_dir).withColumn("name", F.regexp_extract("record", r"^(\S+)", 1))
    broken = F.when(F.col("mol_id") % 11 == 0, F.regexp_replace("record", "(?m)^ *\\d+ *\\d+(.*V2000)", " xx xx$1")).otherwise(F.col("record"))
    numbered = records.join(molecules, "name").select("source_file", F.col("mol_id").cast("bigint").alias("record_no"), broken.alias("record"))
    parsed = settle(sdf.parse_molecules(numbered))
    path = F.concat(F.lit("/spectra/"), "name", F.lit(".csv"))
    files = molecules.filter("mol_id % 2 = 0").select("mol_id", path.alias("path"))
    shift = F.concat((F.col("obs_id") + 1).cast("string"), F.lit("\t"), F.format_string("%.2f", "shift"))
    line = F.when(F.col("mol_id") % 10 == 4, F.lit("no data")).otherwise(shift)
    lines = fx.observed(spark, sf_dir).join(files, "mol_id").select("path", F.col("obs_id").alias("line_no"), line.alias("line"))
    rows = batch.assign_batch(parsed, files.select("path"), lines, CONFIG)
    return rows.groupBy("id", "kind", "reason").agg(F.count("*").alias("n_rows"), F.count("observed").alias("n_observed"))
