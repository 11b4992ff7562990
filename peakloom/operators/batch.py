"""Assignment of many molecules at once, each with its own data files; errors stay with their molecule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peakloom.config import AssignConfig
from peakloom.functions import text
from peakloom.operators import structure
from peakloom.session import settle
from peakloom.sources import peaks, sdf

KEY = ["source_file", "record_no"]
# Room for the hydrogen groups of one carbon in the number of a group.
GROUPS = 8
COLUMNS = (
    "source_file string, record_no bigint, id string, path string, kind string, reason string, atom_id int, group_no int, "
    "suffix string, h_count int, predicted double, observed double, error double, status string"
)


DATA_FILES = "*.{[cC][sS][vV],[tT][sS][vV],[tT][xX][tT]}"


def _plain_path() -> Column:
    """Path of the file of a row; Spark gives it in the form of a URI, where a plus sign is no blank."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))).alias("path")


def list_files(spark: SparkSession, folder: str, pattern: str = DATA_FILES) -> DataFrame:
    """Columns: path; the data files of a folder, empty ones too. Their contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return found.select(_plain_path())


def read_lines(spark: SparkSession, folder: str, pattern: str = DATA_FILES) -> DataFrame:
    """Columns: path, line_no, line; numbers rise in each file but need not follow on each other."""
    lines = spark.read.option("pathGlobFilter", pattern).text(folder)
    return lines.select(_plain_path(), F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"))


def shift_list(lines: DataFrame) -> DataFrame:
    """Shifts of the lines (mol_id, line_no, line): mol_id, obs_id, shift."""
    values = F.transform(text.text_lines(F.col("line"), split_semicolons=True), text.assignment_values)
    return lines.select("mol_id", "line_no", F.posexplode(F.flatten(values)).alias("at", "shift")).select(
        "mol_id", F.struct("line_no", "at").alias("obs_id"), "shift"
    )


def point_list(lines: DataFrame) -> DataFrame:
    """HSQC points of the lines (mol_id, line_no, line): mol_id, obs_id, obs_c, obs_h, intensity; numbered from 1."""
    points = F.transform(text.text_lines(F.col("line")), text.hsqc_point)
    rows = lines.select("mol_id", "line_no", F.posexplode(points).alias("at", "p")).filter("p IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("mol_id").orderBy("line_no", "at"))
    return rows.select(
        "mol_id", place.cast("bigint").alias("obs_id"), F.col("p.c").alias("obs_c"), F.col("p.h").alias("obs_h"), "p.intensity"
    )


def proton_groups(carbons: DataFrame, config: AssignConfig) -> DataFrame:
    """Hydrogen groups of carbons (mol_id, atom_id, predicted, h_indices, h_shifts).

    Columns: mol_id, atom_id, group_no, point_id, h_count, c, predicted, suffix.
    """
    hydrogens = F.transform("h_indices", lambda h, i: F.struct(h.alias("h_idx"), F.get("h_shifts", i).alias("shift")))
    groups = structure.hydrogen_groups(hydrogens, config.equivalence_tol)
    rows = carbons.filter("h_count > 0").select("mol_id", "atom_id", "h_count", F.col("predicted").alias("c"), F.posexplode(groups).alias("group_no", "g"))
    point = F.col("atom_id") * GROUPS + F.col("group_no")
    return rows.select("mol_id", "atom_id", "group_no", point.alias("point_id"), "h_count", "c", "g.predicted", "g.suffix")


def assign(
    carbons: DataFrame,
    shifts: DataFrame,
    config: AssignConfig,
    protons: DataFrame | None = None,
    points: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Carbons and hydrogen groups with observed shifts, errors and statuses.

    Molecules with HSQC points take the shifts of their groups from the points, and those of
    carbons with a matched point too; the others match their groups with the proton list.
    """
    groups = settle(proton_groups(carbons, config))
    atoms = carbons.select("mol_id", "atom_id", "h_count", "predicted")
    found = structure.assign_nearest(atoms, shifts).drop("obs_id")
    rows = atoms.join(found, ["mol_id", "atom_id"], "left")
    seen = None
    if points is not None:
        points = settle(points)
        limit = points.groupBy("mol_id").count().agg(F.max("count")).first()[0] or 1
        first = groups.filter("h_count = 2 OR group_no = 0").select("mol_id", "point_id", "c", F.col("predicted").alias("h"), "h_count")
        matched = settle(structure.assign_hsqc(first, points, config, limit).withColumn("atom_id", F.floor(F.col("point_id") / GROUPS).cast("int")))
        rows = structure.prefer_hsqc_carbon(rows, matched)
        seen = matched.select("mol_id", "point_id", F.col("obs_h").alias("observed"))
    if protons is not None:
        wanted = groups.select("mol_id", F.col("point_id").alias("atom_id"), "predicted")
        if points is not None:
            wanted = wanted.join(points.select("mol_id").distinct(), "mol_id", "left_anti")
        listed = structure.assign_nearest(wanted, protons).select("mol_id", F.col("atom_id").alias("point_id"), "observed")
        seen = listed if seen is None else seen.unionByName(listed)
    if seen is None:
        measured = groups.withColumn("observed", F.lit(None).cast("double"))
    else:
        measured = groups.join(seen, ["mol_id", "point_id"], "left")
    return structure.with_status(rows, atoms, shifts, config), structure.proton_status(measured, config)


def match_data(ids: DataFrame, files: DataFrame) -> DataFrame:
    """Data file of every record (source_file, record_no, id): adds path, warning and ``again``.

    Of files with equal stems the last path counts. Records that repeat an ID (``again``) share its file.
    """
    last = files.groupBy(peaks.stem(F.col("path")).alias("_stem")).agg(F.max("path").alias("path")).select("path")
    first = ids.groupBy("id").agg(F.min(F.struct(*KEY)).alias("position"))
    found = peaks.match_files(first, last).join(first, "id")
    return ids.join(found, "id").withColumn("again", F.struct(*KEY) != F.col("position")).drop("position")


def assign_batch(
    parsed: DataFrame,
    files: DataFrame,
    lines: DataFrame,
    config: AssignConfig,
    hsqc_files: DataFrame | None = None,
    hsqc_lines: DataFrame | None = None,
) -> DataFrame:
    """Every molecule of ``parsed`` (with record numbers) against its data file, typed rows in one table.

    ``kind`` is ``carbon`` or ``proton`` for results, ``warning`` for remarks beside them, ``error`` for
    the one row of a molecule that cannot be assigned; ``reason`` says why. A molecule without an
    ID goes by its number. A record whose ID was there before is assigned with its own structure, with a warning.
    Inputs: files (path), lines (path, line_no, line). Null lines hold nothing; empty inputs give
    an empty table or errors for all.
    """
    rows = parsed.withColumn("id", F.coalesce(F.nullif("name", F.lit("")), F.col("record_no").cast("string")))
    matched = match_data(rows.select(*KEY, "id"), files)
    # The weight is of no use here, and the shift lines are read as the assignment reader does.
    unread = F.when(F.col("problem") != sdf.NO_WEIGHT, F.col("problem"))
    rows = sdf.with_shifts(rows.withColumn("problem", unread).drop("carbon_shifts", "proton_shifts"), sdf.CARBON_TAG, "carbon_shifts", sdf.LOOSE_SHIFT)
    rows = sdf.with_shifts(rows, sdf.PROTON_TAG, "proton_shifts", sdf.LOOSE_SHIFT)
    reason = (
        F.when(F.col("problem").isNotNull(), F.col("problem"))
        .when(~F.array_contains("atoms", "C"), F.lit("no carbon atoms"))
        .when(F.col("path").isNull(), F.lit("no data file"))
    )
    judged = settle(rows.join(matched.drop("id"), KEY).withColumn("reason", reason).withColumn("mol_id", F.struct(*KEY)).drop("record"))
    good = judged.filter("reason IS NULL")
    carbons = sdf.carbon_rows(good).select(
        F.struct(*KEY).alias("mol_id"), F.col("c_index").alias("atom_id"), F.col("c_shift").alias("predicted"), "h_count", "h_indices", "h_shifts"
    )
    carbons = settle(carbons)
    owners = good.select("mol_id", "id", "path")
    shifts = settle(shift_list(lines.join(owners.select("mol_id", "path"), "path")))
    points = None
    if hsqc_files is not None and hsqc_lines is not None and config.use_hsqc:
        # Only an exact stem or, with enough files, the order counts here as well; without a file 13C alone is used.
        pointed = match_data(good.select(*KEY, "id"), hsqc_files).filter("path IS NOT NULL").select(F.struct(*KEY).alias("mol_id"), "path")
        points = point_list(hsqc_lines.join(pointed, "path"))
    done_c, done_h = assign(carbons, shifts, config, points=points)
    result_c = done_c.select("mol_id", F.lit("carbon").alias("kind"), "atom_id", "h_count", "predicted", "observed", "error", "status")
    result_h = done_h.select("mol_id", F.lit("proton").alias("kind"), "atom_id", "group_no", "suffix", "h_count", "predicted", "observed", "error", "status")
    results = result_c.unionByName(result_h, allowMissingColumns=True).join(owners, "mol_id")

    def remark(source: DataFrame, kind: str, why) -> DataFrame:
        return source.select("mol_id", "id", "path", F.lit(kind).alias("kind"), why.alias("reason"))

    silent = good.join(shifts.select("mol_id").distinct(), "mol_id", "left_anti")
    notes = (
        remark(judged.filter("reason IS NOT NULL"), "error", F.col("reason"))
        .unionByName(remark(good.filter("warning IS NOT NULL"), "warning", F.col("warning")))
        .unionByName(remark(good.filter("again"), "warning", F.lit("repeated ID")))
        .unionByName(remark(good.filter("cardinality(carbon_shifts) = 0"), "warning", F.lit("no predicted 13C shifts")))
        .unionByName(remark(silent, "warning", F.lit("no shifts in the data file")))
    )
    both = results.unionByName(notes, allowMissingColumns=True).select("*", "mol_id.*")
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    return both.select(*[F.col(n).cast(c.split()[1]).alias(n) for n, c in zip(names, COLUMNS.split(", "))])
