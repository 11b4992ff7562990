"""Registered queries: text parsing, peak-table and structure-file round trips, list formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peakloom.functions import text
from peakloom.plans import fixtures as fx
from peakloom.plans.registry import query
from peakloom.session import cut_lineage, new_folder, settle, table
from peakloom.sinks import export
from peakloom.sources import peaks as peak_files
from peakloom.sources import sdf

NUMBER = r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?"
PAIR = rf"\(\s*({NUMBER})\s*,\s*({NUMBER})\s*\)"
# The oracle has no Unicode word boundary: a neighbouring non-word character is matched instead (twice, as it is consumed).
EDGE = r"(^|[^\p{L}\p{N}_])"


@query(
    "parse_numbers",
    f"""SELECT doc_id, len(t) AS n, array_to_string(t, ' ') AS tokens, list_max(list_filter(
          list_transform(t, lambda x: TRY_CAST(x AS DOUBLE)), lambda v: v < 1e9)) AS largest
        FROM (SELECT doc_id, regexp_extract_all(text, '{NUMBER}') AS t FROM documents)""",
)
def parse_numbers(spark, sf_dir):
    body = F.col("text")
    tokens = table(spark, sf_dir, "documents").select("doc_id", text.number_tokens(body).alias("t"), text.numbers(body).alias("v"))
    return tokens.select(
        "doc_id",
        F.size("t").cast("long").alias("n"),
        F.array_join("t", " ").alias("tokens"),
        F.array_max(F.filter("v", lambda v: v < 1e9)).alias("largest"),
    )


@query(
    "parse_pairs",
    f"""WITH p AS (SELECT conv_id, turn, regexp_extract_all(text, '{NUMBER}') AS t,
          regexp_extract_all(text, '{PAIR}', 1) AS c, regexp_extract_all(text, '{PAIR}', 2) AS h FROM conversations)
        SELECT conv_id, turn, CASE WHEN len(c) > 0 THEN len(c) ELSE len(t) // 2 END AS n_pairs,
          CASE WHEN len(c) > 0 THEN c[1]::DOUBLE WHEN len(t) >= 2 THEN TRY_CAST(t[1] AS DOUBLE) END AS first_c,
          CASE WHEN len(c) > 0 THEN h[1]::DOUBLE WHEN len(t) >= 2 THEN TRY_CAST(t[2] AS DOUBLE) END AS first_h FROM p""",
)
def parse_pairs(spark, sf_dir):
    found = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.pairs(F.col("text")).alias("p"))
    return found.select(
        "conv_id",
        "turn",
        F.size("p").cast("long").alias("n_pairs"),
        F.get("p", F.lit(0))["c"].alias("first_c"),
        F.get("p", F.lit(0))["h"].alias("first_h"),
    )


LINE_SQL = rf"""WITH l AS (SELECT doc_id, unnest(s) AS line, unnest(range(len(s))) AS line_no FROM (
      SELECT doc_id, string_split_regex(text, '\r\n|\r|\n|;') AS s FROM documents)),
    c1 AS (SELECT doc_id, line_no, regexp_replace(regexp_replace(line, '(?i){EDGE}[CH]\s*-\s*\d+[a-z]?', '\1 ', 'g'),
      '(?i){EDGE}[CH]\s*-\s*\d+[a-z]?', '\1 ', 'g') AS line FROM l),
    c2 AS (SELECT doc_id, line_no, regexp_replace(regexp_replace(line, '(?i){EDGE}\d+\s*H($|[^\p{{L}}\p{{N}}_])', '\1 \2', 'g'),
      '(?i){EDGE}\d+\s*H($|[^\p{{L}}\p{{N}}_])', '\1 \2', 'g') AS line FROM c1),
    v AS (SELECT doc_id, line_no, list_transform(regexp_extract_all(line, '[-+]?\d+(?:\.\d+)?'),
      lambda x: TRY_CAST(x AS DOUBLE)) AS v FROM c2)"""


@query(
    "parse_assignment_lines",
    LINE_SQL
    + """ SELECT doc_id, count(*) AS n, round(max(x), 6) AS largest FROM (SELECT doc_id, unnest(CASE
        WHEN len(v) = 2 AND abs(v[1] - round(v[1])) < 1e-6 AND v[2] BETWEEN 0 AND 240 THEN [v[2]]
        WHEN len(v) >= 5 AND abs(v[1] - round(v[1])) < 1e-6 AND v[2] > 1000 AND v[3] BETWEEN 0 AND 240 THEN [v[3]]
        ELSE v END) AS x FROM v) GROUP BY 1""",
)
def parse_assignment_lines(spark, sf_dir):
    """Shifts of every document read as an assignment text, line by line."""
    lines = table(spark, sf_dir, "documents").select(
        "doc_id", F.explode(text.text_lines(F.col("text"), split_semicolons=True)).alias("line")
    )
    values = lines.select("doc_id", F.explode(text.assignment_values(F.col("line"))).alias("x"))
    return values.groupBy("doc_id").agg(F.count("*").alias("n"), F.round(F.max("x"), 6).alias("largest"))


PLAUSIBLE = "{0} >= 0 AND {1} >= 0 AND (({0} BETWEEN 10 AND 240 AND {1} <= 15) OR ({1} BETWEEN 10 AND 240 AND {0} <= 15))"


def _plausible(a, b):
    return PLAUSIBLE.format(a, b)


@query(
    "parse_hsqc_lines",
    LINE_SQL.replace("|;')", "')")
    + f""" SELECT doc_id, line_no::INTEGER AS line_no, greatest(a, b) AS c, least(a, b) AS h, i AS intensity FROM (
        SELECT doc_id, line_no, CASE k WHEN 1 THEN v[2] WHEN 2 THEN v[1] WHEN 3 THEN v[2] WHEN 4 THEN v[-2] END AS a,
          CASE k WHEN 1 THEN v[3] WHEN 2 THEN v[2] WHEN 3 THEN v[3] WHEN 4 THEN v[-1] END AS b,
          CASE k WHEN 1 THEN v[4] WHEN 2 THEN v[3] END AS i FROM (
          SELECT *, CASE WHEN len(v) >= 4 AND v[1] >= 0 AND abs(v[1] - round(v[1])) < 1e-6 AND {_plausible("v[2]", "v[3]")} THEN 1
            WHEN len(v) >= 3 AND {_plausible("v[1]", "v[2]")} THEN 2
            WHEN len(v) >= 3 AND v[1] >= 0 AND abs(v[1] - round(v[1])) < 1e-6 AND {_plausible("v[2]", "v[3]")} THEN 3
            WHEN len(v) >= 2 AND {_plausible("v[-2]", "v[-1]")} THEN 4 END AS k FROM v)) WHERE a IS NOT NULL""",
)
def parse_hsqc_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select(
        "doc_id", F.posexplode(text.text_lines(F.col("text"))).alias("line_no", "line")
    )
    points = lines.select("doc_id", "line_no", text.hsqc_point(F.col("line")).alias("p")).filter("p IS NOT NULL")
    return points.select("doc_id", "line_no", "p.c", "p.h", "p.intensity")


@query(
    "format_lists",
    """SELECT series_id, sample_id, array_to_string(list_transform(list_sort(list(ppm)), lambda v: printf('%.3f', v)), ', ') AS shifts,
         array_to_string(list_transform(list_sort(list({'c': ppm, 'h': h_ppm})), lambda p: printf('(%.3f, %.3f)', p.c, p.h)), ', ') AS points
       FROM fx_peaks GROUP BY 1, 2""",
)
def format_lists(spark, sf_dir):
    lists = fx.peaks(spark, sf_dir).groupBy("series_id", "sample_id").agg(
        F.collect_list("ppm").alias("v"), F.collect_list(F.struct(F.col("ppm").alias("c"), F.col("h_ppm").alias("h"))).alias("p")
    )
    return lists.select(
        "series_id", "sample_id", text.format_values(F.col("v")).alias("shifts"), text.format_points(F.col("p")).alias("points")
    )


@query(
    "numeric_peak_table",
    """SELECT series_id, peak_id, ppm, intensity AS height, CASE WHEN area IS NULL THEN NULL ELSE width END AS area,
         CASE WHEN area IS NULL THEN NULL ELSE peak_id::DOUBLE END AS width FROM fx_peaks WHERE peak_id % 11 <> 0""",
)
def numeric_peak_table(spark, sf_dir):
    """Peak lines with mixed separators, every eleventh commented out, read as headerless numbers."""
    mark = F.when(F.col("peak_id") % 11 == 0, F.lit("# ")).otherwise(F.lit(" "))
    tail = F.when(F.col("area").isNotNull(), F.concat(F.lit("\t"), "width", F.lit(" n/a "), "peak_id")).otherwise(F.lit("  "))
    line = F.concat(mark, F.col("ppm"), F.lit("; "), F.col("intensity"), tail)
    lines = fx.peaks(spark, sf_dir).select("series_id", "peak_id", line.alias("line"))
    return peak_files.numeric_table(lines).drop("extra")


@query(
    "fill_signal",
    """SELECT series_id, peak_id, coalesce(i, a, 1.0) AS intensity, coalesce(a, i, 1.0) AS area FROM (
        SELECT series_id, peak_id, CASE WHEN peak_id % 2 = 0 THEN intensity END AS i, area AS a FROM fx_peaks)""",
)
def fill_signal(spark, sf_dir):
    half = fx.peaks(spark, sf_dir).select(
        "series_id", "peak_id", F.when(F.col("peak_id") % 2 == 0, F.col("intensity")).alias("intensity"), "area"
    )
    return peak_files.fill_signal(half)


def structure_records(spark, sf_dir) -> DataFrame:
    """One structure-file record per molecule: its carbons as a chain, with shift fields."""
    rows = (
        fx.carbons(spark, sf_dir)
        .groupBy("mol_id")
        .agg(F.array_sort(F.collect_list(F.struct("c_index", "c_shift"))).alias("a"))
        .join(fx.molecules(spark, sf_dir), "mol_id")
    )
    n = F.size("a")
    steps = F.when(n > 1, F.sequence(F.lit(0), n - 2)).otherwise(F.array().cast("array<int>"))
    bonds = F.transform(steps, lambda i: F.struct(i.alias("a"), (i + 1).alias("b"), F.lit(1).alias("order")))
    block = export.molecule_block(F.col("name"), F.transform("a", lambda _: F.lit("C")), bonds)
    shifts = F.filter(
        F.transform(
            "a", lambda x, i: F.concat(F.lit("1["), (i + 1).cast("string"), F.lit("]  "), F.format_string("%.2f", x["c_shift"]))
        ),
        lambda s: s.isNotNull() & ~s.contains("null"),
    )
    protons = F.concat(F.lit("1H["), (n + 1).cast("string"), F.lit("]  1.25"))
    record = export.set_field(block, "ID", F.col("name"))
    record = export.set_field(record, "FW", F.format_string("%.2f", "fw"))
    record = export.set_field(record, sdf.CARBON_TAG, F.array_join(shifts, "\n"))
    return rows.select("source_file", export.set_field(record, sdf.PROTON_TAG, protons).alias("record"))


@query(
    "structure_round_trip",
    """SELECT m.name, CAST(row_number() OVER w - 1 AS INTEGER) AS c_index, round(c.c_shift, 2) AS c_shift,
         CAST(4 - CASE WHEN row_number() OVER w = 1 THEN 0 ELSE 1 END - CASE WHEN row_number() OVER w = count(*) OVER
           (PARTITION BY c.mol_id) THEN 0 ELSE 1 END AS INTEGER) AS h_count,
         CAST(CASE WHEN row_number() OVER w = 1 THEN 0 ELSE 1 END + CASE WHEN row_number() OVER w = count(*) OVER
           (PARTITION BY c.mol_id) THEN 0 ELSE 1 END AS INTEGER) AS n_neighbours,
         CASE WHEN row_number() OVER w = 1 THEN 1.25::DOUBLE END AS first_h_shift
       FROM fx_carbons c JOIN fx_molecules m ON m.mol_id = c.mol_id WINDOW w AS (PARTITION BY c.mol_id ORDER BY c.c_index)""",
)
def structure_round_trip(spark, sf_dir):
    """Structure records written from the tables and parsed back to carbons."""
    # Parsed once and written: a filter on a parsed column would repeat the parsing below it, once per atom.
    parsed = settle(sdf.parse_molecules(cut_lineage(structure_records(spark, sf_dir))))
    return sdf.carbon_rows(parsed).select(
        "name",
        "c_index",
        "c_shift",
        "h_count",
        F.size("connected_carbon").alias("n_neighbours"),
        F.get("h_shifts", F.lit(0)).alias("first_h_shift"),
    )


@query(
    "structure_library",
    """SELECT name, source_file, round(fw, 2) AS fw, carbon_count, 3 * carbon_count + 2 AS num_atoms,
         3 * carbon_count + 1 AS num_bonds FROM fx_molecules""",
)
def structure_library(spark, sf_dir):
    return sdf.library(settle(sdf.parse_molecules(structure_records(spark, sf_dir)))).drop("mol_block")


@query(
    "structure_formula",
    """SELECT name, concat('C', CASE WHEN carbon_count > 1 THEN carbon_count::VARCHAR ELSE '' END, 'H', h) AS formula,
         round(carbon_count * 12.011::DOUBLE + h * 1.008::DOUBLE, 4) AS weight,
         round(carbon_count * 12.0::DOUBLE + h * 1.00782503207::DOUBLE, 6) AS exact_mass
       FROM (SELECT *, 2 * carbon_count + 2 AS h FROM fx_molecules)""",
)
def structure_formula(spark, sf_dir):
    counts = sdf.element_counts(settle(sdf.parse_molecules(structure_records(spark, sf_dir))))
    return counts.select("name", "formula", "weight", "exact_mass")


@query(
    "molecule_at",
    """WITH m AS (SELECT name, row_number() OVER (ORDER BY name) AS number, carbon_count FROM fx_molecules)
       SELECT name, number, 'id' AS asked, name AS found, carbon_count, NULL::VARCHAR AS missing FROM m
       UNION ALL SELECT name, number, 'number', name, carbon_count, NULL FROM m
       UNION ALL SELECT name, number, 'absent', NULL, NULL, concat('no molecule with ID ', name, '?') FROM m""",
)
def molecule_at(spark, sf_dir):
    """Structure files written in the order of names and read by number; every molecule looked up by ID and by number.

    ``number`` counts through all files: the records of the files before, and the place in the own file.
    """
    records = structure_records(spark, sf_dir).withColumn("name", F.regexp_extract("record", r"^(\S+)", 1))
    folder = new_folder(spark, "structures")
    export.write_records(records.repartitionByRange("name").sortWithinPartitions("name"), folder)
    parsed = settle(sdf.parse_molecules(sdf.read_numbered(spark, folder, "*.txt")))
    held = parsed.groupBy("source_file").agg(F.count("*").alias("n"))
    # One row per file.
    before = F.sum("n").over(Window.orderBy("source_file").rowsBetween(Window.unboundedPreceding, -1))
    files = held.select("source_file", F.coalesce(before, F.lit(0)).alias("before"))
    rows = parsed.select("source_file", "record_no", "name").join(files, "source_file")
    key = F.struct("name", (F.col("before") + F.col("record_no")).alias("number"))

    def ask(kind: str, name, number) -> DataFrame:
        request = F.struct(key.alias("key"), F.lit(kind).alias("asked")).alias("request_id")
        return rows.select(request, "source_file", name.alias("molecule_id"), number.alias("record_no"))

    none = F.lit(None)
    requests = (
        ask("id", F.col("name"), none.cast("bigint"))
        .unionByName(ask("number", none.cast("string"), F.col("record_no")))
        .unionByName(ask("absent", F.concat("name", F.lit("?")), none.cast("bigint")))
    )
    return sdf.find_molecules(parsed, requests).select(
        "request_id.key.name",
        "request_id.key.number",
        "request_id.asked",
        F.col("molecule.name").alias("found"),
        F.size(F.filter("molecule.atoms", lambda a: a == "C")).alias("carbon_count"),
        "missing",
    )


@query(
    "assigned_structure_file",
    """SELECT m.name, CAST(row_number() OVER (PARTITION BY c.mol_id ORDER BY c.c_index) - 1 AS INTEGER) AS c_index,
         coalesce(round(o.shift + 1e-9, 2), round(c.c_shift, 2)) AS c_shift FROM fx_carbons c JOIN fx_molecules m ON m.mol_id = c.mol_id
         LEFT JOIN fx_observed o ON o.mol_id = c.mol_id AND o.obs_id = c.c_index""",
)
def assigned_structure_file(spark, sf_dir):
    """Records whose predicted shifts are replaced by the observed ones, read back."""
    order = Window.partitionBy("mol_id").orderBy("c_index")
    atoms = fx.carbons(spark, sf_dir).select("mol_id", "c_index", F.row_number().over(order).cast("string").alias("atom"))
    seen = fx.observed(spark, sf_dir).withColumnRenamed("obs_id", "c_index")
    values = atoms.join(seen, ["mol_id", "c_index"]).groupBy("mol_id").agg(
        F.map_from_entries(F.collect_list(F.struct("atom", "shift"))).alias("carbon_values")
    )
    names = fx.molecules(spark, sf_dir).select("mol_id", "name")
    records = structure_records(spark, sf_dir).withColumn("name", F.regexp_extract("record", r"^(\S+)", 1))
    joined = records.join(names, "name").join(values, "mol_id", "left")
    empty = F.create_map().cast("map<string,double>")
    joined = joined.withColumn("carbon_values", F.coalesce("carbon_values", empty)).withColumn("proton_values", empty)
    written = export.assigned_records(joined.select("source_file", "record", "carbon_values", "proton_values"))
    # The written file is the boundary between the two plans.
    parsed = settle(sdf.parse_molecules(cut_lineage(written.select("source_file", "record"))))
    return sdf.carbon_rows(parsed).select("name", "c_index", "c_shift")


@query(
    "batch_files",
    """SELECT m.name AS id, CASE WHEN m.mol_id % 2 = 0 THEN concat('/spectra/', m.name, '.csv') END AS path,
         CASE WHEN m.mol_id % 2 <> 0 THEN 'no data file' END AS warning FROM fx_molecules m""",
)
def batch_files(spark, sf_dir):
    """Data files joined to molecule ids by stem; there are fewer files than ids."""
    molecules = fx.molecules(spark, sf_dir)
    ids = molecules.select(F.col("name").alias("id"), F.col("mol_id").alias("position"))
    files = molecules.filter("mol_id % 2 = 0").select(F.concat(F.lit("/spectra/"), "name", F.lit(".csv")).alias("path"))
    return peak_files.match_files(ids, files)


@query(
    "form_checks",
    rf"""SELECT doc_id, regexp_matches(text, '^\s*{NUMBER}(\s*,\s*{NUMBER})*\s*$') AS is_numbers,
          CASE WHEN length(regexp_replace(trim(source), '[^A-Za-z0-9._-]+', '_', 'g')) > 0
            THEN regexp_replace(trim(source), '[^A-Za-z0-9._-]+', '_', 'g') ELSE 'molecule' END AS file_name FROM documents""",
)
def form_checks(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.is_number_list(F.col("text")).alias("is_numbers"), text.safe_file_name(F.col("source")).alias("file_name")
    )
