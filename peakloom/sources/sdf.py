"""Structure files (V2000 SD files) as DataFrames.

Records are split by Spark's text source, which can divide a file at the record
separator; everything inside a record is parsed with Column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEPARATOR = "$$$$"
SUFFIXES = "*.{[sS][dD][fF],[sS][dD]}"
# Symbol, valences, average atomic weight, exact mass of the lightest main isotope.
ELEMENTS = (
    ("H", (1,), 1.008, 1.00782503207),
    ("B", (3,), 10.812, 11.0093054),
    ("C", (4,), 12.011, 12.0),
    ("N", (3,), 14.007, 14.0030740048),
    ("O", (2,), 15.999, 15.99491461956),
    ("F", (1,), 18.998, 18.99840322),
    ("Si", (4,), 28.086, 27.9769265325),
    ("P", (3, 5, 7), 30.974, 30.97376163),
    ("S", (2, 4, 6), 32.067, 31.972071),
    ("Cl", (1,), 35.453, 34.96885268),
    ("Br", (1,), 79.904, 78.9183371),
    ("I", (1, 3, 5), 126.904, 126.904473),
)
# Fixed values of the format: charge by the code of an atom line (4 is a radical), order number of aromatic bonds.
CHARGE_CODES = (0, 3, 2, 1, 0, -1, -2, -3)
AROMATIC = 4
# A negative charge leaves carbon and silicon one bond fewer and boron one more; a positive one does the reverse for boron.
SIGN_OF_CHARGE = {"B": -1, "C": 0, "Si": 0}
CARBON_TAG = "Predicted 13C shifts"
PROTON_TAG = "HydrogenShifts"
# Shift lines: number, optional letters, [1-based atom], value.
STRICT_SHIFT = r"(?m)^\s*\d+[a-zA-Z]*\[(\d+)\]\s+([-+]?\d*\.?\d+)"
# Looser form of the assignment reader: the bracket may stand anywhere in the line, the first one counts.
LOOSE_SHIFT = r"(?m)^[^\n]*?\[(\d+)\][ \t]+([-+]?\d+(?:\.\d+)?)"
NO_WEIGHT = "no FW field"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Columns: source_file, record. Only .sdf and .sd files of the folder are read, in any case of letters.

    What follows a separator starts with the rest of its line, which goes.  The first record of a
    file has none: there a blank first line is the title, and the counts line is the fourth.
    """
    raw = (
        spark.read.option("lineSep", SEPARATOR)
        .option("pathGlobFilter", SUFFIXES)
        .text(path)
        .withColumn("source_file", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1))
    )
    return raw.select("source_file", _body(F.col("value")).alias("record")).filter(~_blank(F.col("record")))


def _body(value: Column) -> Column:
    lines = F.regexp_replace(value, "\r\n?", "\n")
    whole = F.get(F.split(lines, "\n"), F.lit(3)).rlike("V[23]000")
    return F.when(F.coalesce(whole, F.lit(False)), lines).otherwise(F.regexp_replace(lines, r"^[ \t]*\n", ""))


def _blank(record: Column) -> Column:
    return F.trim(F.regexp_replace(record, "\\s", "")) == ""


def read_numbered(spark: SparkSession, path: str, pattern: str = SUFFIXES) -> DataFrame:
    """Columns: source_file, record_no, record; records are numbered from 1 in each file that fits ``pattern``.

    Spark may read a file in many blocks. Places inside a block come from the order of the scan, the
    places before a block from the counts of the blocks before it, so only one number per block
    is sorted and no record is. A blank record between two separators keeps its number and gives no
    row, as an unreadable record keeps its number. Files of equal name in different folders are counted apart.
    """
    raw = (
        spark.read.option("lineSep", SEPARATOR)
        .option("pathGlobFilter", pattern)
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("_path"),
            F.col("_metadata.file_name").alias("source_file"),
            F.col("_metadata.file_block_start").alias("_start"),
            F.monotonically_increasing_id().alias("_place"),
            "value",
        )
    )
    block = ["_path", "_start"]
    sizes = raw.groupBy(*block).agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_path").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")
    number = F.col("_before") + F.col("_place") - F.col("_first") + 1
    rows = raw.join(offsets, block).select("source_file", number.alias("record_no"), _body(F.col("value")).alias("record"))
    return rows.filter(~_blank(F.col("record")))


def find_molecules(parsed: DataFrame, requests: DataFrame) -> DataFrame:
    """The molecule of each request (request_id, source_file, molecule_id, record_no).

    ``molecule_id`` counts if it is not blank: the first record of the file with that ID field, blanks
    around both ignored. Otherwise the record with that number. Columns: request_id, all columns of
    ``parsed`` under ``molecule`` (null if there is none), ``missing`` with the reason, null when found.
    Requests with null or unknown files are answered as missing too; repeated requests are answered each.
    """
    wanted = F.nullif(F.trim("molecule_id"), F.lit(""))
    asked = requests.select(
        "request_id", "source_file", wanted.alias("_name"), F.when(wanted.isNull(), F.col("record_no").cast("bigint")).alias("_no")
    )
    whole = F.struct(*[F.col(c) for c in parsed.columns])
    records = parsed.select("source_file", F.col("record_no").alias("_no"), F.col("name").alias("_name"), whole.alias("molecule"))
    # Only numbers are grouped, and only for names that are asked for.
    names = asked.select("source_file", "_name").dropna().distinct()
    firsts = (
        records.select("source_file", "_name", "_no")
        .join(names, ["source_file", "_name"])
        .groupBy("source_file", "_name")
        .agg(F.min("_no").alias("_named_no"))
    )
    placed = asked.join(firsts, ["source_file", "_name"], "left").withColumn("_no", F.coalesce("_named_no", "_no"))
    found = placed.join(records.drop("_name"), ["source_file", "_no"], "left")
    missing = (
        F.when(F.col("molecule").isNotNull(), F.lit(None).cast("string"))
        .when(F.col("_name").isNotNull(), F.concat(F.lit("no molecule with ID "), "_name"))
        .when(F.col("_no").isNull(), F.lit("neither ID nor number"))
        .otherwise(F.concat(F.lit("no molecule with number "), F.col("_no").cast("string")))
    )
    return found.select("request_id", "molecule", missing.alias("missing"))


def tag_value(record: Column, tag: str) -> Column:
    """Text of a data field, null when the record does not have it."""
    value = F.regexp_extract(record, rf"(?s)>[^\n]*<{tag}>[^\n]*\n(.*?)(?:\n[ \t]*\n|\n?$)", 1)
    return F.when(F.contains(record, F.lit(f"<{tag}>")), value)


def with_shifts(records: DataFrame, tag: str, column: str, pattern: str = STRICT_SHIFT) -> DataFrame:
    """Add map<0-based atom index, shift>; the last line of an atom wins, other lines are ignored.

    The lines are staged in columns of their own, so no text is searched twice.
    """
    staged = records.withColumn("_text", F.coalesce(tag_value(F.col("record"), tag), F.lit("")))
    staged = staged.withColumn("_atoms", F.regexp_extract_all("_text", F.lit(pattern), F.lit(1)).try_cast("array<int>"))
    staged = staged.withColumn("_shifts", F.regexp_extract_all("_text", F.lit(pattern), F.lit(2)).cast("array<double>"))
    back = F.reverse(F.arrays_zip("_atoms", "_shifts"))
    staged = staged.withColumn("_lines", back).withColumn("_atoms", F.reverse("_atoms"))
    last = F.filter("_lines", lambda x, i: F.array_position(F.col("_atoms"), x["_atoms"]) == i + 1)
    pairs = F.transform(last, lambda x: F.struct((x["_atoms"] - 1).alias("atom"), x["_shifts"].alias("shift")))
    return staged.withColumn(column, F.map_from_entries(pairs)).drop("_text", "_atoms", "_shifts", "_lines")


def _field(line: Column, start: int, width: int) -> Column:
    return F.trim(F.substring(line, start, width))


def parse_molecules(records: DataFrame) -> DataFrame:
    """Columns: source_file, record, name, fw, atoms, charges, bonds, added, carbon_shifts, proton_shifts, problem.

    ``atoms`` holds symbols, ``bonds`` structs (a, b, order) with 0-based ends, ``added`` the number of
    hydrogens that each atom of a record without any hydrogen gets.  Records that cannot be
    read keep their row with the reason in ``problem``.  ``record_no`` is kept where the records have it.
    """
    lines = F.split("record", "\n")
    staged = with_shifts(records, CARBON_TAG, "carbon_shifts")
    staged = with_shifts(staged, PROTON_TAG, "proton_shifts").withColumn("lines", lines)
    counts = F.get("lines", F.lit(3))
    staged = staged.select(
        "*", _field(counts, 1, 3).try_cast("int").alias("n_atoms"), _field(counts, 4, 3).try_cast("int").alias("n_bonds")
    )
    readable = F.col("n_atoms").isNotNull() & F.col("n_bonds").isNotNull() & (F.size("lines") >= 4 + F.col("n_atoms") + F.col("n_bonds"))
    n_atoms, n_bonds = F.when(readable, F.col("n_atoms")).otherwise(0), F.when(readable, F.col("n_bonds")).otherwise(0)
    atom_lines = F.slice("lines", F.lit(5), n_atoms)
    bonds = F.transform(
        F.slice("lines", F.lit(5) + n_atoms, n_bonds),
        lambda x: F.struct(
            (_field(x, 1, 3).try_cast("int") - 1).alias("a"),
            (_field(x, 4, 3).try_cast("int") - 1).alias("b"),
            _field(x, 7, 3).try_cast("int").alias("order"),
        ),
    )
    staged = staged.withColumns(
        {"readable": readable, "atoms": F.transform(atom_lines, lambda x: _field(x, 32, 3)), "bonds": bonds}
    )
    staged = staged.withColumn("charges", _charges(F.slice("lines", F.lit(5), F.size("atoms"))))
    staged = staged.withColumn("added", _missing_hydrogens())
    fw = F.trim(tag_value(F.col("record"), "FW")).try_cast("double")
    return staged.select(
        "source_file",
        *[c for c in records.columns if c == "record_no"],
        "record",
        F.coalesce(F.trim(tag_value(F.col("record"), "ID")), F.lit("")).alias("name"),
        fw.alias("fw"),
        "atoms",
        "charges",
        "bonds",
        "added",
        "carbon_shifts",
        "proton_shifts",
        F.when(~F.col("readable"), F.lit("unreadable atom or bond block"))
        .when(fw.isNull(), F.lit(NO_WEIGHT))
        .alias("problem"),
    )


def _charges(atom_lines: Column) -> Column:
    """Charge of every atom; ``M  CHG`` lines, where there are any, replace the codes of the atom lines."""
    stated = F.filter("lines", lambda x: x.startswith("M  CHG"))
    numbers = F.flatten(F.transform(stated, lambda x: F.slice(F.regexp_extract_all(x, F.lit(r"(-?\d+)"), F.lit(1)), 2, 1_000)))
    codes = F.array(*[F.lit(c) for c in CHARGE_CODES])
    by_code = F.transform(
        atom_lines, lambda x: F.coalesce(F.get(codes, F.coalesce(_field(x, 37, 3).try_cast("int"), F.lit(0))), F.lit(0))
    )
    # Numbers alternate: 1-based atom, charge.
    ends = F.transform(numbers, lambda x, i: F.when(i % 2 == 0, x.cast("int")))
    by_line = F.transform(
        atom_lines,
        lambda x, i: F.coalesce(F.get(numbers, F.array_position(ends, i + 1).cast("int")).cast("int"), F.lit(0)),
    )
    # array_position is 1-based, so it points at the charge behind its atom; 0 (no such atom) is caught here.
    by_line = F.transform(by_line, lambda c, i: F.when(F.array_contains(ends, i + 1), c).otherwise(0))
    return F.when(F.size(stated) > 0, by_line).otherwise(by_code)


def _missing_hydrogens() -> Column:
    """Hydrogens that each atom of a record without any hydrogen lacks; zeros where one is drawn.

    The first valence of the element that holds all bonds counts, moved by the charge.  Atoms with
    an aromatic bond (one and a half each, the sum rounded down) have their first valence only.
    Elements not listed get none.
    """
    valences = F.create_map(*[x for e in ELEMENTS for x in (F.lit(e[0]), F.array(*[F.lit(v) for v in e[1]]))])
    signs = F.create_map(*[F.lit(x) for pair in SIGN_OF_CHARGE.items() for x in pair])

    def lacking(symbol: Column, i: Column) -> Column:
        near = _neighbours(i)
        used = F.aggregate(
            near, F.lit(0.0), lambda acc, n: acc + F.when(n["order"] == AROMATIC, 1.5).otherwise(F.coalesce(n["order"], F.lit(0)))
        )
        used = F.floor(used).cast("int")
        charge = F.get("charges", i)
        shift = F.when(symbol.isin("C", "Si"), -F.abs(charge)).otherwise(charge * F.coalesce(F.try_element_at(signs, symbol), F.lit(1)))
        rooms = F.transform(F.try_element_at(valences, symbol), lambda v: v + shift)
        rooms = F.when(F.exists(near, lambda n: n["order"] == AROMATIC), F.slice(rooms, 1, 1)).otherwise(rooms)
        return F.coalesce(F.get(F.filter(rooms, lambda v: v >= used), F.lit(0)) - used, F.lit(0))

    return F.when(F.array_contains("atoms", "H"), F.transform("atoms", lambda a: F.lit(0))).otherwise(
        F.transform("atoms", lacking)
    )


def _total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0), lambda acc, n: acc + n)


def library(parsed: DataFrame) -> DataFrame:
    """Molecules with a weight, atoms completed: adds carbon_count, num_atoms and num_bonds.

    A record without any hydrogen gets them appended after the heavy atoms, atom by
    atom in order, as free valences; ``mol_block`` holds the completed record.
    """
    n_added = _total(F.col("added"))
    return parsed.filter("problem IS NULL").select(
        "source_file",
        *[c for c in parsed.columns if c == "record_no"],
        "name",
        "fw",
        F.size(F.filter("atoms", lambda a: a == "C")).alias("carbon_count"),
        (F.size("atoms") + n_added).alias("num_atoms"),
        (F.size("bonds") + n_added).alias("num_bonds"),
        _completed_block().alias("mol_block"),
    )


def _completed_block() -> Column:
    """The record with a line for every added hydrogen and its bond; unchanged where none is added.

    Counts have three digits in the format: a molecule that would pass 999 keeps its drawn record.
    """
    n_added, lines = _total(F.col("added")), F.split("record", "\n")
    n_atoms, n_bonds = F.size("atoms"), F.size("bonds")
    owners = F.flatten(F.transform("added", lambda n, i: F.array_repeat(i, n)))
    atom_lines = F.transform(owners, lambda i: F.lit("    0.0000    0.0000    0.0000 H   0  0"))
    bond_lines = F.transform(owners, lambda i, j: F.format_string("%3d%3d  1  0", i + 1, n_atoms + j + 1))
    counts = F.concat(F.format_string("%3d%3d", n_atoms + n_added, n_bonds + n_added), F.substring(F.get(lines, F.lit(3)), 7, 1_000))
    grown = F.array_join(
        F.concat(
            F.slice(lines, 1, 3),
            F.array(counts),
            F.slice(lines, F.lit(5), n_atoms),
            atom_lines,
            F.slice(lines, n_atoms + 5, n_bonds),
            bond_lines,
            F.slice(lines, n_atoms + n_bonds + 5, F.size(lines)),
        ),
        "\n",
    )
    fits = (n_added > 0) & (n_atoms + n_added <= 999) & (n_bonds + n_added <= 999)
    return F.when(fits, grown).otherwise(F.col("record"))


def _neighbours(atom: Column) -> Column:
    touching = F.filter("bonds", lambda b: (b["a"] == atom) | (b["b"] == atom))
    return F.transform(
        touching, lambda b: F.struct(F.when(b["a"] == atom, b["b"]).otherwise(b["a"]).alias("atom"), b["order"].alias("order"))
    )


def carbon_rows(parsed: DataFrame) -> DataFrame:
    """One row per carbon: name, c_index, c_shift, h_count, h_indices, h_shifts, connected_carbon."""
    index = F.sequence(F.lit(0), F.size("atoms") - 1)
    rows = parsed.filter("problem IS NULL AND size(atoms) > 0").withColumns(
        {"carbons": F.filter(index, lambda i: F.get("atoms", i) == "C"), "explicit": F.array_contains("atoms", "H")}
    )
    flat = rows.select("*", F.explode("carbons").alias("c_index")).withColumn("near", _neighbours(F.col("c_index")))
    n_added = F.get("added", F.col("c_index"))
    first = F.size("atoms") + _total(F.slice("added", F.lit(1), F.col("c_index")))
    implicit = F.when(n_added > 0, F.sequence(first, first + n_added - 1)).otherwise(F.array().cast("array<int>"))
    drawn = F.transform(F.filter("near", lambda n: F.get("atoms", n["atom"]) == "H"), lambda n: n["atom"])
    with_h = flat.withColumn("h_indices", F.when(F.col("explicit"), drawn).otherwise(implicit))
    return with_h.select(
        "source_file",
        *[c for c in parsed.columns if c == "record_no"],
        "name",
        "c_index",
        F.try_element_at("carbon_shifts", F.col("c_index")).alias("c_shift"),
        F.size("h_indices").alias("h_count"),
        "h_indices",
        F.transform("h_indices", lambda h: F.try_element_at("proton_shifts", h)).alias("h_shifts"),
        F.transform(
            F.filter("near", lambda n: F.get("atoms", n["atom"]) == "C"), lambda n: n["atom"]
        ).alias("connected_carbon"),
    )


def element_counts(parsed: DataFrame) -> DataFrame:
    """Formula (Hill order, charge at the end), average weight and exact mass of every readable record.

    Added hydrogens count.  Records are worked on one by one, so equal or missing IDs stay apart.
    A record with an element that is not listed has ``known`` false and null masses.
    """
    weights = F.create_map(*[F.lit(x) for e in ELEMENTS for x in (e[0], e[2])])
    exact = F.create_map(*[F.lit(x) for e in ELEMENTS for x in (e[0], e[3])])
    n_added = _total(F.col("added"))
    all_symbols = F.array_distinct(F.concat("atoms", F.when(n_added > 0, F.array(F.lit("H"))).otherwise(F.array().cast("array<string>"))))

    def cell(symbol: Column) -> Column:
        key = F.when(symbol == "C", F.lit(" C")).when(symbol == "H", F.lit(" H")).otherwise(symbol)
        drawn = F.size(F.filter("atoms", lambda a: a == symbol))
        return F.struct(key.alias("key"), symbol.alias("symbol"), (drawn + F.when(symbol == "H", n_added).otherwise(0)).alias("n"))

    rows = parsed.filter("problem IS NULL AND size(atoms) > 0").withColumn("_cells", F.array_sort(F.transform(all_symbols, cell)))
    charge = _total(F.col("charges"))
    sign = F.concat(F.when(charge > 0, F.lit("+")).otherwise(F.lit("-")), F.when(F.abs(charge) > 1, F.abs(charge).cast("string")).otherwise(F.lit("")))
    parts = F.transform("_cells", lambda c: F.concat(c["symbol"], F.when(c["n"] > 1, c["n"].cast("string")).otherwise(F.lit(""))))

    def mass(table: Column) -> Column:
        return F.aggregate("_cells", F.lit(0.0), lambda acc, c: acc + F.try_element_at(table, c["symbol"]) * c["n"])

    return rows.select(
        "source_file",
        *[c for c in parsed.columns if c == "record_no"],
        "name",
        F.concat(F.array_join(parts, ""), F.when(charge == 0, F.lit("")).otherwise(sign)).alias("formula"),
        F.round(mass(weights), 4).alias("weight"),
        F.round(mass(exact), 6).alias("exact_mass"),
        F.forall("_cells", lambda c: F.array_contains(F.map_keys(weights), c["symbol"])).alias("known"),
    )


def molecule_ids(parsed: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """ID field of every record, its ordinal where the field is empty."""
    return parsed.select("source_file", F.coalesce(F.nullif("name", F.lit("")), F.col(ordinal).cast("string")).alias("id"))
