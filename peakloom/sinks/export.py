"""Writers: cluster and peak tables, summaries, journal text, structure files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakloom.functions import scoring
from peakloom.sources import sdf


def write_csv(df: DataFrame, path: str, quote_all: bool = False) -> None:
    """Table with a header; tasks write their own part files."""
    df.write.mode("overwrite").option("header", True).option("quoteAll", quote_all).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_table(df: DataFrame, path: str) -> None:
    """Replace a result table."""
    df.write.mode("overwrite").parquet(path)


def write_samples(df: DataFrame, path: str) -> None:
    """Corrected peaks, one folder per sample."""
    df.write.mode("overwrite").option("header", True).partitionBy("sample").csv(path)


def union_columns(first: DataFrame, second: DataFrame) -> DataFrame:
    return first.unionByName(second, allowMissingColumns=True)


def upsert(current: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``changes`` replace the rows of ``current`` with the same key."""
    return current.join(changes.select(*keys), keys, "left_anti").unionByName(changes)


def _decimals(value: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", scoring.half_up(value, digits))


def carbon_text(carbons: DataFrame, prefix: str = "C-") -> DataFrame:
    """Per molecule the 13C list sorted by shift: value (1 decimal), label, multiplicity."""
    part = F.concat(
        _decimals(F.col("observed"), 1), F.lit(f" ({prefix}"), "label", F.lit(", "), scoring.multiplicity(F.col("h_count")), F.lit(")")
    )
    rows = F.array_sort(F.collect_list(F.struct("observed", F.col("atom_id"), part.alias("text"))))
    return (
        carbons.filter("observed IS NOT NULL")
        .groupBy("mol_id")
        .agg(F.array_join(F.transform(rows, lambda r: r["text"]), ", ").alias("carbon_text"))
    )


def proton_text(groups: DataFrame, prefix: str = "H-") -> DataFrame:
    """Per molecule the 1H list sorted by shift: value (2 decimals), hydrogen count, label."""
    part = F.concat(
        _decimals(F.col("observed"), 2), F.lit(" ("), F.col("n_h").cast("string"), F.lit(f"H, {prefix}"), "label", "suffix", F.lit(")")
    )
    rows = F.array_sort(F.collect_list(F.struct("observed", "atom_id", "suffix", part.alias("text"))))
    return (
        groups.filter("observed IS NOT NULL")
        .groupBy("mol_id")
        .agg(F.array_join(F.transform(rows, lambda r: r["text"]), ", ").alias("proton_text"))
    )


def journal_text(molecules: DataFrame, carbons: DataFrame, protons: DataFrame, c_mhz: str, h_mhz: str, solvent: str) -> DataFrame:
    """Report line of each molecule (mol_id, formula, exact_mass) with its 1H and 13C lists."""
    h_part = F.concat(F.lit(f"1H-NMR({h_mhz}MHz, {solvent}) δH: "), F.col("proton_text"))
    c_part = F.concat(F.lit(f"13C-NMR({c_mhz}MHz, {solvent}) δC: "), F.col("carbon_text"))
    sections = F.concat_ws("; ", h_part, c_part)
    body = F.when(sections == "", F.lit("No assigned NMR shifts.")).otherwise(F.concat(sections, F.lit(".")))
    mass = F.coalesce(F.format_string("%.4f", "exact_mass"), F.lit("not available"))
    head = F.concat(F.coalesce("formula", F.lit("Formula not available")), F.lit(", calculated m/z: "), mass, F.lit(", "))
    joined = molecules.join(protons, "mol_id", "left").join(carbons, "mol_id", "left")
    return joined.select("mol_id", F.concat(head, body).alias("report"))


# Shift lines look like ``12[5]  77.10``, or ``5  77.10`` in the typed fields.
BRACKET_LINE = r"^(.*\[(\d+)\]\s+)[-+]?\d+(?:\.\d+)?(.*)$"
TYPED_LINE = r"^(\s*(\d+)\s+)[-+]?\d+(?:\.\d+)?(.*)$"


TYPED_FIELDS = ("Quaternaries", "Tertiaries", "Secondaries", "Primaries")


def _rewrite(line: Column, values: Column, pattern: str) -> Column:
    """The line with the new shift of its atom; ``values`` is map<1-based atom as string, shift>."""
    new = F.try_element_at(values, F.regexp_extract(line, pattern, 2))
    changed = F.concat(F.regexp_extract(line, pattern, 1), _decimals(new, 2), F.regexp_extract(line, pattern, 3))
    return F.when(new.isNull(), line).otherwise(changed)


def assigned_records(records: DataFrame) -> DataFrame:
    """Records with the assigned shifts (carbon_values, proton_values) in all their fields.

    One pass over the lines of a record, remembering the field a line belongs to.
    """
    carbon, proton = F.col("carbon_values"), F.col("proton_values")
    kind = "struct<tag:string,lines:array<string>>"

    def step(state: Column, line: Column) -> Column:
        header = line.startswith(">")
        tag = F.when(header, F.regexp_extract(line, "<([^>]*)>", 1)).otherwise(state["tag"])
        body = (
            F.when(header, line)
            .when(state["tag"] == sdf.CARBON_TAG, _rewrite(line, carbon, BRACKET_LINE))
            .when(state["tag"] == sdf.PROTON_TAG, _rewrite(line, proton, BRACKET_LINE))
            .when(state["tag"].isin(*TYPED_FIELDS), _rewrite(line, carbon, TYPED_LINE))
            .otherwise(line)
        )
        return F.struct(tag.alias("tag"), F.array_append(state["lines"], body).alias("lines")).cast(kind)

    start = F.struct(F.lit("").alias("tag"), F.array().cast("array<string>").alias("lines")).cast(kind)
    done = F.aggregate(F.split("record", "\n"), start, step, lambda state: F.array_join(state["lines"], "\n"))
    return records.withColumn("record", done)


def set_field(record: Column, tag: str, value: Column) -> Column:
    """Append a data field to a record."""
    return F.concat(F.rtrim(record), F.lit(f"\n> <{tag}>\n"), value, F.lit("\n\n"))


def annotate(records: DataFrame, ordinal: str, weight: str) -> DataFrame:
    """Number the records and store their average weight (4 decimals)."""
    numbered = set_field(F.col("record"), "ID", F.col(ordinal).cast("string"))
    return records.withColumn("record", set_field(numbered, "FW", F.format_string("%.4f", weight)))


def write_records(records: DataFrame, path: str) -> None:
    """Structure records as text files."""
    text = F.concat(F.rtrim("record"), F.lit(f"\n\n{sdf.SEPARATOR}"))
    records.select(text.alias("value")).write.mode("overwrite").text(path)


def molecule_block(name: Column, atoms: Column, bonds: Column) -> Column:
    """V2000 block from symbols and bonds (0-based ends), without coordinates."""
    atom_lines = F.transform(atoms, lambda a: F.concat(F.lit("    0.0000    0.0000    0.0000 "), F.rpad(a, 3, " "), F.lit(" 0  0")))
    bond_lines = F.transform(bonds, lambda b: F.format_string("%3d%3d%3d  0", b["a"] + 1, b["b"] + 1, b["order"]))
    counts = F.format_string("%3d%3d  0  0  0  0  0  0  0  0999 V2000", F.size(atoms), F.size(bonds))
    return F.array_join(
        F.concat(F.array(name, F.lit(""), F.lit(""), counts), atom_lines, bond_lines, F.array(F.lit("M  END"))), "\n"
    )
