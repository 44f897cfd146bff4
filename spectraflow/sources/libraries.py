"""Spectral libraries as text: MSP and MGF. Files are split between records and parsed in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NUMBER = r"-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"
PAIR = rf"({NUMBER})[\s:,]+({NUMBER})(?::[^\s;]*|\s+\"[^\"]*\")?"


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\r?\n"), lambda line: F.trim(line)), lambda line: F.length(line) > 0)


def _peaks(lines: Column, pattern: str = PAIR) -> Column:
    text = F.array_join(lines, "\n")
    number = lambda group: F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    pair = lambda a, b: F.struct(a.cast("double").alias("mz"), b.cast("double").alias("intensity"))
    return F.zip_with(number(1), number(2), pair)


def _fields(lines: Column, separator: str) -> Column:
    """Upper-case keys to values; the first of a repeated key counts."""
    entry = lambda line: F.struct(
        F.upper(F.trim(F.substring_index(line, separator, 1))).alias("key"),
        F.trim(F.regexp_replace(line, rf"^[^{separator}]*{separator}", "")).alias("value"),
    )
    entries = F.transform(lines, entry)
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    first = lambda key: F.get(F.filter(entries, lambda e: e["key"] == key), F.lit(0))["value"]
    return F.map_from_arrays(keys, F.transform(keys, first))


def read_msp(spark: SparkSession, path: str) -> DataFrame:
    """name, precursor_mz, fields (map), peaks. ``Name:`` opens a record; records are parted by blank lines.

    ``key: value`` lines don't start with a digit; other lines hold peaks, as
    ``mz intensity`` or ``mz:intensity``, with annotations left out.
    """
    blocks = spark.read.option("lineSep", "\n\n").text(path)
    records = blocks.select(F.explode(F.split("value", r"(?im)(?=^name\s*:)")).alias("record")).where(F.col("record").rlike(r"(?i)^\s*name\s*:"))
    lines = records.select(_lines(F.col("record")).alias("lines"))
    numeric = lambda line: line.rlike(r"^[-0-9.]")
    parts = lines.select(
        _fields(F.filter("lines", lambda line: ~numeric(line) & line.contains(":")), ":").alias("fields"),
        _peaks(F.filter("lines", numeric)).alias("peaks"),
    )
    mass = F.coalesce(*[F.element_at("fields", k).try_cast("double") for k in ("PRECURSORMZ", "PRECURSOR_MZ", "EXACTMASS", "MW")])
    return parts.select(F.element_at("fields", "NAME").alias("name"), mass.alias("precursor_mz"), "fields", "peaks")


def read_mgf(spark: SparkSession, path: str) -> DataFrame:
    """title, precursor_mz, precursor_intensity, charge, fields (map), peaks of each BEGIN IONS block; malformed peak lines are skipped."""
    blocks = spark.read.option("lineSep", "BEGIN IONS").text(path).where(F.col("value").contains("END IONS"))
    lines = blocks.select(_lines(F.substring_index("value", "END IONS", 1)).alias("lines"))
    pair = rf"(?m)^({NUMBER})\s+({NUMBER})(?:\s.*)?$"
    parts = lines.select(
        _fields(F.filter("lines", lambda line: line.contains("=")), "=").alias("fields"),
        _peaks(F.filter("lines", lambda line: ~line.contains("=")), pair).alias("peaks"),
    )
    mass = F.split(F.element_at("fields", "PEPMASS"), r"\s+")
    return parts.select(
        F.element_at("fields", "TITLE").alias("title"), F.get(mass, F.lit(0)).try_cast("double").alias("precursor_mz"),
        F.get(mass, F.lit(1)).try_cast("double").alias("precursor_intensity"), F.regexp_extract(F.element_at("fields", "CHARGE"), "[0-9]+", 0).try_cast("int").alias("charge"),
        "fields", "peaks",
    )


def write_msp(records: DataFrame, path: str) -> None:
    """Write name and peaks, four decimals each, one record a row."""
    peaks = F.transform("peaks", lambda p: F.format_string("%.4f %.4f", p["mz"].cast("double"), p["intensity"].cast("double")))
    text = F.concat_ws("\n", F.concat(F.lit("Name: "), F.coalesce("name", F.lit(""))), F.concat(F.lit("Num Peaks: "), F.size("peaks").cast("string")), F.array_join(peaks, "\n"), F.lit(""))
    records.select(text.alias("value")).write.text(path)
