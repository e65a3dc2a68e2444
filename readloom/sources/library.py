"""Library files: JSON with settings and a column-wise table of named sequences."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions import seq
from readloom.plans.config import Config, from_json

SCHEMA = "row long, feature string, grp string, sequence string, attrs map<string,string>"
#: Bytes of a library file; it is parsed on the driver.
MAX_BYTES = 1 << 28


def column_index(headers: list[str], name: str) -> int | None:
    """The first header of that name."""
    return headers.index(name) if name in headers else None


def strings(values, label: str) -> list[str]:
    if not isinstance(values, list) or not all(isinstance(v, str) for v in values):
        raise ValueError(f"{label} must be a list of strings")
    return values


def parse(text: str, chemistry: str = "none") -> tuple[Config, list[tuple]]:
    """Settings and rows (row, feature, group, sequence, attributes). U becomes T in sequences; names must be unique."""
    try:
        parts = json.loads(text)
    except ValueError as e:
        raise ValueError(f"the library isn't valid JSON: {e}") from e
    if not isinstance(parts, list) or len(parts) < 2:
        raise ValueError("a library is a list of its settings and its table")
    config, table = from_json(parts[0], chemistry), parts[1]
    headers = strings(table.get("headers"), "headers")
    columns = [strings(c, f"column {k}") for k, c in enumerate(table.get("columns") or [])]
    name, sequence = column_index(headers, "sequence_name"), column_index(headers, "sequence")
    if name is None or sequence is None:
        raise ValueError("a library needs the columns sequence_name and sequence")
    group = column_index(headers, config.group_on) if config.group_on else name
    if group is None:
        raise ValueError(f"there is no column {config.group_on} to group on")
    if len(columns) != len(headers) or len({len(c) for c in columns}) > 1:
        raise ValueError("the library's columns differ in number or length")
    if len(set(columns[name])) < len(columns[name]):
        raise ValueError("sequence names must be unique")
    by_sequence = config.group_on == "nt_sequence"  # groups are then not rolled up
    rows = []
    for k, cells in enumerate(zip(*columns)):
        dna = cells[sequence].translate(str.maketrans("Uu", "Tt"))
        if set(dna) - set("ACGTNacgtn"):
            raise ValueError(f"the sequence of {cells[name]} holds letters that aren't bases")
        rows.append((k, cells[name], cells[name] if by_sequence else cells[group], dna, dict(zip(headers, cells))))
    return config, rows


def load_library(spark: SparkSession, path: str, chemistry: str = "none") -> tuple[Config, DataFrame]:
    """Read a library through Spark's file systems. Returns its settings and its expanded table."""
    text = spark.read.text(path, wholetext=True).where(F.length("value") <= MAX_BYTES).first()
    if text is None:
        raise ValueError(f"{path} is empty or larger than {MAX_BYTES} bytes")
    config, rows = parse(text[0], chemistry)
    return config, expand(spark.createDataFrame(rows, SCHEMA))


def expand(library: DataFrame) -> DataFrame:
    """Each row and then its reverse complement: ref_idx is twice the row number, and one more for the reverse."""
    both = F.explode(F.array(F.lit(False), F.lit(True))).alias("is_rev")
    rows = library.select("row", "feature", F.coalesce(F.nullif("grp", F.lit("")), "feature").alias("grp"), F.upper("sequence").alias("dna"), both)
    return rows.select((F.col("row") * 2 + F.col("is_rev").cast("long")).alias("ref_idx"), "feature", "is_rev", "grp", F.when(F.col("is_rev"), seq.revcomp(F.col("dna"))).otherwise(F.col("dna")).alias("sequence"))
