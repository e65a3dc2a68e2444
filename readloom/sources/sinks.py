"""Result files: counts as TSV, audit rows as gzipped TSV with a header."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.sources.bam import FIELDS

HIDDEN = ("QUAL", "SEQ")


def counts_lines(counts: DataFrame, ragged: bool = False) -> DataFrame:
    """One text line per feature set: names joined by commas (or tabs, if ragged), a tab, and the count."""
    return counts.select(F.concat_ws("\t", F.array_join("features", "\t" if ragged else ","), F.col("score").cast("string")).alias("value"))


def write_counts(counts: DataFrame, path: str, ragged: bool = False, mode: str = "append") -> None:
    """Counts in feature order. In append mode each run adds files of its own; a reader sees one header per file."""
    rows = counts.orderBy("features").select(F.array_join("features", "\t" if ragged else ",").alias("feature"), "score")
    rows.write.mode(mode).option("sep", "\t").option("header", True).option("quote", "").csv(path)


def metadata(side: str, name: str | None = None) -> list:
    """The fields of a mate's record that the audit shows, with the mate's prefix (or another name)."""
    return [F.col(f"{side}.`{f}`").alias(f"{name or side}_{f}") for f in FIELDS if f not in HIDDEN]


def write_audit(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").option("compression", "gzip").csv(path)
