"""Pairing reads and grouping them by molecule: file order comes as a column, never from the order of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.functions import seq

POLY_A = "A" * 10


def mate_join(r1: DataFrame, r2: DataFrame) -> DataFrame:
    """(record_no, r1, r2) of two files' reads by position. A second file that is shorter is an error; what it has beyond the first is ignored."""
    both = r1.select("record_no", F.col("seq").alias("r1")).join(r2.select("record_no", F.col("seq").alias("r2")), "record_no", "left")
    return both.select("record_no", "r1", F.when(F.col("r2").isNull(), F.raise_error(F.lit("the second file has fewer reads than the first"))).otherwise(F.col("r2")).alias("r2"))


def umi_filters(records: DataFrame, paired_only: bool = False) -> DataFrame:
    """Records with a cell barcode whose UMI isn't a run of A; only paired ones if asked."""
    rows = records.where(F.col("cb").isNotNull() & (F.coalesce(F.col("umi"), F.lit("")) != POLY_A))
    return rows.where("paired") if paired_only else rows


def umi_groups(records: DataFrame) -> DataFrame:
    """Number the runs of records that follow each other, by file_pos within their file, with equal (umi, cell): adds grp.

    Runs are numbered within a file, each from the position of its first record, so the order needs no single task
    beyond that of a file.
    """
    w = Window.partitionBy("file").orderBy("file_pos")
    same = F.lag("umi").over(w).eqNullSafe(F.col("umi")) & F.lag("cell").over(w).eqNullSafe(F.col("cell"))
    rows = records.withColumn("new", ~same | F.lag("file_pos").over(w).isNull())
    return rows.withColumn("grp", F.last(F.when(F.col("new"), F.col("file_pos")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new")


def dummy_mates(records: DataFrame) -> DataFrame:
    """An unpaired record gets a second copy that is flagged to be skipped."""
    return records.withColumn("skip", F.explode(F.when(F.col("paired"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))))


def pair_by_name(records: DataFrame, *carry: str) -> DataFrame:
    """(file, umi, cell, qname, pos1, pos2) of records that share a name within a molecule of a file and follow each other; the first in template is mate 1.

    In a molecule, by file position (and a read before its dummy), each record pairs with the next one if that has its name and it is not
    the second of a pair already; other records are dropped. Columns to carry come as one for each mate, numbered.
    """
    keys, order = ["file", "umi", "cell"], ["file_pos", *(["skip"] if "skip" in records.columns else [])]
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = records.withColumn("n", F.row_number().over(w)).withColumn("prev", F.lag("qname").over(w))
    rows = rows.withColumn("start", F.last(F.when(~F.col("qname").eqNullSafe(F.col("prev")), F.col("n")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("k", F.floor((F.col("n") - F.coalesce("start", F.lit(1))) / 2))
    one = F.struct((~F.col("first")).cast("int").alias("o"), F.col("file_pos").alias("pos"), *carry)
    two = rows.groupBy(*keys, "qname", "start", "k").agg(F.count("*").alias("c"), F.min(one).alias("a"), F.max(one).alias("b")).where("c = 2")
    return two.select(*keys, "qname", *[F.col(f"{side}.{c}").alias(f"{c}{n}") for c in ("pos", *carry) for n, side in ((1, "a"), (2, "b"))])


def umi_counts(calls: DataFrame) -> DataFrame:
    """(library, umi, cell, features, score): distinct read keys per feature set and molecule."""
    return calls.groupBy("library", "umi", "cell", "features").agg(F.countDistinct("read_key").alias("score"))


def unscored(pairs: DataFrame, scored: DataFrame) -> DataFrame:
    """Pairs whose name isn't among the scored ones of their molecule, with no features and score 0; molecules without any call have none."""
    keys = [c for c in ("file", "umi", "cell") if c in scored.columns]
    rest = pairs.join(scored.select(*keys, "qname").distinct(), [*keys, "qname"], "left_anti").join(scored.select(*keys).distinct(), keys, "left_semi")
    return rest.withColumn("features", F.lit("")).withColumn("score", F.lit(0).cast("long"))


def audit_join(rows: DataFrame, audit: DataFrame) -> DataFrame:
    """Rows with their read's reasons; reads without any get ``None`` and 0."""
    kept = rows.join(audit, ["umi", "cell", "read_key"], "left")
    return kept.withColumns({"reason": F.coalesce("reason", F.lit("None")), "reason_score": F.coalesce("reason_score", F.lit(0))})


def last_reason(events: DataFrame) -> DataFrame:
    """(read_key, reason, score): the last write per read key wins, by seq_no."""
    return events.groupBy("read_key").agg(F.max_by(F.struct("reason", "score"), F.struct("seq_no", "reason", "score")).alias("x")).select("read_key", "x.reason", "x.score")


def with_umi(records: DataFrame) -> DataFrame:
    """Adds umi (corrected, else raw) and cell (barcode without its suffix) from the tags ub, ur and cb."""
    return records.withColumn("umi", seq.umi_choice(F.col("ub"), F.col("ur"))).withColumn("cell", seq.cell_barcode(F.col("cb")))
