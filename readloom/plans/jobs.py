"""Batch jobs: read files and libraries in, counts and audits out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.operators import align, counts, pairs
from readloom.plans import scratch
from readloom.plans.config import Config
from readloom.sources import bam, fastq, sinks


def file_kind(path: str) -> str:
    """fastq or bam, by the file's extension (.fastq, .fastq.gz or .bam, in lower case)."""
    if path.endswith((".fastq", ".fastq.gz")):
        return "fastq"
    if path.endswith(".bam"):
        return "bam"
    raise ValueError(f"{path} is neither a .fastq, a .fastq.gz nor a .bam file")


def bam_records(rows: DataFrame, force_paired: bool = False) -> DataFrame:
    """Alignments as records with umi, cell, reverse, paired, first and last; without cell barcode, with a UMI of ten A or (if forced) unpaired ones go."""
    flag = lambda n: F.col("flag").bitwiseAND(n) != 0
    named = rows.select("file", "file_pos", "qname", flag(1).alias("paired"), flag(16).alias("reverse"), flag(64).alias("first"), flag(128).alias("last"), "seq", "quality", F.col("tags")["CB"].alias("cb"), F.col("tags")["UB"].alias("ub"), F.col("tags")["UR"].alias("ur")).where("cb IS NOT NULL")
    return pairs.umi_filters(pairs.with_umi(named), force_paired)


def bam_pairs(records: DataFrame, cfg: Config) -> DataFrame:
    """(pair_id, file, umi, cell, qname, pos1, pos2, r1, r2, raw1, raw2, skip1, skip2) of records, trimmed and read along their strand.

    Mates share a name in a molecule of a file and follow each other; an unpaired record gets a dummy mate, a copy that isn't aligned, and is mate 1
    unless it is flagged as the last (with compat: mate 2 unless it is flagged as the first). raw1 and raw2 are the untrimmed reads, by which equal pairs
    meet; a pair's id is its file and its first position there.
    """
    own = F.col("first") if cfg.compat else ~F.col("last")
    rows = pairs.dummy_mates(records).withColumn("first", F.when(F.col("paired"), F.col("first")).otherwise(own != F.col("skip")))
    found = pairs.pair_by_name(counts.trim_pairs(rows, cfg), "seq", "raw", "skip")
    return found.withColumn("pair_id", F.struct("file", F.least("pos1", "pos2").alias("pos"))).withColumnsRenamed({"seq1": "r1", "seq2": "r2"})


#: Columns of the result that tell what became of a pair.
AUDIT = ("r1_filter_forward", "r1_forward_score", "r1_filter_reverse", "r1_reverse_score", "r2_filter_forward", "r2_forward_score", "r2_filter_reverse", "r2_reverse_score", "triage_reason", "aligndirection")


def molecule_rows(found: DataFrame, library: DataFrame, cfg: Config) -> DataFrame:
    """A row per feature set of a molecule, and score-0 rows for its pairs that represent none: file, umi, cell, features, score, qname, pos1, pos2, skip1, skip2 and AUDIT.

    Pairs of a molecule with equal untrimmed reads count once, as the last of them; the last pair stands for its feature set; molecules without a call
    have no rows. Only the library as it is, with both strands, is aligned to, so the columns of the reverse pass and the direction are empty.
    """
    molecule, shown = ["file", "umi", "cell"], ("qname", "pos1", "pos2", "skip1", "skip2")
    last = found.groupBy(*molecule, "raw1", "raw2").agg(F.max(F.struct("pair_id", *shown, "r1", "r2")).alias("x")).select(*molecule, "raw1", "raw2", "x.*")
    traced = counts.trace(last.select("pair_id", "r1", "r2", "skip1", "skip2"), library, cfg)
    none = F.lit("None")
    reasons = {f"r{m}_{c}": v for m in (1, 2) for c, v in (("filter_forward", F.coalesce(F.col(f"r{m}.reason"), none)), ("forward_score", F.coalesce(F.col(f"r{m}.shown"), F.lit(0))), ("filter_reverse", none), ("reverse_score", F.lit(0)))}
    reasons |= {"triage_reason": F.when(F.col("triage") == align.MATCH, none).otherwise(F.coalesce("triage", none)), "aligndirection": none}
    audited = last.drop("r1", "r2").join(traced.select("pair_id", F.when(F.col("triage") == align.MATCH, F.array_join("features", ",")).alias("features"), *[reasons[c].alias(c) for c in AUDIT]), "pair_id")
    scored = audited.where("features IS NOT NULL").groupBy(*molecule, "features").agg(F.count("*").alias("score"), F.max(F.struct("pair_id", *shown, *AUDIT)).alias("x")).select(*molecule, "features", "score", "x.*")
    rest = found.select(*molecule, "raw1", "raw2", *shown).join(audited.select(*molecule, "raw1", "raw2", *AUDIT), [*molecule, "raw1", "raw2"])
    columns = [*molecule, "features", "score", *shown, *AUDIT]
    return scored.select(*columns).unionByName(pairs.unscored(rest, scored).select(*columns))


def bam_result(rows: DataFrame, library: DataFrame, cfg: Config, force_paired: bool = False) -> DataFrame:
    """The result of alignments: features and score of each molecule row, the fields of both mates' records, and AUDIT (with compat: mates swapped)."""
    found = molecule_rows(bam_pairs(bam_records(rows, force_paired), cfg), library, cfg)
    fields = bam.project(rows, cfg.compat)
    for m in (1, 2):
        mate = fields.select("file", F.col("file_pos").alias(f"pos{m}"), F.struct(*[f for f in bam.FIELDS if f != "SKIP_ALIGN"]).alias(f"r{m}"))
        found = found.join(mate, ["file", f"pos{m}"]).withColumn(f"r{m}", F.col(f"r{m}").withField("SKIP_ALIGN", F.upper(F.col(f"skip{m}").cast("string"))))
    one, two = ("r2", "r1") if cfg.compat else ("r1", "r2")
    audit = [F.col(c.replace("r1_", f"{one}_") if c.startswith("r1_") else c.replace("r2_", f"{two}_")).alias(c) for c in AUDIT]
    return found.select("features", "score", *sinks.metadata(one, "r1"), *sinks.metadata(two, "r2"), *audit)


def run(spark: SparkSession, libraries: list[tuple[Config, DataFrame]], inputs: list[str], outputs: list[str], force_paired: bool = False) -> None:
    """One output folder per library: counts for FASTQ input (one file, or two with mates), molecule rows for BAM input. Files are read once for all libraries."""
    if len(libraries) != len(outputs):
        raise ValueError(f"{len(outputs)} outputs for {len(libraries)} libraries")
    kind = file_kind(inputs[0])
    if kind == "fastq":
        for found, out in zip(counts.counts_by_library(fastq.read_pairs(spark, *inputs[:2]), libraries), outputs):
            sinks.write_counts(found, out)
        return
    reads = scratch.hold(bam.read_bam(spark, inputs[0]).where(F.col("tags")["CB"].isNotNull()), "alignments")
    for (cfg, library), out in zip(libraries, outputs):
        sinks.write_audit(bam_result(reads, library, cfg, force_paired), out)
