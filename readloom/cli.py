"""Command line: ``spark-submit --py-files ... readloom/cli.py -r LIBRARY -o OUT -i READS [READS]``."""

from __future__ import annotations

import argparse
from dataclasses import replace

from readloom.plans.config import CHEMISTRIES, trim_overrides
from readloom.plans.jobs import run
from readloom.sources.library import load_library


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description="Assign sequencing reads to the features of sequence libraries and count them.")
    p.add_argument("-r", "--reference", action="append", required=True, help="library file; may be given several times")
    p.add_argument("-o", "--output", action="append", required=True, help="output folder, one per library")
    p.add_argument("-i", "--input", nargs="+", required=True, help="one or two .fastq(.gz) files, or one .bam file")
    p.add_argument("-c", "--cores", type=int, default=1, help="local cores, where no master is configured")
    p.add_argument("-f", "--strand_filter", choices=CHEMISTRIES, default="unstranded")
    p.add_argument("-t", "--trim", help="length:strictness per library, separated by commas")
    p.add_argument("-p", "--force_bam_paired", action="store_true", help="skip unpaired BAM records")
    p.add_argument("--compat", action="store_true", help="reproduce odd behaviour of existing outputs (see Config.compat)")
    return p


def main(args: list[str] | None = None, spark=None) -> None:
    from pyspark import SparkConf
    from pyspark.sql import SparkSession

    a = parser().parse_args(args)
    if spark is None:
        builder = SparkSession.builder.appName("readloom")
        spark = (builder if SparkConf().contains("spark.master") else builder.master(f"local[{a.cores}]")).getOrCreate()
    loaded = [load_library(spark, path, a.strand_filter) for path in a.reference]
    configs = [replace(c, compat=a.compat) for c, _ in loaded]
    if a.trim:
        configs = trim_overrides(a.trim, configs)
    run(spark, [(c, lib) for c, (_, lib) in zip(configs, loaded)], a.input, a.output, a.force_bam_paired)


if __name__ == "__main__":
    main()
