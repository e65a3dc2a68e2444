"""FASTQ through Spark's text reader: any file system and codec, plain files split by blocks. Files whose content isn't what their name says come as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readloom.sources.files import file_system


GZIP, BATCH = b"\x1f\x8b", 1 << 16


def _sorted_out(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """Files that Spark's reader takes as they are, and those that are gzipped without being named so, or the other way round."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(conf)
    named = [x for x in (system.globStatus(where) or [])]
    files = [y for x in named for y in (system.listStatus(x.getPath()) if x.isDirectory() else [x]) if not y.isDirectory() and y.getPath().getName()[0] not in "._"]
    sound, odd = [], []
    for x in files:
        stream = system.open(x.getPath())
        head = bytes(b & 255 for b in (stream.read(), stream.read()))
        stream.close()
        (sound if (head == GZIP) == x.getPath().getName().endswith(".gz") or not x.getLen() else odd).append(x.getPath().toString())
    return sound, odd


def _streamed(batches):
    """(file, line, value) of the lines of files, gzipped or not by their content; a file is one stream."""
    import gzip
    import io
    from itertools import islice

    import pyarrow as pa

    for b in batches:
        for name in b.column(0).to_pylist():
            system, base = file_system(name)
            with system.open_input_file(base) as f:
                packed = f.read(2) == GZIP
                f.seek(0)
                lines, n = io.TextIOWrapper(gzip.GzipFile(fileobj=f) if packed else f, "utf-8", "replace"), 0
                while part := [x.rstrip("\n") for x in islice(lines, BATCH)]:
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(range(n, n + len(part)), pa.int64()), pa.array(part)], names=["file", "line", "value"])
                    n += len(part)


def _numbered(spark: SparkSession, files: list[str]) -> DataFrame:
    """(file, line, value) through Spark's reader. Lines are numbered in two steps: within the block that a task reads, then by the lines of the blocks before it."""
    lines = spark.read.text(files).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    blocks = lines.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")
    blocks = blocks.select("file", "block", (before - F.col("first")).alias("shift"))
    return lines.join(blocks, ["file", "block"]).select("file", (F.col("id") + F.col("shift")).alias("line"), "value")


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(file, record_no, name, seq, qual), record_no from 0 within a file. A record without @ and + lines is an error; an empty file gives no rows.

    Gzipped files are told by their content, whatever their name.
    """
    sound, odd = _sorted_out(spark, path)
    rows = _numbered(spark, sound or [path]) if sound or not odd else None
    if odd:
        files = spark.createDataFrame([(x,) for x in odd], "file string").repartition(len(odd), "file")
        streamed = files.mapInArrow(_streamed, "file string, line long, value string")
        rows = streamed if rows is None else rows.unionByName(streamed)
    rows = rows.groupBy("file", F.floor(F.col("line") / 4).alias("record_no")).agg(*[F.max(F.when(F.col("line") % 4 == k, F.col("value"))).alias(c) for k, c in enumerate(("name", "seq", "plus", "qual"))])
    sound = F.coalesce(F.startswith("name", F.lit("@")) & F.startswith("plus", F.lit("+")) & F.col("seq").isNotNull(), F.lit(False))
    name = F.when(sound, F.expr("substring(name, 2)")).otherwise(F.raise_error(F.concat(F.lit("bad FASTQ record "), F.col("record_no").cast("string"))))
    return rows.select("file", "record_no", name.alias("name"), "seq", F.coalesce("qual", F.lit("")).alias("qual"))


def read_pairs(spark: SparkSession, path: str, mate_path: str | None = None) -> DataFrame:
    """(pair_id, r1, r2) of one FASTQ file, or of two by position; r2 is null for one file."""
    from readloom.operators.pairs import mate_join

    one = read_fastq(spark, path)
    if mate_path is None:
        return one.select(F.col("record_no").alias("pair_id"), F.col("seq").alias("r1"), F.lit(None).cast("string").alias("r2"))
    return mate_join(one, read_fastq(spark, mate_path)).withColumnRenamed("record_no", "pair_id")
